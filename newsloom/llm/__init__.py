"""Training-data operators: scans, deduplication, archives, counts, mixing and sharding of document tables."""
