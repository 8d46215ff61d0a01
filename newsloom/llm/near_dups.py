"""Operator 10: near-duplicate documents by bottom-k sketches from one hash function.

1. Each document's set of distinct word shingles is hashed once; equal sets become one node (a node may stand for any
   number of copies, which are never expanded into pairs).
2. The node's sketch is the k least hashes. Inverted lists of retained values join nodes: up to SMALL shingles a list
   for each of the least n - ceil(t n) + 1 values (a prefix filter, which loses nothing), from LARGE shingles a list for
   each run of three consecutive retained values. At a similarity of 0.8 two sets lack a common run with a chance of
   about 3e-8, and a passage that thousands of unrelated documents share fills few lists.
3. Round one compares neighbours in a node's first lists, in an order that differs from list to list, so a group of
   near copies gets a sparse set of pairs instead of all of them. A sketch estimate filters; by it, each list's hub is
   the node that is most like its neighbours, and all nodes of a list are compared with its hub. The exact Jaccard on full
   sets verifies, and components are formed. In a group of near copies most links meet a hub, so most of it is joined here.
4. Round two is complete: of nodes in lists that still hold several components, an exact prefix filter with rare shingles
   first finds every pair from different components that can reach the threshold, in blocks of bounded size; estimate
   and exact Jaccard follow. Pairs inside one component can't change the result: the members of a shingle's largest
   component meet only the nodes outside of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored
from newsloom.llm import textnum as T
from newsloom.llm.names import unused
from newsloom.operators.graph import connected_components

K = 48  # retained values
SMALL, LARGE = 125, 100  # shingles: single-value lists up to SMALL, run lists from LARGE; LARGE <= 0.8 * SMALL
FIRST = 10  # of a node's lists, those in which round one compares neighbours
LIST = 1000  # nodes of a list that one task orders; a longer list is dealt by node into as many parts as it needs
BLOCK = 500  # nodes that share a shingle and are joined with as many others at once
HEAVY, BITS = 3, 20  # times in a batch from which a shingle counts as frequent; 2**BITS buckets of shingles
MISS = 1e-9  # chance, at most, that the estimate drops a pair whose similarity is exactly the threshold


def _sets(h: np.ndarray, first: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    runs = T.windows(h, shingle)
    for a, b in zip(first[:-1], first[1:], strict=True):
        n = b - a
        if n >= shingle:
            x = np.sort(runs[a : b - shingle + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x
        elif n > 0:
            yield T.mix(T.windows(h[a:b], n) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sketcher(shingle: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, buf, off in T.slices(batch.column(1)):
                h, _, _, first = T.words(buf, off, T.NON_SPACE, lower=True)
                n, s1, s2, keep = [], [], [], []
                for x in _sets(h, first, shingle):
                    n.append(len(x))
                    m = T.mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                    s1.append(m.sum(dtype=np.uint64))
                    s2.append(T.mix(m + np.uint64(1)).sum(dtype=np.uint64))
                    keep.append(x if full else x[:K])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(n)).cast(pa.int64()), pa.array(n, pa.int64()),
                        *(pa.array(np.array(s, np.uint64).view(np.int64)) for s in (s1, s2)), _lists(keep)
                    ],
                    names=["doc_id", "n_shingles", "s1", "s2", "hashes"],
                )

    return run


def _hashed(docs: DataFrame, shingle: int, full: bool = False) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_sketcher(shingle, full), "doc_id long, n_shingles long, s1 long, s2 long, hashes array<long>")


def _keys(threshold: float) -> Column:
    """The keys of a node's lists; see the module's text."""
    prefix = (F.col("n_shingles") - F.ceil(F.col("n_shingles") * threshold) + 1).cast("int")
    single = F.slice("sketch", 1, F.least(prefix, F.lit(K)))
    runs = F.transform(F.sequence(F.lit(0), F.size("sketch") - 3), lambda i: F.xxhash64(*(F.get(F.col("sketch"), i + k) for k in range(3))))
    none = F.array().cast("array<long>")
    return F.concat(F.when(F.col("n_shingles") <= SMALL, single).otherwise(none), F.when(F.col("n_shingles") >= LARGE, runs).otherwise(none))


def _fits(a: str, b: str, pct: int) -> Column:
    """Sets of these sizes can reach the threshold."""
    return 100 * F.least(a, b) >= pct * F.greatest(a, b)


def _linked(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Of the pairs (a, b), those with an exact Jaccard similarity of pct per cent or more."""
    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), "b")
    both = two.withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.filter(100 * F.col("common") >= pct * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")


def _brief() -> Column:
    """The sketch's upper 32 bits, which serve for estimates, shifted so that signed order is the hashes' order."""
    return F.transform("sketch", lambda x: (F.shiftrightunsigned(x, 32) - (1 << 31)).cast("int"))


def _cut(pct: int) -> int:
    """The most common values among K of a union to ask for, so that a pair at pct per cent has fewer with a chance of MISS at most."""
    p, tail = pct / 100, 0.0
    for c in range(K + 1):
        tail += comb(K, c) * p**c * (1 - p) ** (K - c)
        if tail > MISS:
            return c
    return K


def _sampled(a: str, b: str) -> tuple[Column, Column]:
    """(values of the union's sample, those in common); a, b: suffixes of the two nodes' columns.

    The K least values of both sketches are a sample of the union, whatever the sizes of the two sets: each is common
    with the chance that is their similarity. A union of fewer values is whole, but for equal upper bits.
    """
    union = F.sort_array(F.array_union(f"brief_{a}", f"brief_{b}"))
    common = F.array_intersect(f"brief_{a}", f"brief_{b}")
    return F.least(F.size(union), F.lit(K)), F.size(F.array_intersect(common, F.slice(union, 1, K)))


def _rated(pairs: DataFrame, brief: DataFrame, pct: int) -> DataFrame:
    """(a, b, likeness) of the pairs (a, b) whose sketches have enough values in common for the threshold."""
    both = pairs.join(brief.toDF("a", "n_a", "brief_a"), "a").join(brief.toDF("b", "n_b", "brief_b"), "b")
    of, common = _sampled("a", "b")
    both = both.select("a", "b", of.alias("of"), common.alias("common"))
    passes = F.when(F.col("of") < K, 100 * (F.col("common") + 2) >= pct * F.col("of")).otherwise(F.col("common") >= _cut(pct))
    return both.filter(passes).select("a", "b", (F.col("common") / F.col("of")).alias("likeness"))


def _lists_of(nodes: DataFrame, pct: int) -> DataFrame:
    """(node, n_shingles, at, key, part, long): the entries of all lists; one of more than LIST nodes is long and comes in parts."""
    entries = nodes.select("node", "n_shingles", F.posexplode(_keys(pct / 100)).alias("at", "key"))
    # counted in each task first; written down, so that Spark knows how small this table is and whether to broadcast it
    long = stored(entries.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > LIST), "near-long")
    dealt = F.pmod(F.xxhash64("node", "key"), F.ceil(F.coalesce("m", F.lit(1)) / LIST)).cast("int")
    return entries.join(long, "key", "left").select("node", "n_shingles", "at", "key", dealt.alias("part"), F.col("m").isNotNull().alias("long"))


def _neighbours(near: DataFrame, pct: int) -> DataFrame:
    """Distinct pairs (a, b) of neighbours in the first lists of a node."""
    pairs = near.filter(F.col("before").isNotNull() & (F.col("at") < FIRST) & _fits("n_shingles", "n_before", pct))
    return pairs.select(F.least("node", "before").alias("a"), F.greatest("node", "before").alias("b")).distinct()


def _spokes(near: DataFrame, rated: DataFrame, pct: int) -> DataFrame:
    """Distinct pairs (a, b) of a list's hub, by the mean likeness to its neighbours, and each other node of the list."""
    central = rated.select(F.explode(F.array("a", "b")).alias("node"), "likeness").groupBy("node").agg(F.avg("likeness").alias("mean"))
    hubs = near.join(central, "node").groupBy("key", "part").agg(F.max(F.struct("mean", "node", "n_shingles")).alias("hub"))
    both = near.select("key", "part", "node", "n_shingles").join(
        hubs.select("key", "part", F.col("hub.node").alias("hub"), F.col("hub.n_shingles").alias("n_hub")), ["key", "part"]
    )
    both = both.filter((F.col("node") != F.col("hub")) & _fits("n_shingles", "n_hub", pct))
    return both.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of hashes that a batch of sets holds HEAVY times or more, with the times."""
    for batch in batches:
        x, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
        x, n = x[n >= HEAVY], n[n >= HEAVY]
        yield pa.RecordBatch.from_arrays(
            [pa.array((x.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64)), pa.array(n)], names=["bucket", "times"]
        )


def _prefixes(times: np.ndarray, pct: int):
    """Of each set the first n - ceil(pct n) + 1 hashes, in an order that puts frequent buckets last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, places, hashes = [], [], [], []
            for node, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = own.values.to_numpy(zero_copy_only=False).view(np.uint64)
                k = len(x) + pct * len(x) // -100 + 1
                first = x[np.lexsort((x, times[(x >> np.uint64(64 - BITS)).astype(np.int64)]))[:k]]
                nodes.append(np.full(len(first), node))
                sizes.append(np.full(len(first), len(x)))
                places.append(np.arange(len(first)))
                hashes.append(first.view(np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in (nodes, sizes, places, hashes)],
                    names=["node", "n", "place", "hash"]
                )

    return run


def _open_pairs(open_nodes: DataFrame, sets: DataFrame, part: DataFrame, pct: int) -> DataFrame:
    """Distinct pairs (a, b) of nodes in different components that an exact prefix filter leaves.

    Hashes are ordered by how often their bucket occurs, then by value. Two sets that reach the threshold share a hash
    in their prefixes, and after the first that they share enough hashes are left in both; the counts only choose the
    order, so they may be rough. Hashes of a passage that many documents share come last, and texts with many words of
    their own meet nobody. The histogram has 2**BITS entries, whatever the input.
    """
    heavy = sets.select("hashes").mapInArrow(_frequent, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times"))
    times = np.zeros(1 << BITS, np.int64)
    found = heavy.toPandas()
    times[found.bucket.to_numpy()] = found.times.to_numpy()
    rows = sets.select("node", "hashes").mapInArrow(
        _prefixes(times, pct), "node long, n long, place long, hash long"
    ).join(open_nodes, "node", "left_semi")
    rows = rows.join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_part = rows.groupBy("hash", "component").agg(F.count("*").alias("m"))
    sizes = of_part.groupBy("hash").agg(
        F.sum("m").alias("m"), F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("parts")
    ).filter("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select(
        "hash", F.col("most.component").alias("most"), blocks(F.col("m")).alias("blocks"), blocks(F.col("m") - F.col("most.m")).alias("few")
    )
    rows = rows.join(sizes, "hash").withColumn("outside", F.col("component") != F.col("most"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ("node", "n", "place", "component", "outside")
    left = rows.filter("outside").select(
        "hash", block("few").alias("own"), every("blocks").alias("other"), *(F.col(c).alias(f"{c}_a") for c in names)
    )
    right = rows.select("hash", every("few").alias("own"), block("blocks").alias("other"), *(F.col(c).alias(f"{c}_b") for c in names))
    fit = _fits("n_a", "n_b", pct) & (F.col("component_a") != F.col("component_b")) & (~F.col("outside_b") | (F.col("node_a") < F.col("node_b")))
    left_over = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    both = left.join(right, ["hash", "own", "other"]).filter(fit & ((100 + pct) * left_over >= pct * (F.col("n_a") + F.col("n_b"))))
    return both.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, pct: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs (doc_id, text).

    Words are runs of other than white space, A-Z lower-cased. Links: Jaccard of shingle sets of pct per cent or more.
    component_id is the least doc_id reachable; kept marks that document. A null or word-less text has no shingles and
    no links. Rows that repeat a doc_id each get a row; a null doc_id takes its group's least id, or null alone. An
    empty table gives an empty result. Other columns are ignored.
    """
    hashed = stored(_hashed(docs, shingle), "near-hashed")
    nodes = hashed.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("least"), F.first("hashes").alias("sketch"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")

    order = Window.partitionBy("key", "part").orderBy(F.floor(F.log("n_shingles") / float(np.log(1.25))), F.xxhash64("key", "node"))
    near = _lists_of(nodes, pct).withColumns({
        "before": F.lag("node").over(order), "n_before": F.lag("n_shingles").over(order), "after": F.lead("node").over(order)
    })
    near = stored(near.filter("before is not null or after is not null or long").drop("after", "long"), "near-lists")

    live = nodes.join(near.select("node").distinct(), "node", "left_semi").select("node", "least", "s1", "s2", "n_shingles")
    texts = docs.select("doc_id", "text").join(live.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    sets = _hashed(texts, shingle, full=True).join(live, ["s1", "s2", "n_shingles"]).dropDuplicates(["s1", "s2", "n_shingles"]).select("node", "hashes")
    sets = stored(sets, "near-sets")
    brief = nodes.select("node", F.col("n_shingles").alias("n"), _brief().alias("brief"))

    beside = _neighbours(near, pct)
    rated = stored(_rated(beside, brief, pct), "near-rated")
    spokes = _spokes(near, rated, pct).join(beside, ["a", "b"], "left_anti")
    rated = rated.select("a", "b").unionByName(_rated(spokes, brief, pct).select("a", "b"))
    part = stored(connected_components(_linked(rated, sets, pct), "a", "b"), "near-parts")

    members = near.select("key", "part", "node").join(part, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = members.groupBy("key", "part").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_lists = ends.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("part").alias("last")).filter("lo <> hi")
    open_lists = open_lists.select("key", F.explode(F.sequence(F.lit(0), "last")).alias("part"))
    open_nodes = near.select("key", "part", "node").join(open_lists, ["key", "part"], "left_semi").select("node").distinct()
    more = _open_pairs(open_nodes, sets, part, pct)
    more = _linked(_rated(more, brief, pct).select("a", "b"), sets, pct)
    ends = more.join(part.toDF("a", "ca"), "a", "left").join(part.toDF("b", "cb"), "b", "left")
    joined = connected_components(ends.select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y")).distinct(), "x", "y")

    named = nodes.join(part, "node", "left").withColumn("first", F.coalesce("component", "node")).drop("component")
    named = named.join(joined.toDF("first", "second"), "first", "left")
    named = stored(named.select("s1", "s2", "n_shingles", "least", F.coalesce("second", "first").alias("component")), "near-named")
    # written, so that its size is known and the join with a large component's nodes can be split; a node alone has its own id
    several = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("m")).filter("m > 1").drop("m")
    named = named.join(stored(several, "near-components"), "component", "left").withColumn("component_id", F.coalesce("component_id", "least"))
    out = hashed.select("doc_id", "n_shingles", "s1", "s2").join(
        named.select("s1", "s2", "n_shingles", "component_id"), ["s1", "s2", "n_shingles"], "left"
    )
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, shingle: int = 5, pct: int = 80) -> DataFrame:
    """The rows of docs whose doc_id stands for its group, with all their columns; rows that repeat a doc_id are one document."""
    (own,) = unused(docs, "_id")
    kept = near_duplicates(docs, shingle, pct).filter("kept").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
