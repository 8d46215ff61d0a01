"""C14: a stored inverted index of titles and summaries, and its search.

Documents get numbers in blocks of BLOCK neighbours. A row of the index is a block of a term's list: the term, the block,
the highest score part in it, and its postings (place in the block, frequency, length of the document). The rows stand in term order, dealt by ranges of
(term, block), so that a term of a third of all documents is spread over many files, and a term or a prefix is a range of
Parquet row groups that the scan finds by their statistics. All lists are cut at the same documents, so that blocks of
several terms are compared by their highest parts before any posting is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored
from newsloom.operators.events import tokens

BLOCK = 128  # documents of a block; a power of two
LONGEST = 2**28  # words of a document, below which a posting fits a long
WORDS = 10_000_000  # of a partition of the term order: sorted in some hundred MB
K1, B = 1.2, 0.75


def _part(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, id, _t) as the lists of each block: neighbours stand in one task, so that no shuffle brings them together."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([rest, rows]) if rest else rows).combine_chunks()
        block = rows["doc"].to_numpy() // BLOCK
        starts = [0, *(np.flatnonzero(np.diff(block)) + 1)]
        for start, end in pairwise(starts):
            yield from _lists(rows.slice(start, end - start))
        rest = rows.slice(starts[-1])  # its block may go on
    if rest:
        yield from _lists(rest)


def _lists(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """A block's documents (term null), and its terms in order with places, frequencies and lengths."""
    doc, ids, texts = (rows[c].combine_chunks() for c in ("doc", "id", "_t"))
    block, at = doc[0].as_py() // BLOCK, (doc.to_numpy() % BLOCK).astype(np.int16)
    length = pc.list_value_length(texts).to_numpy().astype(np.int32)
    if length.max(initial=0) >= LONGEST:
        raise ValueError(f"a document of {LONGEST} words or more")
    names = ["block", "term", "at", "tf", "length", "id"]
    lists = lambda values, starts: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values))
    each, n = np.arange(len(at) + 1), len(at)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, block)), pa.nulls(n, pa.string()), lists(at, each), pa.nulls(n, pa.list_(pa.int32())), lists(length, each), ids], names
    )
    words = texts.flatten().dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key, tf = np.unique(rank[words.indices.to_numpy()] * BLOCK + np.repeat(at, length), return_counts=True)
    starts, n = np.append(np.flatnonzero(np.diff(key // BLOCK, prepend=-1)), len(key)), len(order)
    at_length = np.zeros(BLOCK, np.int32)
    at_length[at] = length
    at = (key % BLOCK).astype(np.int16)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(n, block)), words.dictionary.take(pa.array(order)), lists(at, starts), lists(tf.astype(np.int32), starts),
        lists(at_length[at], starts), pa.nulls(n, ids.type)
    ], names)


def build_index(corpus: DataFrame, path: str, id_col: str = "doc_id", texts: tuple[str, ...] = ("text",), blocks: int = 64) -> None:
    """Write the index of corpus (id_col, texts) under path: documents, postings and a line of totals.

    A null text is empty; a document without words is counted, as any other. blocks: partitions of the term order, more from
    WORDS words each on. Lists are made where the texts are read, and shuffled once, to the term order.
    """
    spark, kind = corpus.sparkSession, corpus.schema[id_col].dataType.simpleString()
    rows = corpus.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), tokens(F.concat_ws("\n", *texts)).alias("_t"))
    rows = rows.mapInArrow(_listed, f"block long, term string, at array<short>, tf array<int>, length array<int>, id {kind}")
    rows = stored(rows, "search-lists")
    docs = rows.filter("term is null").select((F.col("block") * BLOCK + F.col("at")[0]).alias("doc"), "id", F.col("length")[0].alias("length"))
    docs.write.mode("overwrite").parquet(f"{path}/documents")
    docs = spark.read.parquet(f"{path}/documents")
    docs.agg(F.count("*").alias("docs"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    totals = spark.read.parquet(f"{path}/totals").first()
    # a posting is shuffled as one number: three arrays of one or two entries are mostly their headers
    one = F.transform("at", lambda at, k: (F.get("tf", k).cast("long") * LONGEST + F.get("length", k)) * BLOCK + at)
    lists = rows.filter("term is not null").select("term", "block", one.alias("one"))
    lists = lists.repartitionByRange(max(blocks, int(totals["docs"] * totals["mean"]) // WORDS), "term", "block").sortWithinPartitions("term", "block")
    lists = lists.select(
        "term", "block", F.transform("one", lambda x: (x % BLOCK).cast("short")).alias("at"),
        F.transform("one", lambda x: F.call_function("div", x, F.lit(BLOCK * LONGEST)).cast("int")).alias("tf"),
        F.transform("one", lambda x: (F.call_function("div", x, F.lit(BLOCK)) % LONGEST).cast("int")).alias("length")
    )
    top = F.array_max(F.zip_with("tf", "length", lambda tf, length: _part(tf, length, F.lit(totals["mean"]))))
    lists = lists.select("term", "block", top.alias("top"), F.size("at").alias("m"), "at", "tf", "length")
    lists.write.mode("overwrite").parquet(f"{path}/postings")


def _matches(q: str) -> Column:
    """Rows of a term, or with a trailing * of the terms that begin with it; either reaches the scan."""
    return F.col("term").startswith(q[:-1]) if q.endswith("*") else F.col("term") == q


def search_index(spark: SparkSession, path: str, query: list[str | list[str]], limit: int = 20, first_blocks: int | None = None) -> DataFrame:
    """(id, score) of the limit best documents that hold each term of query, by BM25 and then by id.

    A term is a word, a prefix that ends with *, or a list of them of which a document holds at least one; their
    frequencies add up. Words are matched in lower case. Only lists of the query's terms are read: first their blocks' highest
    parts, then the postings of the first_blocks blocks of highest bound (default: limit), then those of the blocks whose
    bound reaches the limit-th best score of these.
    """
    asked = [[x.lower() for x in ([q] if isinstance(q, str) else q)] for q in query]
    postings = spark.read.parquet(f"{path}/postings")
    groups = []
    wanted = F.lit(False)
    for k, words in enumerate(asked):
        one = F.lit(False)
        for q in words:
            one = one | _matches(q)
        wanted = wanted | one
        groups.append(F.when(one, k))
    empty = spark.createDataFrame([], "id long, score double")
    if not asked:
        return empty
    hits = postings.filter(wanted).withColumn("group", F.explode(F.array_compact(F.array(*groups))))
    # documents of a single word are counted without reading its postings; those of several words may be the same ones
    alone = [k for k, words in enumerate(asked) if len(words) == 1 and not words[0].endswith("*")]
    heads = hits.filter(F.col("group").isin(alone)).groupBy("block", "group").agg(F.sum("top").alias("top"), F.sum("m").cast("long").alias("m"))
    several = [k for k in range(len(asked)) if k not in alone]
    if several:
        of = hits.filter(F.col("group").isin(several)).groupBy("block", "group").agg(
            F.sum("top").alias("top"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("m")
        )
        heads = heads.unionByName(of) if alone else of
    heads = stored(heads, "search-heads")
    totals = spark.read.parquet(f"{path}/totals").first()
    df = {r["group"]: r["m"] for r in heads.groupBy("group").agg(F.sum("m").alias("m")).collect()}  # a row for each term of the query
    if len(df) < len(asked):
        return empty
    idf = F.create_map(*[x for k, m in df.items() for x in (F.lit(k), F.log(F.lit(1 + (totals["docs"] - m + 0.5) / (m + 0.5))))])
    bounds = heads.groupBy("block").agg(F.count("*").alias("k"), F.sum(F.col("top") * idf[F.col("group")]).alias("bound")).filter(F.col("k") == len(asked))
    bounds = stored(bounds.select("block", "bound"), "search-bounds")

    def scored(blocks: DataFrame) -> DataFrame:
        rows = hits.join(blocks.select("block"), "block", "left_semi").select("group", "block", F.inline(F.arrays_zip("at", "tf", "length")))
        rows = rows.groupBy((F.col("block") * BLOCK + F.col("at")).alias("doc"), "group", "length").agg(F.sum("tf").alias("tf"))
        part = _part(F.col("tf"), F.col("length"), F.lit(totals["mean"])) * idf[F.col("group")]
        out = rows.groupBy("doc").agg(F.count("*").alias("k"), F.sum(part).alias("score")).filter(F.col("k") == len(asked))
        return out.select("doc", F.round("score", 6).alias("score"))

    first = bounds.orderBy(F.desc("bound"), "block").limit(first_blocks or limit)
    best = scored(first).orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    least = best["least"] if best["n"] == limit else 0.0
    named = spark.read.parquet(f"{path}/documents").select("doc", "id")
    top = scored(bounds.filter(F.col("bound") >= least - 1e-6))
    # a tie at the last place is decided by id, so all documents of that score are named first
    last = top.orderBy(F.desc("score")).limit(limit).agg(F.min("score").alias("least"))
    kept = top.join(F.broadcast(last), F.col("score") >= F.col("least")).drop("least")  # one row
    return kept.join(named, "doc").orderBy(F.desc("score"), "id").limit(limit).select("id", "score")


def search_events(
    spark: SparkSession, path: str, heads: DataFrame, query: list[str | list[str]], limit: int = 50, id_col: str = "event_id"
) -> DataFrame:
    """C14: (id_col, score, ranked) from the index; where it gives none, heads (id_col, titles, risk) whose title, canonical
    title or an alias contains the words of query as one text, whatever the case of A-Z, by risk and then by id.

    Columns display_title, canonical_title (strings) and aliases (an array of strings) are looked into where heads has them.
    """
    found = search_index(spark, path, query, limit)
    if found.head(1):
        return found.select(F.col("id").alias(id_col), "score", F.lit(True).alias("ranked"))
    text = " ".join(q.rstrip("*") for q in (x if isinstance(x, str) else x[0] for x in query))
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    have = [lower(F.col(c)).contains(lower(F.lit(text))) for c in ("display_title", "canonical_title") if c in heads.columns]
    if "aliases" in heads.columns:
        have.append(F.exists("aliases", lambda x: lower(x).contains(lower(F.lit(text)))))
    met = F.lit(False)
    for x in have:
        met = met | F.coalesce(x, F.lit(False))
    out = heads.filter(met).orderBy(F.desc("risk"), id_col).limit(limit)
    return out.select(id_col, F.lit(0.0).alias("score"), F.lit(False).alias("ranked"))
