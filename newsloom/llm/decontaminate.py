"""Operator 6: benchmark decontamination with a distributed positional inverted index.

The training texts are split into segments of some million words. A segment is one row of the index: its sorted terms
and for each term the delta-coded places where it stands in the segment's stream of words. A search loads one segment
at a time, aligns each benchmark item by the rarest term of each of its windows and intersects the offset-adjusted
lists of the other terms, rarest first. Documents never leave their segment, so that a term or a passage that a third
of all documents share is spread over all segments and moves nothing between tasks.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored
from newsloom.llm import textnum as T
from newsloom.llm.names import unused

SEGMENT_WORDS = 2_000_000
BLOCK_WORDS = 400_000  # words of benchmark items that one pass over the index holds in memory (3 MB of hashes)
INDEX = "segment string, docs binary, absent binary, crcs binary, lengths binary, terms binary, counts binary, gaps binary, wide binary"


def _segment(ids: list, absent: list, crcs: list, lengths: list, hashes: list) -> pa.RecordBatch:
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    gap = np.diff(order, prepend=0)
    gap[new] = order[new]
    rows = [
        np.concatenate(ids).astype(np.int64), np.concatenate(absent).astype(np.uint8), np.concatenate(crcs),
        np.concatenate(lengths).astype(np.int32), h[new], np.diff(np.flatnonzero(np.append(new, True))).astype(np.int32),
        np.minimum(gap, 255).astype(np.uint8), gap[gap >= 255].astype(np.int32)
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid.uuid4().hex]), *(pa.array([x.tobytes()], pa.binary()) for x in rows)],
        names=["segment", "docs", "absent", "crcs", "lengths", "terms", "counts", "gaps", "wide"]
    )


def _crcs(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(buf[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], np.int64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list] = [[] for _ in range(5)]
    n = 0
    for batch in batches:
        ids = batch.column(0).cast(pa.int64())
        for lo, buf, off in T.slices(batch.column(1)):
            h, _, _, first = T.words(buf, off, T.ALNUM, lower=True)
            own = ids.slice(lo, len(off) - 1)
            for to, x in zip(held, (np.asarray(own.fill_null(0)), np.asarray(own.is_null()), _crcs(buf, off), np.diff(first), h), strict=True):
                to.append(x)
            n += len(h) + len(own)
            if n >= SEGMENT_WORDS:
                yield _segment(*held)
                held, n = [[] for _ in range(5)], 0
    if held[0]:
        yield _segment(*held)


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all words of docs (doc_id, text), written to the shared folder."""
    return stored(docs.select("doc_id", "text").mapInArrow(_index, INDEX), "postings")


def _matches(item: np.ndarray, known: np.ndarray, lists, freq: np.ndarray, size: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of exact occurrences of the item's windows in the stream, and starts of near ones.

    item: term indexes; known: whether the segment has the term; lists(q): places of word q of the item.
    """
    m = len(item)
    w = min(size, m)
    whole = np.convolve(known, np.ones(w, int), "valid") == w
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    anchors = {i + int(np.argmin(freq[i : i + w])) for i in np.flatnonzero(whole)}
    at = np.unique(np.concatenate([lists(q) - q for q in anchors]))
    exact, near = np.zeros((len(at), m), bool), np.zeros((len(at), m), bool)
    for q in np.argsort(freq, kind="stable"):
        if known[q]:
            p = lists(q)
            k = np.searchsorted(p, at + q)
            exact[:, q] = (k < len(p)) & (p[np.minimum(k, len(p) - 1)] == at + q)
            k = np.searchsorted(p, at + q - slop)
            near[:, q] = (k < len(p)) & (p[np.minimum(k, len(p) - 1)] <= at + q + slop)

    def starts(found: np.ndarray) -> np.ndarray:
        c = np.concatenate([np.zeros((len(at), 1), np.int32), np.cumsum(found, axis=1, dtype=np.int32)], axis=1)
        row, i = np.nonzero(c[:, w:] - c[:, :-w] == w)
        return at[row] + i

    return starts(exact), starts(near)


def _searcher(items: list[tuple[str, np.ndarray]], size: int, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                docs, absent, crcs, lengths, terms, counts, gaps, wide = (
                    np.frombuffer(batch.column(k + 1)[r].as_py(), t) for k,
                    t in enumerate((np.int64, np.uint8, np.int64, np.int32, np.uint64, np.int32, np.uint8, np.int32))
                )
                step = gaps.astype(np.int64)
                step[gaps == 255] = wide
                upto = np.concatenate([[0], np.cumsum(counts)])
                begins = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                hit = np.zeros(int(begins[-1]) + 1, np.int32)
                found: list[tuple[np.ndarray, int]] = []
                close: list[tuple[np.ndarray, int]] = []
                places: dict[int, np.ndarray] = {}

                def lists_of(t: int) -> np.ndarray:
                    if t not in places:
                        places[t] = np.cumsum(step[upto[t] : upto[t + 1]])
                    return places[t]

                flat = np.concatenate([h for _, h in items]) if items else np.zeros(0, np.uint64)
                index = np.minimum(np.searchsorted(terms, flat), max(0, len(terms) - 1))
                have = (terms[index] == flat) if len(terms) else np.zeros(len(flat), bool)
                lo = 0
                for number, (_, h) in enumerate(items):
                    t, known = index[lo : lo + len(h)], have[lo : lo + len(h)]
                    lo += len(h)
                    w = min(size, len(h))
                    freq = np.where(known, counts[t] if len(counts) else 0, np.iinfo(np.int32).max)
                    exact, near = _matches(t, known, lambda q, t=t: lists_of(int(t[q])), freq, size, slop)
                    for s, to in ((exact, found), (near, close)):
                        if len(s):
                            d = np.searchsorted(begins, s, "right") - 1
                            ok = (s >= 0) & (s + w <= begins[np.minimum(d + 1, len(begins) - 1)])
                            to.append((np.unique(d[ok]), number))
                            if to is found:
                                np.add.at(hit, s[ok], 1)
                                np.add.at(hit, s[ok] + w, -1)
                n = len(docs)
                mask = np.cumsum(hit)[:-1] > 0
                of = np.repeat(np.arange(n), lengths)
                edge = np.flatnonzero(mask & np.concatenate([[True], ~mask[:-1] | (of[1:] != of[:-1])])) if len(mask) else np.zeros(0, np.int64)
                last = np.flatnonzero(mask & np.concatenate([~mask[1:] | (of[1:] != of[:-1]), [True]])) if len(mask) else np.zeros(0, np.int64)
                spans = [[] for _ in range(n)]
                for a, b in zip(edge, last, strict=True):
                    spans[of[a]].append({"start": int(a - begins[of[a]]), "end": int(b + 1 - begins[of[a]])})

                def named(pairs: list[tuple[np.ndarray, int]], n: int = n) -> list[list[str]]:
                    out: list[set] = [set() for _ in range(n)]
                    for d, number in pairs:
                        for x in d:
                            out[x].add(items[number][0])
                    return [sorted(x) for x in out]

                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, mask=absent.astype(bool)), pa.array(crcs), pa.array(lengths.astype(np.int64)),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(named(found), pa.list_(pa.string())), pa.array(named(close), pa.list_(pa.string())),
                        pa.array([batch.column(0)[r].as_py()] * n, pa.string()), pa.array(range(n), pa.int64())
                    ],
                    names=["doc_id", "text_crc32", "n_words", "spans", "items", "near_items", "_segment", "_row"],
                )

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The items with words, as (item_id, word hashes), in blocks of bounded size."""
    block, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").filter("item_id is not null and text is not null").toLocalIterator():
        for _, buf, off in T.slices(pa.array([row[1]])):
            h = T.words(buf, off, T.ALNUM, lower=True)[0]
            if len(h):
                block.append((row[0], h))
                n += len(h)
        if n >= BLOCK_WORDS:
            yield block
            block, n = [], 0
    yield block


def search(index: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 2) -> DataFrame:
    """For each indexed document: doc_id, text_crc32 (null as an empty text), n_words, spans of hit words (start, end), items, near_items.

    An item's windows are its runs of window words, or the whole item where it has fewer. items have a window that
    occurs word for word; near_items have one whose words all stand within slop words of their place. Items without a
    word or an item_id match nothing; equal ids are one item. Benchmark items are taken in blocks of bounded size, one
    pass over the index each; with several blocks the driver holds one at a time, and each one's matches are written.
    Words are compared by 64-bit hashes: a window matches wrongly only if all its words' hashes meet by chance.
    """
    kind = "doc_id long, text_crc32 long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, near_items array<string>, _segment string, _row long"
    blocks = _blocks(benchmark)
    block, following = next(blocks), next(blocks, None)
    one = lambda b: index.mapInArrow(_searcher(b, window, slop), kind)
    if following is None:
        return one(block).drop("_segment", "_row")
    every = stored(one(block), "matches")
    while following is not None:
        every = every.unionByName(stored(one(following), "matches"))
        following = next(blocks, None)
    whole = every.groupBy("_segment", "_row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_crc32").alias("text_crc32"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items")
    )
    return whole.drop("_segment", "_row")


def n_hit() -> F.Column:
    """Words inside the union of the sorted spans."""
    step = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s.upto, x.end).alias("upto"), (s.n + F.greatest(F.lit(0), x.end - F.greatest(s.upto, x.start))).alias("n"))
    )
    return step.n


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, near_items) for each row of docs (doc_id, text).

    Words are runs of 0-9, a-z and characters beyond ASCII after A-Z are lower-cased; a null text has none. A word
    inside any occurrence of a window is hit; contaminated where at least one word in twenty is hit. Rows that repeat a
    doc_id each get a row; empty tables give empty results or no hits.
    """
    out = search(build_index(docs), benchmark, window)
    return out.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))).alias("contaminated"), "near_items"
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns. Only ids and checksums of the others are joined."""
    own, crc = unused(docs, "_id", "_crc")
    found = search(build_index(docs), benchmark, window).filter((n_hit() > 0) & (20 * n_hit() >= F.col("n_words")))
    bad = found.select(F.col("doc_id").alias(own), F.col("text_crc32").alias(crc)).distinct()
    text_crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own)) & (text_crc == F.col(crc)), "left_anti")
