"""Operator 12: ranked lexical search with K2-treaps over term-document grids.

Documents are dealt into segments of some million words, as they come; a document never leaves its task. A segment is a
grid: a row for each of its terms, the most frequent first, a column for each document, and in a cell the impact of the
term in the document. The grid is a quadtree of which only the cells that hold something are kept, level by level in
Z-order: four bits for each cell that tell which of its quarters hold something, and the maximum of the impacts in it,
rounded up. A child's place is the count of the bits before it.

A search descends from the root along the paths of all rows of an item at once. A state is a range of columns, one cell
for each row, and its bound: the sum of the cells' maxima times the terms' weights. The ranges of highest bound are halved
first; a single column's bound is its score. The search of a segment ends when no bound reaches the k-th best score, which a
task keeps from one segment to the next. Each task gives k documents an item, of which the best are taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored
from newsloom.llm import textnum as T

SEGMENT_WORDS = 2_000_000
BLOCK_TERMS = 100_000  # terms of the items that are searched together
BEAM = 64  # ranges that are halved at once
STEP = 16  # maxima of inner cells are kept in steps of this
INDEX = "segment string, n_tokens long, docs binary, absent binary, lengths binary, terms array<long>, dfs array<int>, sizes array<int>, masks binary, maxima binary, tfs binary, wide binary"
POPCOUNT = np.array([bin(x).count("1") for x in range(16)], np.int64)


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _length_part(lengths: np.ndarray, n_docs: int, n_tokens: int) -> np.ndarray:
    """m of documents of these lengths."""
    return 10 + 90 * lengths * n_docs // max(1, n_tokens)


def _spread(x: np.ndarray) -> np.ndarray:
    """The low 31 bits of x, each followed by a zero bit."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and all terms, of a batch."""
    for batch in batches:
        docs = tokens = 0
        for _, buf, off in T.slices(batch.column(1)):
            n = np.diff(T.words(buf, off, T.ALNUM, lower=True)[3])
            docs, tokens = docs + int((n > 0).sum()), tokens + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], names=["docs", "tokens"])


def _segment(ids: list, absent: list, lengths: list, hashes: list, n_docs: int, n_tokens: int) -> pa.RecordBatch:
    size = np.concatenate(lengths).astype(np.int64)
    terms, row = np.unique(np.concatenate(hashes), return_inverse=True)
    pair, tf = np.unique(row * len(size) + np.repeat(np.arange(len(size)), size), return_counts=True)
    row, col = np.divmod(pair, len(size))
    df = np.bincount(row, minlength=len(terms))
    order = np.argsort(-df, kind="stable")
    place = np.empty(len(terms), np.int64)
    place[order] = np.arange(len(terms))
    code = (_spread(place[row]) << np.uint64(1)) | _spread(col)
    z = np.argsort(code)
    code, tf, top = code[z], tf[z], _impact(tf, _length_part(size, n_docs, n_tokens)[col])[z]
    levels = max(1, (max(len(terms), len(size)) - 1).bit_length())
    masks, maxima, sizes = [], [], [len(code)]
    for level in range(levels):
        new = np.ones(len(code), bool)
        new[1:] = code[1:] >> np.uint64(2) != code[:-1] >> np.uint64(2)
        first = np.flatnonzero(new)
        masks.append(np.bitwise_or.reduceat(np.left_shift(1, (code & np.uint64(3)).astype(np.int64)), first).astype(np.uint8))
        if level:
            maxima.append((-(-top // STEP)).astype(np.uint16))
        code, top = code[first] >> np.uint64(2), np.maximum.reduceat(top, first)
        sizes.append(len(code))
    rows = [np.concatenate(ids).astype(np.int64), np.concatenate(absent).astype(np.uint8), size.astype(np.int32)]
    tree = [np.concatenate(masks[::-1]), np.concatenate(maxima[::-1]) if maxima else np.zeros(0, np.uint16), np.minimum(tf, 255).astype(np.uint8), tf[tf >= 255].astype(np.int64)]
    column = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([uuid.uuid4().hex]), pa.array([int(size.sum())], pa.int64()), *map(column, rows),
            pa.array([terms[order].view(np.int64)]), pa.array([df[order].astype(np.int32)]), pa.array([np.array(sizes[::-1], np.int32)]),
            *map(column, tree)
        ],
        names=[c.split()[0] for c in INDEX.split(", ")]
    )


def _indexer(n_docs: int, n_tokens: int, segment_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(4)]
        n = 0
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for lo, buf, off in T.slices(batch.column(1)):
                h, _, _, first = T.words(buf, off, T.ALNUM, lower=True)
                own, size = ids.slice(lo, len(off) - 1), np.diff(first)
                some = size > 0
                for to, x in zip(held, (np.asarray(own.fill_null(0))[some], np.asarray(own.is_null())[some], size[some], h), strict=True):
                    to.append(x)
                n += len(h)
                if n >= segment_words:
                    yield _segment(*held, n_docs, n_tokens)
                    held, n = [[] for _ in range(4)], 0
        if n:
            yield _segment(*held, n_docs, n_tokens)

    return run


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of docs (doc_id, text), written to the shared folder: a row for each segment. Documents without terms are left out."""
    rows = docs.select("doc_id", "text")
    of = rows.mapInArrow(_cells, "docs long, tokens long").agg(F.sum("docs"), F.sum("tokens")).first()
    return stored(rows.mapInArrow(_indexer(of[0] or 0, of[1] or 0, segment_words), INDEX), "treaps", group_rows=1)


class Treap:
    """A segment read for searching: its cells are numbered from the root on, level by level; cell 0 stands for an empty one."""

    def __init__(self, row: dict, n_docs: int, n_tokens: int):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.docs, self.absent = read("docs", np.int64), read("absent", np.uint8)
        terms = np.asarray(row["terms"], np.int64)
        self.order = np.argsort(terms)
        self.sorted_terms = terms[self.order]
        self.levels = len(row["sizes"]) - 1
        masks, tf = read("masks", np.uint8), read("tfs", np.uint8).astype(np.int64)
        tf[tf == 255] = read("wide", np.int64)
        self.mask = np.concatenate([np.zeros(1, np.uint8), masks])
        count = POPCOUNT.astype(np.uint8)[self.mask]
        self.child = np.cumsum(count, dtype=np.int32 if len(count) < 2**29 else np.int64)
        self.child += 2  # the root is cell 1
        self.child -= count
        columns = self._columns(np.asarray(row["sizes"], np.int64))
        m = _length_part(read("lengths", np.int32).astype(np.int64), n_docs, n_tokens)
        inner = read("maxima", np.uint16).astype(np.int32) * STEP
        self.top = np.concatenate([np.zeros(2, np.int32), inner, _impact(tf, m[columns]).astype(np.int32)]) if self.levels else np.zeros(2, np.int32)

    def _columns(self, sizes: np.ndarray) -> np.ndarray:
        """The column of each leaf."""
        column, at = np.zeros(1, np.int64), 1
        for n in sizes[:-1]:
            held = (self.mask[at : at + n, None] >> np.arange(4)) & 1
            cell, quarter = np.nonzero(held)
            column, at = column[cell] * 2 + (quarter & 1), at + n
        return column

    def rows_of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of those terms that the segment has, and which they are."""
        k = np.minimum(np.searchsorted(self.sorted_terms, terms), len(self.sorted_terms) - 1)
        have = self.sorted_terms[k] == terms
        return self.order[k[have]], have

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple], k: int) -> list[tuple]:
        """The best k of best and of the segment's documents, as (minus score, without id, id), in order."""
        rows, have = self.rows_of(terms)
        w = weights[have]
        if not len(rows):
            return best
        least = -best[-1][0] if len(best) == k else 1
        cell = np.ones((1, len(rows)), np.int64)
        level, column, bound = np.array([self.levels]), np.zeros(1, np.int64), np.array([np.iinfo(np.int64).max])
        while len(bound):
            if len(bound) > BEAM:
                some = np.zeros(len(bound), bool)
                some[np.argpartition(-bound, BEAM)[:BEAM]] = True
            else:
                some = np.ones(len(bound), bool)
            at, below = cell[some], level[some] - 1
            bit = (rows >> below[:, None]) & 1
            mask, child = self.mask[at].astype(np.int64), self.child[at]
            halves = []
            for side in (0, 1):
                quarter = 2 * bit + side
                held = (mask >> quarter) & 1
                halves.append(np.where(held == 1, child + POPCOUNT[mask & ((1 << quarter) - 1)], 0))
            new, below = np.concatenate(halves), np.concatenate([below, below])
            place = np.concatenate([2 * column[some], 2 * column[some] + 1])
            reach = self.top[new] @ w
            single = (below == 0) & (reach >= least)
            if single.any():
                found = zip((-reach[single]).tolist(), self.absent[place[single]].tolist(), self.docs[place[single]].tolist(), strict=True)
                best = sorted([*best, *found])[:k]
                least = -best[-1][0] if len(best) == k else 1
            going = (below > 0) & (reach >= least)
            still = ~some & (bound >= least)
            cell, level = np.concatenate([cell[still], new[going]]), np.concatenate([level[still], below[going]])
            column, bound = np.concatenate([column[still], place[going]]), np.concatenate([bound[still], reach[going]])
        return best


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, buf, off in T.slices(batch.column(1)):
            h, _, _, first = T.words(buf, off, T.ALNUM, lower=True)
            own = [np.unique(h[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
            row = np.repeat(np.arange(lo, lo + len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(np.concatenate(own))], names=["item", "term"])


def weighted_items(index: DataFrame, items: DataFrame, n_docs: int) -> DataFrame:
    """(item, terms, weights) of items (item, text): terms as hashes that the index has, weights by their document frequency."""
    kind = items.schema["item"].dataType.simpleString()
    wanted = stored(items.mapInArrow(_item_terms, f"item {kind}, term long").distinct(), "search-terms")
    held = index.select(F.inline(F.arrays_zip("terms", "dfs"))).join(wanted.select("term").distinct().toDF("terms"), "terms", "left_semi")
    df = held.groupBy("terms").agg(F.sum("dfs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    both = wanted.join(df.select(F.col("terms").alias("term"), weight.alias("weight")), "term")
    return both.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("all")).select("item", F.col("all.term").alias("terms"), F.col("all.weight").alias("weights"))


def _searcher(k: int, n_docs: int, n_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        name, treap = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                if row["segment"].as_py() != name:
                    name, treap = row["segment"].as_py(), Treap({c: _plain(v) for c, v in row.items() if c != "items"}, n_docs, n_tokens)
                for x in row["items"].values:
                    item = x["item"].as_py()
                    best[item] = treap.search(_plain(x["terms"]), _plain(x["weights"]), best.get(item, []), k)
        rows = [(item, None if absent else doc, -score) for item, found in best.items() for score, absent, doc in found]
        yield pa.RecordBatch.from_pylist([dict(zip(("item", "doc_id", "score"), x, strict=True)) for x in rows], schema=pa.schema([("item", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    return run


def _plain(x: pa.Scalar):
    """A list as an array of numpy, other values as they are."""
    return x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) else x.as_py()


def search(index: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, doc_id, score): each item's k best of the indexed documents; items has item (a string) and text.

    Every block of about block_terms terms of items meets every segment once. Equal scores are ranked by doc_id, documents without one last; documents
    that repeat a doc_id are ranked one by one. Scores are above 0. Rows of one item are one query, also those without a
    name; an item without terms, or none that a document has, gives no rows. No documents or no items give no rows. Terms
    are compared by 64-bit hashes.
    """
    of = index.agg(F.sum(F.octet_length("lengths") / 4), F.sum("n_tokens")).first()
    n_docs, n_tokens = int(of[0] or 0), int(of[1] or 0)
    weighted = stored(weighted_items(index, items, n_docs), "search-items")
    total = weighted.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = 1 + total // block_terms
    block = F.pmod(F.xxhash64("item"), F.lit(n_blocks))
    blocks = stored(weighted.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item", "terms", "weights")).alias("items")), "search-blocks")
    # a set of queries, in blocks, against all rows: a pass over the index for each block, so that a task holds one at a time
    passes = [index.drop("dfs", "n_tokens").crossJoin(blocks.filter(F.col("block") == b).select("items")) for b in range(n_blocks)]
    found = reduce(DataFrame.unionByName, [x.mapInArrow(_searcher(k, n_docs, n_tokens), "item string, doc_id long, score long") for x in passes])
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score) of the best k of docs (doc_id, text) for items (item_id, text). Other columns are ignored."""
    kind = items.schema["item_id"].dataType
    named = items.select(F.col("item_id").cast("string").alias("item"), "text")
    return search(build_index(docs), named, k).select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")
