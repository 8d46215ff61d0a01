"""Operator 5: exact token counts at every prefix of a text, for one tokenizer file.

The tokenizer splits at white space, so a text's tokens are those of its words one after another (a word is a run
without ASCII white space; special strings, contractions and Unicode rules act inside words). That is read from the
tokenizer's file, and one whose file doesn't show it is refused. Counting is a dynamic programme over prefixes on two
levels: tokens[i] = tokens[i - 1] + count(word i), where each distinct word is counted once in a task and remembered; and
inside a word, character by character, over its last tokens (prefix_bpe, and prefix_batch for many words at once). So
every text's table has all its prefixes, and answers how many tokens a prefix has, and where a budget ends, without
encoding anything again.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import textnum as T
from newsloom.llm.prefix_batch import BatchCounter
from newsloom.llm.prefix_bpe import PrefixCounter

REMEMBERED = 500_000  # words of which a worker keeps the counts; all are forgotten when there are more
TOGETHER = 6  # slices of texts whose new words are counted together


class _Words:
    """Counts at each character of words, remembered: of word k those of flat from start[k] on, size[k] of them."""

    def __init__(self, counter: BatchCounter) -> None:
        self.counter = counter
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > REMEMBERED:
            self.forget()
        new = [w for w in words if w not in self.known]
        if new:
            size, flat = self.counter.words(new)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
            self.known.update(zip(new, range(len(self.known), len(self.start)), strict=True))


@lru_cache(maxsize=2)
def _loaded(path: str) -> _Words:
    """The remembered words, once for each Python worker and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are shared out by Spark
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return _Words(BatchCounter(PrefixCounter(path, tokenizer)))


def _table(words: _Words, parts: list[list[bytes]], buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts and their words: (ends, tokens) of all prefixes and the place of each text's first one; and of all words
    (place of the last prefix, tokens before, tokens up to it)."""
    kind = np.int32 if max(4 * len(buf), len(words.flat)) < 2**31 else np.int64  # a row of its own for each character
    of = np.cumsum([0, *map(len, parts)])
    own = np.fromiter(map(words.known.__getitem__, chain.from_iterable(parts)), np.int64, of[-1])
    start, size = words.start[own].astype(kind), words.size[own]
    stop = np.cumsum(size)
    last = np.append(0, stop)
    total = words.flat[start + size - 1] if len(own) else size
    upto = np.append(0, np.cumsum(total, dtype=kind))
    before = upto[:-1] - np.repeat(upto[of[:-1]], np.diff(of))
    at = np.arange(last[-1], dtype=kind)
    at += np.repeat(start - last[:-1].astype(kind), size)
    tokens = words.flat[at].astype(kind, copy=False)
    del at
    tokens += np.repeat(before, size)
    final = T.NON_SPACE[buf]  # bytes of words with which a character ends
    final[:-1] &= (buf[1:] & 0xC0) != 0x80
    first = last[of]
    ends = np.flatnonzero(final).astype(kind)
    ends -= np.repeat(off[:-1].astype(kind) - 1, np.diff(first))
    return ends, tokens, first, stop - 1, before, before + total


def _over(path: str, emit: Callable) -> Callable:
    """A function of batches (doc_id, text) that gives emit(ids, sizes, table) for consecutive texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded(path)
        for batch in batches:
            for some in batched(T.slices(batch.column(1)), TOGETHER):
                split = []
                for _, buf, off in some:
                    raw = buf.tobytes()
                    split.append([raw[a:b].split() for a, b in zip(off[:-1], off[1:], strict=True)])
                words.learn(set(chain.from_iterable(chain.from_iterable(split))))
                for (lo, buf, off), parts in zip(some, split, strict=True):
                    ids = batch.column(0).slice(lo, len(off) - 1).cast(pa.int64())
                    yield emit(ids, np.diff(off), _table(words, parts, buf, off))

    return run


def _rows(budget: int | None, every: bool) -> Callable:
    def emit(ids: pa.Array, sizes: np.ndarray, table: tuple) -> pa.RecordBatch:
        ends, tokens, first, last, before, upto = table
        if not every:
            keep = np.zeros(len(ends), bool)
            if budget is not None:
                keep = np.repeat((before <= budget) & (upto > budget), np.diff(np.append(-1, last)))
            keep[last] = True
            ends, tokens, first = ends[keep], tokens[keep], np.append(0, np.cumsum(keep))[first]
        bounds = pa.array(first.astype(np.int32))
        ends, tokens = (pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int64))) for x in (ends, tokens))
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes), ends, tokens], names=["doc_id", "n_bytes", "prefix_bytes", "prefix_tokens"])

    return emit


def _counts(budget: int) -> Callable:
    def emit(ids: pa.Array, sizes: np.ndarray, table: tuple) -> pa.RecordBatch:
        ends, tokens, first, *_ = table
        n, within = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        some = first[1:] > first[:-1]
        if some.any():
            n[some] = tokens[first[1:][some] - 1]
            within[some] = np.maximum.reduceat(np.where(tokens <= budget, ends, 0), first[:-1][some])
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes), pa.array(n), pa.array(n > budget), pa.array(within)],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit", "bytes_in_limit"],
        )

    return emit


def prefix_tables(docs: DataFrame, tokenizer: str, budget: int | None = None, every: bool = False) -> DataFrame:
    """(doc_id, n_bytes, prefix_bytes, prefix_tokens) for each row of docs (doc_id, text).

    The k-th prefix of the table ends prefix_bytes[k] bytes from the start and has prefix_tokens[k] tokens. Prefixes end
    with the text's words; with a budget also with each character of the word in which it ends; with every, with each
    character of all words (white space adds nothing). A prefix inside a word may have more tokens than a longer one. A
    null, empty or blank text has no prefixes. Nothing is truncated. Other columns are ignored. A tokenizer file that
    doesn't show that words are encoded one by one raises ValueError.
    """
    _loaded(tokenizer)
    return docs.select("doc_id", "text").mapInArrow(
        _over(tokenizer, _rows(budget, every)), "doc_id long, n_bytes long, prefix_bytes array<long>, prefix_tokens array<long>"
    )


def total() -> F.Column:
    """Tokens of the whole text."""
    return F.coalesce(F.try_element_at("prefix_tokens", F.lit(-1)), F.lit(0))


def bytes_within(budget: int) -> F.Column:
    """Bytes of the longest prefix in the table that has at most budget tokens: of all prefixes, in a table made for that budget."""
    return F.coalesce(F.array_max(F.zip_with("prefix_bytes", "prefix_tokens", lambda b, n: F.when(n <= budget, b))), F.lit(0))


def tokens_within(n_bytes: F.Column) -> F.Column:
    """Tokens of the longest prefix in the table that ends within n_bytes."""
    fits = F.size(F.filter("prefix_bytes", lambda x: x <= n_bytes))
    return F.when(fits > 0, F.element_at("prefix_tokens", fits)).otherwise(F.lit(0))


def token_counts(docs: DataFrame, tokenizer: str, budget: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, bytes_in_limit) of whole texts, from the tables of all their prefixes.

    bytes_in_limit: of the longest prefix that has at most budget tokens, up to the last character of its last word. The
    tables are read where they are made.
    """
    _loaded(tokenizer)
    return docs.select("doc_id", "text").mapInArrow(
        _over(tokenizer, _counts(budget)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, bytes_in_limit long"
    )
