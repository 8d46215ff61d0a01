"""Which of many word lists a text has a word of: one pass of an automaton over the text, whatever the number of words."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import scalars as S

FEW = 200  # words up to which the text stays in the JVM and is searched for each of them


@lru_cache(maxsize=4)
def _automaton(lists: tuple[tuple[str, ...], ...]):
    """(automaton from words to the numbers of their lists, lists with an empty word), once for each worker."""
    import ahocorasick

    of: dict[str, list[int]] = {}
    for k, words in enumerate(lists):
        for w in words:
            of.setdefault(w, []).append(k)
    found = ahocorasick.Automaton()
    for w, ks in of.items():
        if w:
            found.add_word(w, tuple(dict.fromkeys(ks)))
    found.make_automaton()
    return found, frozenset(of.get("", ()))


def _searched(lists: tuple[tuple[str, ...], ...]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, always = _automaton(lists)
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                if text is None:
                    out.append(None)
                    continue
                got = set(always)
                if len(automaton):
                    for _, ks in automaton.iter(text):
                        got.update(ks)
                        if len(got) == len(lists):
                            break
                out.append(sorted(got))
            yield pa.array(out, pa.list_(pa.int32()))

    return run


def lists_found(low: Column, lists: Iterable[Iterable[str]]) -> Column:
    """The numbers of the lists of which a text in lower case contains a word, in order; null for a null text.

    Words are put in lower case; an empty word is in every text, an empty list in none. Up to FEW words in all the text is
    searched for each, from there on an automaton of all of them is run over it.
    """
    all_ = tuple(tuple(w.lower() for w in words) for words in lists)
    if len({w for words in all_ for w in words}) > FEW:
        # the signature is given by annotations, that of an iterator of arrays
        return F.arrow_udf(_searched(all_), T.ArrayType(T.IntegerType()))(low)
    hits = [F.when(S.has_low(low, list(words)), k) for k, words in enumerate(all_) if words]
    return F.when(low.isNotNull(), F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>"))


def with_lists(df: DataFrame, low: Column, lists: Iterable[Iterable[str]]) -> tuple[DataFrame, Callable[[Iterable[str]], Column]]:
    """df with columns _low and _lists, and a function from one of the lists to whether the text has a word of it."""
    number = {words: k for k, words in enumerate(dict.fromkeys(tuple(x) for x in lists))}
    out = df.withColumn("_low", low)
    if len({w.lower() for words in number for w in words}) <= FEW:
        return out, lambda words: S.has_low(F.col("_low"), list(words))
    return out.withColumn("_lists", lists_found(F.col("_low"), number)), lambda words: F.array_contains("_lists", number[tuple(words)])
