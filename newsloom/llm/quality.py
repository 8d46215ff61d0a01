"""Operator 8: quality rules by distribution divergence.

Each language's reference is the histogram of character classes and of common words over all its documents. A document
is kept if the Jensen-Shannon distance of its own histograms to the reference stays within limits. Short texts say too
little for a histogram: below MIN_COMPARED words no distance is taken, and length alone decides.

The limits lie between the labelled rows of the test tables: of good texts of MIN_COMPARED words or more, 99 of 100 have
a class distance under 0.22 and a common-word distance under 0.39, and nearly all junk is over one of the two limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored
from newsloom.llm import textnum as T

MIN_WORDS, MAX_REPEATED = 50, 50  # the base rule: words at least, per cent of words in repeated windows at most
MIN_COMPARED = 50  # words from which a text's histograms are compared
COMMON_SHARE = 0.002  # a word is common in a language from this share of its words on: 500 words at most
MAX_CLASS, MAX_COMMON = 0.30, 0.44  # limits of the distances
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _classes() -> np.ndarray:
    """The character class of each byte: bytes after the first of a character have none (last class)."""
    c = np.full(256, 5)
    c[ord("a") : ord("z") + 1] = 0
    c[ord("A") : ord("Z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    c[[0x20, *range(0x09, 0x0E)]] = 3
    c[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = 4
    c[0xC0:0xE0] = 6  # two-byte characters: Latin supplements, Greek, Cyrillic, ...
    c[0xE0:0xF0] = 7
    c[0xF0:] = 8
    c[0x80:0xC0] = 9
    return c


CLASS = _classes()
N_CLASSES = 9


def _class_counts(buf: np.ndarray) -> np.ndarray:
    return np.bincount(CLASS[buf], minlength=N_CLASSES + 1)[:N_CLASSES]


def _corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch and language the counts of classes (kind 1) and of word hashes (kind 0)."""
    for batch in batches:
        sums: dict = {}
        langs = batch.column(0).to_pylist()
        for lo, buf, off in T.slices(batch.column(1)):
            h, _, _, first = T.words(buf, off, T.NON_SPACE, lower=True)
            for k in range(len(off) - 1):
                classes, words = sums.setdefault(langs[lo + k], (np.zeros(N_CLASSES, np.int64), []))
                classes += _class_counts(buf[off[k] : off[k + 1]])
                words.append(h[first[k] : first[k + 1]])
        for lang, (classes, words) in sums.items():
            key, n = np.unique(np.concatenate(words), return_counts=True)
            m = len(key) + N_CLASSES
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * m, pa.string()),
                    pa.array(np.concatenate([np.zeros(len(key), np.int32), np.ones(N_CLASSES, np.int32)])),
                    pa.array(np.concatenate([key.view(np.int64), np.arange(N_CLASSES)])), pa.array(np.concatenate([n, classes]))
                ],
                names=["lang", "kind", "key", "n"],
            )


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """language -> (class shares, sorted hashes of common words, their shares), over all documents with a language.

    What reaches the driver is bounded: 9 classes and at most 500 words for each language.
    """
    sums = docs.filter("lang is not null and text is not null").select("lang", "text").mapInArrow(_corpus, "lang string, kind int, key long, n long")
    sums = stored(sums.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "quality-words")
    totals = sums.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    common = sums.join(F.broadcast(totals), ["lang", "kind"]).filter(f"kind = 1 or n >= {COMMON_SHARE} * total").select(
        "lang", "kind", "key", (F.col("n") / F.greatest("total", F.lit(1))).alias("share")
    )
    out: dict = {}
    for lang, kind, key, share in common.collect():
        out.setdefault(lang, ({}, {}))[0 if kind else 1][key] = share
    made = {}
    for lang, (classes, words) in sorted(out.items()):
        p = np.array([classes.get(k, 0.0) for k in range(N_CLASSES)])
        keys = np.array(sorted(words), np.int64).view(np.uint64)
        keys.sort()
        made[lang] = (p, keys, np.array([words[int(k)] for k in keys.view(np.int64)]))
    return made


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence to base 2: 0 for equal distributions, 1 for disjoint ones."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.nansum(np.where(p > 0, p * np.log2(p / m), 0)) + np.nansum(np.where(q > 0, q * np.log2(q / m), 0))
    return float(np.sqrt(max(0.0, d / 2)))


def _repeated(h: np.ndarray) -> int:
    """Words in three-word windows that occur twice or more."""
    w = T.windows(h, 3)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(h), bool)
    both = order[np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))]
    for k in range(3):
        hit[both + k] = True
    return int(hit.sum())


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _judge(refs: dict):
    """For batches that begin with doc_id, text and lang, the verdicts of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(2).to_pylist()
            for lo, buf, off in T.slices(batch.column(1)):
                h, starts, ends, first = T.words(buf, off, T.NON_SPACE, lower=False)
                low = T.words(buf, off, T.NON_SPACE, lower=True)[0]
                chars = np.concatenate([[0], np.cumsum(T.NON_SPACE[buf] & (CLASS[buf] != 9))])
                symbols = np.concatenate([[0], np.cumsum(SYMBOLS[buf])])
                rows = []
                for k in range(len(off) - 1):
                    a, b, w = off[k], off[k + 1], slice(first[k], first[k + 1])
                    n = int(first[k + 1] - first[k])
                    repeated = _repeated(h[w])
                    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
                    classes = common = None
                    if refs and n >= MIN_COMPARED:
                        p = _class_counts(buf[a:b]).astype(float)
                        p /= p.sum()
                        lang = langs[lo + k]
                        tried = [lang] if lang in refs else list(refs)
                        both = []
                        for name in tried:
                            q, keys, share = refs[name]
                            at = np.searchsorted(keys, low[w])
                            at[at == len(keys)] = 0
                            found = keys[at] == low[w] if len(keys) else np.zeros(n, bool)
                            c = np.bincount(at[found], minlength=len(keys)) / n
                            rest = np.append(c, 1 - c.sum()), np.append(share, max(0.0, 1 - share.sum()))
                            both.append((js_distance(p, q), js_distance(*rest)))
                        classes, common = min(both, key=lambda x: (x[0] + x[1], x))
                    kept = not failed and (classes is None or (classes <= MAX_CLASS and common <= MAX_COMMON))
                    rows.append((
                        n, int(chars[b] - chars[a]), int(symbols[b] - symbols[a]), _dup_lines(buf[a:b].tobytes()), repeated, failed, kept,
                        classes, common
                    ))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(rows)).cast(pa.int64()),
                        *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))
                    ],
                    names=[
                        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "class_distance", "common_distance"
                    ]
                )

    return run


def quality_rules(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text, lang): base counts, base_failed, kept, class_distance, common_distance.

    kept: not base_failed, the distance of character classes at most MAX_CLASS and that of common words at most
    MAX_COMMON; both are null, and decide nothing, below MIN_COMPARED words. A document without a known language is
    compared with every reference and the nearest counts. A null or blank text has no words and fails; without any reference the base rule decides alone.
    Rows that repeat a doc_id each get a row. Other columns are ignored.
    """
    kind = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, common_distance double"
    return docs.select("doc_id", "text", "lang").mapInArrow(_judge(references(docs)), kind)


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; nothing is moved between tasks."""
    judge = _judge(references(docs))
    at = [docs.columns.index(c) for c in ("doc_id", "text", "lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(k) for k in at], names=["doc_id", "text", "lang"])
            kept = [x for verdict in judge(iter([own])) for x in verdict.column("kept").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
