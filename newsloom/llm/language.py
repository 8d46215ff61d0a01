"""Operator 7: language proportions of a text by expectation-maximisation over n-gram likelihoods.

Byte trigrams of letters (digits and punctuation count as a blank) are counted in hashed buckets for each language over
all labelled training documents. A document is a mixture of languages: EM estimates the proportions. It starts with all
learned languages, the least one goes step by step, and of the sets on the way that with the best likelihood after a
penalty for each language (Bayesian information criterion) is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import textnum as T

BITS = 15  # 2**BITS buckets of trigrams; a model has as many floats for each language
SMOOTH = 0.2
CLOSE = 1e-4  # EM ends when no proportion moves by more


def _letters() -> np.ndarray:
    m = np.full(256, 32, np.uint8)
    m[0x80:] = np.arange(0x80, 0x100)
    m[97:123] = np.arange(97, 123)
    m[65:91] = np.arange(97, 123)
    return m


LETTER = _letters()


def _trigrams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the trigram at each byte (two less than bytes), and whether it counts."""
    m = LETTER[buf]
    if len(m) < 3:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    a, b, c = m[:-2].astype(np.uint32), m[1:-1].astype(np.uint32), m[2:].astype(np.uint32)
    code = ((a << np.uint32(16)) | (b << np.uint32(8)) | c) * np.uint32(2654435761)
    return (code >> np.uint32(32 - BITS)).astype(np.int64), (b != 32) & ((a != 32) | (c != 32))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        langs = batch.column(0).to_pylist()
        for lo, buf, off in T.slices(batch.column(1)):
            code, ok = _trigrams(buf)
            for k in range(len(off) - 1):
                span = slice(off[k], max(off[k], off[k + 1] - 2))
                own = sums.setdefault(langs[lo + k], np.zeros(1 << BITS, np.int64))
                own += np.bincount(code[span][ok[span]], minlength=1 << BITS) if off[k + 1] - off[k] > 4000 else 0
                if off[k + 1] - off[k] <= 4000:
                    np.add.at(own, code[span][ok[span]], 1)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of the buckets in each) from labelled (lang, text); rows without either are left out.

    The counts are summed on the cluster; the driver gets 2**BITS numbers at most for each language.
    """
    rows = labelled.select("lang", "text").filter("lang is not null and text is not null").mapInArrow(_counts, "lang string, bucket long, n long")
    got = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got.lang.unique())
    n = np.zeros((1 << BITS, len(langs)))
    for k, lang in enumerate(langs):
        own = got[got.lang == lang]
        n[own.bucket.to_numpy(), k] = own.n.to_numpy()
    p = (n + SMOOTH) / (n.sum(axis=0) + SMOOTH * (1 << BITS)) if langs else n
    return langs, np.log(p).astype(np.float32)


def _em(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of a mixture of the columns of p, for counts c; each round raises the likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = c.sum()
    while True:
        moved = share * ((c / (p @ share)) @ p) / total
        done = np.abs(moved - share).max() < CLOSE
        share = moved
        if done:
            return share, float(c @ np.log(p @ share))


def penalty(c: np.ndarray) -> float:
    """What each further language costs; neighbouring trigrams overlap, so that three count as one observation."""
    return 0.5 * float(np.log(max(2.0, c.sum() / 3)))


def mixture(log_p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, proportions) of the selected languages for bucket counts c and their rows of log probabilities.

    Of equal likelihoods the first language counts.
    """
    alone = c @ log_p
    best, best_score, share = np.array([int(np.argmax(alone))]), float(alone.max()), np.ones(1)
    p = np.exp(log_p.astype(np.float64))
    chosen, cost = np.arange(log_p.shape[1]), penalty(c)
    while len(chosen) > 1:
        s, likelihood = _em(p[:, chosen], c)
        if likelihood - cost * (len(chosen) - 1) > best_score:
            best, best_score, share = chosen, likelihood - cost * (len(chosen) - 1), s
        chosen = np.delete(chosen, int(np.argmin(s)))
    return best, share


def _has_letter(raw: bytes) -> bool:
    return any(x.isalpha() for x in raw.decode())


def _predict(langs: list[str], log_p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, buf, off in T.slices(batch.column(1)):
                code, ok = _trigrams(buf)
                ascii_letters = np.concatenate([[0], np.cumsum((LETTER[buf] != 32) & (buf < 128))])
                named, score, sets, shares = [], [], [], []
                for k in range(len(off) - 1):
                    a, b = off[k], off[k + 1]
                    if not langs or not (ascii_letters[b] > ascii_letters[a] or _has_letter(buf[a:b].tobytes())):
                        named.append("und"), score.append(0.0), sets.append([]), shares.append([])
                        continue
                    span = slice(a, max(a, b - 2))
                    u, c = np.unique(code[span][ok[span]], return_counts=True)
                    if len(u) == 0:  # one or two letters: the languages' own shares decide nothing, the first is taken
                        named.append(langs[0]), score.append(1 / len(langs)), sets.append([langs[0]]), shares.append([1 / len(langs)])
                        continue
                    who, share = mixture(log_p[u], c.astype(np.float64))
                    top = int(np.argmax(share))
                    named.append(langs[who[top]]), score.append(float(min(1.0, max(0.0, share[top]))))
                    sets.append([langs[x] for x in who]), shares.append([float(x) for x in share])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(named)).cast(pa.int64()), pa.array(named, pa.string()), pa.array(score, pa.float64()),
                        pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))
                    ],
                    names=["doc_id", "lang_pred", "score", "languages", "proportions"],
                )

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score, languages, proportions) for each row of docs (doc_id, text).

    languages are the selected set and proportions their shares; lang_pred is the largest (of equal ones the first by
    name) and score its share. A null text, one without a letter, or an empty model gives `und` and 0; a text with letters
    but no trigram that counts gives the first language by name and equal shares. Whole texts are used; other columns
    never are. Rows that repeat a doc_id each get a row; an empty table gives an empty result.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _predict(*model), "doc_id long, lang_pred string, score double, languages array<string>, proportions array<double>"
    )


def fold() -> F.Column:
    """The held-out rule: CRC-32 of the doc_id as text, modulo 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents outside the held-out fold and predict all: doc_id, held_out, lang_pred, score, ...

    A null doc_id is in no fold: not learned from, and not held out.
    """
    model = fit(docs.filter(fold() != 0))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages", "proportions")
