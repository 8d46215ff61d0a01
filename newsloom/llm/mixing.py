"""Operator 9: mixing to target weights by soft membership, DataFrame and JVM ML operations only.

A multinomial logistic regression on the labels table gives each document posteriors of the domains. Nonnegative rates
r are then fitted to min |sum_d r_d t_d p_d - T|^2 (t tokens, p posteriors, T target token totals) by projected
gradient steps from r = 1: r_d <- max(0, r_d - p_d . g). All rates move by one small vector g, so an iteration is one
aggregation of a few sums for each of several g at once: the residual over the largest curvature, which is the gradient
in the norm that weighs a document by its tokens and always descends, and the residual times the inverse of
sum t p p' over documents whose rate is not 0, whole and in parts, which is mostly faster. The g that leaves the least
squared residual is taken. Rates are an expression of p and the steps; nothing is kept between iterations.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from typing import NamedTuple

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored

TARGETS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}
SAMPLE = 10_000  # labelled documents to fit the classifier on, about; all where there are fewer
FEATURES = 1 << 12
CLOSE = 1e-7  # of all tokens: a residual that needs no more steps
GAIN = 1e-2  # of the squared residual: steps end when the best of them gains less


def domain() -> F.Column:
    """The domain of a row of labels."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def n_tokens() -> F.Column:
    """Words of the text: runs of other than white space."""
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def featured(docs: DataFrame) -> DataFrame:
    """_row, the rows of docs as they are, with the columns that the classifier reads, _tokens and _u, a seeded uniform number."""
    out = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    share = lambda kept: F.length(F.regexp_replace(text, kept, "")) / chars
    out = out.withColumns({
        "_words": F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != ""), "_tokens": n_tokens(),
        "_u": F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    })
    return out.withColumns({
        "_symbols": 5 * share(r"[^#*$%&|<>!]+"), "_upper": share(r"[^A-Z]+"), "_short": F.least(F.lit(1.0), 20.0 / (1 + F.col("_tokens")))
    }).drop("text")


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7):
    """(fitted pipeline or None, domains in the order of its probabilities).

    Fitted on about sample labelled documents, taken by a seeded hash of doc_id and written down once. Labels with nulls
    or of absent documents are left out, and of repeated labels of a document the greatest domain name counts. None
    where fewer than two domains are labelled.
    """
    named = labels.select("doc_id", domain().alias("_domain")).filter("doc_id is not null and _domain is not null").groupBy("doc_id").agg(F.max("_domain").alias("_domain"))
    n = named.count()
    named = named.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(named), "doc_id")  # about sample rows are broadcast
    train = stored(featured(rows).select("_row._domain", "_words", "_symbols", "_upper", "_short"), "mixing-train")
    found = sorted(r[0] for r in train.select("_domain").distinct().collect())
    if len(found) < 2:
        return None, found
    train = train.withColumn("_label", F.array_position(F.array(*map(F.lit, found)), F.col("_domain")).cast("double") - 1)
    stages = [
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=FEATURES), Normalizer(inputCol="_tf", outputCol="_norm"), VectorAssembler(
            inputCols=["_norm", "_symbols", "_upper", "_short"], outputCol="_features"
        ),
        LogisticRegression(
            featuresCol="_features", labelCol="_label", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_hard", regParam=1e-4,
            maxIter=40, family="multinomial"
        ),
    ]
    return Pipeline(stages=stages).fit(train), found


def with_posteriors(docs: DataFrame, model, found: list[str], domains: list[str]) -> DataFrame:
    """(_row, doc_id, _tokens, _u, p_<domain>...) for each row of docs; equal shares where there is no model."""
    out = featured(docs)
    if model is None:
        return out.select("_row", "doc_id", "_tokens", "_u", *(F.lit(1.0 / len(domains)).alias(f"p_{d}") for d in domains))
    p = vector_to_array("_p")
    share = {d: p[found.index(d)] if d in found else F.lit(0.0) for d in domains}
    return model.transform(out).select("_row", "doc_id", "_tokens", "_u", *(share[d].alias(f"p_{d}") for d in domains))


def rate(domains: list[str], steps: list[np.ndarray]) -> F.Column:
    """A document's rate after the steps; they are one literal, so that the expression is the same for any number of them."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*(F.array(*(F.lit(float(x)) for x in g)) for g in steps))

    def move(r: F.Column, g: F.Column) -> F.Column:
        for k, d in enumerate(domains):
            r = r - F.get(g, F.lit(k)) * F.col(f"p_{d}")
        return F.greatest(F.lit(0.0), r)

    return F.aggregate(moves, F.lit(1.0), move)


class Fit(NamedTuple):
    steps: list[np.ndarray]
    residual: dict[str, float]  # of each domain, its expected less its target tokens, as a share of all tokens


def fit_rates(posteriors: DataFrame, targets: dict[str, float]) -> Fit:
    """The steps g of projected gradient descent; see the module's text. posteriors: _tokens and p_<domain> columns.

    Each step lowers the squared residual. They end when it is CLOSE to 0 or the best step gains less than GAIN of it:
    with targets that no nonnegative rates reach, the residual that is returned is near the least one.
    """
    domains = sorted(targets)
    weight = np.array([targets[d] for d in domains]) / sum(targets.values())
    pairs = list(combinations_with_replacement(range(len(domains)), 2))
    p, t = [F.col(f"p_{d}") for d in domains], F.col("_tokens").cast("double")
    r = F.col("_rate")
    sums = [
        F.sum(t).alias("all"), *(F.sum(r * t * x).alias(f"s{k}") for k, x in enumerate(p)),
        *(F.sum(F.when(r > 0, t * p[i] * p[j]).otherwise(0.0)).alias(f"g{i}_{j}") for i, j in pairs),
        *(F.sum(t * p[i] * p[j]).alias(f"h{i}_{j}") for i, j in pairs)
    ]

    def tried(choices: list[list[np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
        """(all tokens, residual, curvature of rates over 0, of all) after each choice of steps, in one pass."""
        rates = F.array(*(rate(domains, c) for c in choices))
        rows = posteriors.select("_tokens", *p, F.posexplode(rates).alias("_choice", "_rate")).groupBy("_choice").agg(*sums).collect()
        out = []
        for row in sorted(rows):
            total = row["all"] or 0.0
            square = np.zeros((2, len(p), len(p)))
            for i, j in pairs:
                square[0, i, j] = square[0, j, i] = row[f"g{i}_{j}"] or 0.0
                square[1, i, j] = square[1, j, i] = row[f"h{i}_{j}"] or 0.0
            out.append((total, np.array([row[f"s{k}"] or 0.0 for k in range(len(p))]) - weight * total, *square))
        return out

    steps: list[np.ndarray] = []
    state = next(iter(tried([steps])), None)
    while state and state[0] and np.abs(state[1]).max() >= CLOSE * state[0]:
        total, short, active, whole = state
        fast = np.linalg.solve(active + np.eye(len(p)) * (1e-9 * np.trace(active) + 1e-12), short)
        sure = short / max(np.linalg.eigvalsh(whole)[-1], 1e-12)
        moves = [fast, fast / 4, fast / 16, fast / 64, sure, 8 * sure, 64 * sure]
        after = tried([[*steps, g] for g in moves])
        best = min(range(len(after)), key=lambda k: after[k][1] @ after[k][1])
        if after[best][1] @ after[best][1] > (1 - GAIN) * (short @ short):
            break
        steps.append(moves[best])
        state = after[best]
    left = state[1] / state[0] if state and state[0] else np.zeros(len(p))
    return Fit(steps, dict(zip(domains, map(float, left), strict=True)))


def copies(r: F.Column) -> F.Column:
    """The whole number of copies with expectation r, by the row's uniform number _u."""
    return (F.floor(r) + (F.col("_u") < r - F.floor(r)).cast("int")).cast("int")


def plan(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, whole: bool = False) -> tuple[DataFrame, Fit]:
    """(table of doc_id, _tokens, posteriors, _u, with whole also _row; the fitted steps). Posteriors are inferred once."""
    model, found = fit_classifier(docs, labels)
    known = with_posteriors(docs if whole else docs.select("doc_id", "text"), model, found, sorted(targets))
    known = stored(known if whole else known.drop("_row"), "mixing")
    return known, fit_rates(known, targets)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>..., rate, copies) for each row of docs (doc_id, text).

    Target weights are shares of all tokens of docs. A null or empty text has no tokens and any rate; targets that no
    nonnegative rates reach are met as nearly as the steps get. An empty table gives an empty result. Rows that repeat
    a doc_id each get a row; other columns are ignored.
    """
    known, fit = plan(docs, labels, targets)
    out = known.withColumn("rate", rate(sorted(targets), fit.steps))
    return out.select(
        "doc_id", F.col("_tokens").alias("n_tokens"), *(f"p_{d}" for d in sorted(targets)), "rate", copies(F.col("rate")).alias("copies")
    )


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """The rows of docs with all their columns, each as often as its copies: the corpus whose expected domain totals meet the targets."""
    known, fit = plan(docs, labels, targets, whole=True)
    out = known.withColumn("_rate", rate(sorted(targets), fit.steps)).withColumn("_copies", copies(F.col("_rate"))).filter("_copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")
