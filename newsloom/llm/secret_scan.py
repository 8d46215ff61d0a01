"""Operator 1: secret scan with a random forest against false positives, DataFrame and JVM ML operations only.

Patterns propose candidates in whole texts. Each is described by its length, its changes of character class, the share
of it that is words of the corpus, the path it stands in and the words around it; a random forest trained on labelled
findings decides which are secrets.
"""

from __future__ import annotations

from math import ceil

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored

SAMPLE = 20_000  # labelled findings to train on, about; all where there are fewer
SHARE = 1e-4  # of all documents, those that a word of the dictionary occurs in; three at least
CONTEXT = 40  # characters before and after a candidate
KEYWORD = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential)"
ASSIGN = KEYWORD + r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: One alternation: keys with a known prefix, key files, assignments, long mixed tokens (a token's digits may come late).
CANDIDATE = (
    r"\bAKIA[0-9A-Z]{16}\b"
    r"|\b(?:ghp_|gho_|xox[abp]-|sk-|eyJ)[A-Za-z0-9_.-]{16,}"
    r"|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    rf"|{ASSIGN}[^\s\"',;]{{6,}}"
    r"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{16,}+"
)
FEATURES = [
    "length", "changes", "distinct", "digits", "upper", "symbols", "hex", "coverage", "in_path", "in_address", "keyword_before", "assigned",
    "quoted", "reference_before"
]
USER = r"://(?:[^\s/@:]{0,40}:)?$"  # before a token or password that a URL gives before its host
REFERENCE = r"(?i)(?:commit|sha\d*|md5|hash|uuid|checksum|card|phone|tel|order|invoice|isbn|example|sample|dummy|placeholder)\W{0,4}$"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, start, secret, matched_keyword, before, after) of each candidate, in whole texts.

    start counts characters from 0. path is the document's source.
    """
    found = docs.select(
        "doc_id", F.col("source").alias("path"), "text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("m")
    ).filter("size(m) > 0")
    found = found.withColumn("gaps", F.split("text", CANDIDATE, -1)).drop("text").withColumn("_doc", F.monotonically_increasing_id())
    each = found.select(
        "doc_id", "path", "_doc",
        F.posexplode(F.transform(
            "m",
            lambda x, i: F.struct(
                x.alias("match"), F.length(F.get("gaps", i)).alias("gap"), F.right(F.get("gaps", i), F.lit(CONTEXT)).alias("before"),
                F.left(F.get("gaps", i + 1), F.lit(CONTEXT)).alias("after")
            )
        )).alias("at", "c")
    )
    order = Window.partitionBy("_doc").orderBy("at")  # over the candidates of one text
    rows = each.select("doc_id", "path", "_doc", "at", "c.*").withColumns({
        "gap": F.sum("gap").over(order), "prior": F.sum(F.length("match")).over(order) - F.length("match")
    })
    head = F.regexp_extract("match", rf"^{ASSIGN}(?=[^\s\"',;]{{6,}})", 0)
    return rows.withColumn("head", head).select(
        "doc_id", "path", (F.col("gap") + F.col("prior") + F.length("head")).cast("long").alias("start"),
        F.expr("substring(match, length(head) + 1)").alias("secret"), F.concat("before", "head").alias("before"), "after",
    )


def _chunks() -> Column:
    """Runs of three letters or more in the candidate, lower-cased."""
    return F.filter(F.split(F.lower("secret"), "[^a-z]+"), lambda w: F.length(w) >= 3)


def dictionary(docs: DataFrame) -> DataFrame:
    """(word): words of three letters a-z or more in at least SHARE of all documents, over whole texts without their candidates."""
    least = max(3, ceil(SHARE * docs.count()))
    words = F.regexp_extract_all(F.lower(F.regexp_replace("text", CANDIDATE, " ")), F.lit(r"(?<![\p{L}\p{N}])[a-z]{3,}+(?![\p{L}\p{N}])"), F.lit(0))
    return docs.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").count().filter(F.col("count") >= least).select("word")


def featured(found: DataFrame, docs: DataFrame) -> DataFrame:
    """found, the candidates of docs, with an _id and the columns FEATURES.

    Coverage is the share of the candidate's characters in runs of letters that are words of the dictionary of docs.
    """
    found = stored(found.withColumn("_id", F.monotonically_increasing_id()), "secret-candidates")
    covered = found.select("_id", F.explode(_chunks()).alias("word")).join(dictionary(docs), "word").groupBy("_id").agg(F.sum(F.length("word")).alias("covered"))
    n = F.length("secret")
    share = lambda other: F.length(F.regexp_replace("secret", other, "")) / n
    shape = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace("secret", r"[^A-Za-z0-9]", "-"), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"
    )
    flag = lambda column, pattern: F.col(column).rlike(pattern).cast("double")
    login = F.greatest(
        flag("before", USER), flag("before", ":$") * flag("secret", "^//[^/]+$")
    ) * flag("after", r"^@\w")  # a bare login takes the slashes with it
    return found.join(covered, "_id", "left").withColumns({
        "length": n.cast("double"),
        "changes": (F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) - 1) / n,
        "distinct": F.size(F.array_distinct(F.split("secret", ""))) / n,
        "digits": share("[^0-9]"),
        "upper": share("[^A-Z]"),
        "symbols": share("[A-Za-z0-9]"),
        "hex": flag("secret", "^[0-9a-f]+$"),
        "coverage": F.coalesce(F.col("covered"), F.lit(0)) / n,
        "in_path": F.greatest(flag("before", r"[/\\]$") * (1 - login), F.coalesce(flag("path", r"[/\\](?:test|example|sample|doc)"), F.lit(0.0))),
        "in_address": F.greatest(flag("before", r"[@.]$"), flag("after", r"^[@.]\w")) * (1 - login),
        "keyword_before": F.greatest(flag("before", KEYWORD + r"\W{0,8}$"), login),
        "assigned": F.greatest(flag("before", r"[=:]\s{0,3}[\"']?$"), login),
        "quoted": flag("before", r"[\"']$"),
        "reference_before": flag("before", REFERENCE),
    }).drop("covered")


def labelled(found: DataFrame) -> DataFrame:
    """found with is_secret by provenance: 1 for provider keys and values assigned to a secret's name or given as a URL's
    login, 0 for numbers, repeated characters, placeholders and references, and, unless they are such values, for parts of
    addresses and of paths and for ordinary words; the others, bare tokens among them, are not labelled and left out.

    Stands in for reviewed findings where a caller has none.
    """
    value = F.col("secret")
    fake = value.rlike(r"^[0-9 -]+$") | value.rlike(r"(?i)example|placeholder|changeme|your[_-]|xxxx|dummy") | value.rlike(r"^(.)\1+$") | (F.col("reference_before") == 1)
    real = value.rlike(r"^(?:AKIA[0-9A-Z]{16}|(?:ghp_|gho_|xox[abp]-|sk-|eyJ).{16,}|-----BEGIN .*)$") | ((F.col("keyword_before") == 1) & (F.col("assigned") == 1) & value.rlike("[0-9]") & (F.length(value) >= 8))
    part = (F.col("in_address") == 1) | F.col("before").rlike(r"[/\\]$") & ~F.col("before").rlike(USER) | (F.col("coverage") >= 0.6)
    return found.withColumn("is_secret", F.when(fake, 0).when(real, 1).when(part, 0)).filter("is_secret is not null")


def fit_forest(findings: DataFrame, sample: int = SAMPLE, seed: int = 11):
    """A random forest on about sample labelled findings (FEATURES, is_secret); None unless both labels occur."""
    n = {r[0]: r[1] for r in findings.groupBy("is_secret").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    rate = min(1.0, sample / sum(n.values()))
    rows = findings.filter(F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rows).select(
        "_features", F.col("is_secret").cast("double").alias("is_secret")
    )
    return RandomForestClassifier(featuresCol="_features", labelCol="is_secret", numTrees=20, maxDepth=6, seed=seed).fit(rows)


def _scored(model, found: DataFrame) -> DataFrame:
    return model.transform(VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(found)).withColumn("score", vector_to_array("probability")[1])


def evaluate(docs: DataFrame, findings: DataFrame, share: float = 0.3, limit: float = 0.5, seed: int = 11) -> DataFrame:
    """(judge, findings, secrets, precision, recall) on held-out reviewed findings (doc_id, start, is_secret), for the forest
    and for the rule of labelled() apart.

    About share of the documents are held out with all their findings; the forest learns from those of the others. The rule
    takes what it doesn't label for no secret. Precision is null where nothing is kept, recall without secrets. Findings that
    are no candidates are not counted. No rows where the forest can't be fitted for want of one of the labels.
    """
    reviewed = findings.groupBy("doc_id", "start").agg(F.max("is_secret").alias("is_secret"))
    found = stored(featured(candidates(docs), docs), "secret-features")
    held = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 20)) < int(share * (1 << 20))
    known = found.join(reviewed, ["doc_id", "start"])
    model = fit_forest(known.filter(~held), seed=seed)
    if model is None:
        return docs.sparkSession.createDataFrame([], "judge string, findings long, secrets long, precision double, recall double")
    test = stored(_scored(model, known.filter(held)).select("_id", "is_secret", (F.col("score") >= limit).alias("forest")), "secret-held-out")
    rule = labelled(found).select("_id", (F.col("is_secret") == 1).alias("rule"))
    both = test.join(rule, "_id", "left").withColumn("rule", F.coalesce("rule", F.lit(False)))
    each = both.select("is_secret", F.explode(F.array(
        F.struct(F.lit("forest").alias("judge"), F.col("forest").alias("kept")), F.struct(F.lit("rule").alias("judge"), F.col("rule").alias("kept"))
    )).alias("x")).select("is_secret", "x.*")
    true = F.count_if(F.col("kept") & (F.col("is_secret") == 1))
    return each.groupBy("judge").agg(
        F.count("*").alias("findings"), F.count_if(F.col("is_secret") == 1).alias("secrets"),
        F.try_divide(true, F.count_if("kept")).alias("precision"), F.try_divide(true, F.count_if(F.col("is_secret") == 1)).alias("recall")
    )


def scan(docs: DataFrame, findings: DataFrame | None = None, limit: float = 0.5) -> DataFrame:
    """Each candidate: doc_id, path, start, n_chars, secret_sha256, score, kept.

    findings, where given, are reviewed candidates (doc_id, start, is_secret) that the forest learns from; else the rule
    of labelled() does. score is the forest's probability; kept: score of limit or more. Without both labels the score is
    1 and all candidates stay. Null and empty texts have no candidates; a null source is an unknown path. Rows that
    repeat a document give its candidates again.
    """
    found = stored(featured(candidates(docs), docs), "secret-features")  # read by every pass of the forest
    known = labelled(found) if findings is None else found.join(
        findings.groupBy("doc_id", "start").agg(F.max("is_secret").alias("is_secret")), ["doc_id", "start"]
    )
    model = fit_forest(known)
    if model is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        scored = _scored(model, found)
    return scored.select(
        "doc_id", "path", "start", F.length("secret").cast("long").alias("n_chars"), F.sha2("secret", 256).alias("secret_sha256"), "score",
        (F.col("score") >= limit).alias("kept")
    )
