"""The operators as registered queries over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import (
    byte_bpe, decontaminate, language, line_runs, mixing, near_dups, quality, ranked_search, secret_scan, sharding, spelling, tokens, warc
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of documents with score and verdict. Null and empty texts give no rows; a null source is an unknown path; repeated rows give theirs again."""
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: lines removed, their runs, and size and hash of what is left. A null text stays null; ties in doc_id are told apart by text."""
    out = line_runs.deduplicate_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.coalesce(F.aggregate("removed", F.lit(0), lambda n, r: n + r.end - r.start + 1), F.lit(0)).cast("long")
    return out.select(
        "doc_id", gone.alias("n_removed"), "removed", F.octet_length("text").cast("long").alias("kept_bytes"),
        F.sha2("text", 256).alias("kept_sha256")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, as the written shards hold them. Null texts are empty; repeated rows are dealt one by one."""
    docs = _table(spark, sf_dir, "documents")
    out = sharding.read_back(sharding.shard(docs, 16))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return out.select(
        "doc_id", sharding.text_size().alias("size"), crc, F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard")
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, read back from the WARC files. A null html is an empty payload; of equal ids with one payload all are responses."""
    out = warc.archived(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each whole document. A null or blank text has none; repeated rows each get a row."""
    import public_tokenizers  # here, so that the other queries don't need the folder of vocabulary files

    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items hit in each document. A null text has no words; items without words or id match nothing; equal ids are one item."""
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.drop("near_items")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and mixture of each document. Without text or letters und and 0; ties go to the first language by name."""
    return language.language_id(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of each document. A null or blank text has no words and fails; an unknown language takes the nearest reference."""
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rate and copies of each document. A null text has no tokens; without labels shares are equal; repeated rows each get a row."""
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and group of each document. Without words none and alone; a group is named by its least doc_id; a null doc_id takes its group's."""
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, pct=80)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 7 letters with their near words, form and root. A null text has no words; repeated rows count again."""
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"), least=7, times=2, ratio=10, noise=31)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item. A null text has no terms; repeated documents are ranked one by one."""
    return ranked_search.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each whole document and the bytes that they decode to, as digests. A null text is empty; repeated rows each get a row."""
    import public_tokenizers  # here, so that the other queries don't need the folder of vocabulary files

    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_secret_scan, op2_line_dedup, op3_sharding, op4_warc, op5_token_counts, op6_decontamination, op7_language_id, op8_quality_rules,
        op9_mixing, op10_near_duplicates, op11_spelling_variants, op12_ranked_search, op13_byte_bpe
    )}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
  FROM pages)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((((CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS INT), 5) AS BIGINT)) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM p
"""

OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[CAST(k AS INT):CAST(k + least(13, len(w)) - 1 AS INT)], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[CAST(k AS INT):CAST(k + n - 1 AS INT)], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, dw.n AS n, k FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN s ON d.doc_id = s.doc_id
"""

OP10_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[CAST(i AS INT):CAST(i + 3 AS INT)], ' '))
                               WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS id, doc_id AS seen FROM w UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

# crc32 byte by byte from a table that its polynomial gives; letters beyond ASCII are two bytes
OP11_SQL = f"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
b AS (
  SELECT run, n, flatten(list_transform(string_split(concat(doc_id, ':', run), ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) AS BIGINT) - 64] END)) AS bytes FROM r),
h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) AS h
  FROM b, tab),
w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN concat(left(run, CAST(h % length(run) AS INT)), substr(run, CAST(h % length(run) AS INT) + 2)) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
s AS (
  SELECT word, n, left(word, CAST(i AS INT) - 1) AS p, substr(word, CAST(i AS INT) + 1) AS q
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
e AS (
  SELECT a.word AS a, b.word AS b FROM s AS a JOIN s AS b ON a.p = b.p AND a.q = b.q AND a.word <> b.word
  UNION SELECT s.word, w.word FROM s JOIN w ON concat(s.p, s.q) = w.word
  UNION SELECT w.word, s.word FROM s JOIN w ON concat(s.p, s.q) = w.word),
m AS (
  SELECT e.a, count(*) AS n_near, arg_max(struct_pack(b := e.b, n := w.n), struct_pack(n := w.n, b := -k)) AS best
  FROM e JOIN (SELECT word, n, row_number() OVER (ORDER BY word) AS k FROM w) AS w ON w.word = e.b GROUP BY e.a),
f AS (SELECT w.word, best.b AS form, best.n AS form_n FROM w JOIN m ON m.a = w.word WHERE best.n >= 10 * w.n),
g AS (
  SELECT word, word AS last, 0 AS steps FROM w
  UNION ALL SELECT g.word, f.form, steps + 1 FROM g JOIN f ON f.word = g.last)
SELECT w.word, f.form, g.root, w.n, CAST(coalesce(m.n_near, 0) AS BIGINT) AS n_near, f.form_n
FROM w LEFT JOIN f ON f.word = w.word LEFT JOIN m ON m.a = w.word
JOIN (SELECT word, arg_max(last, steps) AS root FROM g GROUP BY word) AS g ON g.word = w.word
"""

OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM s),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
x AS (
  SELECT item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN t USING (term) JOIN s USING (r), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM x JOIN s USING (r) WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc": OP4_SQL, "op6_decontamination": OP6_SQL, "op10_near_duplicates": OP10_SQL, "op11_spelling_variants": OP11_SQL,
        "op12_ranked_search": OP12_SQL
    }
