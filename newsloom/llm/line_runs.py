"""Operator 2: repeated line runs by a suffix array over line ids, DataFrame functions only.

Lines that hold a word are numbered through each document, and those that occur once in the corpus cut a document into
segments, since no repeated run can cross them. Prefix doubling ranks the suffixes of all segments: after round k a
suffix's rank is the place in the suffix array of the first suffix with the same 2**k lines, written as the hash of the
first line and an offset inside that line's bucket, so that ranks are made bucket by bucket and not by one global sort.
Suffixes with equal ranks are an interval of the array with a common prefix of 2**k lines; for any other length two
overlapping ranks name the interval. Each interval of two or more suffixes whose common prefix has MIN_WORDS words is a
repeated run: its first occurrence stays and the others' lines are deleted.

Every deleted line lies in a repeated run that is shortest from its first line, or ends one that is shortest from its
last line. Such runs have MIN_WORDS lines at most after their first, so that doubling ends after log2(MIN_WORDS)
rounds, and a line asks for two intervals, whatever the length of the maximal run they belong to.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored
from newsloom.llm.names import unused

MIN_WORDS = 50
HOT = 1000  # copies of a line from which it is looked up in a table of its own
WORD = r"[^\x20\x09-\x0D]+"


def _documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, _doc): equal rows have the same _doc."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(1)).alias("_doc"))


def words_of(x: Column) -> Column:
    """Words of a line. Most lines hold single spaces and no other blanks: there, words are counted by spaces, not by the pattern."""
    odd = x.startswith(" ") | x.endswith(" ") | (x == "")
    for blank in ("  ", "\t", "\v", "\f", "\r"):
        odd = odd | x.contains(blank)
    spaces = F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))
    return F.when(odd, F.regexp_count(x, F.lit(WORD))).otherwise(spaces + 1)


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that holds a word: doc_id, _doc, line (0-based), number (among such lines), h, h2, words."""
    each = _documents(docs).filter("text is not null")
    parts = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("h2"), words_of(x).alias("words"))
    )
    full = each.select("doc_id", "_doc", F.filter(parts, lambda x: x.words > 0).alias("_parts"))
    return full.select("doc_id", "_doc", F.posexplode("_parts").alias("number", "_p")).select("doc_id", "_doc", "number", "_p.*")


def _once(docs: DataFrame) -> DataFrame:
    """The lines of docs, those of equal rows once."""
    lines = stored(_lines(docs), "line-ids")
    again = _documents(docs).groupBy("_doc").agg(F.count("*").alias("n")).filter("n > 1").select("_doc")
    again = stored(again, "line-repeated-rows")  # written, so that Spark knows how small it is
    return lines.join(again, "_doc", "left_anti").unionByName(lines.join(again, "_doc", "left_semi").dropDuplicates(["_doc", "number"]))


def _segments(docs: DataFrame) -> DataFrame:
    """The lines that occur twice or more, with their segment: the number of the first line of it.

    Lines that occur more than HOT times are looked up apart: their table is small, and no task gets all rows of one.
    """
    lines = _once(docs)
    often = stored(lines.groupBy("h", "h2").agg(F.count("*").alias("n")).filter("n > 1"), "line-counts")
    hot = stored(often.filter(F.col("n") > HOT).select("h", "h2"), "line-hot")
    kept = lines.join(hot, ["h", "h2"], "left_semi").unionByName(lines.join(hot, ["h", "h2"], "left_anti").join(often.select("h", "h2"), ["h", "h2"], "left_semi"))
    order = Window.partitionBy("_doc").orderBy("number")
    return kept.withColumn("segment", F.col("number") - F.row_number().over(order))


def _doubled(rows: DataFrame, k: int) -> DataFrame:
    """rows with o<k+1>: the offset, in the bucket of the first line, of the first suffix with the same 2**(k+1) lines.

    Suffixes are ordered by their rank of 2**k lines and then by that of the 2**k lines that follow; one that ends
    before comes first and its rank, at this length, names no run.
    """
    order = Window.partitionBy("_doc", "segment").orderBy("number")
    nxt = rows.withColumns({"nh": F.lead("h", 2**k).over(order), "nh2": F.lead("h2", 2**k).over(order), "no": F.lead(f"o{k}", 2**k).over(order)})
    # pairs are counted in each task before anything is moved: a line in a third of all documents gives few of them
    pairs = nxt.groupBy("h", "h2", f"o{k}", "nh", "nh2", "no").agg(F.count("*").alias("n"))
    below = Window.partitionBy("h", "h2", f"o{k}").orderBy("nh", "nh2", "no").rowsBetween(Window.unboundedPreceding, -1)
    ranked = pairs.withColumn(f"o{k + 1}", F.col(f"o{k}") + F.coalesce(F.sum("n").over(below), F.lit(0))).drop("n")
    ranked = ranked.select(*(F.col(c).alias(f"_{c}") for c in ("h", "h2", f"o{k}", "nh", "nh2", "no")), f"o{k + 1}")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("h", "h2", f"o{k}", "nh", "nh2", "no")]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return nxt.join(ranked, on).drop("nh", "nh2", "no", *(f"_{c}" for c in ("h", "h2", f"o{k}", "nh", "nh2", "no")))


def suffix_ranks(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, int]:
    """(rows with offsets o0, o1, ..., the number of rounds), written to the shared folder."""
    rounds = max(1, math.ceil(math.log2(min_words + 2)))
    rows = stored(_segments(docs).withColumn("o0", F.lit(0).cast("long")), "line-segments")
    for k in range(rounds):
        rows = _doubled(rows, k)
        if k % 2:
            rows = stored(rows, "line-ranks")
    return rows, rounds


def _intervals(rows: DataFrame, rounds: int, min_words: int) -> DataFrame:
    """A row for each shortest run of min_words words: its lines and the interval of the suffix array that it is in."""
    part = Window.partitionBy("_doc", "segment")
    order = part.orderBy("number")
    before = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"before": before, "upto": before + F.col("words"), "at": F.row_number().over(order) - 1})
    rows = rows.withColumns({"whole": F.sum("words").over(part), "last": F.count("*").over(part)})
    starts = part.orderBy("before")
    stops = part.orderBy("upto")
    # forward: [at, end), the first end with enough words; backward: [start, at], the last start with enough
    end = F.coalesce(
        F.min("at").over(starts.rangeBetween(min_words, Window.unboundedFollowing)),
        F.when(F.col("whole") - F.col("before") >= min_words, F.col("last"))
    )
    start = F.coalesce(F.max("at").over(stops.rangeBetween(Window.unboundedPreceding, -min_words)) + 1, F.when(F.col("upto") >= min_words, F.lit(0)))
    rows = rows.withColumns({"end": end.cast("int"), "start": start.cast("int")})
    offsets = [f"o{k}" for k in range(rounds + 1)]
    held = F.struct("at", "end", "start", "number", "line", "h", "h2", F.array(*offsets).alias("o"))
    whole = rows.groupBy("doc_id", "_doc", "segment").agg(F.array_sort(F.collect_list(held)).alias("s"))

    def name(a: Column, b: Column) -> Column:
        """The interval of lines [a, b): two overlapping ranks of the longest power of two within it."""
        n = b - a
        k = F.floor(F.log2(n.cast("double") + 0.5)).cast("int")
        x, y = F.get("s", a), F.get("s", b - F.pow(F.lit(2.0), k).cast("int"))
        return F.struct(
            a.alias("a"), b.alias("b"), n.alias("n"), x.h.alias("h"), x.h2.alias("h2"), F.get(x.o, k).alias("p"), y.h.alias("g"),
            y.h2.alias("g2"), F.get(y.o, k).alias("q")
        )

    ahead = F.transform(F.filter("s", lambda x: x.end.isNotNull()), lambda x: name(x["at"], x.end))
    back = F.transform(F.filter("s", lambda x: x.start.isNotNull()), lambda x: name(x.start, x["at"] + 1))
    both = whole.select(
        "doc_id", "_doc", F.transform("s", lambda x: x.line).alias("lines"), F.col("segment").alias("segment"),
        F.explode(F.array_distinct(F.concat(ahead, back))).alias("run")
    )
    return both.select("doc_id", "_doc", "segment", "run.*", F.slice("lines", F.col("run.a") + 1, F.col("run.n")).alias("lines"))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(_doc, lines): 0-based numbers of the lines to delete, sorted, for documents that have any."""
    rows, rounds = suffix_ranks(docs, min_words)
    runs = stored(_intervals(rows, rounds, min_words), "line-runs")
    key = ["n", "h", "h2", "p", "g", "g2", "q"]
    place = F.struct(F.col("doc_id"), F.col("_doc"), F.element_at("lines", 1).alias("line"))
    first = runs.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    copies = runs.join(first, key).filter(place != F.col("first"))
    return copies.select("_doc", F.explode("lines").alias("line")).groupBy("_doc").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _runs(lines: Column) -> Column:
    """Sorted line numbers as runs of (start, end), both included."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last.start.alias("start"), x.cast("int").alias("end"))))
        return F.when(
            F.size(acc) == 0, F.array(F.struct(x.cast("int").alias("start"), x.cast("int").alias("end")))
        ).when(last.end == x - 1, joined).otherwise(F.concat(acc, F.array(F.struct(x.cast("int").alias("start"), x.cast("int").alias("end")))))

    return F.aggregate(lines, empty, add)


def deduplicate_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text, ...) with removed, the runs of deleted lines (start, end; 0-based), and the text without them.

    A run of lines is deleted where the same lines, with min_words words or more together, stand earlier: in an earlier
    line of the document or in a document with a smaller doc_id (null first). Lines without a word neither count nor
    break a run, and stay. A null text stays null; an empty one and one without repeats stay as they are. Equal rows are
    one document and get the same result; a column removed of docs is replaced; rows with one doc_id and different texts are different documents. An
    earlier copy may overlap the run: of one line over and over, the first stays. What is deleted always stands earlier.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "removed"])
    (key,) = unused(docs, "_key")
    found = later_copies(docs, min_words).select(F.col("_doc").alias(key), _runs(F.col("lines")).alias("removed"))
    joined = docs.withColumn(key, F.xxhash64("doc_id", "text", F.lit(1))).join(found, key, "left").drop(key)
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.exists("removed", lambda r: (i >= r.start) & (i <= r.end)))
    return joined.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
