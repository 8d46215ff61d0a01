"""Operator 11: spelling variants by a dictionary of pairs of trie nodes.

1. Words are counted over whole texts, added up in each task before they are shuffled.
2. The nodes of the trie of all words, and of that of all words read backwards, get numbers. In sorted order a node's words
   stand together: its number is the rank of the first of them and the node's depth. Words are sorted by range; a task
   numbers the nodes of its range, and those that began in an earlier range are handed over between the ranges' ends.
3. A word with one letter skipped is a pair (prefix node, suffix node), and so is a word with a letter inserted nowhere,
   at each place. Two words of one length that share a skipped pair differ in that letter; a word's skipped pair that is
   another's plain pair is one insertion. Nodes are exact, so no pair is a false one, and a pair of nodes is shared by the
   words with one letter of the alphabet between them and the word with none: a group never has more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.scratch import stored
from newsloom.llm import textnum as T

LETTERS = "[A-Za-zÀ-ÿ]"
DEPTH = 25  # bits of a node's number that hold its depth


def _runs(least: int, noise: int | None) -> Callable:
    """Runs of LETTERS of at least so many letters, with their counts in a batch."""
    pattern = re.compile(f"{LETTERS}{{{least},}}")  # a maximal run, since a run that starts later is shorter
    lower = bytes(T.LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[str] = Counter()
            ids = batch.column(0).to_pylist()
            for lo, buf, off in T.slices(batch.column(1)):
                raw = buf.tobytes().translate(lower)
                for row, (a, b) in enumerate(zip(off[:-1], off[1:], strict=True), lo):
                    found = pattern.findall(raw[a:b].decode())
                    if noise is None:
                        counts.update(found)
                        continue
                    doc = "" if ids[row] is None else ids[row]
                    for word, n in Counter(found).items():
                        h = zlib.crc32(f"{doc}:{word}".encode())
                        if h % noise == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                        counts[word] += n
            kept = [(w, n) for w, n in counts.items() if len(w) >= least]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, least: int = 7, times: int = 2, noise: int | None = None) -> DataFrame:
    """(word, n) of the maximal runs of LETTERS, A-Z lower-cased, of least letters and times occurrences at least.

    docs has doc_id and text; null texts have none. With noise, a run whose crc32 with its doc_id that number divides loses
    a letter in that document first; a null doc_id counts as an empty one.
    """
    counts = docs.select("doc_id", "text").mapInArrow(_runs(least, noise), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _common(a: str, b: str) -> int:
    """Letters at the start that two words share."""
    n = min(len(a), len(b))
    return n if a[:n] == b[:n] else next(k for k in range(n) if a[k] != b[k])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to sorted keys the range's number, the place in it, and for each depth the place of the first key with that prefix."""
    part = TaskContext.get().partitionId()
    before, path, at = "", [0], 0
    for batch in batches:
        paths = []
        for key in batch.column(0).to_pylist():
            path = path[: _common(before, key) + 1]
            path += [at] * (len(key) + 1 - len(path))
            paths.append(path)
            before, at = key, at + 1
        n = len(paths)
        bounds = np.cumsum([0, *map(len, paths)]).astype(np.int32)
        own = pa.ListArray.from_arrays(pa.array(bounds), pa.array([x for p in paths for x in p], pa.int64()))
        places = pa.array(np.arange(at - n, at), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[1:], batch.column(0), pa.array(np.full(n, part), pa.int32()), places, own],
            names=[*batch.schema.names[1:], "_key", "_part", "_at", "_own"]
        )


def number_nodes(words: DataFrame, key: Column, name: str) -> DataFrame:
    """words with the array <name>: the numbers of the nodes on the path of key, by depth from 0, in the trie of all keys.

    Keys are distinct and not null. Equal prefixes have equal numbers, and no others. Two rows for each range of the sort
    come to the driver.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    sorted_keys = words.select(key.alias("_key"), "*").orderBy("_key")
    local = stored(sorted_keys.mapInArrow(_local, f"{kinds}, _key string, _part int, _at long, _own array<long>"), f"spelling-{name}")
    ends = local.groupBy("_part").agg(
        F.count("*").alias("n"), F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last"), F.max_by("_own", "_at").alias("own")
    )
    base, last, numbers, handed = 0, None, [], []
    for r in sorted(ends.collect()):
        head = numbers[: _common(last, r["first"]) + 1] if last is not None else []
        handed.append((r["_part"], base, head))
        numbers = [head[j] if x == 0 and j < len(head) else base + x for j, x in enumerate(r["own"])]
        base, last = base + r["n"], r["last"]
    offsets = words.sparkSession.createDataFrame(handed, "_part int, _base long, _head array<long>")
    first = lambda x, j: F.when((x == 0) & (j < F.size("_head")), F.get(F.col("_head"), j)).otherwise(F.col("_base") + x)
    nodes = F.transform("_own", lambda x, j: F.shiftleft(first(x, j), DEPTH) + j)
    return local.join(F.broadcast(offsets), "_part").select(*words.columns, nodes.alias(name))  # a row for each range of the sort


def node_pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, id, n, kind): each word's pairs of nodes with one letter skipped (kind 0; 1 where the next letter is
    the same, so that the word without it is met again) and with none (kind 2). words has word, n, prefixes and suffixes."""
    last = F.size("letters") - 1
    twice = lambda i: F.coalesce(F.get("letters", i) == F.get("letters", i + 1), F.lit(False))
    pair = lambda i, j, kind: F.struct(F.get("prefixes", i).alias("prefix"), F.get("suffixes", j).alias("suffix"), kind.alias("kind"))
    skipped = F.transform(F.sequence(F.lit(0), last), lambda i: pair(i, last - i, twice(i).cast("int")))
    plain = F.transform(F.sequence(F.lit(0), last + 1), lambda i: pair(i, last + 1 - i, F.lit(2)))
    return words.select("id", "n", F.inline(F.concat(skipped, plain))).select("prefix", "suffix", "id", "n", "kind")


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): for each word with a near one their number, and the one of largest n, least id, as (n, minus id).

    Words meet where they share a pair of nodes: two skipped ones, or a skipped and a plain one. Each two near words meet once.
    """
    pair = ("prefix", "suffix")
    met = pairs.withColumn("m", F.count("*").over(Window.partitionBy(*pair))).filter("m > 1")
    groups = met.groupBy(*pair).agg(F.collect_list(F.struct("id", "n", "kind")).alias("all"))  # a word for each letter, and one more

    def others(x: Column) -> Column:
        meets = lambda y: F.when(x.kind == 2, y.kind == 0).when(y.kind == 2, x.kind == 0).otherwise(x.id != y.id)
        return F.transform(F.filter("all", meets), lambda y: F.struct(y.n.alias("n"), F.negative(y.id).alias("minus_id")))

    seen = groups.select(F.explode(F.transform("all", lambda x: F.struct(x.id.alias("id"), others(x).alias("near")))).alias("x")).select("x.*")
    seen = seen.filter(F.size("near") > 0)
    return seen.groupBy("id").agg(F.sum(F.size("near")).cast("long").alias("n_near"), F.max(F.array_max("near")).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) for forms (id, form): forms followed to the last. Each step asks for ten times the count, so they end."""
    links = stored(forms.select("id", F.col("form").alias("root")), "spelling-links")
    while True:
        on = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-links")
        if not links.filter("moved").head(1):
            return links.select("id", "root")
        links = links.select("id", "root")


def variants(counts: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for counts (word, n) of distinct, not null words.

    Near words differ by one inserted, deleted or replaced letter. A word's form is its near word of largest n (ties: the
    first in code-point order) if that is ratio times the word's n at least, else null. root follows forms to the last; a
    word without a form is its own. No words give no rows. Words may have up to 2**25 letters.
    """
    words = number_nodes(counts.select("word", "n"), F.reverse("word"), "suffixes")
    words = number_nodes(words, F.col("word"), "prefixes")
    letters = F.split("word", "")
    words = stored(words.select("*", F.shiftright(F.element_at("prefixes", -1), DEPTH).alias("id"), letters.alias("letters")), "spelling-words")
    near = stored(near_words(node_pairs(words)), "spelling-near")
    named = words.select("id", "word", "n")
    forms = named.select("id", "n").join(near, "id").filter(F.col("best.n") >= ratio * F.col("n"))
    forms = stored(forms.select("id", F.negative("best.minus_id").alias("form"), F.col("best.n").alias("form_n")), "spelling-forms")
    ends = forms.join(_roots(forms), "id")
    ends = ends.join(named.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form")
    ends = ends.join(named.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    out = named.join(near.select("id", "n_near"), "id", "left").join(ends, "id", "left")
    return out.select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def spelling_variants(docs: DataFrame, least: int = 7, times: int = 2, ratio: int = 10, noise: int | None = None) -> DataFrame:
    """variants() of the words that word_counts() finds in docs (doc_id, text). Other columns are ignored."""
    return variants(stored(word_counts(docs, least, times, noise), "spelling-counts"), ratio)
