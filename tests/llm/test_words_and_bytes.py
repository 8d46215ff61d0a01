"""Spelling variants, ranked search and byte-level BPE against brute force and the tokenizer's own library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from test_operators import ALNUM, LOWER, ODD, docs, none, odd  # noqa: F401

from newsloom.llm import byte_bpe, queries, ranked_search, spelling

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def variants(n, ratio=10):
    form, count = {}, {}
    for w in n:
        found = [v for v in n if near(w, v)]
        count[w] = len(found)
        if found:
            best = min(found, key=lambda v: (-n[v], v))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], count[w], n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def counted(rows, least, times, noise):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if noise and h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= times}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_variants(spark, parts):
    """Ties, repeated letters, chains of forms, very long words; nodes that begin in another range of the sort."""
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(400)}
    words |= {"a" * 3000, "a" * 3001, "a" * 2999 + "b", "a" * 1500 + "c" + "a" * 1500, "zé", "zè", "z", "é" * 9, "é" * 10}
    rows = [(w, rnd.choice([2, 3, 20, 25, 200, 200, 2000])) for w in sorted(words)]
    before = [spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = variants(dict(rows))
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert any(w[1] and w[1] != w[2] for w in want)


def test_node_numbers(spark):
    words = spark.createDataFrame([(w,) for w in ("ab", "abc", "abd", "b", "ba")], "word string")
    nodes = {r.word: r.nodes for r in spelling.number_nodes(words, F.col("word"), "nodes").collect()}
    by_prefix = {(w[:k], n) for w, path in nodes.items() for k, n in enumerate(path)}
    assert len(by_prefix) == len({p for p, _ in by_prefix}) == len({n for _, n in by_prefix}) == 7


def test_spelling_of_odd_rows(spark, odd, none):  # noqa: F811
    rows = [(d, t) for d, t, *_ in ODD]
    for noise in (None, 3):
        got = spelling.spelling_variants(odd, least=3, times=2, ratio=2, noise=noise).collect()
        assert sorted((tuple(r) for r in got), key=repr) == variants(counted(rows, 3, 2, noise), 2)
    assert spelling.spelling_variants(none).count() == 0
    assert spelling.spelling_variants(odd.filter("text is null or trim(text) = ''")).count() == 0


def test_spelling_query_against_plain_counts(spark, docs, sf):  # noqa: F811
    want = counted([(r.doc_id, r.text) for r in docs.collect()], 7, 2, 31)
    got = queries.op11_spelling_variants(spark, sf).collect()
    assert {r.word: r.n for r in got} == want
    some = sorted(want)[::40]
    by_word = {r.word: r for r in got}
    for w in some:
        assert by_word[w].n_near == sum(near(w, v) for v in want)


def ranking(rows, items, k=10):
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    texts = [(d, Counter(words(t))) for d, t in rows]
    texts = [(d, c, sum(c.values())) for d, c in texts if c]
    n_docs, n_words = len(texts), sum(n for *_, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    queries_ = {}
    for i, t in items:
        queries_.setdefault(i, set()).update(words(t))
    out = []
    for i, terms in queries_.items():
        scores = []
        for d, c, n in texts:
            m = 10 + 90 * n * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_ranked_search(spark, odd, none):  # noqa: F811
    """Ties between equal texts, repeated and null ids, items that share a name, terms that no document has, many segments and blocks."""
    own = [(1, BASE_ITEM), (2, "w7 w9 END"), (3, None), (4, " "), (None, "x b"), (2, "more"), (5, "absent words"), (6, "日本語 ß don't"), (7, "one " * 300)]
    items = spark.createDataFrame(own, "item_id long, text string").withColumn("doc_id", F.lit(3))
    rows = [(d, t) for d, t, *_ in ODD]
    for segment, block, k in ((2_000_000, 100_000, 10), (40, 4, 3), (1, 100_000, 1)):
        named = items.select(F.col("item_id").cast("string").alias("item"), "text")
        got = ranked_search.search(ranked_search.build_index(odd, segment), named, k, block)
        found = [(None if r.item is None else int(r.item), *tuple(r)[1:]) for r in got.collect()]
        assert sorted(found, key=repr) == ranking(rows, own, k)
    assert ranked_search.ranked(none, items).count() == 0
    assert ranked_search.ranked(odd, items.limit(0)).count() == 0
    assert ranked_search.ranked(odd.filter("text is null"), items).count() == 0


def test_segments_are_read_one_by_one(spark):
    """A row group holds one segment: a task that reads or writes many has one of them in memory."""
    large = spark.range(0, 7, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('one two ', 150000)").alias("text"))
    files = ranked_search.build_index(large, 5).inputFiles()
    groups = [f.row_group(k).num_rows for f in (pq.read_metadata(x.removeprefix("file:")) for x in files) for k in range(f.num_row_groups)]
    assert groups == [1] * 7


BASE_ITEM = "One two THREE four sixteen"


def test_ranked_search_of_many_documents(spark):
    """A term in every document, one many times over in a document, copies by the hundred: 900 columns in one grid."""
    rnd = random.Random(8)
    rows = [(k, " ".join(["the"] + [f"t{int(rnd.paretovariate(0.7))}" for _ in range(rnd.randint(1, 60))])) for k in range(600)]
    rows += [(1000 + k, "the copy of t1 t2 t3") for k in range(300)] + [(5000, "t1 " * 700 + "t9")]
    items = [(k, " ".join(f"t{int(rnd.paretovariate(0.5))}" for _ in range(12)) + " the copy") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = ranked_search.ranked(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranking(rows, items)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_pieces_by_halves(library):
    coder, rnd = byte_bpe.Coder(byte_bpe.read_ranks(RANKS)), random.Random(5)
    single = library._core_bpe.encode_single_piece
    alphabets = ["a", "ab", "aab ", "abcdefghijklmnopqrstuvwxyz", "éüß日本", "etaoin shrdlu", "=-_", "\n \t"]
    for _ in range(3000):
        s = "".join(rnd.choices(rnd.choice(alphabets), k=rnd.choice([1, 3, 9, 17, 33, 100, 300]))).encode()
        ids = coder.encode(s)
        assert ids == list(single(s)) and coder.decode(ids) == s
        k = rnd.randint(0, len(s))
        assert coder.join(coder.reduced(s[:k]), coder.reduced(s[k:])) == coder.merged(s) == coder.reduced(s)
    for s in (b"a" * 20_000, b"=-" * 20_001, "日".encode() * 5000, bytes(rnd.choices(b"ACGT", k=50_000))):
        assert coder.encode(s) == list(single(s))
    with pytest.raises(ValueError, match="no rank for byte"):
        byte_bpe.Coder({b"a": 0})


def test_pieces_in_chunks(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CHUNK", 20)
    pattern = regex.compile(public_tokenizers.PATTERN)
    text = "it's we're they'll  \n\n  a" * 30 + " " * 300 + "z" * 200 + "'re 　\x85 12'd"
    assert [p for some in byte_bpe.pieces(text, pattern) for p in some] == pattern.findall(text)


def test_byte_bpe(spark, odd, none, docs, library):  # noqa: F811
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for df in (odd, docs):
        want = []
        for r in df.collect():
            ids = library.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha((r.text or "").encode())))
        got = byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()
        assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    ids = byte_bpe.encode(odd.filter("doc_id = 13"), RANKS, public_tokenizers.PATTERN).first().ids
    assert ids == library.encode_ordinary(next(t for d, t, *_ in ODD if d == 13))
    given = spark.createDataFrame([(1, None), (2, []), (3, [50, 262])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(given, RANKS).collect()} == {1: b"", 2: b"", 3: library.decode_bytes([50, 262])}
    assert byte_bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
