import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from waymark.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def expected(docs, target):
    corpus, wanted = Counter(), Counter()
    for _, text in docs:
        corpus.update(features(text)[1])
    for text in target:
        wanted.update(features(text)[1])
    S, T = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (S + 10_000) / ((corpus[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in docs:
        words, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(able[: 5 * len(able) // 100], 1):
        row[4] = rank
    return Counter(tuple(r[:5]) for r in out)


def run(spark, docs, target):
    table = spark.createDataFrame([(i, t, "mine") for i, t in docs], "doc_id long, text string, weight string").repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample.ranked(resample.scored(table, wanted).drop("text"))
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect())


def texts(n, seed=5):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{w}" for w in rng.zipf(1.5, rng.integers(1, 60)) % 300) for _ in range(n)]


def test_equals_plain_python(spark):
    docs = list(enumerate(texts(150)))
    assert run(spark, docs, texts(10, seed=6)) == expected(docs, texts(10, seed=6))


def test_hard_rows(spark):
    long = " ".join(texts(400, seed=7))
    hard = [None, "", " .,-", "One", "One-two", "\x00a\x7fb", "É é ß 中文 \U0001f600", "A" * 500_000, long, long.upper(), "w1 w2 " * 30]
    docs = list(enumerate(hard * 3)) + [(None, "w1 " * 30), (5, "w1 " * 30), (5, "w1 " * 30), (5, "w1 " * 31)]
    assert run(spark, docs, ["w1 w2 w3", None, ""]) == expected(docs, ["w1 w2 w3", None, ""])


@pytest.mark.parametrize("docs, target", [([], ["a"]), ([(1, "a b c")], []), ([], [])])
def test_empty_tables(spark, docs, target):
    assert run(spark, docs, target) == expected(docs, target)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab 中") | st.none(), max_size=6), st.integers(1, 4))
def test_pieces_lose_no_run(texts_, at_once):
    found = [Counter() for _ in texts_]
    for doc, number, bucket in resample.runs(pa.array(texts_, pa.string()), at_once=at_once):
        for d, b in zip(doc.tolist(), bucket[number].tolist()):
            found[d][b] += 1
    assert found == [Counter(features(t)[1]) for t in texts_]


def test_crc_of_a_long_second_part():
    a, b = b"one ", b"x" * 100_003
    got = resample.appended(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert got[0] == zlib.crc32(a + b)


def test_drawn_rows_keep_their_columns(spark):
    docs = [(i, f"{t} w1 w2" * 3) for i, t in enumerate(texts(200))]
    table = spark.createDataFrame([(i, t, "mine") for i, t in docs], "doc_id long, text string, weight string")
    wanted = spark.createDataFrame([(t,) for t in texts(10, seed=6)], "text string")
    stay = resample.resampled(table, wanted).collect()
    assert {r.doc_id for r in stay} == {r[0] for r in expected(docs, texts(10, seed=6)) if r[4]}
    assert all(r.weight == "mine" for r in stay)


def test_equals_sql(spark, sf):
    got = Counter(tuple(r) for r in resample.op11_resample(spark, sf).collect())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as from '{sf}/{name}.parquet'")
    assert got == Counter(con.execute(resample.OP11_SQL).fetchall())
