import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from waymark.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = langid.op6_language(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def learned(spark):
    en = "the cat sat on the mat with another cat "
    de = "der hund und die katze sitzen nicht auf dem tisch "
    rows = [Row(doc_id=i, text=(en if i % 2 else de) * 2 + str(i), lang="en" if i % 2 else "de") for i in range(40)]
    return spark.createDataFrame(rows)


def test_hard_rows(spark):
    filters = langid.learn(learned(spark))
    texts = [None, "", " 123 !?", "the cat", "der hund", "ΩΩΩ", "x", "the cat sat " * 200_000, "der hund \U0001f600"]
    rows = [Row(doc_id=i, text=t, score="mine", lang=None) for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, lang string")
    out = langid.identify(docs, filters)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "known"]
    found = {r.doc_id: r for r in out.collect()}
    assert [found[i].lang_pred for i in range(9)] == ["und", "und", "und", "en", "de", "de", "de", "en", "de"]
    assert all(found[i].score == 0 for i in (0, 1, 2, 5)) and all(0 <= r.score <= 1 for r in found.values())
    assert all(found[i].lang_pred == found[i + 9].lang_pred for i in range(9))
    assert langid.identify(docs.limit(0), filters).count() == 0
    nothing = langid.learn(learned(spark).withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def whole_grams(text):
    """n-grams of the folded text, by slicing."""
    folded = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip(" ") + " "
    folded = " " if not folded.strip(" ") else folded
    return Counter(folded[i : i + n] for n in langid.ORDERS for i in range(len(folded) - n + 1))


@settings(max_examples=150, deadline=None)
@given(st.text("ab Ä1\n中", max_size=30), st.integers(1, 12))
def test_pieces_of_any_size_hold_the_same_grams(text, size):
    found = Counter()
    for points, lead in langid._pieces(text, size):
        for n in langid.ORDERS:
            own = points[max(0, lead - n + 1) :]
            assert len(langid._grams(points, n, lead)) == max(0, len(own) - n + 1)
            found.update("".join(map(chr, own[i : i + n])) for i in range(len(own) - n + 1))
    assert found == whole_grams(text)


def test_a_word_over_a_border_counts_whole(spark, monkeypatch):
    filters = langid.learn(learned(spark))
    text = "x" * 1_500_000
    total, _ = filters.counts([text])
    assert total[0] == sum(whole_grams(text).values())
    monkeypatch.setattr(langid, "PIECE", 7)
    text = "the cat sat on the mat with another cat " * 20
    small = filters.counts([text, "der hund"])
    monkeypatch.setattr(langid, "PIECE", 1 << 20)
    large = filters.counts([text, "der hund"])
    assert all((a == b).all() for a, b in zip(small, large))


def test_filters_have_every_learned_gram(spark):
    filters = langid.learn(learned(spark))
    text = "the cat sat on the mat with another cat"
    total, hits = filters.counts([text, ""])
    assert hits[0, filters.languages.index("en")] == total[0] > 0
    points, _ = next(langid._pieces(text, 1000))
    h = np.concatenate([langid._grams(points, n) for n in langid.ORDERS])
    by_gram = [bin(int(m)) for m in next(filters.masks(h))]
    assert sum(b[-1 - filters.languages.index("en")] == "1" for b in by_gram) == total[0]


def test_many_languages(spark):
    rows = [Row(doc_id=i * 3 + j, text=" ".join([f"{chr(97 + i % 26)}{chr(97 + i // 26)}zq"] * 5), lang=f"l{i:03}") for i in range(70) for j in range(3)]
    docs = spark.createDataFrame(rows)
    filters = langid.learn(docs)
    assert len(filters.slots) == 2
    assert all(r.lang == r.lang_pred for r in langid.identify(docs, filters).collect())
