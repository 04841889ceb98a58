import base64

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from waymark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding():
    with open(PATH, "rb") as file:
        return packing._encoding({base64.b64decode(w): int(r) for w, r in map(bytes.split, file)}, public_tokenizers.PATTERN)


def plain_best_fit(lengths, size):
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fitting = [b for b in bins if size - sum(lengths[j] for j in b) >= lengths[i]]
        if fitting:
            min(fitting, key=lambda b: size - sum(lengths[j] for j in b)).append(i)
        else:
            bins.append([i])
    return sorted(sorted(lengths[j] for j in b) for b in bins)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.data())
def test_equals_plain_best_fit(size, data):
    lengths = data.draw(st.lists(st.integers(1, size), max_size=60))
    got = packing.pack(np.array(lengths, np.int64), size)
    assert sorted(i for b in got for i in b) == list(range(len(lengths)))
    rooms = [sum(lengths[i] for i in b) for b in got]
    assert all(r <= size for r in rooms) and len(got) == len(plain_best_fit(lengths, size))


def texts_back(rows, size):
    parts = {}
    for r in rows:
        ids, positions = np.frombuffer(r.ids, np.uint32), np.frombuffer(r.positions, np.uint32)
        assert len(ids) == size and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= size
        assert (ids[r.n_tokens :] == packing.PAD).all()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((start, ids[a:b].tolist()))
    return {d: [i for _, p in sorted(v) for i in p] for d, v in parts.items()}


def test_round_trip(spark, sf):
    bpe = encoding()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.op2_packing(spark, sf).collect()
    want = {r.doc_id: bpe.encode_ordinary(r.text) for r in docs.collect() if r.text}
    assert texts_back(rows, packing.SEQUENCE) == want
    assert sum(r.n_tokens for r in rows) / (len(rows) * packing.SEQUENCE) > 0.97


def test_hard_rows(spark):
    bpe = encoding()
    texts = [None, "", "a", "word " * 5000, "<|endoftext|> é\U0001f600", "x" * 3000]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, ids="mine") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for size, block in ((1, 10), (16, 50), (4096, 10**6)):
        rows = packing.pack_documents(docs, PATH, public_tokenizers.PATTERN, size, block).collect()
        assert texts_back(rows, size) == {i: bpe.encode_ordinary(t) for i, t in enumerate(texts) if t}
    assert packing.pack_documents(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    nameless = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    [row] = packing.pack_documents(nameless.coalesce(1), PATH, public_tokenizers.PATTERN).collect()
    assert row.doc_ids == [None, 1, 1]
