import hashlib

import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from waymark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    None,
    "",
    " \t\n",
    "Hello,  World! it's 2024 -- don't",
    "café café ΣΤΣ İstanbul ßẞ",
    "a b c\u0085d\x1ce\x1ff",
    "<|startoftext|>mid<|endoftext|> <|endoftext|><|startoftext|",
    "\U0001f600\U0001f601 你好世界 สวัสดี",
    "x" * 5000 + "ab" * 3000,
    "!!!??? ''s 's'T 'LL ²½ 1234",
    "the the The THE",
]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


def test_equals_library(library):
    with open(PATH, "rb") as file:
        ours = bpe.Encoder(file.read())
    for text in HARD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = ours.encode(text)
        assert packed == b"".join(i.to_bytes(4, "little") for i in ids), text
        assert ours.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_kept_pieces_do_not_change_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 2)
    with open(PATH, "rb") as file:
        ours = bpe.Encoder(file.read())
    text = "one two three one two four <|endoftext|> one"
    assert ours.encode(text) == b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)


def test_table(spark, library):
    rows = [Row(doc_id=i, text=t, ids="mine", extra=None) for i, t in enumerate([*HARD, HARD[3]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, extra string")
    found = {r.doc_id: r for r in bpe.encode_documents(docs, PATH).collect()}
    assert len(found) == len(rows)
    for row in rows:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert found[row.doc_id].n_tokens == len(ids)
        assert found[row.doc_id].decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op5_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
