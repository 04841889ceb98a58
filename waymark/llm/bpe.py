"""Byte-pair encoding with word ends, and decoding.

The vocabulary is a ``tokenizers`` JSON file of the lower-casing word kind, read once by the driver and broadcast (its
size does not depend on the data). A text is cut at the literal special tokens; the rest is normalised, split into
pieces, and each piece is merged by a priority queue of merge ranks over a doubly linked list of symbols.

Defined results: a null text counts as empty; empty texts have no ids; rows are handled one by one, so ties and
repeated rows do not matter; an empty table gives an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encoded pieces kept for reuse by one Python worker; a full store starts anew, which changes the speed only.
KEPT_PIECES = 200_000
#: Output rows of one Arrow batch.
BATCH_ROWS = 512

SPACE = regex.compile(r"\p{White_Space}+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others for letters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Encoder:
    """Vocabulary, merges and special tokens of one file."""

    def __init__(self, text: str | bytes):
        spec = json.loads(text)
        model = spec["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added
        self.at_special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # \s means the White_Space property there; in this library it has four control characters more
        self.piece = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.words = [""] * (max([*vocab.values(), *added.values()]) + 1)
        for word, i in [*vocab.items(), *added.items()]:
            self.words[i] = word
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + end] for c in letters]
        self.width = len(self.words)
        # merge of ids a, b (as a * width + b) to (rank * width + merged id): one number that sorts by rank
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges.setdefault(vocab[a] * self.width + vocab[b], rank * self.width + vocab[a + b])
        self.kept: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.inner[b] for b in piece[:-1]]
        ids.append(self.last[piece[-1]])
        n, width, merges = len(ids), self.width, self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges.get(ids[i] * width + ids[i + 1])
            if m is not None:
                queue.append((m, i))
        heapify(queue)
        while queue:
            m, i = heappop(queue)
            j = after[i]
            # stale: the left symbol is gone, or the pair is no longer the one that was queued
            if ids[i] < 0 or j >= n or merges.get(ids[i] * width + ids[j]) != m:
                continue
            ids[i] = m % width
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get(ids[i] * width + ids[k])
                if m is not None:
                    heappush(queue, (m, i))
            h = before[i]
            if h >= 0:
                m = merges.get(ids[h] * width + ids[i])
                if m is not None:
                    heappush(queue, (m, h))
        return [i for i in ids if i >= 0]

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = SPACE.sub(" ", text)
        # letter by letter: a whole text's lower() would write another sigma at the end of a word
        text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        kept, out = self.kept, []
        for piece in self.piece.findall(text):
            ids = kept.get(piece)
            if ids is None:
                if len(kept) >= KEPT_PIECES:
                    kept.clear()
                ids = kept[piece] = _packed(self.merge(piece.encode("utf-8", "surrogatepass")))
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.at_special is None or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for found in self.at_special.finditer(text):
            out += [self._plain(text[at : found.start()]), _packed([self.special[found.group()]])]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of packed ids; the file names no decoder, so they stand side by side with spaces."""
        numbers = array("I")
        numbers.frombytes(ids)
        return " ".join(map(self.words.__getitem__, numbers))


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


_loaded: dict[bytes, Encoder] = {}


def encoder(spec: bytes) -> Encoder:
    """The encoder of a file's content, made once in each Python worker."""
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = Encoder(spec)
    return _loaded[spec]


OUTPUT = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]


def encode_documents(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (packed as little-endian uint32), ``n_tokens`` and ``decoded``, the text that the ids give back."""
    with open(vocabulary_path, "rb") as file:  # a small file beside the driver, not a table
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    names = {f.name for f in OUTPUT}
    keep = [c for c in docs.columns if c not in names]
    source = docs.select(*keep, *([F.col(text).alias("_bpe_text")] if text in names else []))
    column = "_bpe_text" if text in names else text
    schema = T.StructType([*docs.select(*keep).schema.fields, *OUTPUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                ids = [bpe.encode(t) for t in batch.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in keep],
                        pa.array(ids, pa.binary()),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array(map(bpe.decode, ids), pa.string()),
                    ],
                    [*keep, *[f.name for f in OUTPUT]],
                )

    return source.mapInArrow(run, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
