"""Token-id output as directly addressable codes (DACs).

File format: a Parquet dataset, one row for each segment of whole documents in ascending doc_id order.
``part`` and ``seg`` order the segments, ``start`` is the segment's first token within its part, ``n_tokens`` its tokens,
``doc_ids`` and ``lens`` its documents, ``payload`` the codes:

    magic "DAC1" | u32 levels | for each level: u32 n | n chunk bytes | ceil(n/8) bytes of continuation bits (little
    bit order) | u32 rank directory, one entry for each 512 bits: set bits before that block

Level k holds bits 8k..8k+7 of the ids that reach it; a set continuation bit says the id goes on in the next level, at
the position that rank gives. Any token is read with one byte and one rank a level; nothing around it is decoded.
Spark's writer commits the files, so retried or speculative tasks leave no duplicates.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, table

END_ID = 1
SEGMENT_TOKENS = 1 << 16
CACHE_WORDS = 400_000
_BLOCK = 512
_encoders: dict[str, WordCachingEncoder] = {}


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 and up in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_CAPITALS = "A-Z" + "".join(chr(c) for c in range(0xC0, 0x180) if c != 0x130 and chr(c) != chr(c).lower())
_SMALL = "a-z" + "".join(chr(c) for c in range(0xC0, 0x180) if chr(c).isalpha() and c != 0x130 and chr(c) == chr(c).lower())
_LETTERS = _CAPITALS[3:] + _SMALL
#: Small letters make one pre-token whatever stands around them; capitals have a lower case without special rules.
_PLAIN = re.compile(f"[{_SMALL}]+")
#: Pre-tokens of lower-cased pieces made of such letters, digits and ASCII marks other than the apostrophe.
_PARTS = re.compile(f"[{_SMALL}]+|[0-9]|[!-&(-/:-@\\[-`{{-~]+")
_SIMPLE = re.compile(f"[A-Z0-9{_LETTERS}!-&(-/:-@\\[-`{{-~]+")
_NOT_FOLDABLE = re.compile("[^\u0000-\u012f\u0131-\u017f\u2000-\u206f]")
_MIXED_MARKS = re.compile(f"[^ 0-9{_LETTERS}][.,] ")


# Fixed value: the pre-tokens of a vocabulary whose texts can be encoded word by word.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _takes_words_apart(made_of: dict) -> bool:
    """Whether a tokenizer file normalises and pre-tokenizes as the word-wise encoding assumes."""
    steps = [x["type"] for x in (made_of.get("normalizer") or {}).get("normalizers", [])]
    split = ((made_of.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return steps == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": _PRE_TOKENS} and not made_of["model"].get("dropout")


class WordCachingEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    A vocabulary of another make is left to the library, text by text. One that lower-cases, and whose pre-tokens never
    span white space, is encoded by words: a text's ids are the ids of
    its space-separated pieces, and lower-casing it or setting a word's full stop or comma apart changes none of them.
    Plain words go straight to the library's BPE model, all other pieces to its whole pipeline. Ids of pieces are kept
    between texts in two generations of about ``limit`` pieces; pieces in use move to the younger one.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made_of = json.loads(Path(path).read_text())
        self.by_words = _takes_words_apart(made_of)
        self.tokenizer, self.limit, self.known, self.older = Tokenizer.from_file(path), limit, {"": b""}, {}
        self.model, self.letters = self.tokenizer.model, dict(enumerate(_byte_letters()))

    def _whole(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            if _PLAIN.fullmatch(piece):
                shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
            elif "<|" not in piece and _SIMPLE.fullmatch(piece) and (parts := _PARTS.findall(piece.lower())) != [piece]:
                ids = b"".join([self.ids(p) for p in parts])
            else:
                ids = self._whole(piece)
        self.known[piece] = ids
        return ids

    def ids(self, piece: str) -> bytes:
        found = self.known.get(piece)
        return self._learn(piece) if found is None else found

    def encode(self, text: str | None) -> np.ndarray:
        if not self.by_words:
            return np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4")
        text = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if "<|" not in text and not _NOT_FOLDABLE.search(text):  # "<|" may start a special token, which is read as written
            text = text.lower()
            if not _MIXED_MARKS.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ")
        pieces = text.split(" ")
        if len(self.known) > self.limit:
            self.known, self.older = {"": b""}, self.known
        known = self.known
        for p in [p for p in set(pieces) if p not in known]:
            self._learn(p)
        return np.frombuffer(b"".join([known[p] for p in pieces]), dtype="<u4")


def encoder(path: str) -> WordCachingEncoder:
    if path not in _encoders:
        _encoders[path] = WordCachingEncoder(path)
    return _encoders[path]


def dac_encode(ids: np.ndarray) -> bytes:
    out, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bits) // 64) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded).reshape(-1, 64).sum(axis=1, dtype=np.uint32)
        out.append(np.uint32(len(rest)).tobytes() + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + (np.cumsum(ones, dtype=np.uint32) - ones).tobytes())
        rest = rest[more] >> np.uint32(8)
        if not len(rest):
            return b"DAC1" + np.uint32(len(out)).tobytes() + b"".join(out)


class DacReader:
    """Random access into one payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"DAC1":
            raise ValueError("not a DAC payload")
        self.levels, at = [], 8
        for _ in range(int.from_bytes(payload[4:8], "little")):
            n = int.from_bytes(payload[at : at + 4], "little")
            parts, at = [], at + 4
            for size, kind in ((n, np.uint8), (-(-n // 8), np.uint8), (-(-n // _BLOCK), np.dtype("<u4"))):
                parts.append(np.frombuffer(payload, dtype=kind, count=size, offset=at))
                at += size * np.dtype(kind).itemsize
            self.levels.append(tuple(parts))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Set continuation bits before position i."""
        _, bits, ranks = self.levels[level]
        if i >= len(self.levels[level][0]):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        first = i // _BLOCK * (_BLOCK // 8)
        inside = int(np.bitwise_count(bits[first : i // 8]).sum(dtype=np.int64))
        return int(ranks[i // _BLOCK]) + inside + (int(bits[i // 8]) & ((1 << (i % 8)) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(k, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1, touching only their own chunks: the codes of a run are a run on every level."""
        value, live = np.zeros(stop - start, dtype=np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            here = chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 : start % 8 + stop - start].astype(bool)
            if live is None:
                value |= here
                live = np.flatnonzero(more)
            else:
                value[live] |= here
                live = live[more]
            if not len(live):
                break
            start = self._rank(k, start)
            stop = start + len(live)
        return value


_SEGMENTS = "part int, seg int, start bigint, n_tokens bigint, doc_ids array<bigint>, lens array<bigint>, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text and write the ids to ``path`` in ascending doc_id order (nulls first, ties by text).

    Null texts count as empty: one end id. Repeated rows are written again. An empty table writes no segments.
    """
    spark = docs.sparkSession
    vocabulary = tokenizer_path or vocabulary_path()
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lens", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seg, start = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        doc_ids, held, n, end = [], [], 0, np.array([end_id], dtype=np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, held, n, seg, start
            row = [part, seg, start, n, doc_ids, [len(x) + 1 for x in held], dac_encode(np.concatenate([y for x in held for y in (x, end)]))]
            seg, start, doc_ids, held, n = seg + 1, start + n, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for b in small_batches(batches):
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = enc.encode(t)
                doc_ids.append(d)
                held.append(ids)
                n += len(ids) + 1
                if n >= SEGMENT_TOKENS:
                    yield flush()
        if doc_ids:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _SEGMENTS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written dataset: doc_id, start, n_tokens (with the end id), ids_crc32."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # A row for each part, however many tokens they hold.
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            for row in b.to_pylist():
                reader, at, out = DacReader(row["payload"]), 0, []
                for d, n in zip(row["doc_ids"], row["lens"], strict=True):
                    out.append((d, row["base"] + row["start"] + at, n, zlib.crc32(reader.slice(at, at + n).astype("<u4").tobytes())))
                    at += n
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.join(F.broadcast(bases), "part").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_digest(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the tokens of ``docs`` to a new dataset in the shared folder and read its digest back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(spark, path)


def op7_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"))
