"""Token ids in a compact binary form: frequency-ranked ids, byte-aligned variable length, control bytes kept apart.

A file holds some documents in a row. Its table lists its ids by falling count over all of its documents (ties: the
smaller id first), and an id is written as its place in that table, so that frequent ids take one byte. Lengths of four
values at a time stand in one control byte, two bits each, before all value bytes. Decoding looks control bytes up in a
table of lengths, finds each value's place by a running sum, and gathers the bytes; then ranks are looked up in the
file's table.

Layout, little-endian: magic 'QTF1'; documents, ids, table entries (8 bytes each); doc_ids (8 bytes each), whether each
is not null (1 byte each), ids of each document (8 bytes each); the table (4 bytes each); control bytes; value bytes.

A file's image is the ``image`` of one row of a table in the shared folder, as Spark's writers reach every kind of store
and survive lost executors; ``export`` puts the images into plain files.

Documents are dealt into ranges of doc_id, so (part, seq) orders the files by doc_id.

Defined results: a null text counts as empty; an empty text has the end id alone; an empty table gives no files; null
doc_ids come first and come back as null; repeated rows each have their place, rows of one doc_id in the order of their
texts (null first); a file closes at ``FILE_IDS`` ids but
always holds whole documents; other columns are left out.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import REMEMBERED, lean, partitions, read, stored

TOKENIZER, END = "byte_bpe_50k.json", 2
FILE_IDS = 1 << 20
#: Texts that go to the tokenizer at a time, in characters.
CHARACTERS_AT_ONCE = 1 << 19
MAGIC = b"QTF1"
#: For each control byte the lengths of its four values.
LENGTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)


def pack(values: np.ndarray) -> bytes:
    """Control bytes, then value bytes, of unsigned 32-bit values."""
    values = values.astype("<u4")
    codes = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes() + values.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= codes[:, None]].tobytes()


def unpack(data: np.ndarray, n: int) -> np.ndarray:
    m = -(-n // 4)
    lengths = LENGTHS[data[:m]].ravel()[:n]
    at = m + np.cumsum(lengths) - lengths
    out = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_image(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    n = np.bincount(ids)
    seen = np.flatnonzero(n)
    order = np.argsort(-n[seen], kind="stable")
    rank = np.zeros(len(n), np.uint32)
    rank[seen[order]] = np.arange(len(seen), dtype=np.uint32)
    return b"".join(
        [
            MAGIC,
            struct.pack("<3q", len(doc_ids), len(ids), len(seen)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            np.array(counts, "<i8").tobytes(),
            seen[order].astype("<u4").tobytes(),
            pack(rank[ids]),
        ]
    )


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, the number of ids of each, and all ids."""
    if image[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, n, entries = struct.unpack_from("<3q", image, 4)
    at = 28
    doc_ids = np.frombuffer(image, "<i8", docs, at).tolist()
    known = np.frombuffer(image, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(image, "<i8", docs, at + 9 * docs)
    table = np.frombuffer(image, "<u4", entries, at + 17 * docs)
    ranks = unpack(np.frombuffer(image, np.uint8, offset=at + 17 * docs + 4 * entries), n)
    return [d if k else None for d, k in zip(doc_ids, known, strict=True)], counts, table[ranks]


#: The classes of byte-level BPE's usual word pattern, for the characters up to U+024F.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_PLAIN = re.compile("[^\0-\u024f]")
_WORDS = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Words whose ids a worker keeps.
KEPT_WORDS = 1_200_000
WORDS_AT_ONCE = 4_096
_ready: dict[int, Encoder] = REMEMBERED.setdefault(__name__, {})


class Numbered(dict):
    """Numbers words as they come; new ones wait in a list."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        i = self[word] = len(self)
        return i


class Encoder:
    """The tokenizers library with a memory: a word's ids depend on the word alone, so each is asked for once.

    That holds for tokenizers that split by the pattern above and change nothing before; with others, and for texts with
    characters beyond the pattern's classes here or with the content of an added token, whole texts go to the library.
    """

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        spec = json.loads(data)
        self.added = [a["content"] for a in spec.get("added_tokens") or []]
        split = spec.get("pre_tokenizer") or {}
        self.by_word = not spec.get("normalizer") and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        self._clear()

    def _clear(self) -> None:
        self.number = Numbered()
        self.pool = np.empty(1 << 16, np.uint32)  # the ids of all numbered words, one after the other
        self.ends = np.zeros(1 << 14, np.int64)  # number n's ids lie from ends[n] to ends[n + 1]

    def _learn(self) -> None:
        words, self.number.new = self.number.new, []
        first = len(self.number) - len(words)
        while len(self.ends) <= len(self.number):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        for at in range(0, len(words), WORDS_AT_ONCE):
            some = words[at : at + WORDS_AT_ONCE]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, n = np.array(e.ids, np.uint32), np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
            base = self.ends[first + at]
            while len(self.pool) < base + len(ids):
                self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
            self.pool[base : base + len(ids)] = ids
            self.ends[first + at + 1 : first + at + 1 + len(some)] = base + np.cumsum(n)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [_WORDS.findall(t) for t in texts]
        n = np.array([len(s) for s in split], np.int64)
        words = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        self._learn()
        start, size = self.ends[words], self.ends[words + 1] - self.ends[words]
        at = np.cumsum(size)
        ids = self.pool[np.repeat(start - (at - size), size) + np.arange(at[-1] if len(at) else 0)]
        return ids, np.diff(np.concatenate([[0], at])[np.concatenate([[0], np.cumsum(n)])])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.number) > KEPT_WORDS:
            self._clear()
        plain = [self.by_word and not _PLAIN.search(t) and not any(a in t for a in self.added) for t in texts]
        ids, n = self._words([t for t, p in zip(texts, plain, strict=True) if p])
        own = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else ())
        rest = iter(self.tokenizer.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [next(own) if p else np.array(next(rest).ids, np.uint32) for p in plain]


def ready(data: bytes) -> Encoder:
    key = zlib.crc32(data)
    if key not in _ready:
        _ready.clear()
        _ready[key] = Encoder(data)
    return _ready[key]


def file_writer(data: bytes, end: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = ready(data), np.array([end], np.uint32)
        part, seq = TaskContext.get().partitionId(), 0
        docs: list = []
        counts: list[int] = []
        ids: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            image = write_image(docs, counts, np.concatenate(ids))
            row = [pa.array([x], pa.int64()) for x in (part, seq, len(docs), held)]
            docs.clear(), counts.clear(), ids.clear()
            seq, held = seq + 1, 0
            return pa.record_batch([*row, pa.array([image], pa.binary())], ["part", "seq", "n_docs", "n_ids", "image"])

        def chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
            at, texts, size = [], [], 0
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                at.append(d.as_py())
                texts.append(t.as_py() or "")
                size += len(texts[-1])
                if size >= CHARACTERS_AT_ONCE:
                    yield at, texts
                    at, texts, size = [], [], 0
            if at:
                yield at, texts

        for batch in batches:
            for some, texts in chunks(batch):
                for d, x in zip(some, encoder.encode(texts), strict=True):
                    docs.append(d)
                    counts.append(len(x) + 1)
                    ids += [x, last]
                    held += counts[-1]
                    if held >= file_ids:
                        yield close()
        if docs:
            yield close()

    return run


def write(docs: DataFrame, path: str | None = None, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes doc_id, text in ascending doc_id order; gives the stored table of files: part, seq, n_docs, n_ids, image. path: of the tokenizer's file on the driver."""
    with open(path or public_tokenizers.path(TOKENIZER), "rb") as f:
        data = f.read()
    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(order.mapInArrow(lean(file_writer(data, end, file_ids)), "part long, seq long, n_docs long, n_ids long, image binary"), "tokens")


def export(files: DataFrame, folder: str) -> None:
    """Plain .qtf files, named by their order, in a folder that this process can write (one file in memory at a time)."""
    for r in files.select("part", "seq", "image").toLocalIterator():
        (Path(folder) / f"{r[0]:06d}-{r[1]:06d}.qtf").write_bytes(r[2])


def file_reader(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                docs, counts, ids = read_image(image.as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                cols = [pa.array(docs, pa.int64()), pa.array(base + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return run


def read_back(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start (ids before it in all files), n_tokens, ids_crc32 and, if wanted, the ids, decoded from the files."""
    so_far = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a part, so at most as many as the session has shuffle partitions; then the files of each part on their own.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", so_far(Window.orderBy("part")).alias("part_base"))
    bases = files.select("part", "seq", so_far(Window.partitionBy("part").orderBy("seq")).alias("in_part")).join(F.broadcast(parts), "part")
    # Written, so that its size is known: sent to all as long as that is below the session's threshold, else shuffled.
    bases = stored(bases.select("part", "seq", (F.col("part_base") + F.col("in_part")).alias("base")), "bases")
    placed = files.select("part", "seq", "image").join(bases, ["part", "seq"])
    return placed.select("image", "base").mapInArrow(lean(file_reader(with_ids)), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(write(read(spark, sf_dir, "documents")), with_ids=False)
