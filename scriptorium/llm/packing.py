"""Packing of documents into fixed windows of tokens: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's full windows leave at once; its rest goes to the
open window that it fills best. When none has room, the fullest is topped up with a cut of
that rest and emitted. What is open at a partition's end is a leftover: leftovers of a few
partitions meet in one task, are packed the same way, and the last tokens leave in windows whose
lengths are powers of two. So no window is padded.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import Workspace, column, give_back, shrink_heaps

LENGTH = 1024
OPEN_WINDOWS = 32
#: Leftovers of so many partitions are merged in one task: at most that many times OPEN_WINDOWS windows.
MERGE = 8
#: Texts with longer words or more white space than this go to the library ``tokenizers`` itself.
LONG_WORD, MUCH_SPACE = 2000, 1000


@lru_cache(4)
def encoder(vocabulary: str, ranks: str | None, special: bool = False):
    """A function from texts to lists of ids, as ``tokenizers`` gives them for ``vocabulary``. Special tokens' strings are their ids if ``special``, as is
    that library's default, else ordinary text.

    ``ranks`` is the same vocabulary for ``tiktoken``, which gives the same ids in a quarter of the time.
    """
    slow: list = []  # loaded when a text needs it

    def exact(text: str) -> list[int]:
        if not slow:
            from tokenizers import Tokenizer

            slow.append(Tokenizer.from_file(vocabulary))
            slow[0].encode_special_tokens = not special
        return slow[0].encode(text, add_special_tokens=False).ids

    if not ranks:
        return exact
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    added: list[str] = []  # the strings that are looked for in a text before it is cut
    if special:
        with open(vocabulary, encoding="utf-8") as file:
            added = [t["content"] for t in json.load(file)["added_tokens"]]

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return exact(text)
        words = text.split()
        sizes = [*map(len, words)]
        if max(sizes, default=0) > LONG_WORD or len(text) - sum(sizes) > 2 * len(words) + MUCH_SPACE:
            return exact(text)
        return quick.encode_ordinary(text)

    return encode


class Packer:
    """Pieces are (doc_id, start, ids, doc_tokens). ``emit`` gets a window's pieces, at most ``length`` ids together."""

    def __init__(self, length: int, windows: int, emit):
        self.length, self.windows, self.emit = length, windows, emit
        self.free: list[tuple[int, int]] = []  # (room, window), sorted
        self.open: dict[int, list] = {}
        self.made = 0

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self.emit([(doc, start, ids[: self.length], total)])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            i = bisect_left(self.free, (len(ids), -1))
            if i < len(self.free):  # the least room that is enough
                room, w = self.free.pop(i)
                self._put(w, room, (doc, start, ids, total))
                return
            if len(self.free) < self.windows:
                w, self.made = self.made, self.made + 1
                self.open[w] = []
                self._put(w, self.length, (doc, start, ids, total))
                return
            room, w = self.free.pop(0)  # the fullest takes what it can and goes
            self._put(w, room, (doc, start, ids[:room], total))
            start, ids = start + room, ids[room:]

    def _put(self, w: int, room: int, piece) -> None:
        self.open[w].append(piece)
        room -= len(piece[2])
        if room:
            insort(self.free, (room, w))
        else:
            self.emit(self.open.pop(w))

    def leftovers(self) -> list[list]:
        out = [self.open[w] for _, w in self.free]
        self.free, self.open = [], {}
        return out

    def finish(self) -> None:
        """Emit all that is open, cut so that each window is full or its length a power of two."""
        rest = [p for w in self.leftovers() for p in w]
        left = sum(len(p[2]) for p in rest)
        window, room = [], 0
        for doc, start, ids, total in rest:
            while len(ids):
                if not room:
                    room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
                    left -= room
                    window = []
                part, ids = ids[:room], ids[room:]
                window.append((doc, start, part, total))
                start, room = start + len(part), room - len(part)
                if not room:
                    self.emit(window)


PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("merge", pa.int64()), ("ids", pa.binary())])
DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, merge bigint, ids binary"


class _Rows:
    """Collects windows as rows of PIECE."""

    def __init__(self, first: int, with_ids: bool):
        self.next, self.with_ids, self.rows = first, with_ids, []

    def window(self, pieces: Iterable[tuple], merge: int | None = None) -> None:
        at, own = 0, self.next
        self.next += merge is None
        for doc, start, ids, total in pieces:
            data = ids.tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(data), total, own if merge is None else None, at, merge, data if self.with_ids or merge is not None else None))
            at += len(ids)

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), PIECE, strict=True)], schema=PIECE)
            self.rows = []


def _pack(vocabulary: str, ranks: str | None, eos: int, length: int, windows: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(vocabulary, ranks, special=True), TaskContext.get().partitionId()
        rows = _Rows(part << 32, with_ids)
        packer = Packer(length, windows, rows.window)
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                ids = np.array([*encode(texts[i].as_py() or ""), eos], "<u4")
                packer.add(docs[i].as_py(), 0, ids, len(ids))
                if len(rows.rows) > 20_000:
                    yield from rows.take()
        for w in packer.leftovers():
            rows.window(w, part // MERGE)
        yield from rows.take()
        give_back()

    return run


def _merge(length: int, windows: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(1 << 62 | TaskContext.get().partitionId() << 32, with_ids)
        packer = Packer(length, windows, rows.window)
        for batch in batches:
            for r in batch.to_pylist():
                packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
            yield from rows.take()
        packer.finish()
        yield from rows.take()

    return run


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, ranks: str | None = None, eos: int = 0, length: int = LENGTH, windows: int = OPEN_WINDOWS, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset and,
    if ``ids``, the ids themselves (unsigned 32-bit little-endian).

    A document's ids are those of its whole text, special tokens' strings in it being their ids, then ``eos``; a null text is empty, so it and an empty one are the id ``eos``
    alone. Each id lies in one piece. A sequence has ``length`` ids or a power of two. Repeated rows are packed as often as they
    occur; a null identifier stays null. No rows: no rows. Other columns aren't read. Memory: one document's ids and the open windows.
    """
    ws = Workspace(spark, "packing")
    content = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    first = ws.keep(content.mapInArrow(_pack(vocabulary, ranks, eos, length, windows, ids), DDL), "first")
    left = first.where("sequence_id is null").repartition("merge").sortWithinPartitions("merge", "doc_id", "start", "ids_crc32")
    both = first.where("sequence_id is not null").unionByName(left.mapInArrow(_merge(length, windows, ids), DDL))
    return both.drop("merge") if ids else both.drop("merge", "ids")


def _public(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _public(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the documents' pieces."""
    shrink_heaps(spark)
    return _public(spark, docs)


__all__ = ["Packer", "encoder", "op1_packing", "pack", "pack_documents"]
