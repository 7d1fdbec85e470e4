"""Bounded-space online packing of token ids into windows of fixed length.

Each partition keeps a fixed number of open windows. A document's full windows leave at once; what
is left of it goes to the open window with the least room that still holds it. When none does and
all windows are open, the fullest is filled with the head of the piece and emitted, and the rest is
placed again. At the end of a partition its open windows are leftovers; those of neighbouring
partitions are merged by the same rule and then poured together, so that at most one window for
each `merge` partitions is padded.

The ids equal those of the `tokenizers` file of the same vocabulary: they are made from its rank
form with `tiktoken`, which is several times faster; texts that spell a special token go through
`tokenizers` itself. Null and empty texts are one end-of-document id. Very long texts are encoded whole
and cut into windows. Repeated rows are packed each, rows without doc_id too. Of windows with equally
little room the first opened takes the piece. Columns besides doc_id and text are not read, those of
the result may clash with them. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table

_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_SCHEMA = pa.schema(_FIELDS + [("leftover", pa.bool_()), ("part", pa.int64()), ("ids", pa.binary())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, leftover boolean, part long, ids binary"
_ENCODERS: dict = {}
SPECIAL = "<|endoftext|>"


def tokenizer_files(json_path: str | None = None, rank_path: str | None = None) -> tuple[str, str]:
    if json_path is None:
        import public_tokenizers

        json_path = public_tokenizers.path("byte_bpe_50k.json")
    return json_path, rank_path or json_path.removesuffix(".json") + ".tiktoken"


def encoder(json_path: str, rank_path: str):
    """text -> uint32 ids, kept for a worker's later tasks."""
    key = (json_path, rank_path)
    if key not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole: list = []

        def encode(text: str) -> np.ndarray:
            if SPECIAL in text:
                if not whole:
                    whole.append(Tokenizer.from_file(json_path))
                return np.array(whole[0].encode(text, add_special_tokens=False).ids, np.uint32)
            return np.array(fast.encode_ordinary(text), np.uint32)

        _ENCODERS[key] = encode
    return _ENCODERS[key]


class Packer:
    """Open windows of one partition. emit(pieces) gets each window that is full."""

    def __init__(self, window: int, most_open: int, emit):
        self.window, self.most_open, self.emit = window, most_open, emit
        self.open: list[list] = []  # [used, [piece, ...]]; a piece: (doc, start, ids, doc_tokens)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        w = self.window
        while len(ids) >= w:
            self.emit([(doc, start, ids[:w], total)])
            start, ids = start + w, ids[w:]
        while len(ids):
            n, best = len(ids), None
            for x in self.open:
                if x[0] + n <= w and (best is None or x[0] > best[0]):
                    best = x
            if best is None and len(self.open) < self.most_open:
                best = [0, []]
                self.open.append(best)
            if best is not None:
                best[0] += n
                best[1].append((doc, start, ids, total))
                if best[0] == w:
                    self.open.remove(best)
                    self.emit(best[1])
                return
            best = max(self.open, key=lambda x: x[0])
            room = w - best[0]
            best[1].append((doc, start, ids[:room], total))
            self.open.remove(best)
            self.emit(best[1])
            start, ids = start + room, ids[room:]

    def pour(self) -> None:
        """Pour the open windows together; the last may be short."""
        rest = [x for _, x in sorted(self.open, key=lambda x: -x[0])]
        self.open, used, now = [], 0, []
        for doc, start, ids, total in (p for x in rest for p in x):
            while len(ids):
                n = min(len(ids), self.window - used)
                now.append((doc, start, ids[:n], total))
                start, ids, used = start + n, ids[n:], used + n
                if used == self.window:
                    self.emit(now)
                    used, now = 0, []
        if now:
            self.emit(now)


class _Rows:
    def __init__(self):
        self.rows: list[tuple] = []

    def window(self, pieces: list, sequence: int, part: int, leftover: bool) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, leftover, part, raw if leftover else None))
            offset += len(ids)

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[] for _ in _SCHEMA]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def pack(docs: DataFrame, window: int = 1024, most_open: int = 16, merge: int = 64, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, json_path: str | None = None, rank_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    files = tokenizer_files(json_path, rank_path)
    scratch = Scratch(docs.sparkSession, "pack")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        part = TaskContext.get().partitionId()
        rows, seen = _Rows(), [0]

        def emit(pieces: list) -> None:
            rows.window(pieces, (part << 33) | seen[0], part, False)
            seen[0] += 1

        packer = Packer(window, most_open, emit)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                packer.add(doc, 0, ids, len(ids))
                if len(rows.rows) >= 20_000:
                    yield rows.batch()
        for _, pieces in packer.open:
            rows.window(pieces, (part << 33) | seen[0], part, True)
            seen[0] += 1
        yield rows.batch()

    packed = scratch.write(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(first, _DDL), "packed")

    def second(table: pa.Table) -> pa.Table:
        got = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        group = (got[0]["part"] // merge) if got else 0
        rows, seen = _Rows(), [0]

        def emit(pieces: list) -> None:
            rows.window(pieces, (1 << 62) | (group << 33) | seen[0], group, False)
            seen[0] += 1

        packer = Packer(window, most_open, emit)
        for r in got:
            packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
        packer.pour()
        return pa.Table.from_batches([rows.batch()])

    left = packed.where("leftover").groupBy((F.col("part") / merge).cast("long").alias("g")).applyInArrow(second, _DDL)
    keep = [n for n, _ in _FIELDS]
    return packed.where("not leftover").select(*keep).unionByName(left.select(*keep))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
