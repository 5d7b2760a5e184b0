"""Best-fit-decreasing packing of token ids into fixed-length rows.

Documents longer than a row are cut into whole rows and a rest; nothing is
dropped.  The pieces of a window of documents are taken from the longest to the
shortest, and each goes to the row with the least room that still holds it: a
segment tree over the capacities finds that room in as many steps as the
logarithm of the row's length.  A window is a run of documents of one input
partition with about ``WINDOW`` tokens, so the memory a task needs is bounded and
no text is shuffled; each window leaves a few rows at most that are not full.

A row comes with its ids and position ids, as little-endian binaries, its
cumulative segment lengths, and the document and offset of each segment.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import narrow, table

#: Tokens of a row, and about those of a window.
ROW_LENGTH = 2_048
WINDOW = 4_000_000


class CapacityTree:
    """Open rows by the room they have left; finds the least room that is enough."""

    def __init__(self, most: int):
        self.size = 1
        while self.size <= most:
            self.size *= 2
        self.some = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.size + room
        while i and not self.some[i]:
            self.some[i] = 1
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and number of the tightest row with ``need`` left, taken out; None if there is none."""
        some, i = self.some, self.size + need
        if not some[i]:
            while i > 1 and (i & 1 or not some[i + 1]):  # up, until a subtree to the right has rows
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if some[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            some[i] = 0
            i //= 2
            while i and not (some[2 * i] or some[2 * i + 1]):
                some[i] = 0
                i //= 2
        return room, row


def pack_lengths(lengths: list[int], row_length: int) -> list[list[tuple[int, int, int]]]:
    """Rows of ``(document, offset, length)`` that hold all tokens of documents of these lengths."""
    pieces = []
    for doc, n in enumerate(lengths):
        pieces += [(min(row_length, n - at), doc, at) for at in range(0, n, row_length)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    rows: list[list[tuple[int, int, int]]] = []
    tree = CapacityTree(row_length)
    for n, doc, at in pieces:
        found = tree.take(n)
        if found is None:
            room, row = row_length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append((doc, at, n))
        if room > n:
            tree.add(room - n, row)
    return rows


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType())]))
PACKED = T.StructType([
    T.StructField("n_tokens", T.IntegerType()),
    T.StructField("n_padding", T.IntegerType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("position_ids", T.BinaryType()),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
    T.StructField("segments", _SEGMENTS),
])
_SEGMENTS_ARROW = pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32())]))


def _packed(docs: list[tuple[int | None, np.ndarray]], row_length: int, pad: int, kind: str) -> Iterator[pa.RecordBatch]:
    rows = pack_lengths([len(ids) for _, ids in docs], row_length)
    for first in range(0, len(rows), 1024):
        out: dict[str, list] = {f.name: [] for f in PACKED}
        for row in rows[first : first + 1024]:
            ids = np.full(row_length, pad, dtype=kind)
            positions = np.zeros(row_length, dtype="<u4")
            ends = [0]
            for doc, start, n in row:
                a = ends[-1]
                ids[a : a + n] = docs[doc][1][start : start + n]
                positions[a : a + n] = np.arange(n)
                ends.append(a + n)
            out["n_tokens"].append(ends[-1])
            out["n_padding"].append(row_length - ends[-1])
            out["ids"].append(ids.tobytes())
            out["position_ids"].append(positions.tobytes())
            out["cu_seqlens"].append(ends)
            out["segments"].append([{"doc_id": docs[d][0], "start": s, "length": n} for d, s, n in row])
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), _SEGMENTS_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))


def _windows(docs: Iterable[tuple[int | None, np.ndarray]], row_length: int, pad: int, kind: str) -> Iterator[pa.RecordBatch]:
    held, tokens = [], 0
    for doc in docs:
        held.append(doc)
        tokens += len(doc[1])
        if tokens >= WINDOW:
            yield from _packed(held, row_length, pad, kind)
            held, tokens = [], 0
    if held:
        yield from _packed(held, row_length, pad, kind)


def pack_ids(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", row_length: int = ROW_LENGTH, pad: int = 0, kind: str = "<u4") -> DataFrame:
    """Packed rows of id lists, with the columns of ``PACKED``; null and empty lists take no room."""
    docs = narrow(df, doc_id=doc_id, ids=ids).select(F.col("doc_id").cast("long"), "ids")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield i, np.asarray(x.as_py() or [], dtype=kind)

        yield from _windows(rows(), row_length, pad, kind)

    return docs.mapInArrow(each, PACKED)


_OPEN: dict[bytes, object] = {}


def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _OPEN:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _OPEN[key] = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _OPEN[key]


def pack_texts(df: DataFrame, ranks_path: str, pattern: str, end_id: int, doc_id: str = "doc_id", text: str = "text", row_length: int = ROW_LENGTH, kind: str = "<u2") -> DataFrame:
    """Packed rows of whole texts under a byte-level vocabulary of ranks, each text closed by ``end_id``, which also pads.

    A null text counts as empty and has its end id only.  Repeated rows and null
    ids are kept, no other column is read, an empty table gives an empty one.
    """
    with open(ranks_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    docs = narrow(df, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks.value, pattern).encode_ordinary

        def rows():
            for batch in batches:
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                    yield i, np.array([*encode(t.as_py() or ""), end_id], dtype=kind)

        yield from _windows(rows(), row_length, end_id, kind)

    return docs.mapInArrow(each, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet files of binary matrices' rows, for readers that map them to arrays."""
    packed.write.mode("errorifexists").parquet(path)


def id_matrix(rows: Iterable, row_length: int = ROW_LENGTH, kind: str = "<u2") -> np.ndarray:
    """The ids of collected packed rows as one matrix."""
    rows = list(rows)
    return np.frombuffer(b"".join(bytes(r["ids"]) for r in rows), dtype=kind).reshape(len(rows), row_length)


def op8_packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in rows of 2,048: each row's layout and the digests of its ids and position ids."""
    import public_tokenizers

    packed = pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=50_256)
    return packed.select(
        F.col("segments.doc_id").alias("doc_ids"),
        F.col("segments.start").alias("starts"),
        "cu_seqlens",
        "n_tokens",
        "n_padding",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("position_ids", 256).alias("position_ids_sha256"),
    )
