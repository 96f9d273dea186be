"""Token-id output: best-fit-decreasing packing with a segment tree over capacities.

Each task reads its documents in groups of bounded size, encodes them, cuts those longer than a row
into pieces of a row's length and a rest, and places the pieces, longest first, each into the row with the
least room that still holds it. A segment tree over the amounts of room finds that row in
O(log capacity) steps. Rows never cross a group, so nothing is shuffled, a lost task redoes its own groups, and
memory is bounded by `group_tokens`.

A row has its ids (16 or 32 bits, little-endian, padded to the row's length), the
cumulative lengths of its segments, the places where positions start again, and for
each segment the document and which of its pieces it is. Joining a document's pieces in order
gives all its ids again.

Null and empty texts have an end-of-text id alone. Bytes that aren't UTF-8 count as U+FFFD. Repeated documents are packed each by itself; a null id
stays null. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import parts_of, ship, texts_of, tokenizer_path

CAPACITY = 2048
GROUP_TOKENS = 4_000_000


class Rooms:
    """A segment tree over the amounts of room 0..capacity: how many open rows have each, and which."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        node = self.size + room
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room of at least this, and its room; it is open no more."""
        node = self.size + least
        if not self.open[node]:
            while node & 1 or not self.open[node + 1]:  # up, until a subtree to the right has one
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node *= 2
                if not self.open[node]:
                    node += 1
        room = node - self.size
        row = self.rows[room].pop()
        while node:
            self.open[node] -= 1
            node >>= 1
        return row, room


def best_fit_decreasing(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The positions in lengths (from 1 to capacity) that share a row, for each row."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[i])
        if found is None:
            row, room = len(rows), capacity
            rows.append([])
        else:
            row, room = found
        rows[row].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], row)
    return rows


@lru_cache(maxsize=4)
def tiktoken_encoder(path: str, pattern: str) -> tuple[Callable[[str], list[int]], int]:
    """What encodes a text, and the highest id that it gives."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, max(ranks.values(), default=0)


ROW = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])
ROW_SCHEMA = "row_id long, n_tokens long, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>"


def packed_rows(segments: list[tuple[int | None, int, np.ndarray]], capacity: int, pad: int, dtype: str) -> Iterator[tuple]:
    """Rows of segments (document, piece, ids), as the columns of ROW after row_id."""
    for row in best_fit_decreasing([len(s[2]) for s in segments], capacity):
        own = [segments[i] for i in row]
        ends = np.cumsum([len(s[2]) for s in own])
        ids = np.full(capacity, pad, dtype)
        ids[: ends[-1]] = np.concatenate([s[2] for s in own])
        cumulative = [0, *ends.tolist()]
        yield int(ends[-1]), ids.tobytes(), cumulative, cumulative[:-1], [s[0] for s in own], [s[1] for s in own]


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, path: str | None = None, pattern: str | None = None, end_id: int = 50256, pad_id: int = 50256, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The packed rows of all documents. row_id is the task's number in the upper 31 bits and the row's own below."""
    ship(docs.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, highest = tiktoken_encoder(path, pattern)
        dtype = "<u2" if max(end_id, pad_id, highest) < 1 << 16 else "<u4"
        task, number = TaskContext.get().partitionId(), 0
        segments: list[tuple[int | None, int, np.ndarray]] = []
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal number, segments, size
            ready = list(packed_rows(segments, capacity, pad_id, dtype))
            segments, size = [], 0
            for start in range(0, len(ready), 1024):
                part = ready[start : start + 1024]
                columns = [[(task << 32) + number + i for i in range(len(part))], *map(list, zip(*part, strict=True))]
                number += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROW, strict=True)], schema=ROW)

        for batch in batches:
            for part in parts_of(batch):
                for doc, text in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                    ids = np.array([*encode(text or ""), end_id], dtype)
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        segments.append((doc, piece, ids[start : start + capacity]))
                    size += len(ids)
                    if size >= group_tokens:
                        yield from rows()
        if segments:
            yield from rows()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, ROW_SCHEMA)


def write(rows: DataFrame, path: str) -> None:
    """Packed rows as a table of id matrices, cumulative lengths and resets at path, which all executors share."""
    rows.write.mode("overwrite").parquet(path)


def matrix(ids: list[bytes], capacity: int = CAPACITY, dtype: str = "<u2") -> np.ndarray:
    """Rows' ids as a matrix, without copying each id."""
    return np.frombuffer(b"".join(ids), dtype).reshape(-1, capacity)


def position_ids(cu_seqlens: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """The position of each id in its segment; padding goes on from 0."""
    starts = np.zeros(capacity, np.int64)
    edges = [x for x in [*cu_seqlens] if x < capacity]
    starts[edges] = edges
    return np.arange(capacity) - np.maximum.accumulate(starts)
