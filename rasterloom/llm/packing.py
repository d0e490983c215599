"""Sequence packing: best-fit decreasing over a segment tree of open windows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.session import ship_package

WINDOW = 2048
#: Pieces held before they are packed; bounds a task's memory whatever its input.
BUFFER_TOKENS = 8_000_000

PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


class OpenWindows:
    """Windows by remaining capacity, over a segment tree whose leaves are the capacities 0 to ``size``.

    A node holds whether any window below it is open; the tightest window for a piece is the first
    set leaf at or after the piece's length, found by walking up and down once.
    """

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.any = bytearray(2 * self.width)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, window: int) -> None:
        self.at[room].append(window)
        if len(self.at[room]) == 1:
            i = self.width + room
            while i and not self.any[i]:
                self.any[i] = 1
                i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and number of the tightest window with at least ``need`` room, which is removed."""
        i = self.width + need
        if not self.any[i]:
            while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.width
        window = self.at[room].pop()
        if not self.at[room]:
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return room, window


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """Numbers of the pieces in each sequence, for lengths up to ``window``: longest first, each into the tightest window."""
    windows, open_ = [], OpenWindows(window)
    for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        got = open_.take(lengths[p])
        if got is None:
            room, w = window, len(windows)
            windows.append([])
        else:
            room, w = got
        windows[w].append(p)
        if room > lengths[p]:
            open_.add(room - lengths[p], w)
    return windows


def fill(windows: list[list[tuple[int, int, int]]], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Empty the windows that hold least into the room of the others, cutting pieces, until at most one has room.

    Items are (piece, first, length). Best fit leaves few windows with room, so few pieces are cut.
    """
    held = [sum(n for _, _, n in w) for w in windows]
    loose = sorted((i for i in range(len(windows)) if held[i] < window), key=lambda i: (held[i], i))
    lo, hi = 0, len(loose) - 1
    while lo < hi:
        a, b = loose[lo], loose[hi]
        if held[b] == window:
            hi -= 1
        elif not windows[a]:
            lo += 1
        else:
            piece, first, n = windows[a].pop()
            part = min(n, window - held[b])
            windows[b].append((piece, first + n - part, part))
            if part < n:
                windows[a].append((piece, first, n - part))
            held[a], held[b] = held[a] - part, held[b] + part
    return [w for w in windows if w]


def pack_documents(
    docs: DataFrame, window: int = WINDOW, end_id: int = 1, text: str = "text", doc_id: str = "doc_id",
    buffer_tokens: int = BUFFER_TOKENS, tokenizer: str | None = None, ranks: str | None = None,
) -> DataFrame:
    """Pack every document's ids, with ``end_id`` after them, into sequences of at most ``window`` ids.

    A row for each piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (unsigned
    32-bit, little-endian). A document's full windows are cut off first and make sequences of their
    own; what remains is packed by best-fit decreasing, and sequences that still have room are filled
    by cutting the pieces of the emptiest ones, so that each buffer of about ``buffer_tokens`` ids
    leaves one short sequence at most. Documents stay in the task that reads them: nothing is
    shuffled, memory is bounded by the buffer and one document, and a lost task repeats itself alike.
    Null texts are empty documents of one id; repeated rows are packed each; an empty table gives no
    piece. ``sequence_id`` is unique within one run: the partition's number and a count.
    """

    ship_package(docs.sparkSession)

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from rasterloom.llm.tokenizer import encoder

        encode = encoder(tokenizer, ranks)
        next_id = TaskContext.get().partitionId() << 32
        schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

        def flush(held: list[tuple]) -> Iterator:
            nonlocal next_id
            lengths = [len(ids) for _, _, _, ids in held]
            whole = [[(p, 0, lengths[p]) for p in w] for w in best_fit(lengths, window)]
            rows, size = [], 0
            for w in fill(whole, window):
                offset = 0
                for p, first, n in w:
                    d, start, total, ids = held[p]
                    rows.append((d, start + first, n, total, next_id, offset, ids[first : first + n].tobytes()))
                    offset += n
                next_id += 1
                size += offset
                if size > 500_000:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

        held, tokens = [], 0
        for b in batches:
            full = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array([*encode(t.as_py() or ""), end_id], dtype="<u4")
                total = len(ids)
                for start in range(0, total - window + 1, window):
                    full.append((d, start, window, total, next_id, 0, ids[start : start + window].tobytes()))
                    next_id += 1
                rest = total % window
                if rest:
                    held.append((d, total - rest, total, ids[total - rest :].copy()))
                    tokens += rest
                if len(full) >= 250:
                    yield batch_of(full)
                    full = []
                if tokens >= buffer_tokens:
                    yield from flush(held)
                    held, tokens = [], 0
            if full:
                yield batch_of(full)
        yield from flush(held)

    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(pack, PIECES)
