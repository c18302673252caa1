"""Token ids packed into fixed-width matrices by best-fit decreasing."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

WIDTH = 2048
MATRIX_ROWS = 64
GROUP_TOKENS = 16 << 20  # tokens of one task that are sorted and packed together
# Fixed value: splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PACKED = ("pack string, matrix int, n_rows int, width int, ids binary, row_starts array<int>, cu_seqlens array<int>,"
          " position_resets array<int>, doc_ids array<long>, pieces array<int>")


class FreeSpace:
    """Segment tree over free capacities 0..width that finds the tightest open bin.

    Node values count the open bins below; bins of one capacity are kept as a stack.
    """

    def __init__(self, width: int):
        self.size = 1 << (width + 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, capacity: int, name: int) -> None:
        self.bins.setdefault(capacity, []).append(name)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) with the smallest capacity of at least ``need``; None without one."""
        node = need + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node <<= 1
                if not self.count[node]:
                    node += 1
        capacity = node - self.size
        self._change(capacity, -1)
        return capacity, self.bins[capacity].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Bins as lists of item numbers; longest items first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    free = FreeSpace(width)
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = free.take(lengths[item])
        if found is None:
            bins.append([item])
            capacity, name = width, len(bins) - 1
        else:
            capacity, name = found
            bins[name].append(item)
        if capacity > lengths[item]:
            free.add(capacity - lengths[item], name)
    return bins


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def _matrices(pack: str, items: list[tuple[int | None, int, np.ndarray]], width: int, pad: int, dtype) -> Iterator[tuple]:
    bins = best_fit_decreasing([len(ids) for _, _, ids in items], width)
    for number, low in enumerate(range(0, len(bins), MATRIX_ROWS)):
        some = bins[low:low + MATRIX_ROWS]
        matrix = np.full((len(some), width), pad, dtype)
        starts, ends, resets, docs, pieces = [0], [], [], [], []
        for r, members in enumerate(some):
            at = 0
            ends.append(0)
            for i in members:
                doc, piece, ids = items[i]
                matrix[r, at:at + len(ids)] = ids
                resets.append(r * width + at)
                at += len(ids)
                ends.append(at)
                docs.append(doc)
                pieces.append(piece)
            starts.append(len(docs))
        yield pack, number, len(some), width, matrix.tobytes(), starts, ends, resets, docs, pieces


def pack_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Packed id matrices of all texts, one row per matrix of at most MATRIX_ROWS sequences.

    Every text becomes its ids and an end id (the vocabulary size, also used as padding); longer
    ones are cut into pieces of ``width`` ids, numbered from 0, that join to the whole again.
    Pieces are packed by best-fit decreasing, in groups of about GROUP_TOKENS inside a task, so
    nothing is shuffled and memory is bounded; groups follow the input splits.

    ``ids``: n_rows x width, little-endian, uint16 if the ids fit, else uint32. ``row_starts``:
    first segment of each row and the number of segments. ``cu_seqlens``: per row 0 and the
    end of each segment. ``position_resets``: flat places where positions start at 0 again.
    Null and empty texts give the end id alone; ids may be null or repeat. Other columns are not
    read. An empty table gives an empty table.
    """
    if width < 1:
        raise ValueError("width must be at least 1")

    def run(batches):
        encoder, end = _encoder(vocabulary)
        dtype = np.uint16 if end < 1 << 16 else np.uint32
        task, group, items, held = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            rows = _matrices(f"{task}-{group}", items, width, end, dtype)
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encoder.encode_ordinary(text.as_py() or ""), end], dtype)
                items += [(doc, k, ids[a:a + width]) for k, a in enumerate(range(0, len(ids), width))]
                held += len(ids)
                if held >= GROUP_TOKENS:
                    yield from flush()
                    group, items, held = group + 1, [], 0
        if items:
            yield from flush()

    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["pack", "matrix", "n_rows", "width", "ids", "row_starts", "cu_seqlens", "position_resets", "doc_ids", "pieces"]
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> DataFrame:
    """Write the matrices as Parquet through Spark's committer and return the written table."""
    packed.write.mode("overwrite").parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """One row per segment of written matrices: doc_id, piece, pack, sequence, start, length, ids (little-endian bytes)."""

    def run(batches):
        for batch in batches:
            for m in batch.to_pylist():
                size = len(m["ids"]) // (m["n_rows"] * m["width"])
                out, place = [], 0
                for r in range(m["n_rows"]):
                    low, high = m["row_starts"][r:r + 2]
                    ends = m["cu_seqlens"][place:place + high - low + 1]
                    place += high - low + 1
                    for s, a, b in zip(range(low, high), ends, ends[1:]):
                        flat = r * m["width"] + a
                        if m["position_resets"][s] != flat:
                            raise ValueError("position resets and segment lengths disagree")
                        out.append((m["doc_ids"][s], m["pieces"][s], m["pack"], m["matrix"] * MATRIX_ROWS + r, a, b - a,
                                    m["ids"][flat * size:(flat + b - a) * size]))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names = ["doc_id", "piece", "pack", "sequence", "start", "length", "ids"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return packed.mapInArrow(run, "doc_id long, piece int, pack string, sequence int, start int, length int, ids binary")


def packed_digest(df: DataFrame, vocabulary: str, path: str, width: int = WIDTH) -> DataFrame:
    """Write packed matrices to ``path`` and return their segments with a checksum of the written ids."""
    written = write_packed(pack_tokens(df, vocabulary, width=width), path)
    return segments(written).select("doc_id", "piece", "pack", "sequence", "start", "length", F.crc32("ids").alias("ids_crc32"))
