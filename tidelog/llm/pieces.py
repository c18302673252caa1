"""SentencePiece BPE ids by vectorised merge rounds, and their decoding.

All distinct words of a chunk of texts are one flat array of symbols. A round looks up the rank of
every neighbouring pair, takes the smallest rank of each word (segmented minimum), merges all its
places in the word from the left at once, and closes the gaps; words without a pair leave.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .words import text_bytes

CHUNK_BYTES = 2 << 20  # text encoded at once; longer texts pass in windows cut where no piece can span
CHUNK_IDS = 1 << 18      # ids decoded at once
SPACE = 0x2581
NONE = np.int32(2**31 - 1)
# Numbers of fields and kinds in the model file, and the text that stands for an unknown id.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, KIND = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, UNKNOWN_TEXT = 3, 35, 44
CHARSMAP, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
UNKNOWN_SURFACE = " ⁇ "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at:at + size]
            at += size


class PieceModel:
    """Tables of a byte-pair model file, made once per Python worker."""

    def __init__(self, data: bytes):
        parts: dict[int, list[bytes]] = {PIECES: [], TRAINER: [], NORMALIZER: []}
        for number, value in _fields(data):
            if number in parts:
                parts[number].append(value)
        trainer, normal = ({k: v for p in parts[n] for k, v in _fields(p)} for n in (TRAINER, NORMALIZER))
        if trainer.get(MODEL_TYPE, 1) != BPE or not trainer.get(BYTE_FALLBACK):
            raise ValueError("expected a BPE model with byte fallback")
        if normal.get(CHARSMAP) or normal.get(EXTRA_SPACES, 1) or not normal.get(ESCAPE_SPACES, 1):
            raise ValueError("only models that keep the text as it is are known here")
        self.prefix = bool(normal.get(DUMMY_PREFIX, 1))
        names, scores, kinds = [], [], []
        for fields in (dict(_fields(p)) for p in parts[PIECES]):
            names.append(fields[PIECE].decode())
            scores.append(struct.unpack("<f", fields[SCORE])[0] if SCORE in fields else 0.0)
            kinds.append(fields.get(KIND, NORMAL))
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not known here")
        self.size, self.kinds = len(names), np.array(kinds)
        self._surfaces(names, trainer.get(UNKNOWN_TEXT, UNKNOWN_SURFACE.encode()))
        self._pairs({name: i for i, name in enumerate(names) if kinds[i] == NORMAL}, scores)

    def _surfaces(self, names: list[str], unknown: bytes) -> None:
        self.bytes = np.full(256, -1, np.int32)
        texts = []
        for i, (name, kind) in enumerate(zip(names, self.kinds)):
            if kind == BYTE:
                self.bytes[int(name[1:-1], 16)] = i
            texts.append({BYTE: lambda: bytes([int(name[1:-1], 16)]), CONTROL: bytes, UNKNOWN: lambda: unknown}.get(
                kind, lambda: name.replace(chr(SPACE), " ").encode())())
        self.surface = np.frombuffer(b"".join(texts), np.uint8)
        self.length = np.array([len(t) for t in texts], np.int32)
        self.place = np.cumsum(self.length, dtype=np.int32) - self.length
        self.leads = (self.kinds == NORMAL) & np.array([n.startswith(chr(SPACE)) for n in names])

    def _pairs(self, ids: dict[str, int], scores: list[float]) -> None:
        """Ranks of all pairs that make a piece; a character without a piece is the symbol size + code point."""
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for name, i in ids.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        rank_of = {name: order[scores[i]] for name, i in ids.items()}

        def symbol(part: str) -> int | None:
            return int(self.symbol[ord(part)]) if len(part) == 1 else ids.get(part)

        keys, ranks, made, early = [], [], [], set()
        for name, i in ids.items():
            for k in range(1, len(name)):
                left, right = symbol(name[:k]), symbol(name[k:])
                if left is not None and right is not None:
                    keys.append(left * (self.size + 0x110000) + right)
                    ranks.append(rank_of[name])
                    made.append(i)
                    # a piece that can go on to one of no later rank: its merges need a look at the neighbours
                    early |= {ids[p] for p in (name[:k], name[k:]) if rank_of.get(p, -1) >= rank_of[name]}
        sort = np.argsort(keys)
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[sort], np.array(ranks, np.int32)[sort], np.array(made, np.int32)[sort]
        self.early = np.zeros(self.size, bool)
        self.early[list(early)] = True
        inside = sorted({c for name in ids if len(name) > 1 for c in name})
        self.group = np.zeros(0x110000, np.int16)
        self.group[[ord(c) for c in inside]] = np.arange(1, len(inside) + 1)
        self.together = np.zeros((len(inside) + 1, len(inside) + 1), bool)
        for name in ids:
            for a, b in zip(name, name[1:]):
                self.together[self.group[ord(a)], self.group[ord(b)]] = True
        self._runs(ids, rank_of)
        plain = [i for i in range(256) if chr(i).isalnum() and i < 128]
        self.cuts = np.zeros(256, bool)  # bytes after which a space always starts a word
        self.cuts[[b for b in plain if not self.together[self.group[b], self.group[SPACE]]]] = True

    def _runs(self, ids: dict[str, int], rank_of: dict[str, int]) -> None:
        """Pieces that are runs of spaces may share one rank; a run is then merged from the left alone (see _fold)."""
        space = chr(SPACE)
        doubled = [n for n in ids if space * 2 in n]
        tied = len({rank_of[n] for n in doubled}) == 1 and all(n == space * len(n) for n in doubled)
        self.run_rank = rank_of[doubled[0]] if tied else -1
        self.run_piece = {len(n): ids[n] for n in doubled} | {1: int(self.symbol[SPACE])}

    def _run(self, size: int) -> list[int]:
        """Pieces of a run of spaces: the leftmost pair that makes a piece goes first."""
        stack: list[int] = []
        for _ in range(size):
            stack.append(1)
            while len(stack) > 1 and stack[-2] + stack[-1] in self.run_piece:
                stack[-2:] = [stack[-2] + stack[-1]]
        return [self.run_piece[n] for n in stack]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * (self.size + 0x110000) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.made[at]

    def _fold(self, sym: np.ndarray, word: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and words of the chosen places, with runs of spaces merged."""
        sym, word = sym[chosen], word[chosen]
        space = sym == self.run_piece[1]
        start = np.flatnonzero(space & ~np.concatenate([[False], space[:-1] & (word[1:] == word[:-1])]))
        end = np.flatnonzero(space & ~np.concatenate([space[1:] & (word[1:] == word[:-1]), [False]])) + 1
        keep, out = np.ones(len(sym), bool), sym.copy()
        known = {n: self._run(n) for n in np.unique(end - start).tolist()}
        for a, b in zip(start.tolist(), end.tolist()):
            pieces = known[b - a]
            out[a:a + len(pieces)] = pieces
            keep[a + len(pieces):b] = False
        return out[keep], word[keep]

    def merge(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words after all merges, and their offsets; ``starts`` are the offsets of the words in ``sym``."""
        words = len(starts) - 1
        word = np.repeat(np.arange(words, dtype=np.int32), np.diff(starts))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made, changed = np.full(len(sym), NONE), np.zeros(len(sym), np.int32), np.arange(len(sym))
        while len(sym):
            changed = changed[changed < len(sym) - 1]
            joined = word[changed] == word[changed + 1]
            rank[changed[~joined]] = NONE
            changed = changed[joined]
            rank[changed], made[changed] = self._look_up(sym[changed], sym[changed + 1])
            rank[-1] = NONE
            fresh = np.concatenate([[True], word[1:] != word[:-1]])
            start = np.flatnonzero(fresh)
            least = np.minimum.reduceat(rank, start)
            best = np.repeat(least, np.diff(np.append(start, len(sym))))
            going = best < NONE
            runs = best == self.run_rank
            if runs.any():  # nothing else is left to merge in these words
                done.append(self._fold(sym, word, runs))
            if not going.all():
                done.append((sym[~going], word[~going]))
            going &= ~runs
            if not going.all():
                sym, word, rank, made, best = sym[going], word[going], rank[going], made[going], best[going]
            hit = np.flatnonzero(rank == best)
            if not len(hit):
                break
            index = np.arange(len(hit))
            alone = np.concatenate([[True], np.diff(hit) > 1])
            hit = hit[(index - np.maximum.accumulate(np.where(alone, index, 0))) % 2 == 0]
            hit = self._until_early(sym, word, made, best, hit)
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym[hit] = made[hit]
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            hit = hit - np.arange(len(hit))
            near = np.zeros(len(sym), bool)
            near[hit] = near[np.maximum(hit - 1, 0)] = True
            changed = np.flatnonzero(near)
        sym, word = (np.concatenate(x) for x in zip(*done, (sym[:0], word[:0])))
        return sym[np.argsort(word, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=words))])

    def _until_early(self, sym, word, made, best, hit):
        """Leave out merges to the right of one that makes a pair of no later rank, which goes first in its word."""
        risky = hit[self.early[made[hit]]]
        if not len(risky):
            return hit
        after = sym.copy()
        after[hit + 1] = made[hit]  # what stands to the left of the next symbol once these are merged
        early = np.zeros(len(sym), bool)
        for side in (-1, 2):
            near = risky + side
            there = (near >= 0) & (near < len(sym))
            there[there] = word[near[there]] == word[risky[there]]
            i = risky[there]
            other = after[i - 1] if side < 0 else sym[i + 2]
            rank = self._look_up(*((other, made[i]) if side < 0 else (made[i], other)))[0]
            early[i[rank <= best[i]]] = True
        count = np.cumsum(early[hit]) - early[hit]  # early ones before
        first = np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])
        return hit[count == np.maximum.accumulate(np.where(first, count, 0))]

    def _spans(self, data: np.ndarray, edges: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of neighbouring stretches of text and how many each has."""
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        edges = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[edges]
        put = prefix & (np.diff(edges) > 0)
        points = np.insert(points, edges[:-1][put], SPACE)
        edges = edges + np.concatenate([[0], np.cumsum(put)])
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(edges) - 1, np.int64)
        points[points == 0x20] = SPACE
        group = self.group[points]
        cut = np.concatenate([[True], ~self.together[group[:-1], group[1:]]])
        cut[edges[:-1][np.diff(edges) > 0]] = True
        starts = np.flatnonzero(cut)
        offsets = np.append(starts, len(points)).astype(np.int32) * 4
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(points)]).dictionary_encode()
        plain, where = words.dictionary.buffers()[2], np.frombuffer(words.dictionary.buffers()[1], np.int32)[:len(words.dictionary) + 1]
        ids, at = self._bytes(*self.merge(self.symbol[np.frombuffer(plain, "<u4", where[-1] // 4)], where // 4))
        word = words.indices.to_numpy()
        size = np.diff(at)[word]
        upto = np.concatenate([[0], np.cumsum(size)])
        flat = ids[np.arange(upto[-1]) + np.repeat(at[word] - upto[:-1], size)]
        return flat, np.diff(upto[np.searchsorted(starts, edges)])

    def _bytes(self, sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the ids of their UTF-8 bytes."""
        point = np.maximum(sym.astype(np.int64) - self.size, 0)
        size = np.where(sym < self.size, 1, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))
        out = np.repeat(sym, size)
        first = np.cumsum(size) - size
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            some = np.flatnonzero((sym >= self.size) & (size == n))
            for k in range(n):
                bits = point[some] >> 6 * (n - 1 - k)
                out[first[some] + k] = self.bytes[bits | lead if k == 0 else bits & 0x3F | 0x80]
        return out, np.append(first, len(out))[at]

    def encode(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (null: none), as a list array."""
        data, offsets = text_bytes(texts)
        parts, counts, low = [], [], 0
        while low < len(texts):
            high = min(len(texts), max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, "right")) - 1))
            some, edges = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
            try:
                ids, n = self._rows(some, edges)
            except UnicodeDecodeError:
                mended = [bytes(some[a:b]).decode(errors="replace") for a, b in zip(edges, edges[1:])]
                ids, n = self._rows(*text_bytes(pa.array(mended, pa.string())))
            parts.append(ids)
            counts.append(n)
            low = high
        flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
        at = np.concatenate([[0], *counts]).cumsum()
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))

    def _rows(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [], np.zeros(len(edges) - 1, np.int64)
        for a, b in self._windows(data, 0, len(data)):
            ids, n = self._spans(data[a:b], np.clip(edges, a, b) - a, np.full(len(counts), self.prefix and a == 0))
            parts.append(ids)
            counts += n
        return np.concatenate(parts), counts

    def _windows(self, data: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int]]:
        while high - low > 2 * CHUNK_BYTES:  # only a single text is that long
            step = CHUNK_BYTES
            while True:
                end = min(low + step, high)
                places = np.flatnonzero((data[low + 1:end] == 0x20) & self.cuts[data[low:end - 1]])
                if len(places) or end == high:
                    break
                step *= 2
            if not len(places):
                break
            yield low, low + 1 + int(places[-1])
            low += 1 + int(places[-1])
        yield low, high

    def decode(self, lists: pa.Array) -> pa.Array:
        """Text of each list of ids (null: empty)."""
        if lists.null_count:
            lists = pa.array([x or [] for x in lists.to_pylist()], lists.type)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy(zero_copy_only=False)
        parts, low = [], 0
        while low < len(lists):
            high = min(len(lists), max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_IDS, "right")) - 1))
            parts.append(self._texts(ids[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]))
            low = high
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    def _texts(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("id outside the vocabulary")
        place, length = self.place[ids], self.length[ids]
        if self.prefix:  # the space in front of the text goes from the first id that is no control id
            said = np.append(np.flatnonzero(self.kinds[ids] != CONTROL), len(ids))
            first = said[np.searchsorted(said, offsets[:-1])]
            first = first[first < offsets[1:]]
            first = first[self.leads[ids[first]]]
            place[first] += 1
            length[first] -= 1
        upto = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        parts = []
        for a in range(0, len(ids), CHUNK_IDS):  # only a single text is that long
            b = min(a + CHUNK_IDS, len(ids))
            parts.append(self.surface[np.arange(upto[b] - upto[a]) + np.repeat(place[a:b] - (upto[a:b] - upto[a]), length[a:b])].tobytes())
        data, ends = b"".join(parts), upto[offsets]
        try:
            data.decode()
        except UnicodeDecodeError:
            return pa.array([self._mend(data[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
        return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])

    @staticmethod
    def _mend(data: bytes) -> str:
        """Text of bytes; each byte that is part of no character becomes one replacement character."""
        out = []
        while data:
            try:
                out.append(data.decode())
                break
            except UnicodeDecodeError as err:
                out += [data[:err.start].decode(), "�"]
                data = data[err.start + 1:]
        return "".join(out)


@lru_cache(4)
def _model(data: bytes) -> PieceModel:
    return PieceModel(data)


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file, from a path that Spark's readers or the driver can open; a vocabulary is small and travels with the function."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as file:
        return file.read()


def encode_column(column: Column, model: bytes) -> Column:
    """Ids of a text column as array<int>, without begin and end ids."""
    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _model(model).encode(texts)

    return encode(column.cast("string"))


def decode_column(column: Column, model: bytes) -> Column:
    """Text of an array<int> column of ids."""
    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids in batches:
            yield _model(model).decode(ids)

    return decode(column.cast("array<int>"))


def encode_texts(df: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str | None = None) -> DataFrame:
    """All columns of ``df``, the ids of the text (``ids_col``) and, if named, the text decoded from them again.

    ``model`` holds the bytes of a BPE model file with byte fallback that keeps texts as they are
    (see read_model). Null and empty texts have no ids and decode to the empty text. Whole texts are
    encoded, very long ones in windows that end where no piece can span, so the ids do not depend on
    batches or windows. Columns named like the new ones are replaced, any others are kept. An empty
    table gives an empty table. Bytes that are no UTF-8 are read as replacement characters.
    """
    kept = [c for c in df.columns if c not in (ids_col, decoded_col)]
    if decoded_col is None:
        return df.select(*kept, encode_column(F.col(text_col), model).alias(ids_col))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:  # one worker for the two directions
        for texts in batches:
            ids = _model(model).encode(texts)
            yield pa.StructArray.from_arrays([ids, _model(model).decode(ids)], names=["ids", "decoded"])

    taken = "pieces__" + "_" * max(map(len, kept), default=0)  # no column has this name
    out = df.select(*kept, both(F.col(text_col).cast("string")).alias(taken))
    return out.select(*kept, F.col(taken)["ids"].alias(ids_col), F.col(taken)["decoded"].alias(decoded_col))
