"""Hierarchical Pitman-Yor word model: context restaurants over one shared parent, seated by Gibbs sampling.

Texts are cut vertically: the pair (previous word, word) of every token goes to the fragment of
the previous word, so a fragment holds whole context restaurants. As every token of a text is
also a context of that text exactly once (the end token starts it), token counts are known
there as well. Fragments send their tables to the parent, cut by word in the same way, and get
back the parent's part of the probability of each word they hold. Children and parent are seated twice in
turn, the second time with one discount for all fragments. Sums per text come back by block.
Contexts that hold a large share of all tokens are cut further, by the next word; their tokens and the
mean tables of their last seating are summed over the fragments, so that the words after any context,
a hot one too, have probabilities that add up to one. Only the size of the input and the few hundred such
words reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .words import chunks, mix

FRAGMENT_BYTES = 12 << 20   # text whose tokens make one fragment
BLOCK_TOKENS = 1_500_000    # tokens whose pairs travel together
STRENGTH = 0.5              # of every restaurant
UNKNOWN = 0.9               # share of the base measure for words never seen; known words share the rest
HOT_SHARE = 1 / 256         # a context above this share of the tokens, and above half a fragment, is cut by the next word
BURN_IN, SAMPLES = 4, 8     # Gibbs sweeps before and while averaging
EXACT = 2048                # customers of a kind up to which the weights of its tables come from the recursion
_END = mix(np.array([0x656E64], np.uint64))[0]

_CELL = "fragment int, block string, contexts binary, counts binary, words binary, low binary, docs binary, heads binary"
_MESSAGE = "fragment int, sender int, codes binary, low binary, many binary, tables binary, totals binary, own binary"
_ANSWER = "fragment int, sender int, mass binary, totals binary, own binary"
_PART = "block string, sums binary, heads binary, totals binary"


def _parents(fragments: int) -> int:
    """Parts of the parent: every fragment writes a row to each of them, and each gets the words of all fragments."""
    return max(min(fragments, 16), fragments // 32)


def _fragment(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int32)


def _six(values: np.ndarray) -> bytes:
    """Upper 48 bits of each value."""
    return values.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _five(high: bytes, low: bytes) -> np.ndarray:
    """Upper 40 bits of each value from their 32 and 8 bits."""
    return (np.frombuffer(high, np.uint32).astype(np.uint64) << np.uint64(32)) | (np.frombuffer(low, np.uint8).astype(np.uint64) << np.uint64(24))


def _frequent(batches):
    """Words with at least half of HOT_SHARE in some run of texts, with their counts there, and the number of tokens (word 0)."""
    for batch in batches:
        for low, high, words, _ in chunks(batch.column(0)):
            tokens = len(words) + high - low
            found, count = np.unique(words, return_counts=True)
            often = count >= tokens * HOT_SHARE / 2
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[found[often], _END, np.uint64(0)].view(np.int64)), pa.array(np.r_[count[often], high - low, tokens])], names=["word", "n"])


def hot_contexts(texts: DataFrame, fragments: int) -> np.ndarray:
    """Sorted hashes of the contexts to be cut by the next word; fewer than 1/HOT_SHARE, as shares add up to one."""
    if fragments == 1:
        return np.empty(0, np.uint64)
    counted = texts.mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.where("word = 0").agg(F.sum("n")).first()[0] or 0
    least = max(total * HOT_SHARE, total / (2 * fragments))
    rows = counted.where((F.col("word") != 0) & (F.col("n") >= least)).select("word").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _cells(fragments: int, hot: np.ndarray):
    """Pairs of every block of texts (id, text, training flag), cut by context, or by the next word after a hot one."""

    def block(name, ids, words, offsets, train):
        sizes = np.diff(offsets) + 1
        ends = np.cumsum(sizes)
        nexts = np.empty(ends[-1], np.uint64)
        inner = np.ones(len(nexts), bool)
        inner[ends - 1] = False
        nexts[inner], nexts[~inner] = words, _END
        before = np.empty_like(nexts)
        before[0], before[1:] = _END, nexts[:-1]
        doc = np.repeat(np.arange(len(sizes)) * 2 + train, sizes).astype(np.uint16)
        part = _fragment(before, fragments)
        if len(hot):
            cut = np.isin(before, hot)
            part[cut] = _fragment(nexts[cut], fragments)
        order = np.argsort(before, kind="stable")
        order = order[np.argsort(part[order], kind="stable")]
        before, nexts, doc, part = before[order], nexts[order], doc[order], part[order]
        starts = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (part[1:] != part[:-1])])
        context, count = before[starts], np.diff(np.r_[starts, len(before)])
        heads = np.stack([ids, train, sizes]).astype(np.int64).tobytes()
        rows = []
        for f in np.unique(np.r_[0, part]):
            c, d = np.searchsorted(part, (f, f + 1))
            a, b = np.searchsorted(starts, (c, d))
            w = nexts[c:d]
            rows.append((int(f), name, _six(context[a:b]), count[a:b].astype(np.uint32).tobytes(), (w >> np.uint64(32)).astype(np.uint32).tobytes(),
                         (w >> np.uint64(24)).astype(np.uint8).tobytes(), doc[c:d].tobytes(), heads if f == 0 else b""))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), *(pa.array(c, pa.binary()) for c in cols[2:])],
                                          names=[x.split()[0] for x in _CELL.split(", ")])

    def run(batches):
        task, serial = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = rows = 0

        def flush():
            nonlocal serial, held, size, rows
            offsets = np.cumsum(np.r_[0, *[np.diff(o) for _, _, o, _ in held]])
            out = block(f"{task}-{serial}", np.concatenate([i for i, *_ in held]), np.concatenate([w for _, w, _, _ in held]), offsets, np.concatenate([t for *_, t in held]))
            serial, held, size, rows = serial + 1, [], 0, 0
            return out

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for low, high, words, offsets in chunks(batch.column(1)):
                for a in range(low, high, 30_000):  # text numbers of a block fit 15 bits
                    b = min(high, a + 30_000)
                    if held and rows + b - a > 30_000:
                        yield flush()
                    held.append((ids[a:b], words[offsets[a - low]:offsets[b - low]], offsets[a - low:b - low + 1], train[a:b]))
                    size, rows = size + len(held[-1][1]), rows + b - a
                    if size >= BLOCK_TOKENS:
                        yield flush()
        if held:
            yield flush()

    return run


class Seatings:
    """Log weights of all seatings of n customers of one dish at 1 .. n tables (generalised Stirling numbers S of a discount).

    The ratios S(n, t + 1) / S(n, t) follow a recursion in n without cancellation. It is carried to
    EXACT customers; from there on the ratios depend on (t + 1/2) / n^d alone, and where tables
    are many against customers on the saddle point of the generating function (1 - (1 - x)^d) / d.
    """

    def __init__(self, discount: float, counts: np.ndarray):
        self.discount = discount
        self.rows: dict[int, np.ndarray] = {}
        most = min(int(counts.max(initial=1)), EXACT)
        wanted = set(counts[counts < EXACT].tolist())
        ratio = np.empty(most)
        for n in range(1, most + 1):
            if n > 1:  # ratio[t - 1] belongs to t; the last one has the weight 1 of n tables above it
                t = np.arange(1, n - 1)
                last = 1 / (1 / ratio[n - 3] + (n - 1) * (1 - discount)) if n > 2 else 1 / (1 - discount)
                inner = ratio[:n - 2]
                up = 1 + (n - 1 - discount * (t + 1)) * inner
                down = n - 1 - discount * t
                down[1:] += 1 / inner[:-1]
                ratio[:n - 2] = up / down
                ratio[n - 2] = last
            if n in wanted:
                self.rows[n] = np.r_[0.0, np.cumsum(np.log(ratio[:n - 1]))]
        if most == EXACT:
            self.last = np.log(ratio[:EXACT - 1])
            self.y = np.geomspace(1e-9, 60 / (1 - discount) if discount < 0.9 else 600.0, 8192)  # -log(1 - x)
            self.size = np.log(self._mean(self.y) - 1)

    def _mean(self, y: np.ndarray) -> np.ndarray:
        """Customers a table at a saddle point."""
        return self.discount * -np.expm1(-y) * np.exp((1 - self.discount) * y) / -np.expm1(-self.discount * y)

    def _saddle(self, n: int, t: np.ndarray) -> np.ndarray:
        """Log of S(n, t + 1) / S(n, t): that of the table's factor at the saddle point half way."""
        y = np.exp(np.interp(np.log(n / (t + 0.5) - 1), self.size, np.log(self.y)))
        spare = n - t
        return np.log(-np.expm1(-self.discount * y) / self.discount / (t + 0.5) * spare / (spare - 0.5))

    def row(self, n: int) -> np.ndarray:
        if n not in self.rows:
            t = np.arange(1.0, n)
            scale = (EXACT / n) ** self.discount
            near = (t + 0.5) * scale - 0.5
            s = np.arange(1.0, EXACT)
            scaled = scale * np.interp(near, s, self.last + np.log(s * self.discount)) - np.log(t * self.discount)
            far = near > min(EXACT / 10, 5 * EXACT ** self.discount)
            scaled[far] = self._saddle(n, t[far])
            self.rows[n] = np.r_[0.0, np.cumsum(scaled)]
        return self.rows[n]


class Restaurants:
    """Seating of many restaurants at once: ``kind`` k has ``count[k]`` customers for one dish in restaurant ``room[k]``.

    Only the number of tables of a kind enters the probabilities, so a sweep reseats all customers of
    every kind at once: given one gamma variable per restaurant the kinds are independent, and the
    tables of a kind have the weights of ``Seatings`` times a power of the weight of one table.
    """

    def __init__(self, count: np.ndarray, room: np.ndarray, rooms: int, discount: float, seed: int):
        self.count, self.room, self.rooms, self.discount = count, room, rooms, discount
        self.rng = np.random.default_rng(seed)
        kind = np.flatnonzero(count > 1)
        self.kind = kind[np.argsort(count[kind], kind="stable")]
        self.tables = np.ones(len(count), np.int64)
        self.open = np.bincount(room, minlength=rooms).astype(float)  # tables per restaurant
        self.sizes, starts = np.unique(count[self.kind], return_index=True)
        self.cuts = np.r_[starts, len(kind)]
        self.seatings = Seatings(discount, self.sizes)

    @property
    def at(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.count[self.kind])])

    @property
    def held(self) -> np.ndarray:
        """One seating with these tables, as customers of each table slot: all but one a table sit at the first."""
        at, count, tables = self.at, self.count[self.kind], self.tables[self.kind]
        out = (np.arange(at[-1]) - np.repeat(at[:-1], count) < np.repeat(tables, count)).astype(np.int32)
        out[at[:-1]] += (count - tables).astype(np.int32)
        return out

    def sweep(self, parent: np.ndarray) -> None:
        """All customers of every kind, given the parent's probability of its dish."""
        kind = self.kind
        if not len(kind):
            return
        gamma = self.rng.standard_gamma(STRENGTH / self.discount + self.open)
        weight = np.log(self.discount * np.maximum(gamma, 1e-300)[self.room[kind]] * parent[kind])
        tables = np.empty(len(kind), np.int64)
        for n, a, b in zip(self.sizes.tolist(), self.cuts[:-1], self.cuts[1:], strict=True):
            row, step = self.seatings.row(n), max(1, (1 << 18) // n)
            for low in range(a, b, step):
                high = min(b, low + step)
                logs = weight[low:high, None] * np.arange(n)
                logs += row
                logs -= logs.max(1, keepdims=True)
                total = np.cumsum(np.exp(logs, out=logs), axis=1, out=logs)
                tables[low:high] = 1 + (total < self.rng.random((high - low, 1)) * total[:, -1:]).sum(1)
        self.open += np.bincount(self.room[kind], tables - self.tables[kind], minlength=self.rooms)
        self.tables[kind] = tables

    def average(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean tables per kind and per restaurant over the samples after the burn-in."""
        for _ in range(BURN_IN):
            self.sweep(parent)
        tables, rooms = np.zeros(len(self.count)), np.zeros(self.rooms)
        for _ in range(SAMPLES):
            self.sweep(parent)
            tables += self.tables
            rooms += self.open
        return tables / SAMPLES, rooms / SAMPLES


def _discount(count: np.ndarray) -> float:
    return _ratio(float((count == 1).sum()), float((count == 2).sum()))


def _ratio(once: float, twice: float) -> float:
    """Discount from the numbers of kinds with one and with two customers."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class _Fragment:
    """Pairs of one fragment, decoded in the order of their blocks."""

    def __init__(self, table: pa.Table, parents: int, hot: np.ndarray):
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        self.number, self.blocks = rows[0]["fragment"], rows
        contexts = [_from_six(r["contexts"]) for r in rows]
        counts = [np.frombuffer(r["counts"], np.uint32) for r in rows]
        self.context, place = np.unique(np.concatenate(contexts), return_inverse=True)
        room = np.repeat(place.astype(np.int32), np.concatenate(counts))
        self.words, dish = np.unique(np.concatenate([_five(r["words"], r["low"]) for r in rows]), return_inverse=True)
        dish = dish.astype(np.int32)
        doc = np.concatenate([np.frombuffer(r["docs"], np.uint16) for r in rows])
        self.sizes = [len(r["docs"]) // 2 for r in rows]
        self.doc, train = doc >> 1, (doc & 1).astype(bool)
        self.room, self.dish = room, dish
        key = room.astype(np.int64) * max(1, len(self.words)) + dish
        self.keys, kind, count = np.unique(key[train], return_inverse=True, return_counts=True)
        self.count = count.astype(np.int64)
        self.kind_room, self.kind_dish = (self.keys // max(1, len(self.words))).astype(np.int32), (self.keys % max(1, len(self.words))).astype(np.int32)
        self.known = np.bincount(room[train], minlength=len(self.context)).astype(float)  # training tokens equal to each context
        # places of the hot contexts here, and which of them are here
        shared = hot & ~np.uint64(0xFFFF)
        spot = np.searchsorted(self.context, shared)
        self.hot = np.flatnonzero(self.context[np.minimum(spot, len(self.context) - 1)] == shared) if len(self.context) else np.empty(0, np.int64)
        self.hot_room = spot[self.hot]
        spot = np.searchsorted(self.keys, key)
        spot = np.minimum(spot, max(0, len(self.keys) - 1)).astype(np.int32)
        self.kind = np.where(self.keys[spot] == key, spot, -1) if len(self.keys) else np.full(len(key), -1, np.int32)
        self.target = _fragment(self.words, parents)

    def seating(self, seed: int, discount: float, elsewhere: np.ndarray) -> Restaurants:
        """Fresh seating; ``elsewhere`` are the tables that hot contexts have in other fragments."""
        seats = Restaurants(self.count, self.kind_room, len(self.context), discount, seed * 1_000_003 + self.number)
        seats.open[self.hot_room] += elsewhere[self.hot]
        return seats

    def rooms(self, tables: np.ndarray) -> np.ndarray:
        """Tables of each context in this fragment, from those of its kinds."""
        return np.bincount(self.kind_room, tables, minlength=len(self.context))

    def guess(self) -> np.ndarray:
        """Probability of each dish from this fragment alone, to start from."""
        share = np.bincount(self.kind_dish, self.count, minlength=len(self.words)) + 0.5
        return share / share.sum()

    def messages(self, tables: np.ndarray, rooms: np.ndarray, parents: int, hot: int, ones: tuple[float, float] = (0.0, 0.0), own: bytes = b"") -> pa.Table:
        """Tables per word for every part of the parent. With them go sums: tables, tokens, vocabulary, pairs seen
        once and twice, and the parent's words with one and two customers (``ones``); to its first part also the training tokens and
        tables of hot contexts here; ``own`` comes back to this fragment through one part."""
        per_word = np.bincount(self.kind_dish, tables, minlength=len(self.words)).astype(np.int64)
        whole = np.ones(len(self.context), bool)
        whole[self.hot_room] = False
        totals = np.array([per_word.sum(), self.known.sum(), (self.known[whole] > 0).sum(), (self.count == 1).sum(), (self.count == 2).sum(), *ones], float).tobytes()
        part = np.zeros((2, hot))
        part[0, self.hot], part[1, self.hot] = self.known[self.hot_room], rooms[self.hot_room]
        rows = []
        for g in range(parents):
            a, b = np.searchsorted(self.target, (g, g + 1))
            w, t = self.words[a:b], per_word[a:b]
            many = np.flatnonzero(t != 1).astype(np.uint32)
            rows.append((g, self.number, (w >> np.uint64(32)).astype(np.uint32).tobytes(), (w >> np.uint64(24)).astype(np.uint8).tobytes(),
                         many.tobytes(), t[many].astype(np.uint32).tobytes(), totals + part.tobytes() if g == 0 else totals, own if g == self.number % parents else b""))
        cols = list(zip(*rows, strict=True))
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[2:])],
                        names=[x.split()[0] for x in _MESSAGE.split(", ")])


class _Answers:
    """What the parent's parts answered to one fragment."""

    def __init__(self, table: pa.Table):
        rows = sorted(table.select(["sender", "mass", "totals", "own"]).to_pylist(), key=lambda r: r["sender"])
        self.mass = np.concatenate([np.frombuffer(r["mass"], np.float32) for r in rows]).astype(float)
        totals = np.stack([np.frombuffer(r["totals"])[:7] for r in rows])
        self.customers, self.tokens, self.vocabulary, _, self.discount = totals[0, :5]
        self.known, self.tables, self.elsewhere = np.frombuffer(rows[0]["totals"])[7:].reshape(3, -1)  # of hot contexts, everywhere and elsewhere
        self.vocabulary += (self.known > 0).sum()
        self.spare = STRENGTH + totals[:, 3].sum()
        self.ones = tuple(totals[:, 5:].sum(0))
        self.own = b"".join(r["own"] for r in rows)

    def parent(self) -> np.ndarray:
        """Probability of each word of the fragment in the parent; all unknown words share the rest."""
        base = np.where(self.mass > 0, (1 - UNKNOWN) / max(1.0, self.vocabulary), UNKNOWN)
        return (self.mass + self.spare * base) / (STRENGTH + self.customers)


def _send(fragments: int, seed: int, hot: np.ndarray):
    """First tables of a fragment's restaurants, seated with its own discount and word shares."""

    def run(table: pa.Table) -> pa.Table:
        f = _Fragment(table, _parents(fragments), hot)
        own = np.zeros(len(hot))
        own[f.hot] = f.rooms(np.ones(len(f.count)))[f.hot_room]
        seats = f.seating(seed, _discount(f.count), own * (fragments - 1))  # until it is known: as many in each other fragment
        parent = f.guess()[f.kind_dish]
        for _ in range(BURN_IN):
            seats.sweep(parent)
        return f.messages(seats.tables, f.rooms(seats.tables), _parents(fragments), len(hot))

    return run


def _reseat(fragments: int, seed: int, hot: np.ndarray):
    """Tables given the parent: the last sample goes to the parent again, the means stay with the fragment."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        f, answers = _Fragment(left, _parents(fragments), hot), _Answers(right)
        seats = f.seating(seed + 1, answers.discount, answers.elsewhere)
        mean, _ = seats.average(answers.parent()[f.kind_dish])
        mean = mean.astype(np.float32)
        return f.messages(seats.tables, f.rooms(mean), _parents(fragments), len(hot), answers.ones, mean[f.count > 1].tobytes())

    return run


def _parent(seed: int):
    """The parent restaurant's part for some words: seat their tables as customers, answer every sender."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["sender"])
        codes = [_five(r["codes"], r["low"]) for r in rows]
        words, place = np.unique(np.concatenate(codes), return_inverse=True)
        tables = []
        for r, c in zip(rows, codes, strict=True):
            t = np.ones(len(c), np.int64)
            t[np.frombuffer(r["many"], np.uint32)] = np.frombuffer(r["tables"], np.uint32)
            tables.append(t)
        count = np.bincount(place, np.concatenate(tables), minlength=len(words)).astype(np.int64)
        given = np.stack([np.frombuffer(r["totals"]) for r in rows])
        customers, tokens, vocabulary, once, twice = given[:, :5].sum(0)
        hot = given[:, 7:].reshape(len(rows), 2, -1)
        seen = np.flatnonzero(count)
        discount = _ratio(*given[0, 5:7]) if given[0, 5] else _discount(count[seen])  # that of all parts, once they know it
        seats = Restaurants(count[seen], np.zeros(len(seen), np.int32), 1, discount, seed * 1_000_003 + 500_009 + rows[0]["fragment"])
        # tables of the whole restaurant are close to one per known word; those of other parts stay fixed
        seats.open += max(0.0, vocabulary - len(seen))
        mean, _ = seats.average(np.full(len(seen), (1 - UNKNOWN) / max(1.0, vocabulary)))
        mass = np.zeros(len(words), np.float32)
        mass[seen] = count[seen] - discount * mean
        totals = np.array([customers, tokens, vocabulary, discount * mean.sum(), _ratio(once, twice), (count == 1).sum(), (count == 2).sum()]).tobytes()
        # each sender learns the tokens and tables of hot contexts everywhere, and their tables elsewhere
        extra = [np.concatenate([hot[:, 0].sum(0), hot[:, 1].sum(0), hot[:, 1].sum(0) - h]).tobytes() for h in hot[:, 1]]
        ends = np.cumsum([0, *map(len, codes)])
        return pa.table([pa.array([r["sender"] for r in rows], pa.int32()), pa.array([rows[0]["fragment"]] * len(rows), pa.int32()),
                         pa.array([mass[place[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                         pa.array([totals + x for x in extra], pa.binary()), pa.array([r["own"] for r in rows], pa.binary())],
                        names=[x.split()[0] for x in _ANSWER.split(", ")])

    return run


class _Predictive:
    """Averaged predictive probabilities of a fragment: (share + spare parent) / size of each context."""

    def __init__(self, f: _Fragment, answers: _Answers):
        tables = np.ones(len(f.count))
        tables[f.count > 1] = np.frombuffer(answers.own, np.float32)
        rooms, known = f.rooms(tables), f.known.copy()
        rooms[f.hot_room], known[f.hot_room] = answers.tables[f.hot], answers.known[f.hot]
        self.share = np.append(f.count - answers.discount * tables, 0.0)  # the last place serves pairs never seen
        self.spare, self.parent, self.known = STRENGTH + answers.discount * rooms, answers.parent(), known

    def of(self, room: np.ndarray, dish: np.ndarray, kind: np.ndarray) -> np.ndarray:
        probability = self.share[kind]
        probability += self.spare[room] * self.parent[dish]
        probability /= (STRENGTH + self.known)[room]
        return probability


def _score(fragments: int, hot: np.ndarray):
    """Partial sums of every text of a fragment's blocks: base term, log probability, known tokens."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        f, answers = _Fragment(left, _parents(fragments), hot), _Answers(right)
        model = _Predictive(f, answers)
        logs = np.log10(model.of(f.room, f.dish, f.kind))
        term = np.log10(model.known + 0.1)[f.room]
        seen = model.known[f.room] > 0
        at, out = 0, []
        for r, size in zip(f.blocks, f.sizes, strict=True):
            doc = f.doc[at:at + size]
            n = int(doc.max()) + 1 if size else 0
            sums = (np.bincount(doc, term[at:at + size], n).tobytes(), np.bincount(doc, logs[at:at + size], n).astype(np.float32).tobytes(),
                    np.bincount(doc, seen[at:at + size], n).astype(np.uint32).tobytes())
            out.append((r["block"], b"".join(sums), r["heads"], np.array([answers.tokens, answers.vocabulary]).tobytes()))
            at += size
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(cols[0]), *(pa.array(c, pa.binary()) for c in cols[1:])], names=[x.split()[0] for x in _PART.split(", ")])

    return run


def _exchange(rows: DataFrame, fragments: int, hot: np.ndarray, seed: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of texts (id, text, train) by fragment, and the answers of the parent after the second seating."""
    cells = rows.mapInArrow(_cells(fragments, hot), _CELL)
    first = cells.groupBy("fragment").applyInArrow(_send(fragments, seed, hot), _MESSAGE)
    told = first.groupBy("fragment").applyInArrow(_parent(seed), _ANSWER)
    again = cells.groupBy("fragment").cogroup(told.groupBy("fragment")).applyInArrow(_reseat(fragments, seed, hot), _MESSAGE)
    return cells, again.groupBy("fragment").applyInArrow(_parent(seed + 1), _ANSWER)


def _sum_blocks(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    ids, train, sizes = np.frombuffer(next(r["heads"] for r in rows if r["heads"]), np.int64).reshape(3, -1)
    base, score, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    for r in rows:
        n = len(r["sums"]) // 16
        base[:n] += np.frombuffer(r["sums"], np.float64, n)
        score[:n] += np.frombuffer(r["sums"], np.float32, n, 8 * n)
        known[:n] += np.frombuffer(r["sums"], np.uint32, n, 12 * n)
    tokens, vocabulary = np.frombuffer(rows[0]["totals"])
    base -= sizes * np.log10(tokens + 0.1 * (vocabulary + 1))
    return pa.table({"row": ids, "held_out": train == 0, "n_tokens": sizes, "n_known": known,
                     "train_tokens": np.full(len(ids), int(tokens)), "base_score": base, "score": score})


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, seed: int = 0) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    The model learns from the rows whose crc32(id as text) mod ``folds`` is not 0. Tokens are the words
    of the text (A-Z lower-cased, cut at blanks) and one end. All words never seen in training are one
    word to the model and to the base. Null and empty texts have the end alone; a null id counts as
    the empty text in the checksum and comes back as null. Without training rows every word is
    unknown. Rows may repeat. An empty table gives an empty table. Other columns are not read.
    """
    text = F.col(text_col).cast("string")
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    fragments = 1 + size // FRAGMENT_BYTES
    train = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds != 0
    missing = -(1 << 63)
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(missing)).alias("id"), text.alias("text"), train.alias("train"))
    hot = hot_contexts(rows.select("text"), fragments)
    cells, answers = _exchange(rows, fragments, hot, seed)
    parts = cells.groupBy("fragment").cogroup(answers.groupBy("fragment")).applyInArrow(_score(fragments, hot), _PART)
    scored = parts.groupBy("block").applyInArrow(
        _sum_blocks, "row long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select(F.when(F.col("row") != missing, F.col("row")).alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
