"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .components import components
from .words import chunks, mix, shingles, text_bytes

WORDS = 5
PERCENT = 75
FRAGMENT_BYTES = 16 << 20  # text whose n-grams make one vertical fragment of the rarity pass
FRAGMENT_GRAMS = 1 << 20  # n-grams of one vertical fragment of the order
WINDOW_BYTES = 128 << 10  # text whose words are hashed at once
BLOCK_GRAMS = 1 << 21  # n-grams of a block; only a single text may have more
BLOCK_ROWS = 1 << 15  # texts are numbered by 16 bits inside a block, which may go over this by one batch of as many
FRAGMENTS = 1 << 16  # most fragments
BROADCAST_ROWS = 1 << 19  # ids of the sets to be ordered that are sent to every executor rather than joined by a shuffle of all texts
TILE_DOCS = 512
TILE_GRAMS = 1 << 20
SMALL_DOCS, SMALL_GRAMS = 64, 1 << 17  # candidate groups up to this size share a tile


def _batches(batches):
    """Batches of at most ``BLOCK_ROWS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def _blocks(sets):
    """Lists of the tuples (n-grams, set sizes, ...) of ``sets`` that make up one block each, joined column by column."""
    held, grams, rows = [], 0, 0
    for one in sets:
        if held and (grams + len(one[0]) > BLOCK_GRAMS or rows >= BLOCK_ROWS):
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, grams, rows = [], 0, 0
        held.append(one)
        grams, rows = grams + len(one[0]), rows + len(one[1])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary column whose row i has the bytes of values[ends[i]:ends[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column in a row, and where each row's begin."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data, ends = text_bytes(column)
    return data.view(kind), ends // np.dtype(kind).itemsize


def _fragment(grams: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment of each n-gram: equal ranges of the hash, in ascending order."""
    return (grams >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)


_POSTED = "fragment int, block long, codes binary, docs binary, repeated binary, ids binary, sizes binary, nodes binary"


def _post(fragments: int, k: int):
    """Cut each block of texts into fragments of the n-gram order.

    An n-gram that repeats inside the block is counted there and sent once, without
    its rows, so that a very common n-gram brings one entry per block at most.
    """

    def sets(batches):
        for batch in _batches(batches):
            keys, named = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for low, high, words, offsets in chunks(batch.column(1), WINDOW_BYTES):
                grams, at = shingles(words, offsets, k)
                yield grams, np.diff(at), keys[low:high], named[low:high], _nodes(grams, at)

    def run(batches):
        name = TaskContext.get().partitionId() << 32
        for grams, sizes, keys, named, nodes in _blocks(sets(batches)):
            # 16 bits of the fragment, 32 of the n-gram, 16 of the text
            entry = _fragment(grams, fragments) << np.uint64(48) | (grams & np.uint64(0xFFFFFFFF)) << np.uint64(16)
            entry |= np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            entry.sort()
            same = entry[1:] >> np.uint64(16) == entry[:-1] >> np.uint64(16)
            many = np.zeros(len(entry), bool)
            many[1:] = same
            many[:-1] |= same
            known = np.bincount((entry[many] & np.uint64(0xFFFF)).astype(np.int64), minlength=len(sizes))
            first = many.copy()
            first[1:] &= ~same
            alone, common = entry[~many], entry[first]
            wanted = np.arange(fragments + 1, dtype=np.uint64)
            a, c = np.searchsorted(alone >> np.uint64(48), wanted), np.searchsorted(common >> np.uint64(48), wanted)
            used = np.flatnonzero((np.diff(a) > 0) | (np.diff(c) > 0) | (wanted[1:] == 1))  # the first one carries the head
            a, c = np.r_[0, a[used + 1]], np.r_[0, c[used + 1]]
            head = lambda x: pa.array([x.tobytes()] + [b""] * (len(used) - 1), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(np.full(len(used), name), pa.int64()), _packed((alone >> np.uint64(16)).astype(np.uint32), a),
                 _packed(alone.astype(np.uint16), a), _packed((common >> np.uint64(16)).astype(np.uint32), c),
                 head(keys.astype(np.int64)), head(np.stack([sizes, known, named]).astype(np.int64)), head(nodes)],
                names=["fragment", "block", "codes", "docs", "repeated", "ids", "sizes", "nodes"])
            name += 1

    return run


def _count_shared(table: pa.Table) -> pa.Table:
    """In one fragment: per block, the text of each n-gram that other texts hold too."""
    codes, ends = _flat(table["codes"], np.uint32)
    entry = np.concatenate([codes, _flat(table["repeated"], np.uint32)[0]]).astype(np.uint64) << np.uint64(32)
    entry |= np.arange(len(entry), dtype=np.uint64)
    entry.sort()
    same = entry[1:] >> np.uint64(32) == entry[:-1] >> np.uint64(32)
    several = np.zeros(len(entry), bool)
    several[1:] = same
    several[:-1] |= same
    hit = np.zeros(len(entry), bool)
    hit[(entry[several] & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    hit = hit[:len(codes)]
    found = np.r_[0, np.cumsum(hit)][ends]
    return pa.table({"block": table["block"], "found": _packed(_flat(table["docs"], np.uint16)[0][hit], found), **{c: table[c] for c in ("ids", "sizes", "nodes")}})


def _sum_block(table: pa.Table) -> pa.Table:
    """Sum the partial counts of a block over all fragments."""
    sizes, known, named = _flat(table["sizes"], np.int64)[0].reshape(3, -1)
    total = known + np.bincount(_flat(table["found"], np.uint16)[0], minlength=len(sizes))
    ids = pa.array(_flat(table["ids"], np.int64)[0], mask=named == 0)
    return pa.table({"id": ids, "n": sizes, "shared": total, "node": _flat(table["nodes"], np.int64)[0]})


def set_table(texts: DataFrame, k: int = WORDS) -> DataFrame:
    """One row per text of ``texts(id, text)``: id, set size n, at least as many shared n-grams as it has, set checksum ``node``.

    n is exact. ``shared`` compares 32 bits of each n-gram besides its fragment, so it may
    only be too large, never too small: a safe filter. Equal sets have equal checksums; unequal
    ones with a chance of 2**-64.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = min(FRAGMENTS, 1 + size // FRAGMENT_BYTES)
    posted = texts.select(F.col("id").cast("long"), F.col("text").cast("string")).mapInArrow(_post(fragments, k), _POSTED)
    counted = posted.groupBy("fragment").applyInArrow(
        _count_shared, "block long, found binary, ids binary, sizes binary, nodes binary")
    summed = counted.groupBy("block").applyInArrow(_sum_block, "id long, n long, shared long, node long")
    return materialize(summed, "ngram-sets")


def _nodes(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Checksum of each set, independent of the order of its n-grams."""
    sizes = np.diff(at)
    out = np.zeros((len(sizes), 2), np.uint64)
    full = sizes > 0
    if full.any():
        out[full, 0] = np.add.reduceat(grams, at[:-1][full])
        out[full, 1] = np.add.reduceat(mix(grams), at[:-1][full])
    return mix(mix(out[:, 0] + sizes.astype(np.uint64)) ^ out[:, 1]).view(np.int64)


_INCIDENT = "fragment int, block long, grams binary, docs binary, nodes binary, sizes binary"


def _post_sets(fragments: int, k: int):
    """N-grams of each block of texts (id, text, node) whose set has the expected checksum, with their holders, by fragment."""

    def sets(batches):
        seen = set()
        for batch in _batches(batches):
            expected = batch.column(2).to_numpy(zero_copy_only=False)
            for low, high, words, offsets in chunks(batch.column(1), WINDOW_BYTES):
                grams, at = shingles(words, offsets, k)
                node, sizes = _nodes(grams, at), np.diff(at)
                right = np.zeros(len(node), bool)
                for i in np.flatnonzero(node == expected[low:high]).tolist():  # rows of one id and text are one set
                    right[i] = node[i] not in seen
                    seen.add(node[i])
                if right.any():
                    yield grams[np.repeat(right, sizes)], sizes[right], node[right]

    def run(batches):
        name = TaskContext.get().partitionId() << 32
        for grams, sizes, node in _blocks(sets(batches)):
            order = np.argsort(grams)
            docs = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)[order]
            grams = grams[order]
            wanted = np.arange(fragments + 1, dtype=np.uint64)
            ends = np.searchsorted(_fragment(grams, fragments), wanted)
            used = np.flatnonzero((np.diff(ends) > 0) | (wanted[1:] == 1))
            ends = np.r_[0, ends[used + 1]]
            head = lambda x: pa.array([x.astype(np.int64).tobytes()] + [b""] * (len(used) - 1), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(np.full(len(used), name), pa.int64()), _packed(grams, ends), _packed(docs, ends), head(node), head(sizes)],
                names=["fragment", "block", "grams", "docs", "nodes", "sizes"])
            name += 1

    return run


def _levels(table: pa.Table) -> pa.Table:
    """In one fragment: per block, the n-grams that several sets hold, with the logarithm of their number."""
    grams, ends = _flat(table["grams"], np.uint64)
    order = np.argsort(grams)
    every = grams[order]
    first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(every)])
    held = np.empty(len(every), np.int64)
    held[order] = np.repeat(count, count)
    kept = held > 1
    ends = np.r_[0, np.cumsum(kept)][ends]
    level = np.floor(np.log2(held[kept])).astype(np.uint8)
    return pa.table({"fragment": table["fragment"], "block": table["block"], "grams": _packed(grams[kept], ends), "levels": _packed(level, ends),
                     "docs": _packed(_flat(table["docs"], np.uint16)[0][kept], ends), "nodes": table["nodes"], "sizes": table["sizes"]})


def _order_block(percent: int):
    """Shared n-grams of each set of a block in the global order; sets with too few of them for any link are left out."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("fragment")  # n-grams ascend with the fragment, and inside it
        node, sizes = _flat(table["nodes"], np.int64)[0], _flat(table["sizes"], np.int64)[0]
        doc, gram, level = _flat(table["docs"], np.uint16)[0], _flat(table["grams"], np.int64)[0], _flat(table["levels"], np.uint8)[0]
        enough = np.bincount(doc, minlength=len(node)) >= (sizes * percent + 99) // 100
        kept = np.flatnonzero(enough[doc])
        doc = doc[kept].astype(np.uint64)
        # 16 bits of the set, 8 of the level, 40 of the place
        entry = doc << np.uint64(48) | level[kept].astype(np.uint64) << np.uint64(40) | kept.astype(np.uint64)
        entry.sort()
        place = (entry & np.uint64((1 << 40) - 1)).astype(np.int64)
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(doc.astype(np.int64), minlength=len(node))[enough])].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (level[place].astype(np.int8), gram[place])]
        return pa.table({"node": node[enough], "n": sizes[enough], "s": np.diff(offsets.to_numpy()), "levels": lists[0], "grams": lists[1]})

    return run


def _pairs(gram: np.ndarray, holder: np.ndarray, size: int) -> np.ndarray:
    """Every two of ``size`` sets that hold an n-gram, as one number, once for each n-gram: for n-grams that few sets hold."""
    at, codes = np.cumsum(np.r_[False, gram[1:] != gram[:-1]]), []
    for step in range(1, int(np.bincount(at).max())):
        i = np.flatnonzero(at[step:] == at[:-step])
        codes.append(holder[i] * size + holder[i + step])
    return np.concatenate(codes)


def _products(gram: np.ndarray, holder: np.ndarray, size: int) -> np.ndarray:
    """Number of n-grams each two of ``size`` sets share, for sets that have most of them in common."""
    new = np.r_[True, gram[1:] != gram[:-1]]
    column = np.cumsum(new) - 1
    out = np.zeros((size, size), np.float32)  # whole numbers below 2**24
    for at in range(0, int(column[-1]) + 1, 8192):
        a, b = np.searchsorted(column, (at, at + 8192))
        block = np.zeros((size, int(column[b - 1]) - at + 1), np.float32)
        block[holder[a:b], column[a:b] - at] = 1
        out += block @ block.T
    return out


def _link_tile(percent: int):
    """Links of one tile: partial overlaps of each fragment counted separately and summed per pair.

    Of the links found, a spanning forest is returned, so a tile gives at most one row per set.
    Small groups that share a tile are counted side by side: n-grams of different groups never meet.
    """

    def run(table: pa.Table) -> pa.Table:
        nodes, first = np.unique(table["node"].to_numpy(), return_index=True)
        group = table["component"].to_numpy()[first]
        by = np.argsort(group, kind="stable")  # equal n-grams of one group stand together below
        nodes, first, group = nodes[by], first[by], group[by]
        n = table["n"].to_numpy()[first]
        lists, levels = pa.concat_arrays(table["grams"].chunks).take(pa.array(first)), pa.concat_arrays(table["levels"].chunks).take(pa.array(first))
        grams, level = lists.flatten().to_numpy(), levels.flatten().to_numpy().astype(np.int64)
        owner = np.repeat(np.arange(len(nodes)), np.diff(lists.offsets.to_numpy()))
        alone = group[0] == group[-1]
        number = np.cumsum(np.r_[False, group[1:] != group[:-1]])[owner]
        # fragments: consecutive cuts of the order (frequency level, then quarter of the hash range)
        fragment = level * 4 + (grams >> 62) + 2
        overlap, met = np.zeros((len(nodes), len(nodes))), []  # whole numbers
        for f in np.unique(fragment):
            chosen = np.flatnonzero(fragment == f)
            chosen = chosen[np.argsort(grams[chosen], kind="stable")]
            gram, holder = grams[chosen], owner[chosen]
            run_of = np.cumsum(np.r_[False, (gram[1:] != gram[:-1]) | (number[chosen][1:] != number[chosen][:-1])])
            held = np.bincount(run_of)
            kept = held[run_of] > 1
            if not kept.any():
                continue
            if alone:
                overlap += _products(run_of[kept], holder[kept], len(nodes))
            else:
                met.append(_pairs(run_of[kept], holder[kept], len(nodes)))
        if met:
            overlap += np.bincount(np.concatenate(met), minlength=overlap.size).reshape(overlap.shape)
            overlap += overlap.T
        linked = (100 + percent) * overlap >= percent * (n[:, None] + n[None, :])
        left, pairs = np.ones(len(nodes), bool), []
        for i in range(len(nodes)):
            queue = [i] if left[i] else []
            left[i] = False
            while queue:
                j = queue.pop()
                more = np.flatnonzero(linked[j] & left)
                left[more] = False
                pairs += [(j, m) for m in more.tolist()]
                queue += more.tolist()
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[found[:, 0]], "b": nodes[found[:, 1]]})

    return run


def order_sets(texts: DataFrame, grams: int, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(node, n, s, levels[], grams[]) of the sets of ``texts(id, text, node)``: the s n-grams that other sets hold too, in the global order.

    ``grams`` is the number of n-grams there are, which fixes the number of fragments. The order is by
    frequency level, then hash; sets that share too few n-grams for any link are left out. As in
    ``set_table`` blocks of sets are cut into fragments of the hash range, so n-grams travel as
    packed numbers and not as rows.
    """
    posted = texts.mapInArrow(_post_sets(min(FRAGMENTS, 1 + grams // FRAGMENT_GRAMS), k), _INCIDENT)
    levelled = posted.groupBy("fragment").applyInArrow(
        _levels, "fragment int, block long, grams binary, levels binary, docs binary, nodes binary, sizes binary")
    ordered = levelled.groupBy("block").applyInArrow(_order_block(percent), "node long, n long, s int, levels array<tinyint>, grams array<long>")
    return materialize(ordered, "ngram-order")


def links(ordered: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) that connect every two sets of ``order_sets`` with Jaccard of at least ``percent``/100.

    A pair that reaches the threshold shares one of the first n - ceil(t*n) + 1 n-grams of the set with
    more n-grams and one of the first n - ceil(2t/(1+t)*n) + 1 of the other, and from there on the former
    has t/(1+t) of the sum of both sizes in shared n-grams. The candidate groups are the connected groups over such
    pairs; sets never meet through their common n-grams alone. Inside a group every pair is counted, in
    tiles of bounded size, and only links are written.
    """
    need, both = F.expr(f"(n * {percent} + 99) div 100"), F.expr(f"(n * {2 * percent} + {99 + percent}) div {100 + percent}")
    # n-grams of one set alone come first in the order and take n - s places of the prefix
    prefix = F.greatest(F.lit(0), F.col("s") - need + 1).cast("int")
    first = ordered.select("node", "n", "s", both.alias("both"), F.posexplode(F.slice("grams", F.lit(1), prefix)).alias("at", "g"))
    centre = first.where("at + both <= s").groupBy("g").agg(F.min(F.struct("n", "node")).alias("c")).select("g", "c.n", "c.node")
    centre = centre.withColumnsRenamed({"n": "least", "node": "a"})
    # at the first n-gram a pair shares, both sets have all they share from there on
    near = first.join(centre, "g").where(f"node <> a and n >= least and (s - at) * {100 + percent} >= (n + least) * {percent}")
    group = components(near.select("a", F.col("node").alias("b")), "ngram-groups")
    member = materialize(group.join(ordered.select("node", "s"), "node"), "ngram-members")
    size = member.groupBy("component").agg(F.count("*").alias("m"), F.sum("s").alias("total")).where("m > 1").select(
        "component", F.greatest(F.ceil(F.col("m") / TILE_DOCS), F.ceil(F.col("total") / TILE_GRAMS)).cast("int").alias("blocks"),
        ((F.col("m") <= SMALL_DOCS) & (F.col("total") <= SMALL_GRAMS)).alias("small"))
    sets, grams = member.agg(F.count("*"), F.sum("s")).first()
    shared = 1 + max(2 * sets // TILE_DOCS, 4 * (grams or 0) // TILE_GRAMS)  # tiles of small groups
    block, other = F.expr("pmod(xxhash64(node), blocks)"), F.expr("sequence(0, blocks - 1)")
    placed = member.join(size, "component").withColumn("block", F.when(F.col("small"), -1).otherwise(block)).select(
        "node", "component", F.when(F.col("small"), F.expr(f"pmod(xxhash64(component), {shared})")).otherwise(F.col("component")).alias("tile"),
        "block", F.explode(F.when(F.col("small"), F.array(F.lit(-1))).otherwise(other)).alias("other")).select(
        "node", "component", "tile", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    tiled = ordered.join(placed, "node")
    return tiled.groupBy("tile", "p", "q").applyInArrow(_link_tile(percent), "a long, b long")


def ngram_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, set_id (equal for equal sets), component.

    Two texts link when ``100 * intersection >= percent * union`` of their distinct k-word
    shingles; component is the smallest id reachable by links. Texts without words link with
    nothing. Null texts are empty. Rows with the same id are one node of the link graph; a
    row with a null id is counted but never linked (its component is null). An empty table
    gives an empty table. Other columns are not read, whatever their names.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    table = set_table(texts, k)
    full = table.where("n > 0 and id is not null")
    classes = full.groupBy("node", "n").agg(F.min("id").alias("rep"), F.max(F.col("shared") * 100 >= F.col("n") * percent).alias("maybe"))
    classes = materialize(classes, "ngram-classes")
    chosen = classes.where("maybe").select(F.col("rep").alias("id"), "node")
    size, sets = classes.where("maybe").agg(F.sum("n"), F.count("*")).first()
    if sets <= BROADCAST_ROWS:  # the texts of one id still meet in one task
        picked = texts.join(F.broadcast(chosen), "id").repartition("id")
    else:
        picked = texts.join(chosen.hint("shuffle_hash"), "id")
    ordered = order_sets(picked.select("id", "text", "node"), size or 0, k, percent)
    found = links(ordered, percent).select("a", "b")
    # rows of one id are one node of the graph, so their sets connect as well
    several = full.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("id", "a")
    same = full.join(several, "id").select("a", F.col("node").alias("b"))
    group = components(found.union(same), "ngram-links")
    grouped = classes.join(group, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("c"))
    lowest = grouped.groupBy("c").agg(F.min("rep").alias("component"))
    named = grouped.join(lowest, "c").select("node", "component")
    linkable = table.withColumn("key", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("node")))
    return linkable.join(named.withColumnRenamed("node", "key"), "key", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("node").alias("set_id"), F.coalesce("component", "id").alias("component"))
