"""Near-duplicate embeddings by int8 tile products with error bounds and full-precision recomputation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .components import components

THRESHOLD = 0.9
BLOCK = 4096   # vectors of a block; a tile compares two blocks
STRIP = 512
SLACK = 1e-5   # above all rounding of the scaled single-precision products


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind, copy=False).reshape(len(column), -1)


def _one(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table[name].chunks)


def _quantise(table: pa.Table) -> pa.Table:
    """One row for a block: codes, scales, error norms and norms of the decoded vectors."""
    full = _matrix(_one(table, "vector"), float)
    unit = full / np.linalg.norm(full / np.abs(full).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(full).max(1, keepdims=True)
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None])
    decoded = codes * scale[:, None]
    error = np.linalg.norm(unit - decoded, axis=1) * (1 + 1e-9) + 1e-12
    return pa.table({
        "dim": pa.array([full.shape[1]], pa.int32()), "block": table["block"].slice(0, 1).cast(pa.int32()),
        "ids": [table["id"].to_numpy().astype(np.int64).tobytes()], "codes": [codes.astype(np.int8).tobytes()],
        "bounds": [np.stack([scale, error, np.linalg.norm(decoded, axis=1) * (1 + 1e-9)]).tobytes()]})


def _possible(threshold: float):
    """Vectors of a tile that take part in a pair whose cosine may reach the threshold."""

    def run(table: pa.Table) -> pa.Table:
        dim, p, q = (table[c][0].as_py() for c in ("dim", "p", "q"))
        kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # whole-number products stay exact
        sides = {}
        for row in table.select(["block", "ids", "codes", "bounds"]).to_pylist():
            sides[row["block"]] = (np.frombuffer(row["ids"], np.int64), np.frombuffer(row["codes"], np.int8).reshape(-1, dim).astype(kind),
                                   np.frombuffer(row["bounds"]).reshape(3, -1))
        if p not in sides or q not in sides:
            return pa.table({"dim": pa.array([], pa.int32()), "p": pa.array([], pa.int32()), "q": pa.array([], pa.int32()), "right": pa.array([], pa.bool_()), "id": pa.array([], pa.int64())})
        (ids, left, (s, e, a)), (other, right, (t, f, b)) = sides[p], sides[q]
        hit_left, hit_right = np.zeros(len(ids), bool), np.zeros(len(other), bool)
        most = f.max() * a.max() + b.max() * e.max() + e.max() * f.max()
        for low in range(0, len(ids), STRIP):
            product = (left[low:low + STRIP] @ right.T) * s[low:low + STRIP, None].astype(kind)
            i, j = np.nonzero(product >= ((threshold - most - SLACK) / t).astype(kind)[None, :])
            upper = product[i, j] * t[j] + e[low + i] * b[j] + a[low + i] * f[j] + e[low + i] * f[j]
            good = upper >= threshold - SLACK
            if p == q:
                good &= low + i != j
            hit_left[low + i[good]] = True
            hit_right[j[good]] = True
        found = np.concatenate([ids[hit_left], other[hit_right]])
        side = np.repeat([False, True], [hit_left.sum(), hit_right.sum()])
        n = len(found)
        return pa.table({"dim": pa.array(np.full(n, dim, np.int32)), "p": pa.array(np.full(n, p, np.int32)), "q": pa.array(np.full(n, q, np.int32)), "right": side, "id": found})

    return run


def _exact(threshold: float):
    """Links of a tile in double precision: per vector its partners counted with their copies, and edges of a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        same = table["p"][0].as_py() == table["q"][0].as_py()
        side = table["right"].to_numpy()
        ids, copies = table["id"].to_numpy(), table["copies"].to_numpy()
        full = _matrix(_one(table, "vector"), float)
        top = np.abs(full).max(1, keepdims=True)
        full = full / top
        norm = np.sqrt(np.einsum("ij,ij->i", full, full))
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        partners = np.zeros(len(ids), np.int64)
        near: list[np.ndarray] = []
        for low in range(0, len(left), STRIP):
            some = left[low:low + STRIP]
            cosine = (full[some] @ full[right].T) / norm[some][:, None] / norm[right][None, :]
            linked = (cosine >= threshold) & (ids[some][:, None] != ids[right][None, :])
            partners[some] += linked @ copies[right]
            if not same:
                partners[right] += linked.T @ copies[some]
            near += [np.flatnonzero(x) for x in linked]
        # edges that connect what the links connect: a right vector goes to the first left vector that
        # holds it, and later holders go to that first one; at most one edge per pair of first holders
        owner, edges = np.full(len(right), -1), []
        for i, js in enumerate(near):
            if len(js):
                new = js[owner[js] < 0]
                firsts = np.unique(owner[js[owner[js] >= 0]])
                owner[new] = i
                edges += [(ids[left[i]], ids[right[j]]) for j in new]
                edges += [(ids[left[i]], ids[left[o]]) for o in firsts]
        known = np.flatnonzero(partners > 0)
        rows = [(int(ids[k]), None, int(partners[k])) for k in known] + [(int(a), int(b), None) for a, b in set(edges)]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("a", "b", "n"), cols, strict=True)})

    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: id, n_links (other rows with cosine of at least ``threshold``), component_id, kept.

    All rows are compared. Equal vectors are compared once and counted with their copies. Vectors
    that are null, empty, zero or hold null or non-finite parts link with nothing, nor do vectors of
    different lengths. Ids must tell rows apart; a null id is kept and never linked. An empty table gives an empty table.
    Other columns are not read, whatever their names.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = (F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("vector", lambda x: x != 0))
    good = rows.where(usable)
    classes = materialize(good.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")
    total = classes.count()
    blocks = 1 + total // BLOCK
    blocked = classes.select("id", "vector", F.size("vector").alias("dim"), F.expr(f"cast(pmod(xxhash64(id), {blocks}) as int)").alias("block"))
    packed = blocked.groupBy("dim", "block").applyInArrow(_quantise, "dim int, block int, ids binary, codes binary, bounds binary")
    tiles = packed.withColumn("other", F.explode(F.expr(f"sequence(0, {blocks - 1})"))).select(
        "*", F.least("block", "other").cast("int").alias("p"), F.greatest("block", "other").cast("int").alias("q"))
    possible = tiles.repartition(blocks * (blocks + 1) // 2, "dim", "p", "q").groupBy("dim", "p", "q").applyInArrow(
        _possible(threshold), "dim int, p int, q int, right boolean, id long")
    possible = materialize(possible, "vector-possible")
    links = possible.join(classes, "id").groupBy("dim", "p", "q").applyInArrow(_exact(threshold), "a long, b long, n long")
    links = materialize(links, "vector-links")
    counts = links.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    group = components(links.where("b is not null").select("a", "b"), "vector-groups").withColumnRenamed("node", "id")
    named = classes.join(counts, "id", "left").join(group, "id", "left").select(
        "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    keyed = rows.withColumn("key", F.when(usable, F.col("vector")))
    return keyed.join(named.withColumnRenamed("vector", "key"), "key", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
