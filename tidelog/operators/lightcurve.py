"""Light-response curves by separable least squares, for any number of groups of any size.

With k = alpha/pmax (and b = beta/pmax) fixed, the curve is linear in pmax and rd, so a
group's best fit at k needs only a few sums. A level evaluates a row of candidates, the next
level zooms in around the best. Rows are first reduced to one cell per distinct light value,
which is exact for least squares. Groups with few cells are searched whole on an executor,
many at a time; a group with more cells is searched by one aggregation per level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curves import saturating
from ..functions.distributions import f_upper_tail, t_two_sided
from ..session import materialize
from .joins import hand_back, key_join, linear_grid

# Relative error sums are compared on this grid, so rounding noise cannot pick the winner.
TIE_GRID = 1e11

# First level: k times the group's largest light runs over 10^-2 .. 10^3 in 17 steps, so the unit
# of light does not matter; each later level covers one step to either side of the best and is 8
# times finer. With inhibition both ratios take 7 steps and each level is 3 times finer.
CENTRE_A, WIDTH_A = 10.0**0.5, 2.5
CENTRE_B, WIDTH_B = 10.0**-1, 2.0
STEPS_ONE, STEPS_TWO = 8, 3
LEVELS_ONE, LEVELS_TWO = 7, 9
ROBUST_STEPS = 4
PACK_CELLS = 4096  # groups with more distinct light values are never gathered


def candidate_offsets(inhibition: bool, steps: int = STEPS_ONE) -> list[tuple[float, float]]:
    """Candidates around a centre, in units of the level's width (log10)."""
    if not inhibition:
        return [(i / steps, 0.0) for i in range(-steps, steps + 1)]
    one_side = range(-STEPS_TWO, STEPS_TWO + 1)
    return [(i / STEPS_TWO, j / STEPS_TWO) for i in one_side for j in one_side]


def curve_cells(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Sums per group and distinct light value: (keys, x, w, s1, s2).

    Rows without light or value make one cell without light, so that their group stays known.
    """
    usable = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.groupBy(*keys, F.when(usable, F.col(x)).alias("x")).agg(
        F.count(F.lit(1)).cast("double").alias("w"),
        F.sum(y).alias("s1"),
        F.sum(F.col(y) * F.col(y)).alias("s2"),
    )


def _candidate_texts(inhibition: bool, steps: int) -> tuple[list[str], list[str]]:
    offsets = candidate_offsets(inhibition, steps)
    a = [f"(_a * pow(10D, _wa * {u!r}D))" for u, _ in offsets]
    b = [f"(_b * pow(10D, _wb * {v!r}D))" if inhibition else "0D" for _, v in offsets]
    return a, b


def with_candidates(groups: DataFrame, inhibition: bool = False, steps: int = STEPS_ONE) -> DataFrame:
    """Candidate ratios of each group as columns, computed per group and not per row."""
    a, b = _candidate_texts(inhibition, steps)
    more = [f"{t} AS _p{i}" for i, t in enumerate(a)] + ([f"{t} AS _q{i}" for i, t in enumerate(b)] if inhibition else [])
    return groups.selectExpr("*", *more)


def best_candidate(
    cells: DataFrame,
    keys: Sequence[str],
    inhibition: bool = False,
    extra: Sequence[tuple[str, str]] = (),
    steps: int = STEPS_ONE,
) -> DataFrame:
    """Best candidate per group around the centres ``_a``/``_b`` with widths ``_wa``/``_wb`` of its rows.

    Centres and widths are data, not literals, so every level runs the same generated code.
    ``extra`` are further (aggregate, name) pairs taken in the same pass.
    """
    centre = ["_a", "_wa"] + (["_b", "_wb"] if inhibition else [])
    offsets = candidate_offsets(inhibition, steps)
    a, b = _candidate_texts(inhibition, steps)
    curves = [
        f"(1 - exp(-_p{i} * x))" + (f" * exp(-_q{i} * x)" if inhibition else "") + f" AS g{i}" for i in range(len(offsets))
    ]
    wide = cells.selectExpr("*", *curves)
    sums = [F.expr(e) for e in ("sum(w) AS _w", "sum(s1) AS _s1", "sum(s2) AS _s2", *[f"first({c}) AS {c}" for c in centre])]
    for i in range(len(offsets)):
        sums += [F.expr(f"sum(w * g{i}) AS _g{i}"), F.expr(f"sum(w * g{i} * g{i}) AS _gg{i}"), F.expr(f"sum(g{i} * s1) AS _gy{i}")]
    sums += [F.expr(e).alias(name) for e, name in extra]
    total = wide.groupBy(*keys).agg(*sums).withColumn("_vy", F.expr("_s2 - _s1 * _s1 / _w"))
    fits = []
    for i, (p, q) in enumerate(zip(a, b)):
        vg, cgy = f"(_gg{i} - _g{i} * _g{i} / _w)", f"(_gy{i} - _g{i} * _s1 / _w)"
        fits.append(
            f"CASE WHEN {vg} > 1e-9 * _w THEN struct(floor((_vy - {cgy} * {cgy} / {vg}) / greatest(_vy, 1e-12D) * {TIE_GRID!r}D) AS rel, "
            f"{p} AS a, {q} AS b, {cgy} / {vg} AS pmax, ({cgy} / {vg} * _g{i} - _s1) / _w AS rd, "
            f"_vy - {cgy} * {cgy} / {vg} AS sse) END"
        )
    best = total.withColumn("_f", F.expr(f"array_min(array({', '.join(fits)}))"))
    finer = STEPS_TWO if inhibition else steps
    widths = [f"{w} / {finer} AS {w}" for w in centre if w.startswith("_w")]
    return best.selectExpr(
        *[f"`{k}`" for k in keys], "_w AS n", "_f.a AS _a", "_f.b AS _b", *widths,
        "_f.pmax AS pmax", "_f.rd AS rd", "greatest(_f.sse, 0D) AS sse", *[name for _, name in extra],
    )


def search_packed(x: np.ndarray, w: np.ndarray, s1: np.ndarray, s2: np.ndarray, inhibition: bool) -> np.ndarray:
    """The same search for a stack of small groups [group, cell], padded with w = 0.

    Returns columns a, b, pmax, rd, sse; NaN where no candidate is usable.
    """
    offsets = np.array(candidate_offsets(inhibition))
    top = np.abs(np.where(w > 0, x, 0.0)).max(1)
    top[top == 0] = 1.0
    a, b = CENTRE_A / top, CENTRE_B / top
    n, t1 = w.sum(1)[:, None], s1.sum(1)[:, None]
    vy = s2.sum(1)[:, None] - t1 * t1 / n
    finer = STEPS_TWO if inhibition else STEPS_ONE
    out = np.full((len(x), 5), np.nan)
    for level in range(LEVELS_TWO if inhibition else LEVELS_ONE):
        ca = a[:, None] * 10.0 ** (WIDTH_A / finer**level * offsets[:, 0])
        cb = b[:, None] * 10.0 ** (WIDTH_B / finer**level * offsets[:, 1])
        g = 1 - np.exp(-ca[:, None, :] * x[:, :, None])
        if inhibition:
            g *= np.exp(-cb[:, None, :] * x[:, :, None])
        sg, sgy = np.einsum("gc,gck->gk", w, g), np.einsum("gc,gck->gk", s1, g)
        vg = np.einsum("gc,gck,gck->gk", w, g, g) - sg * sg / n
        usable = vg > 1e-9 * n
        vg = np.where(usable, vg, 1.0)
        cgy = sgy - sg * t1 / n
        sse = vy - cgy * cgy / vg
        rel = np.where(usable, np.floor(sse / np.maximum(vy, 1e-12) * TIE_GRID), np.inf)
        pick = np.argmin(rel, axis=1)[:, None]  # ties: first, which is the smallest a, then b
        take = lambda m: np.take_along_axis(m, pick, 1)[:, 0]
        pmax = take(cgy / vg)
        a, b = take(ca), take(cb)
        out = np.column_stack([a, b, pmax, (pmax * take(sg) - t1[:, 0]) / n[:, 0], np.maximum(take(sse), 0.0)])
        out[~np.isfinite(take(rel))] = np.nan
    return out


def _fit_packed(cells: DataFrame, group: list[str], inhibition: bool) -> DataFrame:
    """Fit groups whose cell count was checked to be at most PACK_CELLS."""
    cell = F.when(F.col("x").isNotNull(), F.struct("x", "w", "s1", "s2"))
    packed = cells.groupBy(*group).agg(F.collect_list(cell).alias("_c")).select(
        *group, *[F.col(f"_c.{f}").alias(f) for f in ("x", "w", "s1", "s2")]
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name in group)
    schema += ", n_light bigint, n double, _a double, _b double, pmax double, rd double, sse double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            sizes = pdf["x"].map(len).to_numpy()
            order = np.argsort(sizes, kind="stable")
            fits = np.full((len(pdf), 5), np.nan)
            start = int((sizes == 0).sum())
            while start < len(order):
                # Neighbours in size share a padded block of about four million numbers.
                stop = start + 1
                while stop < len(order) and (stop + 1 - start) * sizes[order[stop]] * 49 < 4_000_000:
                    stop += 1
                block, width = order[start:stop], sizes[order[stop - 1]]
                stack = np.zeros((4, len(block), width))
                for i, at in enumerate(block):
                    for j, name in enumerate(("x", "w", "s1", "s2")):
                        stack[j, i, : sizes[at]] = pdf[name].iat[at]
                fits[block] = search_packed(*stack, inhibition)
                start = stop
            out = pdf[group].copy()
            out["n_light"], out["n"] = sizes, [float(np.sum(w)) for w in pdf["w"]]
            for i, name in enumerate(("_a", "_b", "pmax", "rd", "sse")):
                out[name] = [float(v) if np.isfinite(v) else None for v in fits[:, i]]
            yield out

    return packed.mapInPandas(run, schema)


def _fit_by_levels(cells: DataFrame, group: list[str], inhibition: bool) -> DataFrame:
    """Fit groups of any size, one aggregation over the cells per level."""
    place = [(CENTRE_A / F.col("_top")).alias("_a"), F.lit(WIDTH_A).alias("_wa")]
    if inhibition:
        place += [(CENTRE_B / F.col("_top")).alias("_b"), F.lit(WIDTH_B).alias("_wb")]
    centre = ["_a", "_wa"] + (["_b", "_wb"] if inhibition else [])
    count = [("count(1)", "n_light")]
    first = with_candidates(cells.select("*", *place), inhibition)
    cells = cells.drop("_top")
    best = materialize(best_candidate(first, group, inhibition, count), "curve")
    groups = best.count()
    for _ in range(1, LEVELS_TWO if inhibition else LEVELS_ONE):
        near = with_candidates(best.select(*group, *centre, "n"), inhibition)
        placed = hand_back(cells, near, group, "n", ["x"], groups)
        best = materialize(best_candidate(placed, group, inhibition, count), "curve")
    return best.select(*group, "n_light", "n", "_a", "_b", "pmax", "rd", "sse")


def fit_curves(
    df: DataFrame, keys: Sequence[str], x: str, y: str, inhibition: bool = False, pack_cells: int = PACK_CELLS
) -> DataFrame:
    """One row per group: pmax, alpha, (beta,) rd, sse, n, status. y = pmax (1 - e^(-alpha x / pmax)) [e^(-beta x / pmax)] - rd.

    Every group keeps its row. ``status`` is ``few`` (fewer than four rows or three light values,
    or no usable curve: all NULL), ``boundary`` (the error falls on to the end of the searched
    ratios, as for a straight line: parameters NULL, sse kept) or ``ok``. Rows without light or value do not count in n.
    """
    return _fit_from_cells(_written_cells(df, keys, x, y), keys, inhibition, pack_cells)


def _written_cells(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    source = df if keys else df.withColumn("_all", F.lit(1))
    return materialize(curve_cells(source, list(keys) or ["_all"], x, y), "cells")


def _fit_from_cells(cells: DataFrame, keys: Sequence[str], inhibition: bool, pack_cells: int = PACK_CELLS) -> DataFrame:
    group = list(keys) or ["_all"]
    top = F.coalesce(F.nullif(F.max(F.abs("x")), F.lit(0.0)), F.lit(1.0))
    lights = materialize(cells.groupBy(*group).agg(F.count("x").alias("_lights"), top.alias("_top")), "lights")
    if (lights.agg(F.max("_lights")).first()[0] or 0) <= pack_cells:
        fits = _fit_packed(cells, group, inhibition)
    else:
        sized = hand_back(cells, lights.withColumn("_n", F.col("_lights")), group, "_n", ["x"])
        sized = materialize(sized, "cells")
        small = sized.filter(F.col("_lights") <= pack_cells).drop("_lights", "_top")
        large = sized.filter((F.col("_lights") > pack_cells) & F.col("x").isNotNull()).drop("_lights")
        fits = _fit_packed(small, group, inhibition).unionByName(_fit_by_levels(large, group, inhibition))
    fits = key_join(fits, lights.select(*group, "_top"), group)
    enough = (F.col("n") >= 4) & (F.col("n_light") >= 3) & F.col("_a").isNotNull()
    ends = [(F.abs(F.log10(F.col(c) * F.col("_top") / centre)) > width - 1e-6) for c, centre, width in (
        ("_a", CENTRE_A, WIDTH_A), ("_b", CENTRE_B, WIDTH_B))[:2 if inhibition else 1]]
    ok = enough & ~reduce(lambda p, q: p | q, ends)
    return fits.select(
        *keys, F.col("n").cast("bigint").alias("n"),
        F.when(ok, F.col("pmax")).alias("pmax"),
        F.when(ok, F.col("_a") * F.col("pmax")).alias("alpha"),
        *([F.when(ok, F.col("_b") * F.col("pmax")).alias("beta")] if inhibition else []),
        F.when(ok, F.col("rd")).alias("rd"),
        F.when(enough, F.col("sse")).alias("sse"),
        F.when(ok, "ok").when(enough, "boundary").otherwise("few").alias("status"),
    )


GRADIENT = ("1 - exp(-alpha / pmax * x) * (1 + alpha / pmax * x)", "x * exp(-alpha / pmax * x)", "-1D")
POLISH_STEPS = 8


def _gradient_sums(placed: DataFrame, group: list[str]) -> DataFrame:
    """Per group: gradient products ``_hij``, gradients times residuals ``_gi`` and the error sum at its parameters."""
    rest = "(s1 - w * (pmax * (1 - exp(-alpha / pmax * x)) - rd))"
    sums = [F.expr(f"sum(w * ({GRADIENT[i]}) * ({GRADIENT[j]}))").alias(f"_h{i}{j}") for i in range(3) for j in range(i, 3)]
    sums += [F.expr(f"sum(({g}) * {rest})").alias(f"_g{i}") for i, g in enumerate(GRADIENT)]
    sums.append(F.expr(f"sum(greatest(s2 - s1 * s1 / w, 0D) + {rest} * {rest} / w)").alias("_sse"))
    return placed.groupBy(*group).agg(*[F.expr(f"first({c})").alias(c) for c in ("n", "pmax", "alpha", "rd")], *sums)


def _inverse() -> tuple[list[list[str]], str]:
    """Cofactors and determinant of the symmetric matrix ``_hij``."""
    h = [[f"_h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    minor = lambda i, j: [[h[a][b] for b in range(3) if b != j] for a in range(3) if a != i]
    cof = [[f"({'' if (i + j) % 2 == 0 else '-'}({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]}))" for j in range(3) for m in [minor(i, j)]] for i in range(3)]
    return cof, "(" + " + ".join(f"{h[0][j]} * {cof[0][j]}" for j in range(3)) + ")"


def polish_curves(df: DataFrame, keys: Sequence[str], x: str, y: str, steps: int = POLISH_STEPS) -> DataFrame:
    """Least-squares curves carried to the optimum, with unscaled covariances of (pmax, alpha, rd).

    The searched fit starts Gauss-Newton steps; a step needs ten sums per group over its cells, so groups of any
    size are served by one aggregation. Columns: keys, n, pmax, alpha, rd, sse, v00 ... v22 (upper triangle of the
    inverse of the gradient products) and ``gradient``: the largest cosine between the residuals and a gradient,
    zero at an optimum. Groups without a curve (see fit_curves) keep their row with NULLs, so does a
    group whose gradient products are singular.
    """
    group = list(keys) or ["_all"]
    cells = _written_cells(df, keys, x, y)
    start = _fit_from_cells(cells, group, False)
    start = materialize(start, "polish")
    state = start.filter(F.col("pmax").isNotNull()).select(*group, F.col("n").cast("double").alias("n"), "pmax", "alpha", "rd")
    groups = start.count()
    cells = cells.filter(F.col("x").isNotNull())

    def placed(current: DataFrame) -> DataFrame:
        return hand_back(cells, current.withColumn("_size", F.col("n")), group, "_size", ["x"], groups).filter(F.col("pmax").isNotNull())

    cof, det = _inverse()
    move = [F.expr(f"{c} + ({' + '.join(f'{cof[i][j]} * _g{j}' for j in range(3))}) / {det}").alias(c) for i, c in enumerate(("pmax", "alpha", "rd"))]
    for _ in range(steps):
        sums = _gradient_sums(placed(state), group)
        state = materialize(sums.select(*group, "n", *move), "polish").filter(F.expr("NOT isnan(pmax + alpha + rd) AND pmax <> 0"))
    last = _gradient_sums(placed(state), group)
    cosines = [F.expr(f"abs(_g{i}) / sqrt(_h{i}{i} * greatest(_sse, 1e-300D))") for i in range(3)]
    found = last.select(
        *group, "pmax", "alpha", "rd", F.col("_sse").alias("sse"),
        *[F.expr(f"{cof[i][j]} / {det}").alias(f"v{i}{j}") for i in range(3) for j in range(i, 3)], F.greatest(*cosines).alias("gradient"))
    return start.select(*group, "n").join(found, group, "left").drop(*([] if keys else ["_all"]))


def curve_coefficients(fits: DataFrame, key: str) -> DataFrame:
    """Coefficient table of one model with a curve for every level of ``key`` (first level: base, others: differences).

    ``fits`` come from polish_curves; the error scale is common to all levels, as in one least-squares
    fit. Columns: term, estimate, se, statistic, p_value (two-sided t). Levels without a curve have no terms.
    """
    fits = fits.filter(F.col("pmax").isNotNull())
    total = fits.agg(F.struct(F.min(key).alias("base"), F.sum("sse").alias("sse"), (F.sum("n") - 3 * F.count(F.lit(1))).cast("double").alias("df"))).scalar()
    own = fits.withColumn("_t", total).select(
        "_t", F.col(key).cast("string").alias("_level"), (F.col(key) == F.col("_t.base")).alias("_first"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("own"), F.col(f"v{i}{i}").alias("var")) for i, c in enumerate(("pmax", "alpha", "rd"))])))
    base = own.filter("_first").select("name", F.col("own").alias("base_own"), F.col("var").alias("base_var"))
    scale = F.col("_t.sse") / F.col("_t.df")
    # three rows
    terms = own.join(F.broadcast(base), "name").select(
        F.when(F.col("_first"), F.col("name")).otherwise(F.concat(F.lit("d"), "name", F.lit("["), "_level", F.lit("]"))).alias("term"),
        (F.col("own") - F.when(F.col("_first"), 0.0).otherwise(F.col("base_own"))).alias("estimate"),
        F.sqrt((F.col("var") + F.when(F.col("_first"), 0.0).otherwise(F.col("base_var"))) * scale).alias("se"), F.col("_t.df").alias("df"))

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["statistic"] = pdf["estimate"] / pdf["se"]
            pdf["p_value"] = [t_two_sided(t, df) for t, df in zip(pdf["statistic"], pdf["df"])]
            yield pdf[["term", "estimate", "se", "statistic", "p_value"]]

    return terms.mapInPandas(tail, "term string, estimate double, se double, statistic double, p_value double")


def compare_pooled(pooled: DataFrame, per_group: DataFrame, n_parameters: int = 3) -> DataFrame:
    """F test of one curve for all against one curve per group (one row)."""
    full = per_group.filter(F.col("sse").isNotNull()).agg(
        F.sum("sse").alias("sse_full"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups")
    )
    both = full.withColumn("sse_pooled", pooled.select("sse").scalar()).select(
        "sse_pooled", "sse_full",
        ((F.col("groups") - 1) * n_parameters).cast("double").alias("df"),
        (F.col("n") - F.col("groups") * n_parameters).cast("double").alias("df_residual"),
    )
    both = both.withColumn(
        "f_value", (F.col("sse_pooled") - F.col("sse_full")) / F.col("df") / (F.col("sse_full") / F.col("df_residual"))
    )

    def tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["p_value"] = [f_upper_tail(f, a, b) for f, a, b in zip(pdf["f_value"], pdf["df"], pdf["df_residual"])]
            yield pdf

    return both.mapInPandas(tail, "sse_pooled double, sse_full double, df double, df_residual double, f_value double, p_value double")


def predict_grid(fits: DataFrame, keys: Sequence[str], column: str, low, high, points: int = 101) -> DataFrame:
    grid = linear_grid(fits, column, low, high, points)
    return grid.select(*keys, column, saturating(column, "pmax", "alpha", "rd").alias("fit"))


def robust_curves(df: DataFrame, keys: Sequence[str], x: str, y: str, spread_by: Sequence[str], steps: int = 6) -> DataFrame:
    """Curve per group under Student t(2) errors, groups partly pooled. Point estimates.

    Each step reweights the rows by 3 / (2 + z^2) and refits around the previous curve; the
    state between steps is one row per group, written to the shared folder. Afterwards the
    group values are shrunk to their precision-weighted mean by their own uncertainty. Groups
    without a curve, or with at most four rows, keep their row with NULL values.
    """
    keys = list(keys)
    df = materialize(df.select(*dict.fromkeys([*keys, *spread_by, x, y])), "robust-rows")
    rows = df.select(*keys, *[c for c in spread_by if c not in keys + [x, y]], F.col(x).alias("x"), F.col(y).alias("_y"))
    spread = ["x" if c == x else "_y" if c == y else c for c in spread_by]
    start = materialize(fit_curves(df, keys, x, y), "robust-start")
    state = materialize(
        start.filter(F.col("pmax").isNotNull() & (F.col("n") > 4)).select(
            *keys, F.col("n").cast("double").alias("n"), "pmax", "rd",
            (F.col("alpha") / F.col("pmax")).alias("_a"), F.lit(0.2).alias("_wa"),
            (F.col("sse") / F.col("n")).alias("s2"),
        ), "robust")

    groups = state.count()

    def weighted(current: DataFrame) -> DataFrame:
        sized = with_candidates(current, steps=ROBUST_STEPS).withColumn("_size", F.col("n"))
        placed = hand_back(rows, sized.drop("n"), keys, "_size", spread, groups).filter(F.col("_a").isNotNull())
        mu = F.expr("pmax * (1 - exp(-_a * x)) - rd")
        placed = placed.withColumn("_r2", (F.col("_y") - mu) * (F.col("_y") - mu))
        return placed.withColumn("w", 3 / (2 + F.col("_r2") / F.greatest("s2", F.lit(1e-12))))

    for _ in range(steps):
        cells = weighted(state).select(
            *keys, "_a", "_wa", *[f"_p{i}" for i in range(2 * ROBUST_STEPS + 1)], "x", "w", (F.col("w") * F.col("_r2")).alias("_wr2"),
            (F.col("w") * F.col("_y")).alias("s1"), (F.col("w") * F.col("_y") * F.col("_y")).alias("s2"),
        )
        new = best_candidate(cells, keys, extra=[("sum(_wr2)", "_scale"), ("count(1)", "_rows")], steps=ROBUST_STEPS)
        state = materialize(new.select(
            *keys, F.col("_rows").cast("double").alias("n"), "pmax", "rd", "_a",
            (F.col("_wa") * ROBUST_STEPS / 3).alias("_wa"), (F.col("_scale") / F.col("_rows")).alias("s2"),
        ), "robust")

    pooled = _shrink(_uncertainty(weighted(state), keys), keys)
    return key_join(start.select(*keys, "n"), pooled.drop("n"), keys, "left")


def _uncertainty(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Parameter variances per group from the weighted gradient products (six sums per group)."""
    e = "exp(-_a * x)"
    grads = [f"(1 - {e} - _a * x * {e})", f"(x * {e})", "(-1D)"]
    sums = [F.expr(f"sum(w * {grads[i]} * {grads[j]}) AS _h{i}{j}") for i in range(3) for j in range(i, 3)]
    first = [F.expr(f"first({c}) AS {c}") for c in ("pmax", "rd", "_a", "s2")]
    groups = placed.groupBy(*keys).agg(*first, *sums, F.count(F.lit(1)).alias("n"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema if f.name in keys)
    schema += ", n bigint, pmax double, log_alpha double, rd double, sigma double, v_pmax double, v_log_alpha double, v_rd double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            h = np.zeros((len(pdf), 3, 3))
            for i in range(3):
                for j in range(i, 3):
                    h[:, i, j] = h[:, j, i] = pdf[f"_h{i}{j}"]
            ridge = 1e-12 * np.trace(h, axis1=1, axis2=2)[:, None, None] * np.eye(3)
            var = np.diagonal(np.linalg.inv(h + ridge), axis1=1, axis2=2) * pdf["s2"].to_numpy()[:, None]
            alpha = (pdf["_a"] * pdf["pmax"]).clip(lower=1e-12)
            out = pdf[keys + ["n", "pmax", "rd"]].copy()
            out["log_alpha"], out["sigma"] = np.log(alpha), np.sqrt(pdf["s2"])
            out["v_pmax"], out["v_rd"] = np.maximum(var[:, 0], 1e-12), np.maximum(var[:, 2], 1e-12)
            out["v_log_alpha"] = np.maximum(var[:, 1] / alpha.to_numpy() ** 2, 1e-12)
            yield out[keys + ["n", "pmax", "log_alpha", "rd", "sigma", "v_pmax", "v_log_alpha", "v_rd"]]

    return groups.mapInPandas(run, schema)


def _shrink(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Precision-weighted pooling; the between-group variance is a moment estimate."""
    fixed = materialize(groups, "pool")
    names = ("pmax", "log_alpha", "rd")
    first = fixed.agg(F.struct(*[e for p in names for e in (
        F.expr(f"sum({p} / v_{p}) / sum(1 / v_{p}) AS m_{p}"),
        F.expr(f"sum(1 / v_{p}) AS w_{p}"),
        F.expr(f"sum(1 / (v_{p} * v_{p})) AS ww_{p}"),
    )], F.expr("count(1) AS k"))).scalar()
    staged = fixed.withColumn("_m", first)
    between = staged.agg(F.struct(*[
        F.expr(f"greatest((sum(pow({p} - _m.m_{p}, 2) / v_{p}) - (max(_m.k) - 1)) / nullif(max(_m.w_{p} - _m.ww_{p} / _m.w_{p}), 0), 0D) AS t_{p}")
        for p in names
    ])).scalar()
    staged = staged.withColumn("_t", between)
    centre = staged.agg(F.struct(*[
        F.expr(f"sum({p} / (v_{p} + coalesce(_t.t_{p}, 0D))) / sum(1 / (v_{p} + coalesce(_t.t_{p}, 0D))) AS c_{p}") for p in names
    ])).scalar()
    staged = staged.withColumn("_c", centre)
    pooled = [
        F.expr(f"({p} * coalesce(_t.t_{p}, 0D) + _c.c_{p} * v_{p}) / (v_{p} + coalesce(_t.t_{p}, 0D))").alias(f"_s_{p}") for p in names
    ]
    out = staged.select("*", *pooled)
    return out.select(
        *keys, "n", F.col("_s_pmax").alias("pmax"), F.exp("_s_log_alpha").alias("alpha"), F.col("_s_rd").alias("rd"), "sigma",
        F.col("pmax").alias("pmax_own"), F.exp("log_alpha").alias("alpha_own"), F.col("rd").alias("rd_own"),
    )
