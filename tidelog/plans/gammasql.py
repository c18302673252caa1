"""Gamma smooths (log link) as SQL: the working response of the month cells, one recursion step per iteration.

The working weights are the counts, so the matrix of an iteration never changes; its inverses for all
smoothing levels that the search can reach (steps of 0.05 between -7 and 7, numbered -140..140) are
made once by Gauss-Jordan steps. Basis values add up to one, so level and centred smooth together are
the plain basis.
"""

from __future__ import annotations

from ..functions.splines import Spline

ITERATIONS, TUNED = 40, 12
LADDER = (20, 20, 5, 5, 1)  # steps of the search in units of 0.05


def _trace_rest(m: str, k: int) -> str:
    """Trace of m over the directions that keep the smooth's sum ``r`` at zero."""
    one = range(1, k + 1)
    return (f"({' + '.join(f'{m}[{i}][{i}]' for i in one)} - ({' + '.join(f'r[{i}] * r[{j}] * {m}[{i}][{j}]' for i in one for j in one)})"
            f" / ({' + '.join(f'r[{i}] * r[{i}]' for i in one)}))")


def _solved(name: str, keys: str, k: int, source: str, fix: str = "0.0") -> str:
    """Inverses of g + 10^(l / 20) unit s (plus ``fix`` in every place) and their effective df, for all levels l."""
    one = range(1, k + 1)
    rows = ", ".join("list_concat([" + ", ".join(f"g[{i}][{j}] + pow(10::DOUBLE, l / 20.0::DOUBLE) * unit * s[{i}][{j}] + {fix}" for j in one)
                     + f"], [{', '.join('1.0' if i == j else '0.0' for j in one)}]::DOUBLE[])" for i in one)
    return f"""
{name}_steps(p, {keys}, l, g, m) AS (
  SELECT 0, {keys}, l, g, [{rows}] FROM {source}, (SELECT unnest(range(-140, 141)) AS l)
  UNION ALL
  SELECT p + 1, {keys}, l, g, list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = p + 1 THEN top
           ELSE list_transform(range(1, {2 * k + 1}), lambda q: m[i][q] - m[i][p + 1] * top[q]) END)
  FROM (SELECT *, list_transform(m[p + 1], lambda v: v / m[p + 1][p + 1]) AS top FROM {name}_steps WHERE p < {k})),
{name} AS MATERIALIZED (
  SELECT {keys}, l, inv, list_sum(list_transform(list_zip(inv, g), lambda t: list_dot_product(t[1], t[2]))) AS edf
  FROM (SELECT {keys}, l, g, list_transform(m, lambda v: v[{k + 1}:{2 * k}]) AS inv FROM {name}_steps WHERE p = {k}))"""


def _ladder(inner: str, keep: str) -> str:
    """Walk the levels from ``l`` by the scores in ``gcv``, first of equals."""
    for i, step in enumerate(LADDER):
        old = "l" if i == 0 else f"l{i}"
        pick = f"list_sort(list_transform(range(-6, 7), lambda j: {{'v': gcv[greatest(-140, least(140, {old} + {step} * j)) + 141], 'j': j}}))[1].j"
        inner = f"(SELECT *, greatest(-140, least(140, {old} + {step} * {pick})) AS l{i + 1} FROM {inner})"
    return f"(SELECT {keep}, l{len(LADDER)} AS found FROM {inner})"


def gamma_views(keys: str, source: str, spline: Spline, name: str = "gm") -> str:
    """Views ``<name>``(keys, n, l, edf, inv, beta, deviance, pearson) and its parts; ``source`` gives (keys, month, value)."""
    k = spline.size
    basis = ", ".join(f"{t} AS b{i}" for i, t in enumerate(spline.sql("month")))
    b = [f"b{i}" for i in range(k)]
    gram = ", ".join("[" + ", ".join(f"sum(n * {x} * {y})" for y in b) + "]" for x in b)
    penalty = "[" + ", ".join("[" + ", ".join(f"({float(v)!r})::DOUBLE" for v in row) + "]" for row in spline.penalty) + "]"
    score = f"""(SELECT t.*, i.l AS tried, i.edf, list_transform(i.inv, lambda v: list_dot_product(v, cz)) AS b
        FROM (SELECT *, list_transform(range(1, {k + 1}), lambda i: list_sum(list_transform(z, lambda v: v.n * v.z * v.b[i]))) AS cz,
                     list_sum(list_transform(z, lambda v: v.n * v.z * v.z + v.within / (v.mu * v.mu))) AS zz
              FROM (SELECT *, list_transform(work, lambda v: {{'n': v.n, 'b': v.b, 'within': v.within, 'mu': exp(v.eta), 'z': v.eta + (v.mean - exp(v.eta)) / exp(v.eta)}}) AS z
                    FROM {name}_walk WHERE step < {ITERATIONS})) t JOIN {name}_inv i USING ({keys}))"""
    scored = f"""(SELECT {keys}, step, any_value(l) AS l, any_value(work) AS work, any_value(cz) AS cz, list(n * greatest(zz - 2 * list_dot_product(b, cz) +
          list_sum(list_transform(list_zip(b, g), lambda t: t[1] * list_dot_product(t[2], b))), 0) / pow(greatest(n - edf, 1e-6), 2) ORDER BY tried) AS gcv
        FROM {score} GROUP BY {keys}, step)"""
    return f"""
{name}_cells AS (SELECT {keys}, month, count(*)::DOUBLE AS n, sum(value) AS s1, sum(value * value) AS s2, sum(ln(value)) AS slog FROM ({source}) GROUP BY ALL),
{name}_sums AS (
  SELECT {keys}, sum(n) AS n, sum(s1) AS s1, [{gram}] AS g, [{", ".join(f"sum(n * {x})" for x in b)}] AS r, {penalty} AS s,
         list({{'n': n, 'mean': s1 / n, 'within': greatest(s2 - s1 * s1 / n, 0), 's1': s1, 's2': s2, 'slog': slog, 'b': [{", ".join(b)}]}}) AS cells
  FROM (SELECT *, {basis} FROM {name}_cells) GROUP BY ALL),
{name}_models AS MATERIALIZED (SELECT *, (n + {_trace_rest("g", k)}) / {_trace_rest("s", k)} AS unit FROM {name}_sums),{_solved(f"{name}_inv", keys, k, f"{name}_models")},
{name}_walk(step, {keys}, n, g, l, work, beta) AS (
  SELECT 0, {keys}, n, g, 0::BIGINT, list_transform(cells, lambda c: {{'n': c.n, 'mean': c.mean, 'within': c.within, 'b': c.b, 'eta': ln(s1 / n)}}), NULL::DOUBLE[] FROM {name}_models
  UNION ALL
  SELECT step + 1, {keys}, n, g, l, list_transform(work, lambda v: {{'n': v.n, 'mean': v.mean, 'within': v.within, 'b': v.b, 'eta': list_dot_product(v.b, beta)}}), beta
  FROM (SELECT w.step, {keys}, m.n, m.g, w.found AS l, w.work, list_transform(i.inv, lambda v: list_dot_product(v, w.cz)) AS beta
        FROM (SELECT {keys}, step, work, cz, CASE WHEN step < {TUNED} THEN found ELSE l END AS found FROM {_ladder(scored, f"{keys}, step, l, work, cz")}) w
        JOIN {name}_models m USING ({keys}) JOIN {name}_inv i ON {" AND ".join(f"i.{c} = w.{c}" for c in keys.split(", "))} AND i.l = w.found)),
{name} AS MATERIALIZED (
  SELECT {keys}, m.n, i.l, i.edf, i.inv, w.beta,
         list_sum(list_transform(m.cells, lambda c: 2 * (c.n * list_dot_product(c.b, w.beta) - c.slog + c.s1 / exp(list_dot_product(c.b, w.beta)) - c.n))) AS deviance,
         list_sum(list_transform(m.cells, lambda c: (c.s2 - 2 * exp(list_dot_product(c.b, w.beta)) * c.s1 + c.n * exp(2 * list_dot_product(c.b, w.beta))) / exp(2 * list_dot_product(c.b, w.beta)))) AS pearson
  FROM {name}_walk w JOIN {name}_models m USING ({keys}) JOIN {name}_inv i ON {" AND ".join(f"i.{c} = w.{c}" for c in keys.split(", "))} AND i.l = w.l WHERE w.step = {ITERATIONS})"""


def gamma_curve(keys: str, spline: Spline, scale: str, points: int = 50, name: str = "gm") -> str:
    """View ``curve``(keys, month, edf, fit, l95, u95) on the response scale; ``scale`` is an expression over the models."""
    basis = ", ".join(spline.sql("month"))
    return f"""
curve AS (SELECT {keys}, month, edf, exp(e) AS fit, exp(e - 1.96 * h) AS l95, exp(e + 1.96 * h) AS u95 FROM (
  SELECT {keys}, month, edf, list_dot_product(b, beta) AS e,
         sqrt(greatest(phi * list_sum(list_transform(list_zip(b, inv), lambda t: t[1] * list_dot_product(t[2], b))), 0)) AS h
  FROM (SELECT *, {scale} AS phi FROM {name}), (SELECT month, [{basis}] AS b FROM (SELECT 1 + i * 11 / {points}::DOUBLE AS month FROM (SELECT unnest(range({points} + 1)) AS i)))))"""


def shared_views(source: str, spline: Spline, name: str = "sh") -> str:
    """View ``<name>``(n, edf, deviance, pearson): one smooth for all sites and a level for each; ``source`` gives (site, month, value).

    Given the curve a site's level has a closed form. Levels are taken out of the sums, so the matrix has
    the constant in its null space; the number of rows in every place makes it regular and changes nothing else.
    """
    k = spline.size
    b = [f"b{i}" for i in range(k)]
    basis = ", ".join(f"{t} AS b{i}" for i, t in enumerate(spline.sql("month")))
    penalty = "[" + ", ".join("[" + ", ".join(f"({float(v)!r})::DOUBLE" for v in row) + "]" for row in spline.penalty) + "]"
    gram = ", ".join("[" + ", ".join(f"sum(n * {x} * {y})" for y in b) + "]" for x in b)
    minus = ", ".join("[" + ", ".join(f"sum(m[{i}] * m[{j}] / n)" for j in range(1, k + 1)) + "]" for i in range(1, k + 1))
    level = "ln(list_sum(list_transform(cells, lambda c: c.s1 * exp(-curve[c.month]))) / n)"
    z = "(level + curve[c.month] + (c.mean - exp(level + curve[c.month])) / exp(level + curve[c.month]))"
    placed = f"""(SELECT step, l, settled, cells, curve, n, level, list_sum(list_transform(cells, lambda c: c.n * {z})) / n AS zbar
        FROM (SELECT w.*, s.cells, s.n, {level} AS level FROM {name}_walk w, {name}_sites s WHERE step < {ITERATIONS}))"""
    centred = f"({z} - zbar)"
    sums = ", ".join(f"sum(list_sum(list_transform(cells, lambda c: c.n * {centred} * c.b[{i}])))" for i in range(1, k + 1))
    work = f"""(SELECT step, any_value(l) AS l, any_value(settled) AS settled, [{sums}] AS cz,
        sum(list_sum(list_transform(cells, lambda c: c.n * {centred} * {centred} + c.within / exp(2 * (level + curve[c.month]))))) AS zz FROM {placed} GROUP BY step)"""
    scored = f"""(SELECT step, any_value(l) AS l, any_value(settled) AS settled, any_value(cz) AS cz,
        list(n * (zz - 2 * list_dot_product(b, cz) + list_sum(list_transform(list_zip(b, g), lambda t: t[1] * list_dot_product(t[2], b)))) / pow(greatest(n - k - edf, 1e-6), 2) ORDER BY tried) AS gcv
        FROM (SELECT w.*, m.n, m.g, m.k, i.l AS tried, i.edf, list_transform(i.inv, lambda v: list_dot_product(v, cz)) AS b FROM {work} w, {name}_model m, {name}_inv i) GROUP BY step)"""
    tuned = f"""(SELECT step, cz, CASE WHEN open THEN found ELSE l END AS l, CASE WHEN NOT open THEN settled WHEN found = l THEN settled + 1 ELSE 0 END AS settled
        FROM (SELECT *, settled < 2 AND step < {TUNED} AS open FROM {_ladder(scored, "step, l, settled, cz")}))"""
    return f"""
{name}_cells AS (SELECT site, month, count(*)::DOUBLE AS n, sum(value) AS s1, sum(value * value) AS s2, sum(ln(value)) AS slog FROM ({source}) GROUP BY ALL),
{name}_sites AS MATERIALIZED (
  SELECT site, sum(n) AS n, [{", ".join(f"sum(n * {x})" for x in b)}] AS m,
         list({{'month': month, 'n': n, 'mean': s1 / n, 'within': greatest(s2 - s1 * s1 / n, 0), 's1': s1, 's2': s2, 'slog': slog, 'b': [{", ".join(b)}]}}) AS cells
  FROM (SELECT *, {basis} FROM {name}_cells) GROUP BY site),
{name}_model AS MATERIALIZED (
  SELECT 1 AS one, *, {_trace_rest("g", k)} / {_trace_rest("s", k)} AS unit FROM (
    SELECT n, k, r, {penalty} AS s, list_transform(list_zip(whole, minus), lambda t: list_transform(list_zip(t[1], t[2]), lambda u: u[1] - u[2])) AS g
    FROM (SELECT sum(n) AS n, [{gram}] AS whole, [{", ".join(f"sum(n * {x})" for x in b)}] AS r FROM (SELECT *, {basis} FROM {name}_cells)),
         (SELECT count(*) AS k, [{minus}] AS minus FROM {name}_sites))),{_solved(f"{name}_inv", "one", k, f"{name}_model", "n")},
{name}_months AS (SELECT list([{", ".join(b)}] ORDER BY month) AS xs FROM (SELECT month, {basis} FROM (SELECT unnest(range(1, 13))::DOUBLE AS month))),
{name}_walk(step, l, settled, curve) AS (
  SELECT 0, 0::BIGINT, 0, list_transform(range(12), lambda i: 0.0::DOUBLE)
  UNION ALL
  SELECT t.step + 1, t.l, t.settled, list_transform(xs, lambda x: list_dot_product(x, list_transform(i.inv, lambda v: list_dot_product(v, t.cz))))
  FROM {tuned} t JOIN {name}_inv i ON i.l = t.l, {name}_months),
{name} AS (
  SELECT n, k + edf AS edf, deviance, pearson FROM {name}_model, (SELECT i.edf FROM {name}_inv i JOIN {name}_walk w ON w.l = i.l AND w.step = {ITERATIONS}), (
    SELECT sum(list_sum(list_transform(cells, lambda c: 2 * (c.n * (level + curve[c.month]) - c.slog + c.s1 / exp(level + curve[c.month]) - c.n)))) AS deviance,
           sum(list_sum(list_transform(cells, lambda c: (c.s2 - 2 * exp(level + curve[c.month]) * c.s1 + c.n * exp(2 * (level + curve[c.month]))) / exp(2 * (level + curve[c.month]))))) AS pearson
    FROM (SELECT w.*, s.cells, s.n AS sn, {level.replace('/ n)', '/ s.n)')} AS level FROM {name}_walk w, {name}_sites s WHERE w.step = {ITERATIONS})))"""


def f_tail(f: str, d1: str, d2: str) -> str:
    """Upper tail of F with any degrees of freedom: the incomplete beta integral after t = x exp(-s / a), by Simpson's rule."""
    a, b, x = f"({d2} / 2)", f"({d1} / 2)", f"({d2} / ({d2} + {d1} * {f}))"
    front = f"exp({a} * ln({x}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}))"
    return (f"{front} * 0.02 / 3 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
            f" * exp(-i * 0.02) * pow(1 - {x} * exp(-i * 0.02 / {a}), {b} - 1)))")
