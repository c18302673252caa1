"""Queries: daily slopes, seasonal smooths, linear models and their tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.splines import Spline
from ..functions.thinplate import thin_plate, thin_plate_of
from ..functions.values import snap, snap_sql
from ..operators import linear as ln
from ..operators import seasonal as se
from ..operators import simultaneous as sim
from ..operators import siteblocks as sb
from ..operators import smoothing as sm
from ..session import materialize
from ..operators.joins import dimension, grid_by_level
from .gammasql import f_tail, gamma_curve, gamma_views, shared_views
from .registry import query
from .tables import DAILY, PI, READINGS, daily, readings, with_views
from .tails import normal_p, student_p

HOUR_SPLINE = Spline.even(0.0, 24.0, 5, "cs")
MONTH_SPLINE = se.month_spline()
OPEN_SPLINE = se.month_spline(cyclic=False)
MONTH_PLATE = thin_plate(range(1, 13))  # what the distinct months of the tables give


def _snapped(df, *columns, digits=4):
    for c in columns:
        df = df.withColumn(c, snap(c, digits))
    return df


def _gram_sql(keys: str, spline: Spline, x: str, y: str, view: str) -> str:
    """Long form of the sums of products: (keys, entry, total)."""
    k = spline.size
    basis = ", ".join(f"{b} AS b{i}" for i, b in enumerate(spline.sql(x)))
    sums = [f"sum(b{i} * b{j})" for i in range(k) for j in range(i, k)] + [f"sum(b{i} * y)" for i in range(k)]
    return f"""SELECT {keys}, entry, n, {snap_sql('total', 3)} AS total FROM (
        SELECT {keys}, n, unnest(totals) AS total, CAST(unnest(range({len(sums)})) AS INTEGER) AS entry FROM (
          SELECT {keys}, count(*) AS n, [{', '.join(sums)}] AS totals
          FROM (SELECT {keys}, {y} AS y, {basis} FROM {view}) GROUP BY ALL))"""


def _long_gram(grams, keys):
    long = grams.select(*keys, "n", F.posexplode(F.concat("gram", "cross")).alias("entry", "total"))
    return long.withColumn("total", snap("total", 3))


@query(
    "spline_gram_daily",
    with_views(_gram_sql("location, position, day", HOUR_SPLINE, "hour", "oxygen", "readings"), READINGS),
)
def spline_gram_daily(spark, d):
    keys = ["location", "position", "day"]
    return _long_gram(sm.gram(readings(spark, d), keys, HOUR_SPLINE, "hour", "oxygen"), keys)


@query("spline_gram_cyclic", with_views(_gram_sql("location", MONTH_SPLINE, "month", "value", "daily"), DAILY))
def spline_gram_cyclic(spark, d):
    return _long_gram(sm.gram(daily(spark, d), ["location"], MONTH_SPLINE, "month", "value"), ["location"])


def _slope_sql() -> str:
    """Penalised least squares per group: Gauss-Jordan steps on [A | G | c], one recursion step per pivot.

    A = G + lambda S; with X = A^-1 G and beta = A^-1 c the effective df are the trace of X. Two rounds
    of smoothing levels are tried, the second around the best of the first.
    """
    k, s = HOUR_SPLINE.size, HOUR_SPLINE.penalty
    keys = "location, position, day"
    basis = ", ".join(f"{t} AS b{i}" for i, t in enumerate(HOUR_SPLINE.sql("hour")))
    slope = ", ".join(f"{t} AS d{i}" for i, t in enumerate(HOUR_SPLINE.sql("hour", 1)))
    gram = ", ".join("[" + ", ".join(f"sum(b{i} * b{j})" for j in range(k)) + "]" for i in range(k))
    trace = " + ".join(f"g[{i}][{i}]" for i in range(1, k + 1))
    ridge = "[" + ", ".join("[" + ", ".join(f"g[{i}][{j}]" + (f" + 1e-12 * ({trace}) / {k}" if i == j else "") for j in range(1, k + 1)) + "]" for i in range(1, k + 1)) + "]"
    rows = ", ".join("list_concat([" + ", ".join(
        f"g[{i + 1}][{j + 1}] + pow(10::DOUBLE, level) * scale * ({float(s[i, j])!r})::DOUBLE" for j in range(k)) + f"], g[{i + 1}], [c[{i + 1}]])" for i in range(k))
    dots = " + ".join(f"m[{i}][{2 * k + 1}] * c[{i}]" for i in range(1, k + 1))
    squares = " + ".join(f"m[{i}][{2 * k + 1}] * m[{j}][{2 * k + 1}] * g[{i}][{j}]" for i in range(1, k + 1) for j in range(1, k + 1))
    edf = " + ".join(f"m[{i}][{k + i}]" for i in range(1, k + 1))

    def solved(name: str, levels: str) -> str:
        return f"""
{name}_steps(p, {keys}, level, g, c, yy, n, m) AS (
  SELECT 0, {keys}, level, g, c, yy, n, [{rows}] FROM {levels}
  UNION ALL
  SELECT p + 1, {keys}, level, g, c, yy, n, list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = p + 1 THEN top
           ELSE list_transform(range(1, {2 * k + 2}), lambda j: m[i][j] - m[i][p + 1] * top[j]) END)
  FROM (SELECT *, list_transform(m[p + 1], lambda v: v / m[p + 1][p + 1]) AS top FROM {name}_steps WHERE p < {k})),
{name} AS (
  SELECT {keys}, level, n, edf, m, CASE WHEN n - edf > 1e-6 THEN n * greatest(rss, 0) / pow(greatest(n - edf, 1e-6), 2) ELSE 'inf'::DOUBLE END AS gcv
  FROM (SELECT *, {edf} AS edf, yy - 2 * ({dots}) + {squares} AS rss FROM {name}_steps WHERE p = {k}))"""

    first = ", ".join(f"{-7 + 0.5 * i!r}::DOUBLE" for i in range(29))
    second = ", ".join(f"{-0.45 + 0.05 * i!r}::DOUBLE" for i in range(19))
    return f"""
WITH RECURSIVE {READINGS},
centred AS (SELECT *, oxygen - avg(oxygen) OVER (PARTITION BY {keys}) AS y FROM readings),
sums AS (
  SELECT {keys}, count(*)::DOUBLE AS n, sum(y * y) AS yy, [{gram}] AS g, [{", ".join(f"sum(b{i} * y)" for i in range(k))}] AS c
  FROM (SELECT {keys}, y, {basis} FROM centred) GROUP BY ALL),
groups AS (SELECT {keys}, n, yy, {ridge} AS g, c, ({trace}) / {float(s.trace())!r}::DOUBLE AS scale FROM sums),
wide AS (SELECT *, unnest([{first}]) AS level FROM groups),{solved("coarse", "wide")},
chosen AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY gcv, level) AS rn FROM coarse),
near AS (SELECT groups.*, chosen.level + unnest([{second}]) AS level FROM groups JOIN chosen USING ({keys}) WHERE rn = 1),{solved("fine", "near")},
best AS (
  SELECT {keys}, CASE WHEN n > edf + 0.5 THEN m END AS m FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY gcv, round, level) AS pick FROM (
      SELECT {keys}, n, edf, m, gcv, level, 1 AS round FROM chosen WHERE rn = 1
      UNION ALL SELECT {keys}, n, edf, m, gcv, level, 2 FROM fine)) WHERE pick = 1)
SELECT event_id, location, position, day, {snap_sql('hour')} AS hour, {snap_sql('oxygen')} AS oxygen,
       {snap_sql(" + ".join(f"d{i} * m[{i + 1}][{2 * k + 1}]" for i in range(k)), 3)} AS rate
FROM (SELECT *, {slope} FROM readings) JOIN best USING ({keys})"""


@query("oxygen_slope", _slope_sql())
def oxygen_slope(spark, d):
    r = readings(spark, d).select("event_id", "location", "position", "day", "hour", "oxygen")
    out = sm.slope_at_rows(r, ["location", "position", "day"], "hour", "oxygen", HOUR_SPLINE, ["event_id"])
    return _snapped(_snapped(out, "hour", "oxygen"), "rate", digits=3)


def _cells(spark, d, value="value"):
    return materialize(ln.month_cells(daily(spark, d), "location", "month", value), "month-cells")


def _grid(spark, d, points=51):
    return grid_by_level(daily(spark, d).select(F.col("location").alias("site")), "site", "month", 1, 12, points)


def _season_sql(keys: str, source: str, spline: Spline, select: str, points: str) -> str:
    """Gaussian smooth of every group of ``source(keys, month, value)``: same ladder of smoothing levels, own algebra.

    The basis adds up to one and the penalty ignores constants, so level and centred smooth together
    are the plain basis, solved as [A | G | c | I] by Gauss-Jordan steps, A = G + lambda S.
    """
    k, s = spline.size, spline.penalty
    one = range(1, k + 1)
    basis = ", ".join(f"{t} AS b{i}" for i, t in enumerate(spline.sql("month")))
    gram = ", ".join("[" + ", ".join(f"sum(b{i} * b{j})" for j in range(k)) + "]" for i in range(k))
    penalty = "[" + ", ".join("[" + ", ".join(f"({float(v)!r})::DOUBLE" for v in row) + "]" for row in s) + "]"
    total = " + ".join(f"r[{i}] * r[{i}]" for i in one)

    def rest(m: str) -> str:  # trace of m over the directions that keep the smooth's sum at zero
        return f"({' + '.join(f'{m}[{i}][{i}]' for i in one)} - ({' + '.join(f'r[{i}] * r[{j}] * {m}[{i}][{j}]' for i in one for j in one)}) / ({total}))"

    rows = ", ".join("list_concat([" + ", ".join(f"g[{i}][{j}] + pow(10::DOUBLE, level) * unit * s[{i}][{j}]" for j in one)
                     + f"], g[{i}], [c[{i}]], [{', '.join('1.0' if i == j else '0.0' for j in one)}]::DOUBLE[])" for i in one)
    beta = [f"m[{i}][{2 * k + 1}]" for i in one]
    dots = " + ".join(f"{b} * c[{i}]" for i, b in zip(one, beta))
    squares = " + ".join(f"{beta[i - 1]} * {beta[j - 1]} * g[{i}][{j}]" for i in one for j in one)
    edf = " + ".join(f"m[{i}][{k + i}]" for i in one)
    views = []
    for turn, step in enumerate((1.0, 1.0, 0.25, 0.25, 0.05)):
        start = "0.0::DOUBLE" if turn == 0 else "level"
        before = "models" if turn == 0 else f"best{turn - 1}"
        views.append(f"""
tries{turn} AS (SELECT {keys}, n, yy, g, c, s, unit, j, greatest(-7.0::DOUBLE, least(7.0::DOUBLE, start + {step!r}::DOUBLE * j)) AS level
  FROM (SELECT {keys}, n, yy, g, c, s, unit, {start} AS start, unnest(range(-6, 7)) AS j FROM {before})),
steps{turn}(p, {keys}, level, j, g, c, s, unit, yy, n, m) AS (
  SELECT 0, {keys}, level, j, g, c, s, unit, yy, n, [{rows}] FROM tries{turn}
  UNION ALL
  SELECT p + 1, {keys}, level, j, g, c, s, unit, yy, n, list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = p + 1 THEN top
           ELSE list_transform(range(1, {3 * k + 2}), lambda q: m[i][q] - m[i][p + 1] * top[q]) END)
  FROM (SELECT *, list_transform(m[p + 1], lambda v: v / m[p + 1][p + 1]) AS top FROM steps{turn} WHERE p < {k})),
best{turn} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n * rss / pow(greatest(n - edf, 1e-6), 2), j) AS pick
    FROM (SELECT *, {edf} AS edf, yy - 2 * ({dots}) + {squares} AS rss FROM steps{turn} WHERE p = {k})) WHERE pick = 1)""")
    band = " + ".join(f"b{i} * b{j} * m[{i + 1}][{2 * k + 2 + j}]" for i in range(k) for j in range(k))
    return f"""
WITH RECURSIVE {DAILY},
source AS ({source}),
sums AS (SELECT {keys}, count(*)::DOUBLE AS n, sum(value * value) AS yy, [{gram}] AS g, [{", ".join(f"sum(b{i} * value)" for i in range(k))}] AS c,
                [{", ".join(f"sum(b{i})" for i in range(k))}] AS r, {penalty} AS s
         FROM (SELECT {keys}, value, {basis} FROM source) GROUP BY ALL),
models AS (SELECT *, (n + {rest("g")}) / {rest("s")} AS unit FROM sums),{",".join(views)},
curve AS (SELECT {keys}, month, edf, {" + ".join(f"b{i} * m[{i + 1}][{2 * k + 1}]" for i in range(k))} AS fit, sqrt(greatest(({band}) * rss / (n - edf), 0)) AS half
          FROM (SELECT *, {basis} FROM best4, (SELECT 1 + i * 11 / {points}::DOUBLE AS month FROM (SELECT unnest(range({points} + 1)) AS i))))
{select}"""


BAND = f"{snap_sql('month')} AS month, {snap_sql('fit', 3)} AS fit, {snap_sql('fit - 1.96 * half', 3)} AS l95, {snap_sql('fit + 1.96 * half', 3)} AS u95"


def _band_snapped(df):
    return _snapped(_snapped(df, "month"), "fit", "l95", "u95", digits=3)


def _pooled_sql(spline: Spline) -> str:
    return _season_sql("one", "SELECT 1 AS one, month, value FROM daily", spline,
                       f"SELECT site, {BAND} FROM curve, (SELECT DISTINCT location AS site FROM daily)", "50")


def _pooled(spark, d, family, spline):
    model = se.SeasonModel(ln.collect_months(_cells(spark, d)), "pooled", family, spline)
    out = se.predict(model, _grid(spark, d).withColumnRenamed("site", "_site").withColumn("site", F.lit("all")))
    return _band_snapped(out.select(F.col("_site").alias("site"), "month", "fit", "l95", "u95"))


@query("seasonal_gaussian", _pooled_sql(MONTH_SPLINE))
def seasonal_gaussian(spark, d):
    return _pooled(spark, d, "gaussian", MONTH_SPLINE)


GAMMA_BAND = f"{snap_sql('month')} AS month, {snap_sql('fit', 3)} AS fit, {snap_sql('l95', 3)} AS l95, {snap_sql('u95', 3)} AS u95"


@query("seasonal_gamma", f"""WITH RECURSIVE {DAILY},{gamma_views("one", "SELECT 1 AS one, month, value FROM daily", MONTH_SPLINE)},{gamma_curve("one", MONTH_SPLINE, "pearson / (n - edf)")}
SELECT site, {GAMMA_BAND} FROM curve, (SELECT DISTINCT location AS site FROM daily)""")
def seasonal_gamma(spark, d):
    return _pooled(spark, d, "gamma", MONTH_SPLINE)


@query("seasonal_open", _pooled_sql(OPEN_SPLINE))
def seasonal_open(spark, d):
    return _pooled(spark, d, "gaussian", OPEN_SPLINE)


@query("thin_plate_gram", with_views(_gram_sql("location", MONTH_PLATE, "month", "value", "daily"), DAILY))
def thin_plate_gram(spark, d):
    t = daily(spark, d)
    return _long_gram(sm.gram(t, ["location"], thin_plate_of(t, "month"), "month", "value"), ["location"])


@query("seasonal_thin_plate", _pooled_sql(MONTH_PLATE))
def seasonal_thin_plate(spark, d):
    return _pooled(spark, d, "gaussian", thin_plate_of(daily(spark, d), "month"))


@query("seasonal_thin_plate_by_site", f"""WITH RECURSIVE {DAILY},{gamma_views("site", "SELECT location AS site, month, value FROM daily", MONTH_PLATE)},
common AS (SELECT sum(pearson) / sum(n - edf) AS phi FROM gm),{gamma_curve("site", MONTH_PLATE, "(SELECT phi FROM common)")}
SELECT site, {GAMMA_BAND} FROM curve""")
def seasonal_thin_plate_by_site(spark, d):
    curves = sb.fit_site_curves(_cells(spark, d), "gamma", thin_plate_of(daily(spark, d), "month"))
    return _band_snapped(sb.predict_sites(curves, _grid(spark, d)))


@query("seasonal_by_site", f"""WITH RECURSIVE {DAILY},{gamma_views("one", "SELECT 1 AS one, month, value FROM daily", MONTH_SPLINE)},
{shared_views("SELECT location AS site, month, value FROM daily", MONTH_SPLINE)},{gamma_views("site", "SELECT location AS site, month, value FROM daily", MONTH_SPLINE, "own")},
models AS (SELECT 1 AS rank, 'pooled' AS model, n - edf AS df_residual, deviance FROM gm UNION ALL SELECT 2, 'site', n - edf, deviance FROM sh
           UNION ALL SELECT 3, 'by_site', sum(n - edf), sum(deviance) FROM own),
steps AS (SELECT *, lag(df_residual) OVER o - df_residual AS df, lag(deviance) OVER o - deviance AS fall, (SELECT sum(pearson) / sum(n - edf) FROM own) AS phi, (SELECT sum(n - edf) FROM own) AS last
          FROM models WINDOW o AS (ORDER BY rank))
SELECT model, {snap_sql('df_residual', 3)} AS df_residual, {snap_sql('deviance', 3)} AS deviance, {snap_sql('df', 3)} AS df, {snap_sql('fall', 3)} AS deviance_drop,
       {snap_sql('f', 3)} AS f_value, {snap_sql(f_tail('f', 'df', 'last'), 5)} AS p_value FROM (SELECT *, fall / df / phi AS f FROM steps)""")
def seasonal_by_site(spark, d):
    """The three nested seasonal models and their analysis of deviance, from one pass over the rows."""
    cells = _cells(spark, d)
    out = ln.compare_nested(spark, {
        "pooled": se.SeasonModel(ln.collect_months(cells), "pooled", "gamma", MONTH_SPLINE).fit,
        "site": sb.fit_shared_curve(cells, "gamma", MONTH_SPLINE),
        "by_site": sb.fit_site_curves(cells, "gamma", MONTH_SPLINE).summary,
    })
    return _snapped(_snapped(out, "df_residual", "deviance", "df", "deviance_drop", "f_value", digits=3), "p_value", digits=5)


@query("seasonal_predict", f"""WITH RECURSIVE {DAILY},{gamma_views("site", "SELECT location AS site, month, value FROM daily", MONTH_SPLINE)},
common AS (SELECT sum(pearson) / sum(n - edf) AS phi FROM gm),{gamma_curve("site", MONTH_SPLINE, "(SELECT phi FROM common)")}
SELECT site, {GAMMA_BAND} FROM curve""")
def seasonal_predict(spark, d):
    return _band_snapped(sb.predict_sites(sb.fit_site_curves(_cells(spark, d), "gamma", MONTH_SPLINE), _grid(spark, d)))


@query("smooth_per_facet", _season_sql("site", "SELECT concat_ws(' ', location, position) AS site, month, value FROM daily", MONTH_SPLINE,
                                       f"SELECT site, {snap_sql('edf', 3)} AS edf, {BAND} FROM curve", "50"))
def smooth_per_facet(spark, d):
    t = daily(spark, d).withColumn("facet", F.concat_ws(" ", "location", "position"))
    cells = ln.month_cells(t, "facet", "month", "value")
    return _snapped(_band_snapped(se.facet_curves(cells, ["site"], MONTH_SPLINE, "gaussian")), "edf", digits=3)


@query("smooth_per_facet_open", f"""WITH RECURSIVE {DAILY},{gamma_views("site", "SELECT concat_ws(' ', location, position) AS site, month, value FROM daily", OPEN_SPLINE)},{gamma_curve("site", OPEN_SPLINE, "pearson / (n - edf)")}
SELECT site, {snap_sql('edf', 3)} AS edf, {GAMMA_BAND} FROM curve""")
def smooth_per_facet_open(spark, d):
    """The same with the Gamma family and the open basis."""
    t = daily(spark, d).withColumn("facet", F.concat_ws(" ", "location", "position"))
    out = se.facet_curves(ln.month_cells(t, "facet", "month", "value"), ["site"], OPEN_SPLINE, "gamma")
    return _snapped(_band_snapped(out), "edf", digits=3)


@query("smooth_terms")
def smooth_terms(spark, d):
    values = {"scaled": "value", "raw": "raw"}
    tables = [sb.smooth_table(sb.fit_site_curves(_cells(spark, d, c), "gaussian", MONTH_SPLINE), name) for name, c in values.items()]
    return tables[0].unionByName(tables[1])


@query("smooth_terms_reference")
def smooth_terms_reference(spark, d):
    """The smooths of the values and of values without a season, tested with fractional rank."""
    t = daily(spark, d).withColumn("flat", F.col("raw") / 1000)
    tables = []
    for name, column in (("scaled", "value"), ("flat", "flat")):
        cells = materialize(ln.month_cells(t, "location", "month", column), "month-cells")
        tables.append(sb.smooth_reference_table(sb.fit_site_curves(cells, "gaussian", MONTH_SPLINE), name))
    return tables[0].unionByName(tables[1])


# --- linear models -----------------------------------------------------------

# Per-site regression on h = month - 6; the treatment-coded model is a rewriting of it.
COEF = """coef AS (
  SELECT 'intercept' AS term, a AS estimate, sqrt(va) AS se FROM base
  UNION ALL SELECT 'month', b, sqrt(vb) FROM base
  UNION ALL SELECT 'site[' || s.location || ']', s.a - z.a, sqrt(s.va + z.va) FROM site s, base z WHERE s.location <> z.location
  UNION ALL SELECT 'month:site[' || s.location || ']', s.b - z.b, sqrt(s.vb + z.vb) FROM site s, base z WHERE s.location <> z.location)"""
PER_SITE = """per AS (
  SELECT location, count(*) AS n, regr_intercept(value, month - 6) AS a, regr_slope(value, month - 6) AS b,
         regr_sxx(value, month - 6) AS sxx, regr_sxy(value, month - 6) AS sxy, regr_syy(value, month - 6) AS syy,
         avg(month - 6) AS hbar
  FROM daily GROUP BY location),
err AS (SELECT sum(syy - sxy * sxy / sxx) / (sum(n) - 2 * count(*)) AS s2, sum(n) - 2 * count(*) AS df,
               sum(syy - sxy * sxy / sxx) AS sse FROM per),
site AS (SELECT location, a, b, s2 * (1.0 / n + hbar * hbar / sxx) AS va, s2 / sxx AS vb FROM per, err),
base AS (SELECT * FROM site WHERE location = (SELECT min(location) FROM site)),
""" + COEF


NORMAL_P = normal_p("z")
STUDENT_P = student_p("t", "df")


def _full_model(spark, d, form="slope*site", family="gaussian"):
    return sb.fit_site_lines(_cells(spark, d), form, family)


@query(
    "glm_gaussian_site",
    with_views(f"SELECT term, {snap_sql('estimate')} AS estimate, {snap_sql('se')} AS se FROM coef", DAILY, PER_SITE),
)
def glm_gaussian_site(spark, d):
    fit = _full_model(spark, d)
    return _snapped(sb.coefficient_table(fit).select("term", "estimate", "se"), "estimate", "se")


@query(
    "glm_gamma_site",
    with_views(
        f"""SELECT term, {snap_sql('estimate')} AS estimate, {snap_sql('se', 5)} AS se FROM (
              SELECT CASE WHEN g.location = z.location THEN 'intercept' ELSE 'site[' || g.location || ']' END AS term,
                     CASE WHEN g.location = z.location THEN ln(g.mu) ELSE ln(g.mu / z.mu) END AS estimate,
                     sqrt(phi * (1.0 / g.n + CASE WHEN g.location = z.location THEN 0 ELSE 1.0 / z.n END)) AS se
              FROM mu g, (SELECT * FROM mu ORDER BY location LIMIT 1) z, disp)""",
        DAILY,
        "mu AS (SELECT location, avg(value) AS mu, count(*) AS n FROM daily GROUP BY location)",
        """disp AS (SELECT sum((value - mu) * (value - mu) / (mu * mu)) / (count(*) - count(DISTINCT mu.location)) AS phi
                    FROM daily JOIN mu ON mu.location = daily.location)"""),
)
def glm_gamma_site(spark, d):
    fit = _full_model(spark, d, "site", "gamma")
    out = sb.coefficient_table(fit).select("term", "estimate", "se")
    return _snapped(_snapped(out, "estimate"), "se", digits=5)


# With site-wise slopes a Gamma model falls apart into one two-parameter fit per site; each
# iteration is a weighted straight line through the working response of the month cells.
GAMMA_LINES = f"""WITH RECURSIVE {DAILY},
cells AS (SELECT location, (month - 6)::DOUBLE AS h, count(*)::DOUBLE AS n, sum(value) AS s1, sum(value * value) AS s2 FROM daily GROUP BY ALL),
steps(step, location, b0, b1) AS (
  SELECT 0, location, ln(sum(s1) / sum(n)), 0.0::DOUBLE FROM cells GROUP BY location
  UNION ALL
  SELECT step + 1, location, (sz - b * sh) / sn, b FROM (
    SELECT step, location, sum(n) AS sn, sum(n * h) AS sh, sum(n * z) AS sz,
           (sum(n * h * z) - sum(n * h) * sum(n * z) / sum(n)) / (sum(n * h * h) - sum(n * h) * sum(n * h) / sum(n)) AS b
    FROM (SELECT s.step, c.location, n, h, b0 + b1 * h + (s1 / n - exp(b0 + b1 * h)) / exp(b0 + b1 * h) AS z
          FROM cells c JOIN steps s ON s.location = c.location WHERE s.step < 30)
    GROUP BY step, location)),
lines AS (SELECT location, b0 AS a, b1 AS b FROM steps WHERE step = 30),
disp AS (SELECT sum((s2 - 2 * s1 * exp(a + b * h) + n * exp(2 * (a + b * h))) / exp(2 * (a + b * h))) / (sum(n) - 2 * count(DISTINCT c.location)) AS phi
         FROM cells c JOIN lines l ON l.location = c.location),
site AS (SELECT l.location, a, b, phi * shh / (sn * shh - sh * sh) AS va, phi * sn / (sn * shh - sh * sh) AS vb FROM lines l, disp,
         (SELECT location, sum(n) AS sn, sum(n * h) AS sh, sum(n * h * h) AS shh FROM cells GROUP BY location) m WHERE m.location = l.location),
base AS (SELECT * FROM site WHERE location = (SELECT min(location) FROM site)),
"""


@query(
    "glm_gamma_slope_site",
    GAMMA_LINES + COEF + f" SELECT term, {snap_sql('estimate', 5)} AS estimate, {snap_sql('se', 5)} AS se FROM coef",
)
def glm_gamma_slope_site(spark, d):
    fit = _full_model(spark, d, "slope*site", "gamma")
    return _snapped(sb.coefficient_table(fit).select("term", "estimate", "se"), "estimate", "se", digits=5)


def _line_bands(spark, d, family):
    fit = sb.fit_site_lines(_cells(spark, d), "slope*site", family)
    return _snapped(sb.line_bands(fit, 1, 12, 12), "fit", "l95", "u95", digits=3).withColumn("month", F.col("month").cast("int"))


BAND_MONTHS = "(SELECT unnest(range(1, 13))::INTEGER AS month)"


@query(
    "line_per_facet",
    with_views(
        f"""SELECT location AS site, month, {snap_sql('e', 3)} AS fit, {snap_sql('e - 1.96 * s', 3)} AS l95, {snap_sql('e + 1.96 * s', 3)} AS u95 FROM (
              SELECT location, month, a + b * (month - 6) AS e,
                     sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1.0 / n + pow(month - 6 - hbar, 2) / sxx)) AS s FROM per, {BAND_MONTHS})""",
        DAILY, PER_SITE),
)
def line_per_facet(spark, d):
    return _line_bands(spark, d, "gaussian")


@query(
    "line_per_facet_gamma",
    GAMMA_LINES + COEF + f""",
own AS (SELECT l.location, any_value(a) AS a, any_value(b) AS b, sum(n) AS sn, sum(n * h) AS sh, sum(n * h * h) AS shh,
               sum((s2 - 2 * s1 * exp(a + b * h) + n * exp(2 * (a + b * h))) / exp(2 * (a + b * h))) / (sum(n) - 2) AS phi
        FROM cells c JOIN lines l ON l.location = c.location GROUP BY l.location)
SELECT location AS site, month, {snap_sql('exp(e)', 3)} AS fit, {snap_sql('exp(e - 1.96 * s)', 3)} AS l95, {snap_sql('exp(e + 1.96 * s)', 3)} AS u95 FROM (
  SELECT location, month, a + b * (month - 6) AS e,
         sqrt(phi * (shh - 2 * (month - 6) * sh + (month - 6) * (month - 6) * sn) / (sn * shh - sh * sh)) AS s FROM own, {BAND_MONTHS})""",
)
def line_per_facet_gamma(spark, d):
    return _line_bands(spark, d, "gamma")


@query(
    "glm_coef_table",
    with_views(
        f"""SELECT term, {snap_sql('estimate')} AS estimate, {snap_sql('se')} AS se, {snap_sql('t')} AS statistic,
                   {snap_sql(STUDENT_P, 6)} AS p_value
            FROM (SELECT *, estimate / se AS t, df::DOUBLE AS df FROM coef, err)""", DAILY, PER_SITE),
)
def glm_coef_table(spark, d):
    fit = _full_model(spark, d)
    out = _snapped(sb.coefficient_table(fit), "estimate", "se", "statistic")
    return _snapped(out, "p_value", digits=6)


@query(
    "site_intercept_slope",
    with_views(
        f"SELECT location AS site, {snap_sql('a')} AS intercept, {snap_sql('b')} AS slope FROM site", DAILY, PER_SITE),
)
def site_intercept_slope(spark, d):
    fit = _full_model(spark, d)
    return _snapped(sb.site_lines(fit), "intercept", "slope")


# The planned comparisons, by term name.
PLANNED = [
    ("slope 2 - 1", "month:site[2-HIGH]", 1.0),
    ("slope 2 - 3", "month:site[2-HIGH]", 1.0),
    ("slope 2 - 3", "month:site[3-MEDIUM]", -1.0),
    ("level 5 - 4", "site[5-LOW]", 1.0),
    ("level 5 - 4", "site[4-NOT SPECIFIED]", -1.0),
]


@query(
    "contrasts_given",
    with_views(
        f"""SELECT contrast, {snap_sql('estimate')} AS estimate, {snap_sql('se')} AS se, {snap_sql('z')} AS z,
                   {snap_sql(NORMAL_P, 6)} AS p_value FROM (
              SELECT *, estimate / se AS z FROM (
                SELECT 'slope 2 - 1' AS contrast, x.b - y.b AS estimate, sqrt(x.vb + y.vb) AS se FROM site x, site y
                  WHERE x.location = '2-HIGH' AND y.location = '1-URGENT'
                UNION ALL SELECT 'slope 2 - 3', x.b - y.b, sqrt(x.vb + y.vb) FROM site x, site y
                  WHERE x.location = '2-HIGH' AND y.location = '3-MEDIUM'
                UNION ALL SELECT 'level 5 - 4', x.a - y.a, sqrt(x.va + y.va) FROM site x, site y
                  WHERE x.location = '5-LOW' AND y.location = '4-NOT SPECIFIED'))""", DAILY, PER_SITE),
)
def contrasts_given(spark, d):
    fit = _full_model(spark, d)
    weights = dimension(spark, PLANNED, ["contrast", "term", "weight"])
    out = sb.contrasts(fit, weights)
    return _snapped(_snapped(out, "estimate", "se", "z"), "p_value", digits=6)


@query(
    "contrasts_all_pairs",
    with_views(
        f"""SELECT contrast, {snap_sql('estimate')} AS estimate, {snap_sql('z')} AS z, {snap_sql('p', 6)} AS p_value,
                   {snap_sql('max(least(1.0, (m - rn + 1) * p)) OVER (ORDER BY rn)', 6)} AS p_holm FROM (
              SELECT *, row_number() OVER (ORDER BY p, contrast) AS rn, count(*) OVER () AS m FROM (
                SELECT contrast, estimate, z, {NORMAL_P} AS p FROM (
                  SELECT x.location || ' - ' || y.location AS contrast, x.a - y.a AS estimate,
                         (x.a - y.a) / sqrt(x.va + y.va) AS z
                  FROM site x, site y WHERE x.location > y.location)))""", DAILY, PER_SITE),
)
def contrasts_all_pairs(spark, d):
    fit = _full_model(spark, d)
    out = sb.all_pairs(fit).select("contrast", "estimate", "z", "p_value", "p_holm")
    return _snapped(_snapped(out, "estimate", "z"), "p_value", "p_holm", digits=6)


def _tukey_sql(dim: int, points: int, shifts: int, seed: int) -> str:
    """The same lattice, one list per point; ``dim`` is the even number at or above the number of sites."""
    half = range(1, dim // 2 + 1)
    steps = ", ".join(f"{float(v)!r}::DOUBLE" for v in sim.lattice_steps(dim))
    shift = ", ".join(f"(('0x' || substr(md5('{seed}|' || s || '|{j}'), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296" for j in range(dim))
    radius = [f"sqrt(-2 * ln(greatest(u[{2 * j - 1}], 1e-300)))" for j in half]
    normal = [f"{r} * {f}(2 * {PI} * u[{2 * j}])" for f in ("cos", "sin") for j, r in zip(half, radius)]
    tail = " + ".join(["1", *[" * ".join(f"(q / 2 / {i})" for i in range(1, j + 1)) for j in range(1, dim // 2)]])
    return f"""
levels AS (SELECT location, a, va, row_number() OVER (ORDER BY location) AS i FROM site),
pairs AS (SELECT x.location || ' - ' || y.location AS contrast, x.a - y.a AS estimate, (x.a - y.a) / sqrt(x.va + y.va) AS z,
                 y.i AS low, x.i AS high, sqrt(y.va) AS sd_low, sqrt(x.va) AS sd_high, sqrt(x.va + y.va) AS spread FROM levels x JOIN levels y ON x.i > y.i),
lattice AS (SELECT s, i, list_transform(list_zip([{steps}], [{shift}]), lambda t: (i * t[1] + t[2]) - floor(i * t[1] + t[2])) AS u
            FROM (SELECT unnest(range({shifts})) AS s), (SELECT unnest(range({points})) AS i)),
normals AS (SELECT s, i, [{", ".join(normal)}] AS x FROM lattice),
most AS (SELECT s, i, max(abs(x[high] * sd_high - x[low] * sd_low) / spread) / sqrt(any_value(list_dot_product(x, x))) AS m FROM normals, pairs GROUP BY s, i),
chances AS (SELECT contrast, s, avg(exp(-q / 2) * ({tail})) AS p FROM (SELECT contrast, s, pow(z / m, 2) AS q FROM most, pairs) GROUP BY ALL)
SELECT contrast, {snap_sql('any_value(estimate)')} AS estimate, {snap_sql('any_value(z)')} AS z, {snap_sql('avg(p)', 6)} AS p_value, stddev_samp(p) / sqrt({shifts}) < 1e-4 AS close
FROM chances JOIN pairs USING (contrast) GROUP BY contrast"""


@query("contrasts_tukey", "WITH " + ",\n".join([DAILY, PER_SITE]) + "," + _tukey_sql(6, sim.POINTS, sim.SHIFTS, 7))
def contrasts_tukey(spark, d):
    """Single-step p values of all pairs of site levels; ``close``: their standard error is below 1e-4."""
    out = sim.tukey_pairs(_full_model(spark, d)).select("contrast", "estimate", "z", "p_value", (F.col("p_error") < 1e-4).alias("close"))
    return _snapped(_snapped(out, "estimate", "z"), "p_value", digits=6)


@query(
    "wald_pairs",
    with_views(
        f"""SELECT compare, {snap_sql('z')} AS z, {snap_sql(NORMAL_P, 6)} AS p_value FROM (
              SELECT location || ' - ' || lead(location) OVER o AS compare,
                     (a - lead(a) OVER o) / sqrt(va + lead(va) OVER o) AS z
              FROM site WINDOW o AS (ORDER BY a DESC, location)) WHERE z IS NOT NULL""", DAILY, PER_SITE),
)
def wald_pairs(spark, d):
    fit = _full_model(spark, d)
    return _snapped(_snapped(sb.neighbour_z(fit), "z"), "p_value", digits=6)


@query(
    "nested_f_test",
    # Four and eight sites' worth of extra terms: with df = 4 the tail has a closed form.
    with_views(
        f"""SELECT model, df_residual, {snap_sql('deviance', 2)} AS deviance, df, {snap_sql('drop_', 2)} AS deviance_drop,
                   {snap_sql('f')} AS f_value, {snap_sql('pow(x, d / 2) * (1 + d / 2 * (1 - x))', 6)} AS p_value FROM (
              SELECT *, d / (d + df * f) AS x FROM (
                SELECT model, df_residual, deviance, df, drop_, drop_ / df / s2 AS f, d FROM (
                  SELECT model, df_residual, deviance, lag(df_residual) OVER o - df_residual AS df,
                         lag(deviance) OVER o - deviance AS drop_, s2, err.df::DOUBLE AS d
                  FROM models, err WINDOW o AS (ORDER BY rank))))""",
        DAILY, PER_SITE,
        """models AS (
             SELECT 1 AS rank, 'slope' AS model, (count(*) - 2)::DOUBLE AS df_residual,
                    regr_syy(value, month - 6) - pow(regr_sxy(value, month - 6), 2) / regr_sxx(value, month - 6) AS deviance FROM daily
             UNION ALL SELECT 2, 'slope+site', (sum(n) - count(*) - 1)::DOUBLE, sum(syy) - pow(sum(sxy), 2) / sum(sxx) FROM per
             UNION ALL SELECT 3, 'slope*site', df::DOUBLE, sse FROM err)"""),
)
def nested_f_test(spark, d):
    cells = _cells(spark, d)
    own = sb.fit_site_lines(cells)
    out = ln.compare_nested(spark, {
        "slope": ln.linear_model(ln.collect_months(cells), "slope"), "slope+site": own.shared_slope, "slope*site": own.summary})
    out = _snapped(_snapped(out, "deviance", "deviance_drop", digits=2), "f_value")
    # Unpenalised models have whole degrees of freedom.
    return _snapped(out.withColumn("df", F.round("df")).withColumn("df_residual", F.round("df_residual")), "p_value", digits=6)
