"""Queries: light-response fits and posterior-draw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.texts import drawn_index, extract
from ..functions.values import snap, snap_sql
from ..operators import draws as dr
from ..operators import lightcurve as lc
from ..operators import sampler as sp
from .registry import query
from .tails import student_p
from .tables import DRAWS, LINES, SITES_SQL, draws, lines, sites, table, with_views


def _snapped(df, *columns, digits=4):
    for c in columns:
        df = df.withColumn(c, snap(c, digits))
    return df


def _curve_views(keys: str, prefix: str, rows: str, inhibition: bool = False) -> list[str]:
    """The same candidate search written as SQL views ``<prefix>_1 .. <prefix>_best``."""
    offsets = ", ".join(f"({u!r}::DOUBLE, {v!r}::DOUBLE)" for u, v in lc.candidate_offsets(inhibition))
    levels = lc.LEVELS_TWO if inhibition else lc.LEVELS_ONE
    finer = lc.STEPS_TWO if inhibition else lc.STEPS_ONE
    damp = " * exp(-b * x)" if inhibition else ""
    views = [
        f"""{prefix}_cells AS (SELECT {keys}, x, count(*)::DOUBLE AS w, sum(y) AS s1, sum(y * y) AS s2 FROM ({rows}) GROUP BY ALL)""",
        f"""{prefix}_0 AS (SELECT {keys}, {lc.CENTRE_A!r}::DOUBLE / max(abs(x)) AS a, {lc.CENTRE_B!r}::DOUBLE / max(abs(x)) AS b FROM {prefix}_cells GROUP BY ALL)""",
    ]
    for level in range(1, levels + 1):
        wa, wb = (w / finer ** (level - 1) for w in (lc.WIDTH_A, lc.WIDTH_B))
        name = f"{prefix}_best" if level == levels else f"{prefix}_{level}"
        views.append(f"""{name} AS (
          SELECT {keys}, a, b, pmax, rd, sse, n FROM (
            SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY rel, a, b) AS rn FROM (
              SELECT {keys}, a, b, w AS n, cgy / vg AS pmax, (cgy / vg * g - s1) / w AS rd, greatest(vy - cgy * cgy / vg, 0) AS sse,
                     floor((vy - cgy * cgy / vg) / greatest(vy, 1e-12) * {lc.TIE_GRID!r}) AS rel
              FROM (SELECT *, gg - g * g / w AS vg, gy - g * s1 / w AS cgy, s2 - s1 * s1 / w AS vy FROM (
                SELECT {keys}, a, b, sum(w) AS w, sum(s1) AS s1, sum(s2) AS s2, sum(w * e) AS g, sum(w * e * e) AS gg, sum(e * s1) AS gy
                FROM (SELECT *, (1 - exp(-a * x)){damp} AS e FROM (
                  SELECT c.*, p.a * pow(10, {wa!r} * u) AS a, p.b * pow(10, {wb!r} * v) AS b
                  FROM {prefix}_cells c JOIN {prefix}_{level - 1} p USING ({keys}), (VALUES {offsets}) o(u, v)))
                GROUP BY {keys}, a, b))
              WHERE vg > 1e-9 * w)) WHERE rn = 1)""")
    return views


def _status_sql(cells: str, same: str, inhibition: bool = False) -> str:
    """Whether the best ratios lie inside the searched range of the group ``f``."""
    top = f"(SELECT max(abs(x)) FROM {cells} c WHERE {same})"
    ends = [f"abs(log10(f.a * {top} / {lc.CENTRE_A!r})) > {lc.WIDTH_A - 1e-6!r}"]
    if inhibition:
        ends.append(f"abs(log10(f.b * {top} / {lc.CENTRE_B!r})) > {lc.WIDTH_B - 1e-6!r}")
    return f"CASE WHEN {' OR '.join(ends)} THEN 'boundary' ELSE 'ok' END"


SITE_CURVES = _curve_views("location", "site", "SELECT location, x, y FROM lines")
ALL_CURVES = _curve_views("one", "all", "SELECT 1 AS one, x, y FROM lines")
DAY_CURVES = _curve_views("location, day", "day", "SELECT location, day, x, y FROM lines")
DAMPED_CURVES = _curve_views("location", "damp", "SELECT location, x, y * exp(-0.004 * x) AS y FROM lines", inhibition=True)


@query(
    "nls_pooled",
    with_views(
        f"SELECT n::BIGINT AS n, {snap_sql('pmax')} AS pmax, {snap_sql('a * pmax')} AS alpha, {snap_sql('rd')} AS rd, {snap_sql('sse', 2)} AS sse, {_status_sql('all_cells', 'TRUE')} AS status FROM all_best f",
        LINES, *ALL_CURVES),
)
def nls_pooled(spark, d):
    fit = lc.fit_curves(lines(spark, d), [], "x", "y")
    return _snapped(_snapped(fit, "pmax", "alpha", "rd"), "sse", digits=2)


@query(
    "nls_by_site_f",
    # With three sites the extra df is 6, so the F tail is a finite sum.
    with_views(
        f"""SELECT {snap_sql('s0', 2)} AS sse_pooled, {snap_sql('s1', 2)} AS sse_full, df, dr AS df_residual, {snap_sql('f', 3)} AS f_value,
                   {snap_sql('pow(v, dr / 2) * (1 + dr / 2 * (1 - v) + dr / 2 * (dr / 2 + 1) / 2 * (1 - v) * (1 - v))', 6)} AS p_value FROM (
              SELECT *, dr / (dr + df * f) AS v FROM (SELECT *, (s0 - s1) / df / (s1 / dr) AS f FROM (
                SELECT (SELECT sse FROM all_best) AS s0, sum(sse) AS s1, ((count(*) - 1) * 3)::DOUBLE AS df, sum(n) - count(*) * 3 AS dr FROM site_best)))""",
        LINES, *ALL_CURVES, *SITE_CURVES),
)
def nls_by_site_f(spark, d):
    t = lines(spark, d)
    out = lc.compare_pooled(lc.fit_curves(t, [], "x", "y"), lc.fit_curves(t, ["location"], "x", "y"))
    return _snapped(_snapped(_snapped(out, "sse_pooled", "sse_full", digits=2), "f_value", digits=3), "p_value", digits=6)


@query(
    "nls_grid_predict",
    with_views(
        f"""SELECT location, {snap_sql('i * 30 / 100.0::DOUBLE')} AS light, {snap_sql('pmax * (1 - exp(-a * i * 30 / 100)) - rd', 3)} AS fit
            FROM site_best, (SELECT unnest(range(101))::INTEGER AS i)""", LINES, *SITE_CURVES),
)
def nls_grid_predict(spark, d):
    fits = lc.fit_curves(lines(spark, d), ["location"], "x", "y")
    out = lc.predict_grid(fits, ["location"], "light", 0, 30, 101)
    return out.select("location", snap("light").alias("light"), snap("fit", 3).alias("fit"))


@query(
    "nls_by_day_safe",
    with_views(
        f"""SELECT location, day, count(*) AS n,
                   CASE WHEN count(*) >= 4 AND count(DISTINCT x) >= 3 THEN {snap_sql('any_value(f.sse)', 2)} END AS sse
            FROM lines LEFT JOIN day_best f USING (location, day) GROUP BY location, day""", LINES, *DAY_CURVES),
)
def nls_by_day_safe(spark, d):
    # Compared by the error sum: on a handful of rows different parameters can fit equally well.
    fits = lc.fit_curves(lines(spark, d), ["location", "day"], "x", "y")
    return fits.select("location", "day", "n", snap("sse", 2).alias("sse"))


@query(
    "nls_inhibited",
    with_views(
        f"""SELECT location, n::BIGINT AS n, {snap_sql('pmax', 3)} AS pmax, {snap_sql('a * pmax', 3)} AS alpha,
                   {snap_sql('b * pmax', 3)} AS beta, {snap_sql('rd', 3)} AS rd, {snap_sql('sse', 2)} AS sse, {_status_sql('damp_cells', 'c.location = f.location', True)} AS status
            FROM damp_best f""",
        LINES, *DAMPED_CURVES),
)
def nls_inhibited(spark, d):
    t = lines(spark, d).withColumn("y", F.col("y") * F.exp(-0.004 * F.col("x")))
    fits = lc.fit_curves(t, ["location"], "x", "y", inhibition=True)
    return _snapped(_snapped(fits, "pmax", "alpha", "beta", "rd", digits=3), "sse", digits=2)


def _polish_views(keys: str, prefix: str) -> list[str]:
    """Gauss-Newton steps from ``<prefix>_best`` as SQL views; the 3 x 3 systems are solved by Cramer's rule."""
    grads = ["1 - exp(-alpha / pmax * x) * (1 + alpha / pmax * x)", "x * exp(-alpha / pmax * x)", "-1.0"]
    rest = "(s1 - w * (pmax * (1 - exp(-alpha / pmax * x)) - rd))"
    sums = [f"sum(w * ({grads[i]}) * ({grads[j]})) AS h{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum(({g}) * {rest}) AS g{i}" for i, g in enumerate(grads)]
    det = lambda m: " + ".join(
        f"{s} * {m[0][a]} * {m[1][b]} * {m[2][c]}" for s, a, b, c in ((1, 0, 1, 2), (1, 1, 2, 0), (1, 2, 0, 1), (-1, 2, 1, 0), (-1, 1, 0, 2), (-1, 0, 2, 1)))
    h = [[f"h{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    swap = lambda k: [[f"g{i}" if j == k else h[i][j] for j in range(3)] for i in range(3)]
    views = [f"{prefix}_p0 AS (SELECT {keys}, pmax, a * pmax AS alpha, rd FROM {prefix}_best)"]
    for step in range(lc.POLISH_STEPS + 1):
        views.append(f"""{prefix}_s{step} AS MATERIALIZED (SELECT {keys}, sum(w) AS n, any_value(pmax) AS pmax, any_value(alpha) AS alpha, any_value(rd) AS rd,
          sum(greatest(s2 - s1 * s1 / w, 0) + {rest} * {rest} / w) AS sse, {", ".join(sums)}
          FROM {prefix}_cells JOIN {prefix}_p{step} USING ({keys}) GROUP BY {keys})""")
        views.append(f"{prefix}_p{step + 1} AS (SELECT {keys}, " + ", ".join(
            f"{c} + ({det(swap(k))}) / ({det(h)}) AS {c}" for k, c in enumerate(("pmax", "alpha", "rd"))) + f" FROM {prefix}_s{step})")
    unit = lambda k: [["1" if i == j == k else "0" if j == k or i == k else h[i][j] for j in range(3)] for i in range(3)]
    views.append(f"{prefix}_opt AS (SELECT *, " + ", ".join(f"({det(unit(k))}) / ({det(h)}) AS v{k}" for k in range(3))
                 + ", greatest(" + ", ".join(f"abs(g{k}) / sqrt(h{k}{k} * sse)" for k in range(3)) + f") AS gradient FROM {prefix}_s{lc.POLISH_STEPS})")
    return views


@query(
    "nls_optimum",
    with_views(
        f"""SELECT location, n::BIGINT AS n, {snap_sql('pmax', 6)} AS pmax, {snap_sql('alpha', 6)} AS alpha, {snap_sql('rd', 6)} AS rd, {snap_sql('sse')} AS sse,
                   {snap_sql('sqrt(v0 * sse / (n - 3))', 6)} AS se_pmax, {snap_sql('sqrt(v1 * sse / (n - 3))', 6)} AS se_alpha, {snap_sql('sqrt(v2 * sse / (n - 3))', 6)} AS se_rd,
                   gradient < 1e-8 AS at_optimum FROM site_opt""", LINES, *SITE_CURVES, *_polish_views("location", "site")),
)
def nls_optimum(spark, d):
    """Each site's curve with standard errors by its own scale; ``at_optimum``: no gradient is left."""
    fits = lc.polish_curves(lines(spark, d), ["location"], "x", "y")
    scale = F.col("sse") / (F.col("n") - 3)
    out = fits.select("location", "n", "pmax", "alpha", "rd", "sse", *[F.sqrt(F.col(f"v{i}{i}") * scale).alias(f"se_{c}") for i, c in enumerate(("pmax", "alpha", "rd"))],
                      (F.col("gradient") < 1e-8).alias("at_optimum"))
    return _snapped(_snapped(out, "pmax", "alpha", "rd", "se_pmax", "se_alpha", "se_rd", digits=6), "sse")


@query(
    "nls_coef_table",
    with_views(
        f"""SELECT term, {snap_sql('estimate', 6)} AS estimate, {snap_sql('se', 6)} AS se, {snap_sql('t', 3)} AS statistic, {snap_sql(student_p('t', 'df'), 6)} AS p_value FROM (
              SELECT *, estimate / se AS t FROM (
                SELECT CASE WHEN o.location = b.location THEN o.name ELSE 'd' || o.name || '[' || o.location || ']' END AS term, df,
                       CASE WHEN o.location = b.location THEN o.e ELSE o.e - b.e END AS estimate,
                       sqrt(total / df * (o.v + CASE WHEN o.location = b.location THEN 0 ELSE b.v END)) AS se
                FROM long o JOIN long b ON b.name = o.name AND b.location = (SELECT min(location) FROM long), (SELECT sum(sse) AS total, sum(n) - 3 * count(*) AS df FROM site_opt)))""",
        LINES, *SITE_CURVES, *_polish_views("location", "site"),
        """long AS (SELECT location, 'pmax' AS name, pmax AS e, v0 AS v FROM site_opt UNION ALL SELECT location, 'alpha', alpha, v1 FROM site_opt
                    UNION ALL SELECT location, 'rd', rd, v2 FROM site_opt)"""),
)
def nls_coef_table(spark, d):
    """The coefficient table of the model with one curve per site."""
    table = lc.curve_coefficients(lc.polish_curves(lines(spark, d), ["location"], "x", "y"), "location")
    return _snapped(_snapped(table, "estimate", "se", "p_value", digits=6), "statistic", digits=3)


@query("robust_pooled_curve")
def robust_pooled_curve(spark, d):
    t = lines(spark, d).select("l_orderkey", "l_linenumber", "location", "x", "y")
    return lc.robust_curves(t, ["location"], "x", "y", ["l_orderkey", "l_linenumber"])


@query("posterior_curves")
def posterior_curves(spark, d):
    """Posterior mean, 80 % interval and split R-hat of every parameter of the partly pooled site curves."""
    found, groups = sp.sample_curves(lines(spark, d), ["location"], "x", "y", warmup=20, draws=160)
    named = found.join(F.broadcast(groups), "k", "left").withColumn("name", F.concat_ws("|", "param", "location"))
    table = dr.mean_and_interval(named, ["name"], "value").join(dr.split_rhat(named, "name", "chain", "iter", "value"), "name")
    part = F.split("name", "[|]")
    return table.select(F.get(part, F.lit(0)).alias("param"), F.get(part, F.lit(1)).alias("location"), "estimate", "hdi_low", "hdi_high", "rhat")


# --- posterior draws ---------------------------------------------------------


@query(
    "curve_draws",
    with_views(
        f"""SELECT event_id, k, m, {snap_sql('light')} AS light, {snap_sql('yhat')} AS yhat,
                   {snap_sql('yhat + sigma * (2 * u - 1) / sqrt(2 * u * (1 - u))', 3)} AS ypred FROM (
              SELECT *, pmax * (1 - exp(-alpha / pmax * light)) - rd AS yhat,
                     (('0x' || substr(md5('7|' || event_id || '|' || k || '|' || m), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296 AS u
              FROM (SELECT *, i * 3.0::DOUBLE AS light, i + 1 AS m FROM params, (SELECT unnest(range(11))::INTEGER AS i)))""",
        """params AS (SELECT event_id, user_id % 5 + 1 AS k, 10 + value / 50 AS pmax, 0.5 + (user_id % 7) / 10.0::DOUBLE AS alpha,
                       1 + (event_id % 10) / 10.0::DOUBLE AS rd, 0.5 + (event_id % 3) / 10.0::DOUBLE AS sigma FROM events)"""),
)
def curve_draws(spark, d):
    params = table(spark, d, "events").select(
        "event_id", (F.col("user_id") % 5 + 1).alias("k"), (10 + F.col("value") / 50).alias("pmax"),
        (0.5 + (F.col("user_id") % 7) / 10).alias("alpha"), (1 + (F.col("event_id") % 10) / 10).alias("rd"),
        (0.5 + (F.col("event_id") % 3) / 10).alias("sigma"),
    )
    out = dr.curve_draws(params, ["event_id", "k"], F.lit(30.0), 11, seed=7)
    return _snapped(_snapped(out, "light", "yhat"), "ypred", digits=3)


# One parameter draw per nation; regions 0 to 4 are dealt to the three sites.
NATION_DRAWS = """nation_draws AS (
  SELECT CASE n_regionkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' END AS location, n_nationkey AS draw,
         18 + n_nationkey / 5.0::DOUBLE AS pmax, 1 + n_nationkey / 20.0::DOUBLE AS alpha, 2.0::DOUBLE AS rd, 1.25::DOUBLE AS sigma
  FROM nation)"""


def _nation_draws(spark, d):
    n = table(spark, d, "nation")
    site = F.element_at(F.array(*map(F.lit, "ANR")), (F.col("n_regionkey") % 3 + 1).cast("int"))
    return n.select(
        site.alias("location"), F.col("n_nationkey").alias("draw"), (18 + F.col("n_nationkey") / 5).alias("pmax"),
        (1 + F.col("n_nationkey") / 20).alias("alpha"), F.lit(2.0).alias("rd"), F.lit(1.25).alias("sigma"),
    )


@query(
    "loglik_summary",
    with_views(
        f"""SELECT l_orderkey, l_linenumber, count(*) AS n_draws, {snap_sql('ln(avg(exp(ll)))')} AS log_mean,
                   {snap_sql('avg(ll)')} AS mean_log, {snap_sql('var_samp(ll)', 3)} AS var_log FROM (
              SELECT l_orderkey, l_linenumber, -ln(2 * sqrt(2) * sigma) - 1.5 * ln(1 + pow((y - (pmax * (1 - exp(-alpha / pmax * x)) - rd)) / sigma, 2) / 2) AS ll
              FROM lines JOIN nation_draws USING (location)) GROUP BY ALL""", LINES, NATION_DRAWS),
)
def loglik_summary(spark, d):
    out = dr.loglik_summary(lines(spark, d), _nation_draws(spark, d), "location", "x", "y", ["l_orderkey", "l_linenumber"])
    return _snapped(_snapped(out, "log_mean", "mean_log"), "var_log", digits=3)


@query(
    "pointwise_loglik",
    with_views(
        f"""SELECT l_orderkey, l_linenumber, draw,
                   {snap_sql('''-ln(2 * sqrt(2) * sigma) - 1.5 * ln(1 + pow((y - (pmax * (1 - exp(-alpha / pmax * x)) - rd)) / sigma, 2) / 2)''')} AS log_lik
            FROM lines JOIN nation_draws USING (location)""", LINES, NATION_DRAWS),
)
def pointwise_loglik(spark, d):
    out = dr.pointwise_loglik(
        lines(spark, d), _nation_draws(spark, d), "location", "x", "y", ["l_orderkey", "l_linenumber"], ["draw"]
    )
    return _snapped(out, "log_lik")


def _hdi_sql(source: str, keys: str, value: str) -> str:
    return f"""SELECT {keys}, any_value(est) AS est, arg_min(low, (width, i)) AS low, arg_min(high, (width, i)) AS high FROM (
        SELECT {keys}, v AS low, i, est, lead(v, gap) OVER w AS high, lead(v, gap) OVER w - v AS width FROM (
          SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS i,
                 CAST(least(greatest(round(count(*) OVER (PARTITION BY {keys}) * 0.8), 1), count(*) OVER (PARTITION BY {keys}) - 1) AS INTEGER) AS gap,
                 avg({value}) OVER (PARTITION BY {keys}) AS est FROM {source})
        WINDOW w AS (PARTITION BY {keys} ORDER BY i)) WHERE width IS NOT NULL GROUP BY {keys}"""


@query(
    "draws_hdi",
    with_views(
        f"""SELECT param, {snap_sql('est')} AS estimate, {snap_sql('low')} AS hdi_low, {snap_sql('high')} AS hdi_high
            FROM ({_hdi_sql('draws', 'param', 'value')})""", DRAWS),
)
def draws_hdi(spark, d):
    return _snapped(dr.mean_and_interval(draws(spark, d), ["param"], "value"), "estimate", "hdi_low", "hdi_high")


@query(
    "draw_names",
    with_views(
        r"""SELECT event_id, regexp_extract(term, '^[a-z]+') AS base, k, m, s.label AS site_label FROM (
              SELECT event_id, term, CAST(regexp_extract(term, '\[(\d+),(\d+)\]', 1) AS INTEGER) AS k,
                     CAST(regexp_extract(term, '\[(\d+),(\d+)\]', 2) AS INTEGER) AS m FROM named)
            LEFT JOIN sites s ON s.idx = k WHERE regexp_matches(term, 'yhat|ypred')""",
        """named AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'yhat' WHEN 1 THEN 'ypred' ELSE 'lp' END
                      || '[' || (user_id % 7 + 1) || ',' || (event_id % 101 + 1) || ']' AS term FROM events)""", SITES_SQL),
)
def draw_names(spark, d):
    base = F.when(F.col("event_id") % 3 == 0, "yhat").when(F.col("event_id") % 3 == 1, "ypred").otherwise("lp")
    named = table(spark, d, "events").select(
        "event_id", F.format_string("%s[%d,%d]", base, F.col("user_id") % 7 + 1, F.col("event_id") % 101 + 1).alias("term")
    )
    parsed = named.filter(F.col("term").rlike("yhat|ypred")).select(
        "event_id", extract("term", "^[a-z]+").alias("base"), *drawn_index("term")
    )
    labels = sites(spark).select(F.col("idx").alias("k"), F.col("label").alias("site_label"))
    return parsed.join(labels, "k", "left").select("event_id", "base", "k", "m", "site_label")


@query(
    "draws_mean",
    with_views(
        f"""SELECT param, chain, {snap_sql('avg(value)')} AS mean FROM draws GROUP BY param, chain
            UNION ALL SELECT param, NULL, {snap_sql('avg(value)')} FROM draws GROUP BY param""", DRAWS),
)
def draws_mean(spark, d):
    return _snapped(dr.means_by_chain(draws(spark, d), "param", "chain", "value"), "mean")


@query(
    "draws_rhat",
    with_views(
        f"""SELECT param, {snap_sql('sqrt(((max(n) - 1) / max(n) * avg(v) + var_samp(m)) / avg(v))', 6)} AS rhat FROM (
              SELECT param, chain, iter >= size - size // 2 AS half, avg(value) AS m, var_samp(value) AS v, count(*)::DOUBLE AS n
              FROM (SELECT *, max(iter) OVER (PARTITION BY param, chain) + 1 AS size FROM uneven) WHERE iter < size // 2 OR iter >= size - size // 2
              GROUP BY 1, 2, 3) GROUP BY param""", DRAWS,
        """uneven AS (SELECT * FROM draws UNION ALL
             SELECT chain, iter // 3, 'third', value FROM draws WHERE param = 'pmax' AND iter % 3 = 0)"""),
)
def draws_rhat(spark, d):
    t = draws(spark, d)  # and a parameter with chains of a third of the length
    third = t.filter("param = 'pmax' AND iter % 3 = 0").select("chain", F.expr("iter div 3").alias("iter"), F.lit("third").alias("param"), "value")
    return _snapped(dr.split_rhat(t.unionByName(third), "param", "chain", "iter", "value"), "rhat", digits=6)


# The sum ends at the first negative pair of autocorrelations; 200 lags are offered here and the
# result is NULL, hence a mismatch, should a sequence be longer.
ESS_VIEWS = [
    """centred AS (SELECT param, chain, iter, value - avg(value) OVER g AS x, count(*) OVER g AS n FROM draws
                   WINDOW g AS (PARTITION BY param, chain))""",
    """acov AS (SELECT a.param, a.chain, t, sum(a.x * b.x) / any_value(a.n) AS v FROM centred a, (SELECT unnest(range(200)) AS t), centred b
                WHERE b.param = a.param AND b.chain = a.chain AND b.iter = a.iter + t GROUP BY 1, 2, 3)""",
    """size AS (SELECT param, var_samp(m) AS between, min(n)::DOUBLE AS n, count(*) AS chains, sum(n) AS total
                FROM (SELECT param, chain, avg(value) AS m, count(*) AS n FROM draws GROUP BY 1, 2) GROUP BY param)""",
    """rho AS (SELECT param, t, CASE t WHEN 0 THEN 1 ELSE 1 - (w - v * n / (n - 1)) / (w * (n - 1) / n + between) END AS r FROM (
                 SELECT a.param, t, avg(v) AS v, n, between, max(avg(v)) FILTER (t = 0) OVER (PARTITION BY a.param) * n / (n - 1) AS w
                 FROM acov a JOIN size USING (param) GROUP BY a.param, t, n, between))""",
    "pairs AS (SELECT param, t // 2 AS j, sum(r) AS p FROM rho GROUP BY 1, 2)",
    "ends AS (SELECT param, min(j) FILTER (p < 0) AS stop FROM pairs GROUP BY param)",
    """steps AS (SELECT param, j, min(p) OVER (PARTITION BY param ORDER BY j) AS p FROM pairs)""",
]


@query(
    "draws_ess",
    with_views(
        f"""SELECT param, any_value(total)::BIGINT AS n_draws, {snap_sql('1 / greatest(2 * sum(p) - 1, 1 / log10(any_value(chains * n)))')} AS neff_ratio
            FROM steps JOIN ends USING (param) JOIN size USING (param) WHERE j < stop GROUP BY param""", DRAWS, *ESS_VIEWS),
)
def draws_ess(spark, d):
    return _snapped(dr.effective_ratio(draws(spark, d), "param", "chain", "iter", "value"), "neff_ratio")


@query(
    "sampler_counts",
    """SELECT CAST(event_id % 4 AS INTEGER) AS chain, count(*) AS n, count(*) FILTER (value > 150) AS n_divergent,
              count(*) FILTER (user_id % 12 >= 10) AS n_max_depth FROM events GROUP BY 1""",
)
def sampler_counts(spark, d):
    states = table(spark, d, "events").select(
        (F.col("event_id") % 4).cast("int").alias("chain"), "value", (F.col("user_id") % 12).alias("depth")
    )
    return dr.sampler_counts(states, "chain", F.col("value") > 150, F.col("depth"), 10)


BUNDLE_DRAWS = """bundle AS (
  SELECT *, yhat + sigma * (2 * u - 1) / sqrt(2 * u * (1 - u)) AS ypred FROM (
    SELECT location, draw, i + 1 AS m, i * top / 20 AS light, sigma, pmax * (1 - exp(-alpha / pmax * (i * top / 20))) - rd AS yhat,
           (('0x' || substr(md5('11|' || location || '|' || draw || '|' || (i + 1)), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296 AS u
    FROM nation_draws JOIN (SELECT location, max(x) AS top FROM lines GROUP BY location) USING (location),
         (SELECT unnest(range(21))::INTEGER AS i)))"""


@query(
    "fit_bundle",
    with_views(
        f"""SELECT 'raw' AS kind, location, {snap_sql('x')} AS light, {snap_sql('y', 3)} AS value, NULL::DOUBLE AS estimate, NULL::DOUBLE AS hdi_low, NULL::DOUBLE AS hdi_high FROM lines
            UNION ALL SELECT 'fit', location, {snap_sql('light')}, NULL, {snap_sql('est', 3)}, {snap_sql('low', 3)}, {snap_sql('high', 3)} FROM ({_hdi_sql('bundle', 'location, light', 'yhat')})
            UNION ALL SELECT 'predict', location, {snap_sql('light')}, NULL, {snap_sql('est', 3)}, {snap_sql('low', 3)}, {snap_sql('high', 3)} FROM ({_hdi_sql('bundle', 'location, light', 'ypred')})""",
        LINES, NATION_DRAWS, BUNDLE_DRAWS),
)
def fit_bundle(spark, d):
    t = lines(spark, d)
    raw = t.select("location", F.col("x").alias("light"), F.col("y").alias("value"))
    tops = t.groupBy("location").agg(F.max("x").alias("top"))
    params = _nation_draws(spark, d).join(tops, "location")
    curve = dr.curve_draws(params, ["location", "draw"], F.col("top"), 21, seed=11)
    out = dr.fit_bundle(raw, curve, ["location"], "light")
    return _snapped(_snapped(out, "light"), "value", "estimate", "hdi_low", "hdi_high", digits=3).select(
        "kind", "location", "light", "value", "estimate", "hdi_low", "hdi_high"
    )
