"""Mixing sources to target weights: hierarchical budgets over a tree, then seeded token prefixes per leaf."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

PIECE_DOCS = 4096  # rows of a leaf that are sorted together


@dataclass(frozen=True)
class MixTargets:
    """Whole-number weights per tree level: ``weights[level][value]``, ``default`` for other values (null counts as '').

    ``budget`` tokens are shared out, or ``percent`` of the tokens there are if it is None;
    a leaf gives at most ``max_epochs`` times its tokens.
    """

    budget: int | None = None
    percent: int = 100
    max_epochs: int = 1
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    default: int = 1
    seed: int = 0

    def weight(self, level: str) -> Column:
        out = F.lit(self.default)
        for value, w in sorted(self.weights.get(level, {}).items()):
            out = F.when(F.col(level) == value, F.lit(w)).otherwise(out)
        return out.cast("long")


def token_count(text: Column) -> Column:
    """Words of a text, without an object per word: the first characters of words are what is left; null has none."""
    firsts = F.regexp_replace(text, r"[\x20\x09-\x0D]+|(?<=[^\x20\x09-\x0D])[^\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(firsts), F.lit(0)).cast("long")


def share_out(leaves: DataFrame, levels: list[str], targets: MixTargets) -> DataFrame:
    """Token budget of every leaf: ``leaves(*levels, tokens)`` with column ``budget``.

    Weights pass from the root down. Where a node cannot use its share, its siblings take the
    rest in proportion to their weights, and only what a whole subtree cannot hold goes back
    to the siblings of its parent: a node's capacity is the sum over its leaves. Whole-number
    arithmetic; what rounding leaves (fewer tokens than siblings) stays unspent.
    """
    levels_up = [levels[:i + 1] for i in range(len(levels))]
    now = leaves.withColumn("cap", F.col("tokens") * targets.max_epochs)
    nodes = [now.groupBy(*keys).agg(F.sum("cap").alias("cap")) for keys in levels_up]
    parent: DataFrame | None = None
    for depth, (keys, table) in enumerate(zip(levels_up, nodes, strict=True)):
        above = keys[:-1]
        table = table.withColumn("w", targets.weight(keys[-1]))
        if parent is None:
            whole = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {targets.percent} div 100").alias("give"))
            table = table.withColumn("give", F.lit(targets.budget if targets.budget is not None else whole.first()[0]).cast("long"))
        else:
            table = table.join(parent, above)
        # saturate children in the order of capacity per weight; the others share what is left by weight
        order = [F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf"))).asc(), F.col(keys[-1]).asc()]
        scope = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        before = scope.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        onward = scope.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
        table = table.withColumn("rest", F.greatest(F.lit(0), F.col("give") - F.coalesce(F.sum("cap").over(before), F.lit(0)))) \
            .withColumn("weights", F.sum("w").over(onward)) \
            .withColumn("full", (F.col("w") > 0) & (F.col("cap").cast("decimal(38,0)") * F.col("weights") <= F.col("rest").cast("decimal(38,0)") * F.col("w")))
        # the first child that is not saturated fixes the common rate
        table = table.withColumn("open", F.min(F.when(~F.col("full") & (F.col("w") > 0), F.struct(
            (F.col("cap") / F.col("w")).alias("r"), F.col(keys[-1]).alias("name"), "rest", "weights"))).over(scope))
        share = (F.col("open.rest").cast("decimal(38,0)") * F.col("w"))
        table = table.withColumn("got", F.when(F.col("w") == 0, F.lit(0)).when(F.col("full"), F.col("cap")).otherwise(
            F.least(F.col("cap"), F.call_function("div", share, F.col("open.weights").cast("decimal(38,0)")).cast("long"))).cast("long"))
        parent = table.select(*keys, F.col("got").alias("give"))
        if depth == len(levels_up) - 1:
            return leaves.join(parent.withColumnRenamed("give", "budget"), keys)
    raise ValueError("levels must not be empty")


def _place(seed: int, epoch: Column, key: Column) -> Column:
    """60-bit place of a row in the seeded order of an epoch, from MD5 so that other engines can repeat it."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def plan_mix(rows: DataFrame, levels: list[str], targets: MixTargets) -> DataFrame:
    """Per leaf: budget, whole epochs ``epochs`` and ``cut``, the largest place taken in the last, partial epoch (null: none).

    ``rows(key, *levels, tokens)``. The prefix holds rows in the order of their places as long as their
    tokens fit; rows of one key share a place and stand or fall together. Only the piece of a leaf where
    the prefix ends is sorted; the pieces before it are summed.
    """
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = materialize(leaves, "mix-leaves")
    shared = share_out(leaves, levels, targets)
    plan = shared.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn(
        "rest", F.col("budget") - F.col("epochs") * F.col("tokens")).withColumn("pieces", F.ceil(F.col("docs") / PIECE_DOCS))
    plan = materialize(plan, "mix-plan")
    placed = rows.join(plan.where("rest > 0").select(*levels, "epochs", "rest", "pieces"), levels).withColumn(
        "place", _place(targets.seed, F.col("epochs"), F.col("key"))).withColumn("piece", F.expr("(shiftright(place, 28) * pieces) div 4294967296"))
    sums = placed.groupBy(*levels, "piece").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = Window.partitionBy(*levels).orderBy("piece")
    ends = sums.withColumn("end", F.sum("tokens").over(upto)).where("end > rest").groupBy(*levels).agg(
        F.min_by(F.struct("piece", (F.col("end") - F.col("tokens")).alias("start")), "piece").alias("e")).select(
        *levels, F.col("e.piece").alias("piece"), F.col("e.start").alias("start"))
    ends = materialize(ends, "mix-ends")  # one row a leaf; read again, the join is dealt by piece too and a hot leaf stays split
    inside = placed.join(ends, [*levels, "piece"]).groupBy(*levels, "piece", "start", "rest", "place").agg(F.sum("tokens").alias("tokens"))
    run = Window.partitionBy(*levels).orderBy("place")
    last = inside.withColumn("end", F.col("start") + F.sum("tokens").over(run)).groupBy(*levels).agg(
        F.max(F.when(F.col("end") <= F.col("rest"), F.col("place"))).alias("fit"), F.min("place").alias("low"))
    # without a fitting row in its piece the prefix ends just before the piece's first row
    cut = last.select(*levels, F.coalesce("fit", F.col("low") - 1).alias("cut"))
    return plan.join(cut, levels, "left").select(*levels, "tokens", "budget", "epochs", "cut")


def mix_sources(df: DataFrame, levels: list[str], targets: MixTargets, key: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """Rows of ``df``, once per epoch they are taken in, with column mix_epoch (replaced if there).

    Every row belongs to the leaf given by its ``levels`` columns; nulls form a leaf of their own (''). Rows of
    empty text weigh nothing and go with any prefix that reaches them; a leaf without tokens gives no
    rows. All columns are kept. An empty table gives an empty table.
    """
    names = [c for c in df.columns if c != "mix_epoch"]
    tokens = token_count(F.col("text")) if tokens is None else tokens
    level_cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"level{i}__") for i, c in enumerate(levels)]
    inner = [f"level{i}__" for i in range(len(levels))]
    renamed = replace(targets, weights={f"level{i}__": targets.weights.get(c, {}) for i, c in enumerate(levels)})
    rows = materialize(df.select(F.col(key).alias("key"), *level_cols, tokens.alias("tokens")), "mix-rows")
    plan = materialize(plan_mix(rows, inner, renamed).select(*inner, "epochs", "cut"), "mix-cuts")
    taken = df.select(*names, *level_cols).join(plan, inner).withColumn(
        "copies__", F.col("epochs") + (_place(targets.seed, F.col("epochs"), F.col(key)) <= F.col("cut")).cast("long"))
    taken = taken.withColumn("copies__", F.coalesce("copies__", "epochs")).where("copies__ > 0")
    return taken.select(*names, F.explode(F.sequence(F.lit(0), (F.col("copies__") - 1).cast("int"))).alias("mix_epoch"))
