"""Gradient-boosted regression trees as aggregates: all splits and seeds of a plan grow together.

Features are binned at exact quantiles of each key's training rows. A tree level is one ``groupBy`` of residual sums per
(key, node, feature, bin), whose best cuts are read off running sums over at most ``bins`` rows. The driver loops over rounds and
levels only; trees are small tables that are joined back to the rows. Residuals are summed as whole numbers of ``UNIT``, so
histograms, and with them the trees, do not depend on partitioning or retries.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.scalar import hash_uniform
from panelspark.layout import settle, value_ranks

BINS = 32
UNIT = 2.0**-32  # resolution of residuals; labels have to stay below 2^31 in size
LOW_BITS = 20  # residuals are summed in two parts, which no number of rows overflows


def bin_edges(train: DataFrame, features: Sequence[str], keys: Sequence[str], bins: int = BINS) -> DataFrame:
    """(keys, edges): per key a map from feature number to the lower bounds of its bins but the first, equally many rows each.

    Bounds are values of training rows; a feature with few values has fewer bins, a constant one none.
    """
    tall = train.select(*keys, F.posexplode(F.array(*[F.col(f).cast("double") for f in features])).alias("feature", "value"))
    place = F.expr(f"below * {bins} div total")
    lower = value_ranks(tall, [*keys, "feature"], "value").groupBy(*keys, "feature", place.alias("bin")).agg(F.min("value").alias("edge"))
    lists = lower.groupBy(*keys, "feature").agg(F.sort_array(F.collect_list(F.when(F.col("bin") > 0, F.col("edge")))).alias("edges"))
    return lists.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges"))).alias("_edges"))


def binned(rows: DataFrame, features: Sequence[str], edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach ``_bins``: per feature the number of edges at or below the row's value."""
    def below(i: int, feature: str) -> Column:
        return F.size(F.filter(F.try_element_at("_edges", F.lit(i)), lambda edge: edge <= F.col(feature))).cast("int")

    at = [below(i, f) for i, f in enumerate(features)]
    return rows.join(edges, list(keys)).withColumn("_bins", F.array(*at)).drop("_edges")


def leaf_node(bins: Column, cuts: Column, levels: int) -> Column:
    """Heap number of the node a row reaches after ``levels`` levels; a node without a cut sends all its rows to the left."""
    if not levels:
        return F.lit(0)

    def step(node: Column, _: Column) -> Column:
        cut = F.try_element_at(cuts, node)
        right = F.get(bins, cut.getField("feature")) >= cut.getField("bin")
        return node * 2 + 1 + F.coalesce(right.cast("int"), F.lit(0))

    return F.aggregate(F.array_repeat(F.lit(0), levels), F.lit(0), step)


def exact_sums(residual: Column) -> list[Column]:
    whole = F.floor(residual / F.lit(UNIT)).cast("long")
    return [F.sum(F.shiftright(whole, LOW_BITS)).alias("_high"), F.sum(whole.bitwiseAND(F.lit((1 << LOW_BITS) - 1))).alias("_low")]


def from_parts(high: Column, low: Column) -> Column:
    return (high.cast("double") * F.lit(float(1 << LOW_BITS)) + low.cast("double")) * F.lit(UNIT)


def best_cuts(rows: DataFrame, keys: Sequence[str], reg: float, min_rows: int) -> DataFrame:
    """(keys, node, cut): the (feature, bin) with the largest gain of each node; rows at or above the bin go right.

    ``rows``: keys, node, _bins, _w, _residual. Equal gains go to the smaller feature, then bin. Nodes without a cut that gains, or that
    leaves ``min_rows`` rows on both sides, are absent.
    """
    tall = rows.select(*keys, "node", "_w", "_residual", F.posexplode("_bins").alias("feature", "bin"))
    hist = tall.groupBy(*keys, "node", "feature", "bin").agg(*exact_sums(F.col("_residual") * F.col("_w")), F.sum("_w").alias("_weight"), F.count(F.lit(1)).alias("_rows"))
    part = Window.partitionBy(*keys, "node", "feature")  # at most one row per bin
    before = part.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    parts = ["_high", "_low", "_weight", "_rows"]
    sums = hist.select("*", *[F.sum(c).over(part).alias(f"{c}_all") for c in parts], *[F.sum(c).over(before).alias(f"{c}_left") for c in parts])
    g, left = from_parts(F.col("_high_all"), F.col("_low_all")), from_parts(F.col("_high_left"), F.col("_low_left"))
    w, wl = F.col("_weight_all"), F.col("_weight_left")
    scored = sums.filter((F.col("_rows_left") >= min_rows) & (F.col("_rows_all") - F.col("_rows_left") >= min_rows)).select(*keys, "node", "feature", "bin", g.alias("_g"), left.alias("_l"), w.alias("_w"), wl.alias("_wl"))
    right = F.col("_g") - F.col("_l")
    gain = F.col("_l") * F.col("_l") / (F.col("_wl") + reg) + right * right / (F.col("_w") - F.col("_wl") + reg) - F.col("_g") * F.col("_g") / (F.col("_w") + reg)
    cut = F.max_by(F.struct("feature", "bin"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return scored.withColumn("gain", gain).filter("gain > 0").groupBy(*keys, "node").agg(cut.alias("cut"))


def _as_map(table: DataFrame, keys: Sequence[str], key: str, value: str, out: str) -> DataFrame:
    return table.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(out))  # at most one entry per node or round


def grow_tree(rows: DataFrame, keys: Sequence[str], depth: int, rate: float, reg: float, min_rows: int) -> DataFrame:
    """(keys, cuts, leaves): one tree per key, fitted to ``_residual`` of the rows of (keys, _bins, _w, _residual)."""
    keys, levels = list(keys), []
    cuts = None
    for level in range(depth + 1):
        placed = rows.withColumn("_cuts", F.lit(None).cast("map<int, struct<feature:int, bin:int>>")) if cuts is None else rows.join(cuts, keys, "left")
        placed = placed.withColumn("node", leaf_node(F.col("_bins"), F.col("_cuts"), level)).drop("_cuts")
        if level < depth:
            levels.append(settle(best_cuts(placed, keys, reg, min_rows), "boost-cuts"))
            cuts = _as_map(reduce(DataFrame.unionByName, levels), keys, "node", "cut", "_cuts")
    sums = placed.groupBy(*keys, "node").agg(*exact_sums(F.col("_residual") * F.col("_w")), F.sum("_w").alias("_weight"))
    value = from_parts(F.col("_high"), F.col("_low")) / (F.col("_weight") + reg) * F.lit(rate)
    leaves = _as_map(sums.withColumn("value", value), keys, "node", "value", "_leaves")
    return settle(leaves.join(cuts, keys, "left") if cuts is not None else leaves.withColumn("_cuts", F.lit(None).cast("map<int, struct<feature:int, bin:int>>")), "boost-tree")


def leaf_value(bins: Column, cuts: Column, leaves: Column, depth: int) -> Column:
    return F.coalesce(F.try_element_at(leaves, leaf_node(bins, cuts, depth)), F.lit(0.0))


def boosted_predictions(
    train: DataFrame, rows: DataFrame, plan: DataFrame, features: Sequence[str], label: str, *, seed: int = 1, trees: int = 20, depth: int = 3,
    subsample: float = 0.8, rate: float = 0.1, reg: float = 1.0, min_rows: int = 1, bins: int = BINS,
    keys: Sequence[str] = ("split_id",), row_key: Sequence[str] = ("instrument", "date"), out: str = "pred",
) -> DataFrame:
    """Test rows of every key with the prediction of ``trees`` rounds fitted on its train rows.

    ``plan`` is (keys, date, role[, sample_weight, ...]); rows of weight 0 are left out. A round sees a row if the hash of seed, round, keys
    and ``row_key`` draws it (all rows at ``subsample`` 1), and all rows are moved by the tree. The frame of training rows (bins, label,
    prediction) is written once a round. A key without train rows has no predictions.
    """
    keys = list(keys)
    fit_on = plan.filter(F.col("role") == "train").select(*keys, "date", (F.col("sample_weight").cast("double") if "sample_weight" in plan.columns else F.lit(1.0)).alias("_w"))
    fit_on = fit_on.filter("_w > 0")
    there = train.select(*dict.fromkeys([*row_key, "date"]), *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("_y"))
    named = [f"_x{i}" for i in range(len(features))]
    fit_rows = there.join(fit_on, "date")
    edges = settle(bin_edges(fit_rows, named, keys, bins), "boost-edges")
    start = fit_rows.groupBy(*keys).agg(*exact_sums(F.col("_y") * F.col("_w")), F.sum("_w").alias("_weight"))
    start = settle(start.select(*keys, (from_parts(F.col("_high"), F.col("_low")) / F.col("_weight")).alias("_base")), "boost-start")
    held = list(dict.fromkeys([*keys, *row_key, "_bins", "_w", "_y"]))
    frame = settle(binned(fit_rows, named, edges, keys).join(start, keys).select(*held, F.col("_base").alias("_pred")), "boost-rows")
    grown = []
    for t in range(trees):
        residual = frame.withColumn("_residual", F.col("_y") - F.col("_pred"))
        drawn = residual if subsample >= 1 else residual.filter(hash_uniform(F.lit(f"{seed}.{t}"), *keys, *row_key) < subsample)
        tree = grow_tree(drawn.select(*keys, "_bins", "_w", "_residual"), keys, depth, rate, reg, min_rows)
        grown.append(tree.withColumn("_t", F.lit(t)))
        if t + 1 < trees:
            moved = F.col("_pred") + leaf_value(F.col("_bins"), F.col("_cuts"), F.col("_leaves"), depth)
            frame = settle(frame.join(tree, keys, "left").select(*held, moved.alias("_pred")), "boost-rows")
    test = plan.filter(F.col("role") == "test").drop("sample_weight", "role")
    scored = rows.join(test, "date").withColumns({f"_x{i}": F.col(f).cast("double") for i, f in enumerate(features)})
    scored = binned(scored, named, edges, keys).join(start, keys)
    total = F.col("_base")
    if grown:
        model = reduce(DataFrame.unionByName, grown).withColumn("_tree", F.struct("_cuts", "_leaves"))
        scored = scored.join(_as_map(model, keys, "_t", "_tree", "_model"), keys, "left")

        def add(sum_: Column, t: Column) -> Column:
            tree = F.try_element_at("_model", t)
            return sum_ + leaf_value(F.col("_bins"), tree.getField("_cuts"), tree.getField("_leaves"), depth)

        total = F.aggregate(F.sequence(F.lit(0), F.lit(trees - 1)), F.col("_base"), add)
    extra = [c for c in test.columns if c not in rows.columns]
    return scored.withColumn(out, total).select(*dict.fromkeys(["date", *rows.columns, *extra, out]))
