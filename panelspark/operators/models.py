"""Models fitted for many splits or seeds at once.

Least squares is additive: per-date sums of products are computed once from the panel, then summed over each split's
training dates. A sweep of hundreds of splits therefore reads the panel once and shuffles days x splits tiny rows. Boosted
trees grow for all splits together from residual histograms (``boosting``).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelspark.functions.scalar import hash_uniform
from panelspark.operators.boosting import boosted_predictions


def prepare(panel: DataFrame, features: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """(train rows with a label, all rows): missing features are 0, rows without label only serve prediction."""
    filled = panel.na.fill(0.0, list(features))
    return filled.na.drop(subset=[label]), filled


def daily_products(rows: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Per-date sums of all products of (1, features, label)."""
    names = ["_one", *features]
    base = rows.withColumn("_one", F.lit(1.0))
    aggs = [
        F.sum(F.col(a) * F.col(b)).alias(f"xx_{i}_{j}")
        for i, a in enumerate(names) for j, b in enumerate(names) if i <= j
    ]
    aggs += [F.sum(F.col(a) * F.col(label)).alias(f"xy_{i}") for i, a in enumerate(names)]
    return base.groupBy("date").agg(*aggs)


def fit_ridge(products: DataFrame, plan: DataFrame, features: Sequence[str], reg: float, keys: Sequence[str]) -> DataFrame:
    """Ridge coefficients (keys, intercept, coef) from per-date products and (keys, date[, sample_weight]) train rows.

    Minimises mean squared error / 2 + reg / 2 * |coef|^2 with a free intercept. Solving the d x d systems happens
    in tasks, one small matrix per key.
    """
    d = len(features) + 1
    sums = [c for c in products.columns if c != "date"]
    weight = F.col("sample_weight") if "sample_weight" in plan.columns else F.lit(1.0)
    total = plan.join(products, "date").groupBy(*keys).agg(*[F.sum(F.col(c) * weight).alias(c) for c in sums])
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in total.select(*keys).schema.fields)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keys)].copy()
            fits = []
            for row in batch.to_dict("records"):
                n = row["xx_0_0"]
                mean = np.array([row[f"xx_0_{j}"] for j in range(1, d)]) / n
                ybar = row["xy_0"] / n
                xx = np.array([[row[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(1, d)] for i in range(1, d)]) / n
                xy = np.array([row[f"xy_{i}"] for i in range(1, d)]) / n
                coef = np.linalg.lstsq(xx - np.outer(mean, mean) + reg * np.eye(d - 1), xy - mean * ybar, rcond=None)[0]
                fits.append((float(ybar - coef @ mean), coef.tolist()))
            out["intercept"] = [f[0] for f in fits]
            out["coef"] = [f[1] for f in fits]
            yield out

    return total.mapInPandas(solve, f"{key_schema}, intercept double, coef array<double>")


def fit_constant(products: DataFrame, plan: DataFrame, keys: Sequence[str], features: Sequence[str] = ()) -> DataFrame:
    """The train mean in the shape of a linear fit."""
    weight = F.col("sample_weight") if "sample_weight" in plan.columns else F.lit(1.0)
    means = plan.join(products, "date").groupBy(*keys).agg(
        (F.sum(F.col("xy_0") * weight) / F.sum(F.col("xx_0_0") * weight)).alias("intercept")
    )
    return means.withColumn("coef", F.array(*[F.lit(0.0) for _ in features]))


def predict_linear(rows: DataFrame, fits: DataFrame, features: Sequence[str], keys: Sequence[str], out: str = "pred") -> DataFrame:
    score = F.col("intercept")
    for i, f in enumerate(features):
        score = score + F.get("coef", F.lit(i)) * F.col(f)
    return rows.join(fits, list(keys)).withColumn(out, score).drop("intercept", "coef")


def fit_predict_linear(
    panel: DataFrame, plan: DataFrame, features: Sequence[str], label: str, *, reg: float = 0.0, constant: bool = False,
    keys: Sequence[str] = ("split_id",),
) -> DataFrame:
    """Fit on each key's train dates, score its test dates; ``plan`` is (keys, date, role[, sample_weight, ...])."""
    train, rows = prepare(panel, features, label)
    products = daily_products(train, features, label)
    fit_on = plan.filter(F.col("role") == "train")
    fits = fit_constant(products, fit_on, keys, features) if constant else fit_ridge(products, fit_on, features, reg, keys)
    test = plan.filter(F.col("role") == "test").drop("sample_weight", "role")
    return predict_linear(rows.join(test, "date"), fits, features, keys)


def fit_predict_boosted(panel: DataFrame, plan: DataFrame, features: Sequence[str], label: str, **options) -> DataFrame:
    """Gradient-boosted trees, all keys of the plan in one fit; options are those of ``boosting.boosted_predictions``."""
    train, rows = prepare(panel, features, label)
    return boosted_predictions(train, rows, plan, features, label, **options)


def seeded_plan(plan: DataFrame, seeds: int, share: float = 0.8) -> DataFrame:
    """Cross a plan with seeds 1..N; each seed weights training days by a hash draw, so runs differ and replay exactly."""
    seeded = plan.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    return seeded.withColumn("sample_weight", F.when(hash_uniform("seed", "date") < share, 1.0).otherwise(0.0))


MODELS: dict[str, Callable[..., DataFrame]] = {
    "linear": lambda *a, **k: fit_predict_linear(*a, **{"reg": 0.0, **k}),
    "ridge": lambda *a, **k: fit_predict_linear(*a, **{"reg": 1e-3, **k}),
    "constant": lambda *a, **k: fit_predict_linear(*a, **{**k, "constant": True}),
    "boosted": fit_predict_boosted,
}


def fit_predict(panel: DataFrame, plan: DataFrame, features: Sequence[str], label: str, model: str = "ridge", **options) -> DataFrame:
    """Score every split's test rows with the named model."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; choose one of {sorted(MODELS)}")
    return MODELS[model](panel, plan, features, label, **options)
