"""Feature sets built from the window operators. Each is a DataFrame -> DataFrame step for ``DataFrame.transform``."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.scalar import change, ratio, safe_ln
from panelspark.layout import group_quantiles, trailing
from panelspark.operators.panel import with_benchmark
from panelspark.operators.windows import (
    cs_rank_pct, forward_label, frame, full, momentum, ref, roll_beta, roll_corr, roll_mean, roll_std, zscore,
)


def cross_asset_features(
    panel: DataFrame, benchmark: str, *, rs: Sequence[int] = (5, 20), betas: Sequence[int] = (20, 60),
    lags: Sequence[int] = (1, 2, 3), coint: int = 60, vol: int = 20, mom: int = 20,
) -> DataFrame:
    """Relative strength, betas, lead-lag correlations, cointegration z and two cross-sectional ranks."""
    own = F.col("instrument") == benchmark

    def body(df, w):
        df = df.withColumns({"_ret": momentum("close", 1, w), "_bret": momentum("bench", 1, w)})
        df = df.withColumns(
            {f"_lag{n}": ref("_bret", n, w) for n in lags} | {"_spread": safe_ln("close") - safe_ln("bench")}
        )
        cols = {f"rs_{n}": F.when(own, 0.0).otherwise(momentum("close", n, w) - momentum("bench", n, w)) for n in rs}
        cols |= {f"beta_{n}": F.when(own, 1.0).otherwise(roll_beta("_ret", "_bret", n, w)) for n in betas}
        cols |= {f"leadlag_{n}": F.when(~own, roll_corr("_ret", f"_lag{n}", coint, w)) for n in lags}
        cols |= {
            "coint_z": F.when(own, 0.0).otherwise(zscore("_spread", coint, w)),
            "_mom": momentum("close", mom, w), "_vol": roll_std("_ret", vol, w),
        }
        return df.withColumns(cols)

    reach = max(*rs, *betas, coint, vol, mom) + max(lags) + 2
    base = with_benchmark(panel.select("instrument", "date", "close"), benchmark)
    wide = trailing(base, reach, body).select(
        "instrument", "date", *[f"rs_{n}" for n in rs], *[f"beta_{n}" for n in betas], *[f"leadlag_{n}" for n in lags],
        "coint_z", "_mom", "_vol",
    )
    return cs_rank_pct(wide, {"csrank_mom": "_mom", "csrank_vol": "_vol"}).drop("_mom", "_vol")


def funding_features(panel: DataFrame, *, z: int = 30, ma: int = 7, chg: int = 7, field: str = "funding") -> DataFrame:
    def body(df, w):
        return df.withColumns(
            {
                "funding_level": F.col(field), "funding_z": zscore(field, z, w), "funding_ma": roll_mean(field, ma, w),
                "funding_chg": F.col(field) - ref(field, chg, w),
            }
        )

    wide = trailing(panel.select("instrument", "date", field), max(z, ma, chg) + 1, body)
    return cs_rank_pct(wide, {"funding_csrank": field}).drop(field)


def derivatives_features(panel: DataFrame, *, z: int = 30, chg: int = 5, fields: Sequence[str] = (
    "oi", "oi_value", "ls_top", "ls_global", "taker_ratio", "basis")) -> DataFrame:
    def body(df, w):
        cols = {}
        for f in fields:
            cols |= {f"{f}_level": F.col(f), f"{f}_change": momentum(f, chg, w), f"{f}_z": zscore(f, z, w)}
        cols["oi_confirm"] = F.signum(momentum("close", chg, w)) * momentum("oi", chg, w)
        cols["smart_div"] = ratio("ls_top", "ls_global")
        return df.withColumns(cols)

    wide = trailing(panel.select("instrument", "date", "close", *fields), max(z, chg) + 1, body).drop("close")
    return cs_rank_pct(wide, {f"{f}_csrank": f for f in fields}).drop(*fields)


def basic_features(panel: DataFrame) -> DataFrame:
    """RET5, RET20, MA5, MA20, VOL10, VRATIO and the two-day-ahead label."""
    def body(df, w):
        df = df.withColumn("_ret", momentum("close", 1, w))
        return df.withColumns(
            {
                "RET5": momentum("close", 5, w), "RET20": momentum("close", 20, w),
                "MA5": change(roll_mean("close", 5, w), F.col("close")), "MA20": change(roll_mean("close", 20, w), F.col("close")),
                "VOL10": roll_std("_ret", 10, w), "VRATIO": change(F.col("volume"), roll_mean("volume", 5, w)),
                "LABEL": forward_label("close", 1, w),
            }
        ).drop("_ret")

    return trailing(panel.select("instrument", "date", "close", "volume"), 22, body, ahead=2).drop("close", "volume")


def ohlcv_factors(panel: DataFrame, windows: Sequence[int] = (5, 10, 20, 30, 60), lags: int = 0) -> DataFrame:
    """Trailing OHLCV statistics: bar shape, lagged ratios and rolling shape, trend and volume relations.

    Our own factor set; ``lags`` adds that many lagged OHLCV ratios. Every frame of one length is a single Window node.
    """
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))

    def body(df, w):
        span = h - l
        cols = {
            "KMID": ratio(c - o, o), "KLEN": ratio(span, o), "KMID2": ratio(c - o, span),
            "KUP": ratio(h - F.greatest(o, c), o), "KLOW": ratio(F.least(o, c) - l, o), "KSFT": ratio(2 * c - h - l, o),
            "_ret": momentum("close", 1, w), "_vchg": momentum("volume", 1, w), "_t": F.datediff("date", F.lit("1970-01-01").cast("date")),
            "_lnv": F.ln(v + 1),
        }
        df = df.withColumns(cols)
        out = {}
        for n in windows:
            f = frame(w, n)
            ok = lambda x, value, n=n: F.when(full(x, w, n), value)
            out |= {
                f"ROC{n}": ratio(ref("close", n, w), c), f"MA{n}": ratio(roll_mean("close", n, w), c),
                f"STD{n}": ratio(roll_std("close", n, w), c),
                f"MAX{n}": ok(c, ratio(F.max(h).over(f), c)), f"MIN{n}": ok(c, ratio(F.min(l).over(f), c)),
                f"QTLU{n}": ok(c, ratio(F.percentile(c, F.lit(0.8)).over(f), c)),
                f"QTLD{n}": ok(c, ratio(F.percentile(c, F.lit(0.2)).over(f), c)),
                f"BETA{n}": ok(c, ratio(F.regr_slope(c, F.col("_t")).over(f), c)),
                f"RSQR{n}": ok(c, F.regr_r2(c, F.col("_t")).over(f)),
                f"IMAX{n}": ok(c, (F.max_by(F.col("_t"), h).over(f) - F.col("_t") + n) / n),
                f"IMIN{n}": ok(c, (F.min_by(F.col("_t"), l).over(f) - F.col("_t") + n) / n),
                f"CORR{n}": roll_corr("close", "_lnv", n, w), f"CORD{n}": roll_corr("_ret", "_vchg", n, w),
                f"CNTP{n}": ok(F.col("_ret"), F.avg((F.col("_ret") > 0).cast("double")).over(f)),
                f"SUMP{n}": ok(F.col("_ret"), ratio(F.sum(F.greatest(F.col("_ret"), F.lit(0.0))).over(f), F.sum(F.abs("_ret")).over(f))),
                f"VMA{n}": ratio(roll_mean("volume", n, w), v), f"VSTD{n}": ratio(roll_std("volume", n, w), v),
            }
        for i in range(1, lags + 1):
            out |= {f"{x.upper()}_L{i}": ratio(ref(x, i, w), v if x == "volume" else c) for x in ("open", "high", "low", "close", "volume")}
        return df.withColumns(out).drop("_ret", "_vchg", "_t", "_lnv")

    fields = ["open", "high", "low", "close", "volume"]
    return trailing(panel.select("instrument", "date", *fields), max(max(windows), lags) + 2, body).drop(*fields)


def robust_zscore(
    df: DataFrame, columns: Sequence[str], fit: Column, *, keys: Sequence[str] = (), scale: float = 1.4826, clip: float = 3.0
) -> DataFrame:
    """(x - median) / (scale * MAD) clipped to +-clip, fitted on the rows where ``fit`` holds, per key.

    Two exact-quantile passes over one long table for all columns; the fitted pairs are one row per (key, column).
    """
    entries = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in columns])
    tall = df.filter(fit).select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e._c", "_e._x")
    medians = group_quantiles(tall, [*keys, "_c"], "_x", {"_med": 0.5})
    spread = tall.join(medians, [*keys, "_c"]).withColumn("_dev", F.abs(F.col("_x") - F.col("_med")))
    mads = group_quantiles(spread, [*keys, "_c"], "_dev", {"_mad": 0.5})
    one = lambda name, c: F.max(F.when(F.col("_c") == c, F.col(name)))
    fitted = medians.join(mads, [*keys, "_c"]).groupBy(*keys).agg(
        *[one("_med", c).alias(f"_med_{c}") for c in columns], *[one("_mad", c).alias(f"_mad_{c}") for c in columns]
    )
    if keys:
        joined = df.join(fitted, list(keys))
    else:
        names = [f"_{kind}_{c}" for kind in ("med", "mad") for c in columns]
        joined = df.withColumns({name: fitted.select(name).scalar() for name in names})
    return joined.withColumns(
        {
            c: F.when(
                F.col(c).isNotNull(),
                F.greatest(F.least(ratio(F.col(c) - F.col(f"_med_{c}"), F.col(f"_mad_{c}") * scale), F.lit(clip)), F.lit(-clip)),
            )
            for c in columns
        }
    ).drop(*[f"_med_{c}" for c in columns], *[f"_mad_{c}" for c in columns])
