"""Scalar column functions. All of them stay inside whole-stage codegen and map undefined results to NULL."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: ColumnOrName) -> Column:
    """NaN and both infinities become NULL."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / den; a zero or non-finite outcome of the division is NULL instead of an ANSI error."""
    return finite(F.try_divide(col(num), col(den)))


def change(now: ColumnOrName, before: ColumnOrName) -> Column:
    return finite(F.try_divide(col(now), col(before)) - 1)


def safe_ln(c: ColumnOrName) -> Column:
    c = col(c)
    return F.when(c > 0, F.ln(c))


def sign_of(c: ColumnOrName) -> Column:
    return F.signum(col(c))


def clip(c: ColumnOrName, lower: float | None = None, upper: float | None = None) -> Column:
    """Clip that keeps NULL as NULL (greatest and least alone would skip it)."""
    c = col(c)
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(c.isNotNull(), out)


def epoch_seconds(epoch: ColumnOrName) -> Column:
    """Whole seconds of an epoch given per row in s, ms, us or ns: drop thousands until below 1e10."""
    e = col(epoch).cast("long")
    limit = 10_000_000_000
    whole = lambda power: F.floor(e / F.lit(1000**power)).cast("long")
    return (
        F.when(e < limit, e)
        .when(e < limit * 1000, whole(1))
        .when(e < limit * 1_000_000, whole(2))
        .otherwise(whole(3))
    )


def epoch_to_ts(epoch: ColumnOrName) -> Column:
    return F.timestamp_seconds(epoch_seconds(epoch))


def epoch_to_date(epoch: ColumnOrName) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch_seconds(epoch) / 86400).cast("int"))


def vwap(amount: ColumnOrName, volume: ColumnOrName, close: ColumnOrName) -> Column:
    """amount / volume, or the close on a day without volume."""
    return F.coalesce(F.try_divide(col(amount), col(volume)), col(close))


def nvm(market_cap: ColumnOrName, active_addr: ColumnOrName) -> Column:
    """ln(market cap / active addresses squared)."""
    return safe_ln(F.try_divide(col(market_cap), col(active_addr) * col(active_addr)))


def config_hash(columns: Sequence[str]) -> Column:
    """sha256 of the key-sorted JSON of a parameter row."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


# Hart's double-precision rational approximation of the normal tail (numerator and denominator
# coefficients, highest power first) and Acklam's coefficients of the normal quantile.
HART_NUMERATOR = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DENOMINATOR = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
ACKLAM_A = (
    -39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239,
)
ACKLAM_B = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572)
ACKLAM_C = (
    -0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968,
    2.938163982698783,
)
ACKLAM_D = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416)
ACKLAM_LOW = 0.02425
SQRT_TWO_PI = 2.5066282746310002
EULER_GAMMA = 0.5772156649015329
E = 2.718281828459045


def _poly(coefficients: Sequence[float], x: Column, tail_one: bool = False) -> Column:
    acc = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        acc = acc * x + F.lit(float(c))
    return acc * x + F.lit(1.0) if tail_one else acc


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``; keeps the generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_cdf(x: ColumnOrName) -> Column:
    """Standard normal distribution function, absolute error below 1e-14."""

    def tail(z: Column) -> Column:
        near = F.exp(-z * z / 2) * _poly(HART_NUMERATOR, z) / _poly(HART_DENOMINATOR, z)
        fraction = z + F.lit(0.65)
        for n in (4.0, 3.0, 2.0, 1.0):
            fraction = z + F.lit(n) / fraction
        far = F.exp(-z * z / 2) / (fraction * F.lit(SQRT_TWO_PI))
        return F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, near).otherwise(far)

    return _bind(col(x), lambda v: _bind(F.abs(v), lambda z: _bind(tail(z), lambda t: F.when(v > 0, 1 - t).otherwise(t))))


def norm_ppf(p: ColumnOrName) -> Column:
    """Standard normal quantile: rational start value and one Halley step; NULL outside (0, 1)."""

    def side(prob: Column) -> Column:
        return _bind(F.sqrt(F.lit(-2.0) * F.ln(prob)), lambda t: _poly(ACKLAM_C, t) / _poly(ACKLAM_D, t, tail_one=True))

    def middle(q: Column) -> Column:
        return _bind(q * q, lambda r: _poly(ACKLAM_A, r) * q / _poly(ACKLAM_B, r, tail_one=True))

    def refined(prob: Column) -> Column:
        start = F.when(prob < ACKLAM_LOW, side(prob)).when(prob > 1 - ACKLAM_LOW, -side(1 - prob)).otherwise(middle(prob - F.lit(0.5)))

        def halley(s: Column) -> Column:
            step = (norm_cdf(s) - prob) * F.lit(SQRT_TWO_PI) * F.exp(s * s / 2)
            return _bind(step, lambda u: s - u / (1 + s * u / 2))

        return F.when((prob > 0) & (prob < 1), _bind(start, halley))

    return _bind(col(p), refined)


def two_sided_p(t: ColumnOrName) -> Column:
    return 2 * norm_cdf(-F.abs(col(t)))


def expected_max_normal(n: ColumnOrName) -> Column:
    """Approximate expectation of the largest of n standard normal draws."""
    n = col(n).cast("double")
    first = norm_ppf(1 - F.lit(1.0) / n)
    second = norm_ppf(1 - F.lit(1.0) / (n * F.lit(E)))
    return F.lit(1 - EULER_GAMMA) * first + F.lit(EULER_GAMMA) * second


def hash_uniform(*parts: ColumnOrName) -> Column:
    """Uniform in [0, 1) from an md5 prefix of the parts: the same draw wherever the row is computed."""
    text = F.concat_ws("-", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def pearson(x: str, y: str, over: WindowSpec | None = None) -> Column:
    """Correlation of the complete pairs; NULL where a side is constant (the built-in would raise on 0 / 0)."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    put = lambda agg: agg if over is None else agg.over(over)
    return ratio(put(F.covar_samp(a, b)), F.sqrt(put(F.var_samp(a)) * put(F.var_samp(b))))
