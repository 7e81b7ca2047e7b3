"""Column builders for the domain's scalar functions; all stay in generated JVM code but for array lambdas."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded_number(x: Column, digits: int) -> Column:
    """Doubles rounded half away from zero as scaled numbers, as SQL engines do; ``F.round`` goes through decimals, which takes most of a pair's time."""
    scaled = x * 10.0**digits
    whole = F.rint(scaled)
    near = F.when(F.abs(scaled - whole) == 0.5, scaled + 0.5 * F.signum(scaled)).otherwise(whole) / 10.0**digits
    return F.when(F.abs(scaled) < 2.0**52, near).otherwise(x)  # larger ones have no digits left to round


def minmax(x: Column, *by: str) -> Column:
    """0 to 1 over the partition; 0 if all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.when(high > low, (x - low) / (high - low)).otherwise(0.0)


def zscore(x: Column, *by: str) -> Column:
    """Population z-score over the partition; 0 where the deviation is 0 or not finite."""
    w = Window.partitionBy(*by)
    std = F.stddev_pop(x).over(w)
    return F.when(std.isNull() | F.isnan(std) | (std == 0), 0.0).otherwise((x - F.avg(x).over(w)) / std)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate, 0 if a side is constant or there are no rows: the built-in one divides by zero there."""
    a, b = (F.when(x.isNotNull() & y.isNotNull(), x.cast("double")) for x, y in ((a, b), (b, a)))
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def slugify(text: Column) -> Column:
    plain = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "-")
    return F.regexp_replace(plain, "^-+|-+$", "")


def stable_noise(seed: int, name: Column) -> Column:
    """Uniform value in [0, 1] from the first eight bytes of a digest of seed and name."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name.cast("string")), 256), 1, 16)
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64 - 1))


def tier(x: Column, bounds: Sequence[tuple[float, str]], top: str) -> Column:
    """The name of the first bound above x."""
    out = F.lit(top)
    for bound, name in reversed(bounds):
        out = F.when(x < bound, name).otherwise(out)
    return out


def blend(alpha: Column | float, a: Column, b: Column) -> Column:
    """alpha * a + (1 - alpha) * b."""
    if not isinstance(alpha, Column):
        if not 0 <= alpha <= 1:
            raise ValueError("alpha lies between 0 and 1")
        alpha = F.lit(float(alpha))
    return alpha * a + (1 - alpha) * b


def preference_match(preferences: Column, z: Column) -> Column:
    """Logistic of the weighted mean of clipped catalog z-scores, weights being preferences less a half."""
    pairs = F.zip_with(preferences, z, lambda p, v: F.struct((p - 0.5).alias("w"), F.greatest(F.lit(-2.5), F.least(F.lit(2.5), v)).alias("z")))
    top = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["w"] * x["z"])
    weight = F.aggregate(pairs, F.lit(1.0), lambda s, x: s + F.abs(x["w"]))
    return logistic(2.2 * top / weight)


def continuity(same: Column, a: Column, b: Column) -> Column:
    """0.65 for the same category and 0.35 times how close the attributes are."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return 0.65 * same.cast("double") + 0.35 * (1 - gap)


def parse_utc(text: Column) -> Column:
    """An ISO time with a zone, as UTC; null for one without."""
    zoned = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    return F.when(zoned, F.try_to_timestamp(text))


def largest_remainder(rows: DataFrame, weight: str, total: int, tie: Sequence[str | Column], name: str = "n") -> DataFrame:
    """Share ``total`` by weight: floors first, then one each by largest remainder, ``tie`` deciding equal ones."""
    share = F.col(weight) / F.sum(weight).over(Window.partitionBy()) * total
    held = rows.withColumn("__share", F.round(share, 9)).withColumn("__floor", F.floor("__share"))
    rank = F.row_number().over(Window.orderBy((F.col("__share") - F.col("__floor")).desc(), *tie))
    left = total - F.sum("__floor").over(Window.partitionBy())
    return held.withColumn(name, (F.col("__floor") + F.when(rank <= left, 1).otherwise(0)).cast("long")).drop("__share", "__floor")


#: Named builders, the extension point for own ones.
REGISTRY: dict[str, Callable[..., Column]] = {f.__name__: f for f in (logistic, clip, minmax, zscore, dot, norm, cosine, euclidean, slugify, stable_noise, tier, blend, preference_match, continuity, parse_utc)}


def register(name: str, builder: Callable[..., Column]) -> None:
    if name in REGISTRY:
        raise ValueError(f"{name!r} is taken")
    REGISTRY[name] = builder
