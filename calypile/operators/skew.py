"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are first counted by key AND value. That aggregation combines before it shuffles and its groups are spread over the
values, so a hot key is handled by all tasks; what is left of it is one weighted row per distinct value. Counts, distinct
counts, modes and percentiles then follow exactly from the weighted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHT = "weight"
FINE_BITS = 23


def compress(df: DataFrame, keys: list[str], values: list[str], weight: str = WEIGHT) -> DataFrame:
    """One row per distinct (keys, values) with its number of rows; nulls are values like others."""
    return df.groupBy(*[F.col(f"`{c}`") for c in [*keys, *values]]).agg(F.count(F.lit(1)).alias(weight))


def compress_columns(df: DataFrame, keys: list[str], columns: list[str], kind: str, weight: str = WEIGHT) -> DataFrame:
    """compress() of several columns in one scan: (keys, column_name, value of the given type, weight)."""
    entry = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast(kind).alias("value")) for c in columns])
    long = df.select(*[F.col(f"`{k}`") for k in keys], F.explode(entry).alias("_x")).select(*[F.col(f"`{k}`") for k in keys], "_x.*")
    return compress(long, [*keys, "column_name"], ["value"], weight)


def order_bucket(value: Column) -> Column:
    """A bucket number that never falls as value grows: 64 buckets per power of two, the same for all data."""
    return _digits(value)[0]


def _digits(value: Column) -> tuple[Column, Column]:
    """(bucket, place within the bucket), together in the order of the values as double: at most 134,400 buckets, 2**FINE_BITS places in
    each, and so at most 2**(46 - FINE_BITS) different doubles at one place. The arithmetic is exact, as it only scales by powers of two."""
    x = value.cast("double")
    octave = F.floor(F.log2(F.abs(x)))
    scaled = (F.abs(x) / F.pow(F.lit(2.0), octave) - 1) * 64
    size = (octave + 1100) * 64 + F.floor(scaled) + 1
    plain = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))) & (x != 0)
    bucket = F.when(F.isnan(x), F.lit(1 << 40)).when(F.abs(x) == F.lit(float("inf")), F.signum(x) * F.lit(1 << 39)).when(x == 0, F.lit(0)).otherwise(F.signum(x) * size)
    place = F.when(plain, F.signum(x) * F.floor((scaled - F.floor(scaled)) * (1 << FINE_BITS))).otherwise(F.lit(0))
    return bucket.cast("bigint"), place.cast("int")


def same(a: str, b: str, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two aliased frames."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
    return out


def _held(value: str, weight: str) -> Column:
    """The weight of a row with a value, 0 of one without. As a product, it keeps filters above the compression, so that all that is made of
    the same compression shares its scan and shuffle."""
    return F.col(weight) * F.col(value).isNotNull().cast("int")


def key_counts(weighted: DataFrame, keys: list[str], value: str, rows: str = "n_rows", distinct: str = "n_distinct", weight: str = WEIGHT) -> DataFrame:
    """Rows and distinct non-null values of each key."""
    return weighted.groupBy(*keys).agg(F.sum(weight).alias(rows), F.count(F.col(value)).alias(distinct))


def modes(weighted: DataFrame, keys: list[str], value: str, mode: str = "mode", times: str = "mode_rows", weight: str = WEIGHT) -> DataFrame:
    """The most frequent non-null value of each key; of equally frequent ones the smallest. A key without values has no row."""
    best = F.min_by(F.struct(F.col(value).alias("v"), F.col(weight).alias("w")), F.struct(-F.col(weight), F.col(value)))
    return weighted.where(_held(value, weight) > 0).groupBy(*keys).agg(best.alias("_m")).select(*keys, F.col("_m.v").alias(mode), F.col("_m.w").alias(times))


def percentiles(weighted: DataFrame, keys: list[str], value: str, qs: dict[str, float], weight: str = WEIGHT, interpolate: bool = True) -> DataFrame:
    """Exact percentiles of each key, one column per entry of qs.

    interpolate: linear between the two nearest values, else the smallest value whose cumulative weight reaches q of the
    total. A wanted rank is narrowed down: weights are summed over ordered buckets of a key, then over the places within the buckets that hold a
    wanted rank, and only the values at those places are sorted. The three steps see at most 134,400 buckets, 2**23 places and
    2**23 different values of a key, however many the key has and however close they lie. Small integers (int and less) need two steps, of at
    most 2**16 each. Null values do not count; keys without values have no row.
    """
    own = [F.col(f"`{k}`") for k in keys]
    small = weighted.schema[value].dataType.simpleString() in ("tinyint", "smallint", "int")
    bucket, place = (F.shiftright(F.col(value), 16).cast("bigint"), None) if small else _digits(F.col(value))
    levels = ["_b"] if small else ["_b", "_d"]
    wv = weighted.select(*own, F.col(value).alias("_v"), _held(value, weight).alias("_w"), bucket.alias("_b"), *([] if small else [place.alias("_d")])).where("_w > 0")
    spec = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in qs.items()])
    rank = (F.col("_n") - 1) * F.col("_q.q")
    low = F.floor(rank) + 1 if interpolate else F.greatest(F.ceil(F.col("_n") * F.col("_q.q")), F.lit(1))
    asked: DataFrame | None = None
    for i, level in enumerate(levels):
        prefix = [*keys, *levels[:i]]
        parts = Window.partitionBy(*[F.col(f"`{k}`") for k in prefix])
        if asked is None:
            sums = wv.groupBy(*own, level).agg(F.sum("_w").alias("_bw"))
            sums = sums.withColumn("_to", F.sum("_bw").over(parts.orderBy(level))).withColumn("_n", F.sum("_bw").over(parts))
            ranked = sums.withColumn("_q", F.explode(spec)).withColumn("_r", F.explode(F.array(low, F.ceil(rank) + 1) if interpolate else F.array(low))).withColumn("_x", F.struct("_q", "_r")).drop("_q", "_r")
        else:
            near = wv.alias("b").join(asked.alias("a"), same("a", "b", prefix)).select("b.*", "a._from", "a._n", "a._ask")
            sums = near.groupBy(*[F.col(f"`{k}`") for k in [*prefix, level]]).agg(F.sum("_w").alias("_bw"), F.first("_from").alias("_from"), F.first("_n").alias("_n"), F.first("_ask").alias("_ask"))
            ranked = sums.withColumn("_to", F.col("_from") + F.sum("_bw").over(parts.orderBy(level))).withColumn("_x", F.explode("_ask"))
        wanted = ranked.where((F.col("_to") - F.col("_bw") < F.col("_x._r")) & (F.col("_x._r") <= F.col("_to")))
        asked = wanted.groupBy(*[F.col(f"`{k}`") for k in [*prefix, level]]).agg(F.first(F.col("_to") - F.col("_bw")).alias("_from"), F.first("_n").alias("_n"), F.collect_set("_x").alias("_ask"))
    inside = Window.partitionBy(*[F.col(f"b.`{k}`") for k in [*keys, *levels]]).orderBy("_v")
    hits = (
        wv.alias("b").join(asked.alias("a"), same("a", "b", [*keys, *levels]))
        .withColumn("_cum", F.col("_from") + F.sum("_w").over(inside))
        .withColumn("_x", F.explode("_ask"))
        .where((F.col("_cum") >= F.col("_x._r")) & (F.col("_cum") - F.col("_w") < F.col("_x._r")))
        .select(*[F.col(f"b.`{k}`").alias(k) for k in keys], F.col("_x._q.name").alias("_name"), F.col("_x._q.q").alias("_qq"), F.col("_x._r").alias("_r"), "_n", F.col("_v").cast("double").alias("_v"))
    )
    if not interpolate:
        return hits.groupBy(*own).agg(*[F.max(F.when(F.col("_name") == n, F.col("_v"))).alias(n) for n in qs])
    ends = hits.groupBy(*own, "_name", "_qq", "_n").agg(F.min_by("_v", "_r").alias("_lo"), F.max_by("_v", "_r").alias("_hi"))
    part = (F.col("_n") - 1) * F.col("_qq") - F.floor((F.col("_n") - 1) * F.col("_qq"))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part
    return ends.withColumn("_at", at).groupBy(*own).agg(*[F.max(F.when(F.col("_name") == n, F.col("_at"))).alias(n) for n in qs])


def heavy_keys(weighted: DataFrame, key: str, share: float, rows: str = "n_rows", weight: str = WEIGHT) -> DataFrame:
    """Non-null keys that hold at least share of all rows; rows with a null key count in the total."""
    per_key = weighted.groupBy(key).agg(F.sum(weight).alias(rows))
    total = per_key.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("t")).scalar()
    return per_key.where(F.col(rows) * F.col(key).isNotNull().cast("int") >= F.greatest(F.lit(share).cast("decimal(20,10)") * total, F.lit(1)))
