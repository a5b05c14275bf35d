"""Cleaning, quality gates, thinning, sinks that skip what hasn't changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rolling import ordered


def compact_date(number: Column) -> Column:
    """A date from a number such as 20240131; null where it is none."""
    return F.try_to_date(number.cast("string"), "yyyyMMdd")


def finite(x: Column, digits: int) -> Column:
    """``x`` rounded; null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.round(x, digits))


def settled(day: Column, now: Column, close_minute: int = 15 * 60 + 30) -> Column:
    """Whether a day's bar is final at ``now``: earlier days are, the day itself from ``close_minute`` on, later days never."""
    minute = F.hour(now) * 60 + F.minute(now)
    return (day < F.to_date(now)) | ((day == F.to_date(now)) & (minute >= close_minute))


def normalise_names(name: Column, rules: list[tuple[str, str]]) -> Column:
    """``name`` trimmed, then by the first rule (pattern, replacement) that it matches whole; else as it is."""
    text = F.trim(name)
    out = None
    for pattern, to in rules:
        hit = text.rlike(f"^(?:{pattern})$")
        made = F.regexp_replace(text, f"^(?:{pattern})$", to)
        out = F.when(hit, made) if out is None else out.when(hit, made)
    return text if out is None else out.otherwise(text)


def recovered_duration(df: DataFrame, key: str, day: str, duration: str, ties: str | None = None) -> DataFrame:
    """``df`` with a missing duration taken from the key's last known one, less the calendar years since (never below 0),
    and ``recovered``. ``ties`` orders rows of one day."""
    order = [day, ties] if ties else [day]
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col(duration).isNotNull(), F.struct(F.col(day).alias("d"), F.col(duration).alias("v"))), ignorenulls=True).over(before)
    aged = F.greatest(F.col("__known")["v"] - F.datediff(F.col(day), F.col("__known")["d"]) / 365, F.lit(0.0))
    found = df.withColumn("__known", known).withColumn("recovered", F.col(duration).isNull() & F.col("__known").isNotNull())
    return found.withColumn(duration, F.coalesce(F.col(duration), aged)).drop("__known")


def coverage(columns: list[str]) -> Column:
    """Share of the columns that have a finite value."""
    have = [(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).cast("int") for c in columns]
    return sum(have, F.lit(0)) / len(columns)


def problems(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail (or are null), as an array; empty where all is well."""
    named = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def thinned(df: DataFrame, value: str, keys: list[str], most: int, order: str = "s") -> DataFrame:
    """At most ``most`` of a key's rows that have a value, evenly spaced, the first and the last among them."""
    have = df.where(F.col(value).isNotNull())
    i, n = F.row_number().over(ordered(keys, order)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*keys))
    placed = have.withColumn("__i", i).withColumn("__n", n)
    slot, before = (F.floor((F.col("__i") + d) * (most - 1) / F.greatest(F.col("__n") - 1, F.lit(1))) for d in (0, -1))
    keep = (F.col("__n") <= most) | (F.col("__i") == 0) | (slot > before)
    return placed.where(keep).drop("__i", "__n")


def latest(df: DataFrame, keys: list[str], rows: int, order: str) -> DataFrame:
    """The last ``rows`` rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("__p", place).where(F.col("__p") <= rows).drop("__p")


def above_group_percentile(df: DataFrame, value: str, group: str, share: float) -> DataFrame:
    """Rows whose |value| reaches their group's quantile ``share``."""
    cut = df.groupBy(group).agg(F.percentile(F.abs(F.col(value)), F.lit(share)).alias("__cut"))
    return df.join(cut, group).where(F.abs(F.col(value)) >= F.col("__cut")).drop("__cut")


def keep_longer(stored: DataFrame, fresh: DataFrame, key: str, slack: int = 5) -> DataFrame:
    """Per key the fresh series, or the stored one where the fresh has over ``slack`` rows less."""
    sizes = stored.groupBy(key).agg(F.count(F.lit(1)).alias("__a")).join(fresh.groupBy(key).agg(F.count(F.lit(1)).alias("__b")), key, "full")
    old = sizes.where(F.coalesce("__b", F.lit(0)) + slack < F.coalesce("__a", F.lit(0))).select(key)
    return fresh.join(old, key, "left_anti").unionByName(stored.join(old, key, "left_semi"))


def content_digest(df: DataFrame, ignored: list[str] | None = None) -> str:
    """A digest of the rows whatever their order, without the columns ``ignored`` (such as time stamps)."""
    own = sorted(c for c in df.columns if c not in (ignored or []))
    row = F.sha2(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)") for a in (1, 13, 25)]
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(h), F.lit(0)).cast("string").alias(f"h{i}") for i, h in enumerate(halves)]).first()
    return "-".join(str(v) for v in sums)


def write_if_changed(df: DataFrame, path: str, ignored: list[str] | None = None) -> bool:
    """Write ``df`` as Parquet unless what stands at ``path`` holds the same rows but for ``ignored``; whether it wrote."""
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        old = spark.read.parquet(path)
        if set(old.columns) == set(df.columns) and content_digest(old, ignored) == content_digest(df, ignored):
            return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_shards(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Write ``df`` as JSON, a folder a shard, and return the index (by, rows)."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).json(path)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, every text quoted and quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def append_new(df: DataFrame, path: str, day: str) -> int:
    """Append the rows of days that the table at ``path`` hasn't; a second run appends none. The number of rows appended."""
    known = df.sparkSession.read.parquet(path).select(day).distinct()
    fresh = df.join(known, day, "left_anti").cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n
