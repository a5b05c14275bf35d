"""Forecasts by strength: boundaries by sign, classes, and moving-block resampling whose draws all classes and models share.

A draw is a row of blocks of sessions. What a statistic needs of a block is its sums, so rows are added up once by block start
(each row is in ``block`` of them) and a draw adds blocks, not rows. Statistics come from sums of the same draws, so a
difference between models or classes is paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def boundaries(df: DataFrame, keys: list[str], value: str, shares: tuple[float, ...] = (1 / 3, 2 / 3)) -> DataFrame:
    """(keys, side, n, least, most, cuts): quantiles of |value| of each sign (1, -1), linear between neighbours; zero and null have no side.

    Under three values of a side there are no cuts (null). Values are ranked by a sort, so a key of any size fits.
    """
    rows = df.where(F.col(value).isNotNull() & (F.col(value) != 0)).select(*keys, F.signum(value).cast("int").alias("side"), F.abs(value).alias("v"))
    w = Window.partitionBy(*keys, "side")
    ranked = rows.withColumns({"i": F.row_number().over(w.orderBy("v")) - 1, "n": F.count(F.lit(1)).over(w)})
    parts = []
    for q in shares:
        at = F.lit(q) * (F.col("n") - 1)
        low, high = (F.max(F.when(F.col("i") == f(at), F.col("v"))) for f in (F.floor, F.ceil))
        place = F.lit(q) * (F.max("n") - 1)
        parts.append(low + (high - low) * (place - F.floor(place)))
    return ranked.groupBy(*keys, "side").agg(F.max("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.when(F.max("n") >= 3, F.array(*parts)).alias("cuts"))


def classify(df: DataFrame, bounds: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with ``code``: side x (1 + the cuts under |value|); 0 for zero, null for null, and side x 99 where the side has no cuts."""
    side = F.signum(value).cast("int")
    at = df.withColumn("side", side).join(bounds.select(*keys, "side", "cuts"), [*keys, "side"], "left")
    under = F.size(F.filter("cuts", lambda c: c < F.abs(value)))
    code = F.when(F.col("side") == 0, 0).when(F.col("cuts").isNull(), F.col("side") * 99).otherwise(F.col("side") * (1 + under))
    return at.withColumn("code", F.when(F.col(value).isNotNull(), code)).drop("side", "cuts")


def starts(spark, sessions: int, draws: int, block: int = 12, seed: int = 42) -> DataFrame:
    """(draw, b, start): where each block of each draw begins, by a digest of seed, draw and block, so that a lost task draws the same again."""
    rows = spark.range(draws).withColumnRenamed("id", "draw").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(-(-sessions // block) - 1))))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("b").cast("string")))
    return rows.withColumn("start", F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(sessions - block + 1)))


def drawn_sums(df: DataFrame, groups: list[str], order: str, sums: dict[str, Column], draws: int = 2000, block: int = 12, seed: int = 42) -> DataFrame:
    """(draw, groups, sums): each group's sums over the sessions of each draw.

    Blocks are of the distinct sessions of ``df``, in order; a session without a row of a group adds nothing to it and keeps its
    place. The last block is cut so that a draw has as many sessions as there are. Under ``block`` sessions there are no rows;
    nor has a group one in a draw that none of its rows is in. The driver learns the number of sessions.
    """
    places = df.select(order).distinct().withColumn("__i", F.row_number().over(Window.orderBy(order)) - 1)
    n = places.count()
    rest = (n - 1) % block + 1
    each = df.select(*groups, order, *[e.alias(c) for c, e in sums.items()]).join(places, order)
    spread = each.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).withColumn("start", F.col("__i") - F.col("__k"))
    short = F.col("__k") < rest
    blocks = spread.where(F.col("start") >= 0).groupBy(*groups, "start").agg(*[F.sum(c).alias(c) for c in sums], *[F.sum(F.when(short, F.col(c))).alias(f"__{c}") for c in sums])
    drawn = starts(df.sparkSession, max(n, block), draws if n >= block else 0, block, seed)
    last = F.col("b") == -(-n // block) - 1
    return drawn.join(blocks, "start").groupBy("draw", *groups).agg(*[F.sum(F.when(last, F.col(f"__{c}")).otherwise(F.col(c))).alias(c) for c in sums])


def intervals(stats: DataFrame, by: list[str], names: list[str], draws: int) -> DataFrame:
    """(by, name, low, high, valid): 2.5 and 97.5 % of each statistic over the draws; null where under 0.9 of the draws have it."""
    long = stats.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in names])).alias("r")).select(*by, "r.*")
    ends = long.groupBy(*by, "name").agg(F.count("v").alias("valid"), F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    good = F.col("valid") >= int(0.9 * draws)
    return ends.select(*by, "name", F.when(good, F.col("q")[0]).alias("low"), F.when(good, F.col("q")[1]).alias("high"), "valid")


def strata(df: DataFrame, keys: list[str], order: str, y: str, draws: int = 2000, block: int = 12, seed: int = 42) -> DataFrame:
    """(draw, keys, code, signed_mean, direction_accuracy) of each class of ``classify`` in each draw: the outcome in the class's own direction."""
    way = F.signum(F.col("code").cast("double"))
    rows = df.where(F.col("code").isNotNull())
    out = F.col(y).cast("double") * way
    sums = {"rows": F.when(F.col(y).isNotNull(), 1), "total": out, "moved": F.when(F.col(y) != 0, 1), "hits": F.when(F.col(y).isNotNull(), (out > 0).cast("int"))}
    made = drawn_sums(rows, [*keys, "code"], order, sums, draws, block, seed)
    return made.select("draw", *keys, "code", (F.col("total") / F.nullif("rows", F.lit(0))).alias("signed_mean"), (F.col("hits") / F.nullif("moved", F.lit(0))).alias("direction_accuracy"))


def contrasts(drawn: DataFrame, keys: list[str], strong: int = 3) -> DataFrame:
    """(draw, keys, side, signed_mean, direction_accuracy): the strongest class of ``strata`` less the weakest, of the same draws."""
    names = ["signed_mean", "direction_accuracy"]
    side = F.signum(F.col("code").cast("double")).cast("int")
    at = drawn.where(F.abs("code").isin(1, strong)).withColumn("side", side)
    pick = lambda c, k: F.max(F.when(F.abs("code") == k, F.col(c)))
    return at.groupBy("draw", *keys, "side").agg(*[(pick(c, strong) - pick(c, 1)).alias(c) for c in names])


def forecast_figures(df: DataFrame, model: str, order: str, prediction: str, y: str, draws: int = 2000, block: int = 12, seed: int = 42) -> DataFrame:
    """(draw, model, mae, rmse, direction_accuracy, ic) of each model in each draw; rows without a prediction or an outcome add nothing."""
    p, t = F.col(prediction).cast("double"), F.col(y).cast("double")
    have = p.isNotNull() & t.isNotNull()
    only = lambda e: F.when(have, e)
    sums = {"n": only(F.lit(1)), "a": only(F.abs(p - t)), "e": only((p - t) * (p - t)), "m": only((t != 0).cast("int")), "h": only((p * t > 0).cast("int")), "p": only(p), "t": only(t), "pp": only(p * p), "tt": only(t * t), "pt": only(p * t)}
    s = drawn_sums(df, [model], order, sums, draws, block, seed)
    n = F.nullif("n", F.lit(0))
    vp, vt = (F.col(f"{c}{c}") / n - F.pow(F.col(c) / n, F.lit(2)) for c in ("p", "t"))
    fine = (vp > F.lit(1e-12) * F.col("pp") / n) & (vt > F.lit(1e-12) * F.col("tt") / n)
    ic = F.when(fine, (F.col("pt") / n - F.col("p") / n * F.col("t") / n) / F.sqrt(vp * vt))
    return s.select("draw", model, (F.col("a") / n).alias("mae"), F.sqrt(F.col("e") / n).alias("rmse"), (F.col("h") / F.nullif("m", F.lit(0))).alias("direction_accuracy"), ic.alias("ic"))


def paired(figures: DataFrame, model: str, reference: str) -> DataFrame:
    """(draw, model, figures): each model's figures less those of ``reference`` in the same draw, to 12 decimals, as sums of doubles
    depend on their order: equal forecasts differ by 0."""
    names = [c for c in figures.columns if c not in ("draw", model)]
    own = figures.where(F.col(model) == reference).select("draw", *[F.col(c).alias(f"__{c}") for c in names])
    return figures.where(F.col(model) != reference).join(own, "draw").select("draw", model, *[F.round(F.col(c) - F.col(f"__{c}"), 12).alias(c) for c in names])
