"""Ridge regression on two features, fitted again each period on the periods before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ridge_walk_forward(df: DataFrame, period: str, a: str, b: str, y: str, penalty: float) -> DataFrame:
    """(period, n_train, n_test, weight_a, weight_b, rmse) from whole-number columns; the first period has no past and no row.

    Sums of products by period are all that is shuffled; the fit and its error on the next period follow from them.
    Rows with a null are left out. No intercept.
    """
    ok = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(y).isNotNull())
    products = {"aa": (a, a), "ab": (a, b), "bb": (b, b), "ay": (a, y), "by": (b, y), "yy": (y, y)}
    sums = ok.groupBy(period).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col(p) * F.col(q)).alias(k) for k, (p, q) in products.items()))
    past = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, -1)  # a row a period
    m = sums.select(period, *(F.col(k).cast("double").alias(k) for k in products), "n", F.sum("n").over(past).alias("n_train"), *(F.sum(k).over(past).cast("double").alias(f"p_{k}") for k in products))
    aa, bb, ab, ay, by = F.col("p_aa") + penalty, F.col("p_bb") + penalty, F.col("p_ab"), F.col("p_ay"), F.col("p_by")
    det = aa * bb - ab * ab
    m = m.where("n_train is not null").withColumn("weight_a", (bb * ay - ab * by) / det).withColumn("weight_b", (aa * by - ab * ay) / det)
    error = F.expr("(yy - 2*weight_a*ay - 2*weight_b*by + weight_a*weight_a*aa + 2*weight_a*weight_b*ab + weight_b*weight_b*bb) / n")
    return m.select(period, "n_train", F.col("n").alias("n_test"), "weight_a", "weight_b", F.sqrt(error).alias("rmse"))
