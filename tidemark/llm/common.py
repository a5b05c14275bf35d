"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a session on one machine gets its own where it names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bound an Arrow batch in rows and in bytes, so that a batch of long texts fits a Python worker.

    Spark reads both settings when a job starts, so they stay in the session; neither is ever raised.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of ``docs``, and the columns named; other columns, whatever their names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow where ``function`` turns an iterator of dicts of Python lists into such dicts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for columns in function(dict(zip(b.schema.names, (c.to_pylist() for c in b.columns), strict=True)) for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type, from_pandas=True) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def held_out(column: str, modulus: int, remainder: int):
    """Boolean column: crc32 of the id as text has that remainder."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b); component is the smallest id reachable.

    Alternating large and small stars: a logarithmic number of rounds. Minima are pre-aggregated before the shuffle, and
    joins on a hub are plain equi-joins, which adaptive execution splits. Self-edges and nulls are ignored; no edges, no rows.
    """
    spark = edges.sparkSession
    pairs = edges.where("a is not null and b is not null and a <> b")
    now = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        stats = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if stats[0] == 0 or stats == state:
            break
        state = stats
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least2, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.union(least2.select("a", F.col("m").alias("b"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component")
    return stars.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
