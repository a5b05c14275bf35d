"""Embedding near-duplicates: sorted projection passes, then exact links within the components found."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import connected_components, materialize, read

KEYED = "pass int, label long, sig long, vec_id long, half binary"
EDGE = "a long, b long, sure boolean, pass int, border int, side int, label long, vec_id long, half binary"
#: A half keeps 11 bits: with both sides rounded, and a float sum, a cosine is off by less than this.
HALF_ERROR = 0.0012


def unit_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, label, unit): double unit vectors of the rows that can link. Null labels, and vectors that are null,
    empty, zero or hold a null or a non-finite component, can't."""
    x = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("x", lambda v: v != 0), F.lit(False)))
    top = usable.withColumn("top", F.array_max(F.transform("x", F.abs))).withColumn("x", F.transform("x", lambda v: v / F.col("top")))  # no overflow
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return top.withColumn("norm", norm).select("vec_id", "label", F.transform("x", lambda v: v / F.col("norm")).alias("unit"))


def _matrix(column) -> np.ndarray:
    rows = [np.asarray(x, float) for x in column]
    return np.stack(rows) if rows else np.zeros((0, 0))


def _planes(pass_: int, width: int, bits: int) -> np.ndarray:
    return np.random.default_rng([pass_, width]).standard_normal((width, bits))


def _window_links(ids, labels, units, window: int, cosine: float):
    """Stars over the sorted rows whose window neighbours are surely near, (a, b): each linked row with the first row it
    hangs on; and the pairs (a, b) that half precision can't tell."""
    root = np.arange(len(ids))
    unsure = [np.zeros((0, 2), np.int64)]

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for step in range(1, min(window, len(ids) - 1) + 1):
        dots = np.einsum("ij,ij->i", units[:-step], units[step:])
        close = np.nonzero((dots >= cosine - HALF_ERROR) & (labels[:-step] == labels[step:]))[0]
        for i in close[dots[close] >= cosine + HALF_ERROR].tolist():
            a, b = find(i), find(i + step)
            root[max(a, b)] = min(a, b)
        at = close[dots[close] < cosine + HALF_ERROR]
        unsure.append(np.stack([ids[at], ids[at + step]], axis=1))
    top = np.array([find(i) for i in range(len(ids))], np.int64)
    far = top != np.arange(len(ids))
    return (ids[far], ids[top[far]]), np.concatenate(unsure)


def passes_needed(classes: DataFrame, cosine: float, window: int, miss: float = 0.02) -> DataFrame:
    """(label, passes): projection passes after which a pair at ``cosine`` is missed with about the probability ``miss``.

    Two random vectors of a label share a sign with probability q (from the label's mean cosine, that is the squared
    length of its mean vector), two at ``cosine`` with p. A window holds those that share the first ln(n / window) / ln(1/q)
    signs of n, so a pass finds the pair with p to that power. The number grows as a low power of n; a quarter is added.
    """
    sizes = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    sums = classes.select("label", F.posexplode("unit").alias("k", "v")).groupBy("label", "k").agg(F.sum("v").alias("v"))
    mean = sums.groupBy("label").agg(F.sum(F.col("v") * F.col("v")).alias("sq")).join(sizes, "label").withColumn("c", F.least(F.col("sq") / (F.col("n") * F.col("n")), F.lit(cosine)))
    same = 1 - F.acos(F.greatest("c", F.lit(0.0))) / math.pi
    signs = F.ln(F.col("n") / window) / -F.ln(same)
    hit = F.pow(F.lit(1 - math.acos(cosine) / math.pi), signs)
    passes = F.ceil(1.25 * math.log(miss) / F.ln(1 - F.least(hit, F.lit(0.999))))
    return mean.select("label", F.when(F.col("n") <= window + 1, 1).otherwise(F.greatest(passes, F.lit(6))).cast("int").alias("passes"))


def projection_links(vectors: DataFrame, cosine: float, window: int, bits: int, partitions: int) -> DataFrame:
    """(a, b): links that join what the passes find; ``vectors`` holds each one's number of ``passes``.

    In each pass the vectors of a label are ordered by their concatenated sign hashes, and each is compared with
    ``window`` followers; where a partition ends, its last rows meet the first of the next one. Vectors are sorted in half
    precision; the pairs that it can't tell are looked at again as they are.
    """
    out = to_arrow_schema(StructType.fromDDL(KEYED))

    def sign(batches):
        for b in batches:
            units = [np.asarray(x.as_py(), float) for x in b.column("unit")]
            ids, labels, passes = (b.column(c).to_numpy() for c in ("vec_id", "label", "passes"))
            halves = [u.astype(np.float16).tobytes() for u in units]
            width = np.array([len(u) for u in units])
            for k in range(int(passes.max(initial=0))):
                on = np.nonzero(passes > k)[0]
                sigs = np.zeros(len(units), np.int64)
                for w in set(width[on].tolist()):
                    rows = on[width[on] == w]
                    signs = np.stack([units[i] for i in rows]) @ _planes(k, w, bits) > 0
                    sigs[rows] = signs @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), k, np.int32)), pa.array(labels[on]), pa.array(sigs[on]), pa.array(ids[on]), pa.array([halves[i] for i in on], pa.binary())], schema=out)

    keyed = vectors.select("vec_id", "label", "unit", "passes").mapInArrow(sign, KEYED)
    dealt = keyed.repartitionByRange(partitions, "pass", "label", "sig", "vec_id").sortWithinPartitions("pass", "label", "sig", "vec_id")
    dealt = dealt.withColumn("part", F.spark_partition_id())

    def compare(frames):
        head, tail, part = None, None, 0
        for f in frames:
            if not len(f):
                continue
            part = int(f["part"].iloc[0])
            if head is None:
                head = f.iloc[:window]
            elif len(head) < window:
                head = pd.concat([head, f.iloc[: window - len(head)]])
            rows = f if tail is None else pd.concat([tail, f])
            yield from linked(rows)
            tail = rows.iloc[-window:]
        for side, rows in ((0, tail), (1, head)):
            if rows is not None:
                yield pd.DataFrame({"a": None, "b": None, "sure": None, "pass": rows["pass"], "border": part + 1 - side, "side": side, "label": rows["label"], "vec_id": rows["vec_id"], "half": rows["half"]})

    def linked(rows):
        for _, group in rows.groupby(rows["half"].map(len), sort=False):
            keys = group["pass"].to_numpy(np.int64) * 2**32 + pd.factorize(group["label"])[0]
            units = np.stack([np.frombuffer(h, np.float16) for h in group["half"]]).astype(np.float32)
            (a, b), unsure = _window_links(group["vec_id"].to_numpy(), keys, units, window, cosine)
            sure = np.arange(len(a) + len(unsure)) < len(a)
            yield pd.DataFrame({"a": np.concatenate([a, unsure[:, 0]]), "b": np.concatenate([b, unsure[:, 1]]), "sure": sure, "pass": None, "border": None, "side": None, "label": None, "vec_id": None, "half": None})

    found = materialize(dealt.mapInPandas(compare, EDGE), "passes")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("side", kind="stable")
        return pd.concat([x[["a", "b", "sure"]] for x in linked(rows)])

    borders = found.where("side is not null").select("pass", "border", "side", "label", "vec_id", "half")
    both = borders.join(borders.groupBy("border").agg(F.max("side").alias("hi"), F.min("side").alias("lo")).where("hi > lo").select("border"), "border", "left_semi")
    edges = materialize(found.where("a is not null").select("a", "b", "sure").union(both.groupBy("border").applyInPandas(meet, "a long, b long, sure boolean")), "near")
    own = vectors.select(F.col("vec_id"), "unit")
    unsure = edges.where(~F.col("sure")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = unsure.join(own.select(F.col("vec_id").alias("a"), F.col("unit").alias("x")), "a").join(own.select(F.col("vec_id").alias("b"), F.col("unit").alias("y")), "b")
    dot = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return edges.where("sure").select("a", "b").union(pairs.where(dot >= cosine).select("a", "b"))


def count_links(members: DataFrame, cosine: float, block: int = 512) -> DataFrame:
    """(vec_id, n_links): exact numbers of links within each ``component`` of ``members`` (vec_id, component, unit).

    Vectors within half the angle of the component's mean direction are surely linked to one another and only counted;
    all others, the rest, are compared with every member, block by block.
    """
    core_cosine = np.sqrt((1 + cosine) / 2) + 1e-9
    spread = members.select("component", F.posexplode("unit").alias("k", "v")).groupBy("component", "k").agg(F.sum("v").alias("v"))
    centre = spread.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("c"))
    dot = F.aggregate(F.zip_with("unit", "c", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, v: s + v * v))
    sided = materialize(members.join(centre, "component").select("component", "vec_id", "unit", F.coalesce(dot >= core_cosine * size, F.lit(False)).alias("core")), "members")
    sizes = sided.groupBy("component").agg(F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_rest"))
    sure = sided.where("core").join(sizes, "component").select("vec_id", (F.col("n_core") - 1).alias("n"))

    blocks = F.ceil(F.col("n_rest") / F.lit(block)).cast("int")
    with_rest = sided.join(sizes.where("n_rest > 0"), "component").withColumn("blocks", blocks)
    mine = F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("long")).cast("int")
    parts = F.ceil((F.col("n_rest") + F.col("n_core")) / F.lit(4 * block)).cast("int")
    part = F.pmod(F.xxhash64(F.lit(3), "vec_id"), parts.cast("long")).cast("int")
    rest = with_rest.where(~F.col("core")).select("component", mine.alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(True).alias("asks"), "vec_id", "core", "unit")
    every = with_rest.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), F.lit(False).alias("asks"), "vec_id", "core", "unit")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        asks, others = rows[rows["asks"]], rows[~rows["asks"]]
        if not len(asks) or not len(others):
            return pd.DataFrame({"vec_id": [], "n": []}).astype("int64")
        a, b = asks["vec_id"].to_numpy(), others["vec_id"].to_numpy()
        near = (_matrix(asks["unit"]) @ _matrix(others["unit"]).T >= cosine) & (a[:, None] != b[None, :])
        core = others["core"].to_numpy(bool)
        return pd.DataFrame({"vec_id": np.concatenate([a, b[core]]), "n": np.concatenate([near.sum(axis=1), near[:, core].sum(axis=0)])})

    checked = rest.union(every).groupBy("component", "block", "part").applyInPandas(compare, "vec_id long, n long")
    return sure.union(checked).groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def near_duplicate_vectors(table: DataFrame, cosine: float = 0.93, window: int = 24, bits: int = 48) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``table`` (vec_id, embedding, label).

    A label's number of passes follows from its classes (``passes_needed``). Vectors that are null, empty, zero or hold a
    null or non-finite component, and rows with a null label or a null vec_id, link with nothing. Equal vectors of a label
    are one class while the passes run, and counted again at the end. Ties in the order go by vec_id. Rows that share a
    vec_id are one vector, that of the least label, then of the least components, among those that can link; they come back
    as often as they are, each with its links. No rows, no rows.
    """
    spark = table.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    vectors = materialize(unit_vectors(table).groupBy("vec_id").agg(F.min(F.struct("label", "unit")).alias("v")).select("vec_id", "v.label", "v.unit"), "vectors")
    classes = materialize(vectors.groupBy("label", "unit").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    dealt = classes.join(passes_needed(classes, cosine, window), "label")
    edges = projection_links(dealt.select(F.col("rep").alias("vec_id"), "label", "unit", "passes"), cosine, window, bits, partitions)
    joined = materialize(connected_components(edges), "components")
    # within components, and among copies, each copy is a vector of its own
    held = classes.join(joined, classes["rep"] == joined["id"], "left").where("component is not null or copies > 1").select("label", "unit", F.coalesce("component", "rep").alias("component"))
    members = materialize(vectors.join(held, ["label", "unit"]).select("vec_id", "component", "unit"), "linked")
    counted = count_links(members, cosine)
    known = members.select("vec_id", "component").join(counted, "vec_id", "left")
    ids = table.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.join(known, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; see ``near_duplicate_vectors``."""
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
