"""Row-count windows over a stream: event-time windows can't count rows, so each key keeps its last values as state."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout


def rolling_mean(rows: DataFrame, key: str, time: str, id_: str, value: str, size: int) -> DataFrame:
    """(id, key, late, n, total): count and sum of the last ``size`` values of a key at each of its rows.

    Within a batch rows go by (time, id). A row before the key's newest of earlier batches is late: it is reported with
    nulls and isn't applied, so what was published never changes. Null values aren't counted but keep their slot.
    """
    types = dict(rows.dtypes)

    def step(group, batches, state):
        newest, last = state.get if state.exists else (None, [])
        last = list(last)
        found = pd.concat(list(batches)).sort_values([time, id_])
        ids, late, counts, totals = [], [], [], []
        edge = pd.Timestamp(newest) if newest is not None else None
        for t, i, v in zip(found[time], found[id_], found[value], strict=True):
            ids.append(i)
            late.append(edge is not None and t < edge)
            if late[-1]:
                counts.append(None)
                totals.append(None)
                continue
            last = [*last[1 - size :], None if pd.isna(v) else int(v)] if size > 1 else [None if pd.isna(v) else int(v)]
            known = [x for x in last if x is not None]
            counts.append(len(known))
            totals.append(sum(known))
            newest = t if newest is None or t > pd.Timestamp(newest) else newest
        state.update((str(newest) if newest is not None else None, last))
        yield pd.DataFrame({id_: ids, key: [group[0]] * len(ids), "late": late, "n": pd.array(counts, "Int64"), "total": pd.array(totals, "Int64")})

    return rows.groupBy(key).applyInPandasWithState(
        step, f"{id_} {types[id_]}, {key} {types[key]}, late boolean, n long, total long", "newest string, last array<long>", "append", GroupStateTimeout.NoTimeout
    )


def replay(stream: DataFrame, name: str, checkpoint: str | None = None, sink: str | None = None) -> DataFrame:
    """Run ``stream`` over what its source holds now, append to ``sink`` and read that. With the same ``checkpoint`` and
    ``sink`` a later run goes on where this one ended and repeats nothing."""
    spark = stream.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-shared-")
    base = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    sink = sink or f"{base}/rows"
    job = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint or f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)
