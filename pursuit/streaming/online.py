"""Online dictionary learning from a stream, and stateless encoding of one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.learn import OnlineLearner


class StreamingLearner:
    """One micro-batch is one mini-batch. State (A, B, D, batch id) is a table per batch id, so a replayed batch starts from the state before it."""

    def __init__(self, learner: OnlineLearner, state_path: str, beta: float = 1.0):
        self.learner, self.path, self.beta = learner, state_path.rstrip("/"), beta

    def _save(self, spark, batch_id: int) -> None:
        x = self.learner
        rows = [(name, list(a.shape), a.ravel().tolist()) for name, a in (("D", x.D), ("A", x.A), ("B", x.B)) if a is not None]
        spark.createDataFrame(rows, "name string, shape array<int>, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def _load(self, spark, batch_id: int) -> None:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch_id}/_SUCCESS")
        if batch_id >= 0 and p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            for r in spark.read.parquet(f"{self.path}/batch={batch_id}").collect():
                setattr(self.learner, r["name"], np.array(r["v"]).reshape(r["shape"]))

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self._load(spark, batch_id - 1)
        if not batch.isEmpty():
            if self.learner.D is None:
                raise ValueError("a streaming learner needs an initial dictionary")
            self.learner.step(batch, self.beta)
        self._save(spark, batch_id)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        """Begins the query on a stream of (id, x)."""
        writer = stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def vectors_of(events: DataFrame, width: int, time_col: str = "ts", key: str = "user_id", value: str = "value", late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Event values gathered per key and time window into vectors of a fixed length; late rows beyond the watermark are dropped by it."""
    rows = events.withWatermark(time_col, late).groupBy(F.window(time_col, window), key).agg(F.array_sort(F.collect_list(F.struct(F.col(time_col).alias("t"), F.col(value).alias("v")))).alias("s"))
    x = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.get(F.col("s"), i - 1)["v"], F.lit(0.0)))
    return rows.select(F.xxhash64("window", key).alias("id"), x.alias("x"))
