"""Incremental map training and scoring of arriving rows.

One micro-batch is one batch-map step, blended into the codebook with a learning
rate: ``w + eta(t) (w* - w)``. The codebook after batch t is a small snapshot
table named by t, written with the id of the streaming query. A restarted batch finds its
own snapshot and does nothing, so every batch counts once however often it is
attempted; a folder that another query has filled is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graticule.functions.schedules import decayed
from graticule.plans.som import Codebook, assign, unit_sums, updated


def snapshot_path(folder: str, batch_id: int) -> str:
    return f"{folder.rstrip('/')}/batch={batch_id}"


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether the write to ``path`` was committed."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def _refuse_other(spark: SparkSession, path: str, query: str) -> None:
    found = spark.read.parquet(path).select("query").first()[0]
    if found != query:
        raise ValueError(f"{path} belongs to another streaming query; use a folder of its own")


def load_snapshot(spark: SparkSession, folder: str, batch_id: int, rows: int, cols: int) -> Codebook:
    return Codebook.from_table(spark.read.parquet(snapshot_path(folder, batch_id)), rows, cols)


def blended(old: Codebook, target: Codebook, rate: float) -> Codebook:
    return Codebook(old.rows, old.cols, old.weights + rate * (target.weights - old.weights))


class IncrementalSom:
    """The ``foreachBatch`` body and its parameters."""

    def __init__(
        self,
        init: Codebook,
        folder: str,
        sigma_0: float = 4.0,
        sigma_f: float = 0.1,
        eta_0: float = 0.5,
        eta_f: float = 0.01,
        tau: float = 10.0,
        switch_at: int | None = None,
        features: str = "features",
    ) -> None:
        self.init, self.folder, self.features = init, folder, features
        self.sigma, self.eta = (sigma_0, sigma_f), (eta_0, eta_f)
        self.tau, self.switch_at, self.query = tau, switch_at, ""

    def step(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = snapshot_path(self.folder, batch_id)
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or self.query
        if _finished(spark, path):
            return _refuse_other(spark, path, query)
        self.query = query
        old = self.init
        if batch_id > 0:
            _refuse_other(spark, snapshot_path(self.folder, batch_id - 1), query)
            old = load_snapshot(spark, self.folder, batch_id - 1, old.rows, old.cols)
        sigma = decayed(batch_id, *self.sigma, self.tau, self.switch_at)
        eta = decayed(batch_id, *self.eta, self.tau, self.switch_at)
        target = updated(old, unit_sums(batch, old, self.features).collect(), sigma)
        found = blended(old, target, eta).to_table(spark).withColumn("query", F.lit(query))
        found.coalesce(1).write.mode("overwrite").parquet(path)

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = False) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()


def score_stream(stream: DataFrame, codebook: Codebook, features: str = "features") -> DataFrame:
    """Best units of arriving rows; stateless, so any sink and trigger work."""
    return assign(stream, codebook, features)
