"""Session helpers: builder, shared scratch space, broadcast size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A small table is broadcast only while it has at most this many rows; a
# split-table row is about 40 bytes, so this is far below Spark's 8 GB limit.
BROADCAST_ROWS = 500_000

# Upper bound on a model held by the driver (and by each Python worker).
MODEL_BYTES = 1 << 30


def build_session(app: str = "graticule", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution, skew handling and UTC timestamps on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Recording the call site of every column costs more than building it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    path = tempfile.mkdtemp(prefix="graticule-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/graticule/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side of known row count, plain join beyond the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def check_model_size(cells: int, what: str) -> None:
    if cells * 8 > MODEL_BYTES:
        raise ValueError(f"{what} needs {cells * 8} bytes, more than the {MODEL_BYTES} a driver-held model may take")
