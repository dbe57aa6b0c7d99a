"""Session helpers shared by all operators: shared scratch tables, checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where that is unset, a private one in local mode (tests), else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dirs:
        _own_dirs.append(tempfile.TemporaryDirectory(prefix="kbforge-"))
        atexit.register(_own_dirs[0].cleanup)
    return f"file://{_own_dirs[0].name}"


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, label: str = "t") -> str:
        self.count += 1
        return f"{self.base}/{label}{self.count}"

    def cut(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write df once and read it back, so that later plans start from the stored rows."""
        at = self.path(label)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch_path = at
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        """Delete tables returned by cut() that no later plan reads."""
        for df in dfs:
            at = getattr(df, "_scratch_path", None)
            if at:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(at)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Free what plans that are done hold on the driver: broadcasts and shuffles go only once the driver collects its garbage, and its heap grows until then."""
    gc.collect()  # Python's references keep the JVM's plans
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast only after counting that df has at most max_rows rows; else let Catalyst join by shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
