"""The knowledge base: rows, hash-first reconciliation, vacuum, versioned commits.

Parquet has no UPDATE or DELETE: a commit writes a new version directory in full and then moves the _CURRENT pointer; readers
resolve the pointer once. A single writer holds a lock file on the driver.
"""

from __future__ import annotations

import fcntl
import os
import shutil
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HASH_ROW_CAP = 10_000


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def escape_literal(value: str) -> str:
    """Quotes doubled, for texts shown in SQL; filters here use literals and need none."""
    if not isinstance(value, str):
        raise TypeError(f"a string is needed, not {type(value).__name__}")
    return value.replace("'", "''")


def classify(docs: DataFrame, kb: DataFrame, cap: int | None = HASH_ROW_CAP) -> DataFrame:
    """Add action to documents (content_hash, file_path): unchanged, moved, changed or new.

    A hash held by `cap` rows or more counts as not found, so that the path rule decides; with cap None every hash is found. Null hashes or paths match nothing.
    """
    held = kb.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count("*").alias("_n")).where(F.col("_n") < cap if cap is not None else F.lit(True)).select("content_hash", F.lit(True).alias("_hash"))
    same = kb.select("content_hash", "file_path").where("content_hash is not null and file_path is not null").distinct().withColumn("_same", F.lit(True))
    paths = kb.select("file_path").where("file_path is not null").distinct().withColumn("_path", F.lit(True))
    d = docs.join(held, "content_hash", "left").join(same, ["content_hash", "file_path"], "left").join(paths, "file_path", "left")
    known = F.coalesce("_hash", F.lit(False))
    action = F.when(known & F.coalesce("_same", F.lit(False)), "unchanged").when(known, "moved").when(F.coalesce("_path", F.lit(False)), "changed").otherwise("new")
    return d.withColumn("action", action).drop("_hash", "_same", "_path")


def reconcile(kb: DataFrame, classified: DataFrame, at: str) -> DataFrame:
    """The base after a batch: rows of moved contents are retargeted (the last path in ascending order owns them), rows of changed paths deleted."""
    moved = classified.where("action = 'moved'").groupBy("content_hash").agg(F.max("file_path").alias("_to"))
    changed = classified.where("action = 'changed'").select(F.col("file_path")).distinct()
    kept = kb.join(changed, "file_path", "left_anti").select(*kb.columns)
    out = kept.join(moved, "content_hash", "left")
    hit = F.col("_to").isNotNull()
    return out.withColumn("file_path", F.coalesce("_to", "file_path")).withColumn("last_updated", F.when(hit, F.lit(at)).otherwise(F.col("last_updated"))).select(*kb.columns)


def orphans(kb: DataFrame, live: DataFrame, match: str | None = None) -> DataFrame:
    """(file_path, chunks, deletable) of paths that no live file (column file_path) has; match restricts deletion, not the report."""
    paths = kb.where("file_path is not null").groupBy("file_path").agg(F.count("*").alias("chunks"))
    o = paths.join(live.select("file_path").distinct(), "file_path", "left_anti")
    return o.withColumn("deletable", F.contains("file_path", F.lit(match)) if match else F.lit(True))


def vacuum(kb: DataFrame, live: DataFrame, match: str | None = None) -> DataFrame:
    return kb.join(orphans(kb, live, match).where("deletable").select("file_path"), "file_path", "left_anti").select(*kb.columns)


def delete_where(kb: DataFrame, condition: Column) -> DataFrame:
    return kb.where(~F.coalesce(condition, F.lit(False)))


def stats(kb: DataFrame) -> DataFrame:
    return kb.agg(F.count("*").alias("total_chunks"), F.countDistinct("file_path").alias("files"), F.countDistinct("source_project").alias("projects"))


def chunk_rows(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows to append from documents (file_path, project, content_hash) and their chunks (file_path, chunk_index, text, contextual, context, vector); rows without a vector are left out."""
    r = chunks.where(F.col("vector").isNotNull()).join(docs, "file_path")
    return r.withColumn("chunk_id", F.sha2(F.concat_ws("|", "file_path", "content_hash", F.col("chunk_index").cast("string")), 256)).withColumn("token_count", F.expr("length(text) div 4").cast("int"))


class Store:
    """Versions v=<n> of a table under a local or mounted path, with a _CURRENT pointer."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        os.makedirs(path, exist_ok=True)

    @contextmanager
    def lock(self, timeout: float = 30.0, poll: float = 0.5) -> Iterator[None]:
        with open(f"{self.path}/_LOCK", "w") as f:
            end = time.monotonic() + timeout
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except OSError:
                    if time.monotonic() > end:
                        raise TimeoutError("the write lock is held") from None
                    time.sleep(poll)
            try:
                yield
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)

    def version(self) -> int:
        try:
            with open(f"{self.path}/_CURRENT") as f:
                return int(f.read())
        except FileNotFoundError:
            return 0

    def read(self) -> DataFrame | None:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v={v}") if v else None

    def scratch(self, df: DataFrame, label: str) -> DataFrame:
        """df stored for the time of a commit, so that it is computed once; dropped with the next write."""
        at = f"{self.path}/_{label}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def write(self, df: DataFrame, keep: int = 2) -> int:
        """Write df as the next version while the lock is held; nothing changes for readers until all of it is there. The last `keep` versions stay."""
        v = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={v}")
        with open(f"{self.path}/_CURRENT.tmp", "w") as f:
            f.write(str(v))
        os.replace(f"{self.path}/_CURRENT.tmp", f"{self.path}/_CURRENT")
        for name in os.listdir(self.path):
            if name.startswith("v=") and int(name[2:]) <= v - keep:
                shutil.rmtree(f"{self.path}/{name}", ignore_errors=True)
        return v

    def commit(self, df: DataFrame) -> int:
        with self.lock():
            return self.write(df)


def recent_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("rn") <= k)
