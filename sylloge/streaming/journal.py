"""The journal as a stream: new operations keep a table of the clauses in force and counts of events up to date."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.journal import SCHEMA
from ..sources.scratch import hadoop


def read(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Operations of a store's journal as they come; a store whose operations are put into segments is read from these instead."""
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def merge(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The last change of each clause; state is what merge() gave before, so retracted clauses stay as such."""
    batch = batch.where("action <> 'operation'")
    both = batch if state is None else state.unionByName(batch)
    order = Window.partitionBy("namespace", "clause").orderBy(F.desc("sequence"), F.desc("position"))
    return both.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


#: Parts of the table that maintain() keeps: a batch rewrites those that it touches.
PARTS = 64


class _Table:
    """A table in parts under a path, each written by some batch; a manifest for each batch names the parts' batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.folder, self.fs = hadoop(spark, path)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The batch of each part, after the last batch or the last before one."""
        if not self.fs.exists(self.folder):
            return {}
        names = [x.getPath().getName() for x in self.fs.listStatus(self.folder)]
        found = [int(n.split("-")[1]) for n in names if n.startswith("manifest-") and not n.endswith(".new")]
        found = [n for n in found if before is None or n < before]
        if not found:
            return {}
        text = self.spark.read.text(f"{self.path}/manifest-{max(found)}", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def read(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/batch={n}/part={p}" for p, n in manifest.items()]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def publish(self, n: int, manifest: dict[int, int]) -> None:
        """Puts a manifest in its place whole, and deletes what neither it nor the one before it names."""
        out = self.fs.create(self._at(f"manifest-{n}.new"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        old = self.manifest(n)
        self.fs.delete(self._at(f"manifest-{n}"), False)
        self.fs.rename(self._at(f"manifest-{n}.new"), self._at(f"manifest-{n}"))
        oldest = self.manifest(max(old.values(), default=0))
        for p, b in oldest.items():  # those of two batches before
            if b not in (old.get(p), manifest.get(p)):
                self.fs.delete(self._at(f"batch={b}/part={p}"), True)


def maintain(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that keeps merge()'s table: a batch reads and rewrites the parts that its clauses fall into.

    Clauses go to PARTS parts by their hash. A batch that is repeated writes the same again; its table counts once its
    manifest is there.
    """
    spark = stream.sparkSession
    kept = _Table(spark, path)
    part = F.pmod(F.xxhash64("namespace", "clause"), F.lit(PARTS)).cast("int")

    def step(batch: DataFrame, n: int) -> None:
        batch = batch.where("action <> 'operation'").persist()
        try:
            touched = [r[0] for r in batch.select(part.alias("part")).distinct().collect()]
            now = kept.manifest(n)
            old = kept.read({p: b for p, b in now.items() if p in touched})
            merge(old, batch).withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch={n}")
            kept.publish(n, now | dict.fromkeys(touched, n))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The clauses in force after the last batch."""
    kept = _Table(spark, path)
    return kept.read(kept.manifest()).where("action = 'assert'")


def events_per_window(stream: DataFrame, ts: str, width: str, late: str, by: str) -> DataFrame:
    """(start, by, n): events of each window, closed once the watermark has passed it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
