"""Runs that can be killed at any step and started again: a commit log by batch, read in the place of what was written.

A target is a folder with `data/batch=<id>` and `log`. A batch is written whole to its own folder, which a rerun of the
same batch overwrites, and then committed: one small file `log/<id>.json`, made under another name and renamed, so that
it is there whole or not at all. Readers take the folders of committed batches only. Which batches are done is told by
the log's names, one a batch; rows written before are never read again.

Batch ids are named by the caller or by the stream: the same rows must come with the same id. They are letters, digits, `_`,
`-` and `.`, and do not begin with a dot; others raise a ValueError. One writer a batch at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from topolake.sources.storage import shared_dir, written


class Target:
    """A folder that batches are committed to, on any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def _check(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        return batch

    def committed(self) -> list[str]:
        """Ids of the batches whose log entry is there, in order."""
        log = self._path("log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(n[: -len(".json")] for n in names if n.endswith(".json") and not n.startswith("."))

    def write(self, rows: DataFrame, batch: str) -> None:
        """The batch's rows in its folder; what an earlier try left there goes. Not to be seen until commit()."""
        rows.write.mode("overwrite").parquet(f"{self.path}/data/batch={self._check(batch)}")

    def commit(self, batch: str, note: dict | None = None) -> None:
        """Makes the batch visible; a batch that is committed already stays as it is."""
        entry, draft = self._path(f"log/{self._check(batch)}.json"), self._path(f"log/.{batch}.draft")
        if self._fs.exists(entry):
            return
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch": batch, **(note or {})}).encode()))
        out.close()
        if not self._fs.rename(draft, entry) and not self._fs.exists(entry):
            raise OSError(f"batch {batch} was not committed")

    def add(self, rows: DataFrame, batch: str) -> bool:
        """Writes and commits a batch unless it is committed; whether there was anything to do."""
        if self._fs.exists(self._path(f"log/{self._check(batch)}.json")):
            return False
        self.write(rows, batch)
        self.commit(batch)
        return True

    def read(self, schema: StructType | str) -> DataFrame:
        """Rows of committed batches, with their batch as `batch_`; no rows before the first commit."""
        if not (done := self.committed()):
            return self.spark.createDataFrame([], schema).withColumn("batch_", F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/batch={b}" for b in done])
        return rows.withColumn("batch_", F.regexp_extract(F.col("_metadata.file_path"), "/data/batch=([^/]+)/", 1))


def run(target: Target, wanted: DataFrame, work: Callable[[DataFrame], DataFrame], key: str, size: int) -> int:
    """Does `work` on wanted in batches of about `size` rows, each committed by itself; the number of batches done now.

    Rows are dealt by hash of their key, which tells rows apart (those that repeat one share a batch; null is a key), into a number of batches that the first run counts and keeps as the log's first
    entry, so a rerun deals alike, does what is not committed, and adds nothing to what is. Work that fails leaves the
    batches before it. Rows that come to wanted later belong to a target of their own, or to append_stream().
    """
    plan = f"{target.path}/plan"
    if not target._fs.exists(target._path("plan/_SUCCESS")):
        n = max(1, -(-wanted.count() // size))
        target.spark.range(1).select(F.lit(n).alias("batches")).coalesce(1).write.mode("overwrite").json(plan)
    batches = target.spark.read.schema("batches int").json(plan).first()["batches"]
    left = [i for i in range(batches) if f"{i:06d}" not in set(target.committed())]
    if not left:
        return 0
    # One pass over wanted for all batches to come: a folder each, read by its own batch alone.
    held = written(wanted.withColumn("batch_", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")).repartition("batch_"), "batches", by="batch_")
    for i in left:
        target.add(work(held.where(F.col("batch_") == i).drop("batch_")), f"{i:06d}")
    return len(left)


def append_stream(stream: DataFrame, target: Target, key: str | None = None, time: str | None = None, late: str = "10 minutes") -> None:
    """All that the stream has now, each micro-batch committed by its number: one that is delivered again adds nothing.

    With key and time, rows that repeat a key within `late` of the first are left out by the stream, whose state forgets
    keys behind the watermark; the target is not read for it.
    """
    if key and time:
        stream = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])

    def put(batch: DataFrame, number: int) -> None:
        target.add(batch, f"{number:012d}")

    # The same folder for the same target in every process, so that a stream goes on where it was.
    checkpoint = f"{shared_dir(target.spark)}/stream-{hashlib.md5(target.path.encode()).hexdigest()}"
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
