"""Shared pieces: word rule, folds, written intermediates and vector classes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The word rule and the ASCII capitals that are folded.
WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = CAPITALS.lower()

_written: list[tuple[SparkSession, str]] = []
_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is named and all executors are on this machine (tests)."""
    global _own_dir
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="topolake-")
    return _own_dir


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    text_batches(spark)
    path = f"{shared_dir(spark)}/topolake-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._topolake_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df; only when nothing reads it any more."""
    path = getattr(df, "_topolake_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more.

    Its cleaner acts when the driver's JVM has found them unreachable; the first collection only frees what still leads
    to them, so there are two, and the cleaner's thread gets a moment.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside passes so many rows at a time to Python workers, for rows much longer than a document's."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller Arrow batches than the default of 10,000 rows, which are tens of megabytes of text on both sides of a
    Python worker; a value that the session has been given stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[tuple], **kinds: str | pa.DataType) -> DataFrame:
    """A small table from the driver by way of Arrow: unlike a list of rows, it needs no Python worker to be read."""
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table({n: pa.array(list(c), k) for (n, k), c in zip(kinds.items(), columns, strict=True)}))


def wrapped(df: DataFrame, *kept: str) -> DataFrame:
    """df with its columns but those kept named by place, so that none can clash with one computed."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in kept else f"row_{i}_") for i, c in enumerate(df.columns)])


def unwrapped(df: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The rows under their names again, columns named in new replaced by it."""
    placed = [f"row_{i}_" if f"row_{i}_" in df.columns else c for i, c in enumerate(names)]
    return df.select(*[(new[c] if c in new else F.col(p)).alias(c) for c, p in zip(names, placed, strict=True)])


def fold(doc_id: str | Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text, modulo parts, is part; a null id is in no fold."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def usable(vec: str) -> Column:
    """A vector that has components, none of them null or non-finite."""
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & (F.size(vec) > 0) & ok, F.lit(False))


def vector_keys(rows: DataFrame) -> Column:
    """A 64-bit hash of `vec` that no two different vectors of rows share: seeds are tried until one is found."""
    for seed in count(1):
        key = F.xxhash64("vec", F.lit(seed))
        shared = rows.groupBy(key.alias("ck")).agg(F.min("vec").alias("least"), F.max("vec").alias("most")).where("least <> most")
        if shared.isEmpty():
            return key


def vector_classes(rows: DataFrame, key: Column, keep: int, every: int) -> DataFrame:
    """(vec_id, vec) to one row per distinct vec: ck, vec, its `keep` smallest ids, whether a query is in it.

    Copies of one vector score alike, so no answer of `keep`-1 rows needs more of its ids. The ranking is cut before
    the shuffle (window group limit), so a vector that a third of all rows share stays a few rows a task.
    """
    keyed = rows.withColumn("ck", key)
    w = Window.partitionBy("ck").orderBy("vec_id")
    ids = (
        keyed.select("ck", "vec", "vec_id").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= keep)
        .groupBy("ck").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    )
    asks = keyed.where(F.col("vec_id") % every == 0).select("ck").distinct().withColumn("asks", F.lit(True))
    return ids.join(asks, "ck", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))


def answers(tops: DataFrame, queries: DataFrame, k: int, score_type: str) -> DataFrame:
    """Per-shard best (ck, vec_id, score) to each query's k best, its own row left out; of rows that repeat its id, one is its own."""
    w = Window.partitionBy("ck").orderBy(F.desc("score"), "vec_id")
    best = (
        tops.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
        .groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("best"))
    )
    found = queries.select(F.col("vec_id").alias("query_id"), "ck").join(best, "ck")
    own = F.array_position(F.transform("best", lambda x: x["vec_id"]), F.col("query_id")) - 1
    cut = F.slice(F.filter("best", lambda x, i: i != own), 1, k)
    return found.select("query_id", F.posexplode(cut).alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"),
        F.col("hit.score").cast(score_type).alias("score"),
    )
