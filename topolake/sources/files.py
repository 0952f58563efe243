"""Readers and writers of the engine's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topolake.operators.provenance import LINEAGE_MAP


TABLES_CSV = "TABLE_NAME string, TABLE_SCHEMA string, TABLE_TYPE string"
RELATIONS_CSV = "ForeignKeyName string, ChildTable string, ChildColumn string, ParentTable string, ParentColumn string"
LINEAGE_JSON = "source string, target string, dw_table string, oltp_source string, evidence string"
MANIFEST = "map<string,struct<rows:bigint,columns:int,layer:string,silo:string,file:string>>"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; all cells are text unless a schema is given, an empty cell is null."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def with_row_id(df: DataFrame) -> DataFrame:
    """df, read from files and at most filtered or narrowed since, with row_id: its 0-based place by file name and line.

    Spark deals splits of files to tasks by size, so places follow each row's own file and block instead: rows of a block are
    read in order by one task, and blocks are counted and put in order of file name and start. The rows are not
    written again; what is gathered and sorted is one row a block.
    """
    held = df.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("start_"), F.monotonically_increasing_id().alias("spot_"))
    blocks = held.groupBy("file_", "start_").agg(F.count("*").alias("n_"), F.min("spot_").alias("least_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("file_", "start_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file_", "start_", "least_", before.alias("before_"))
    return held.join(blocks, ["file_", "start_"]).withColumn("row_id", F.col("spot_") - F.col("least_") + F.col("before_")).select(*[f"`{c}`" for c in df.columns], "row_id")


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, evidence) of a JSON array in either of two shapes."""
    rows = spark.read.schema(LINEAGE_JSON).option("multiLine", True).json(path)
    return rows.select(F.coalesce("source", "oltp_source").alias("src"), F.coalesce("target", "dw_table").alias("dst"), "evidence")


def read_json_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row with the map of a JSON object file, as column `value`."""
    return spark.read.option("wholetext", True).text(path).select(F.from_json("value", schema).alias("value"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    one = read_json_map(spark, path, MANIFEST).select(F.explode("value").alias("table", "m"))
    return one.select("table", "m.*")


def write_manifest(rows: DataFrame, path: str) -> None:
    """rows (table, rows, columns, layer, silo, file) as one JSON object by table, as read_manifest() takes it."""
    entry = F.struct("table", F.struct("rows", "columns", "layer", "silo", "file"))
    rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_catalogue(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A schema's tables and references as the two catalogue files, with headers."""
    tables = nodes.select(F.col("name").alias("TABLE_NAME"), F.col("dataset").alias("TABLE_SCHEMA"), F.lit("BASE TABLE").alias("TABLE_TYPE"))
    keys = edges.where("edge_type = 'fk_to'").select(
        F.concat_ws("_", F.lit("FK"), "src", "dst").alias("ForeignKeyName"), F.col("src").alias("ChildTable"), F.concat("dst", F.lit("_id")).alias("ChildColumn"), F.col("dst").alias("ParentTable"), F.lit("id").alias("ParentColumn"))
    for name, df in (("tables", tables), ("relations", keys)):
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def read_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tables, relations) of the two catalogue files."""
    return read_csv(spark, f"{path}/tables", TABLES_CSV), read_csv(spark, f"{path}/relations", RELATIONS_CSV)


def consolidated(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All JSON line files that match a pattern, each row with the file that it came from."""
    return spark.read.schema(schema).json(pattern).withColumn("file", F.input_file_name())


def read_lineage_map(spark: SparkSession, path: str) -> DataFrame:
    """Row edges of a nested lineage map file."""
    from topolake.operators.provenance import flatten_map

    return flatten_map(read_json_map(spark, path, LINEAGE_MAP).select(F.to_json("value").alias("value")), "value")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("dataset").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("dataset").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_tables(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as CSV with a header, and the manifest of what was written."""
    rows = None
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"), F.lit(f"{path}/{name}").alias("file"))
        rows = one if rows is None else rows.union(one)
    return rows


def write_results(results: DataFrame, path: str) -> None:
    """Results by baseline, condition, dataset and model: a run of one of them replaces only its own folder."""
    keys = ["baseline", "condition", "dataset", "model"]
    results.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def resume(done: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """What of wanted is not done yet; appending it and asking again changes nothing."""
    return wanted.join(done.select(key), key, "left_anti")


def merge(old: DataFrame, new: DataFrame, stale: DataFrame, key: str = "id") -> DataFrame:
    """old without stale ids, and what new adds; where both have an id the old row stays."""
    kept = old.join(stale.select(key), key, "left_anti")
    return kept.unionByName(new.join(kept.select(key), key, "left_anti"))
