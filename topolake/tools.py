"""Named tools: each name a function of (spark, **arguments) to a DataFrame; unknown names and arguments raise."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolake.operators import kernel as K
from topolake.operators import provenance as P
from topolake.operators import topology as T
from topolake.sources.graphs import published, published_dim


class UnknownToolError(KeyError):
    """No tool has this name."""


class ToolRegistry:
    def __init__(self) -> None:
        self._tools: dict[str, Callable[..., DataFrame]] = {}

    def register(self, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        self._tools[f.__name__] = f
        return f

    def names(self) -> list[str]:
        return sorted(self._tools)

    def call(self, spark: SparkSession, name: str, **arguments) -> DataFrame:
        if name not in self._tools:
            raise UnknownToolError(f"{name}; there are {', '.join(self.names())}")
        inspect.signature(self._tools[name]).bind(spark, **arguments)
        return self._tools[name](spark, **arguments)


TOOLS = ToolRegistry()


def _of(spark: SparkSession, dataset: str) -> tuple[DataFrame, DataFrame]:
    return tuple(t.where(F.col("dataset") == dataset) for t in published(spark))


def _seed(spark: SparkSession, dataset: str, table: str) -> DataFrame:
    return spark.createDataFrame([(dataset, table)], "dataset string, seed string")


@TOOLS.register
def list_tables(spark: SparkSession, dataset: str) -> DataFrame:
    return _of(spark, dataset)[0].select("name")


@TOOLS.register
def find_shortest_path(spark: SparkSession, dataset: str, source: str, target: str) -> DataFrame:
    """path, [] where there is none, over references and derivations."""
    pair = spark.createDataFrame([(dataset, 0, source, target)], "dataset string, pair int, s string, t string")
    return K.paths_between(K.undirected(_of(spark, dataset)[1]), pair).agg(F.coalesce(F.first("path"), F.array().cast("array<string>")).alias("path"))


@TOOLS.register
def check_direct_fk(spark: SparkSession, dataset: str, child: str, parent: str) -> DataFrame:
    hit = _of(spark, dataset)[1].where((F.col("edge_type") == "fk_to") & (F.col("src") == child) & (F.col("dst") == parent))
    return hit.agg((F.count("*") > 0).alias("is_direct"))


@TOOLS.register
def lineage(spark: SparkSession, dataset: str, table: str, direction: str = "forward", transitive: bool = False) -> DataFrame:
    edges = K.directed(_of(spark, dataset)[1], T.LINEAGE)
    edges = K.flipped(edges) if direction == "backward" else edges
    return K.reach(edges, _seed(spark, dataset, table), None if transitive else 1).where("depth > 0").select("node", "depth")


@TOOLS.register
def silo_of(spark: SparkSession, dataset: str, table: str) -> DataFrame:
    """The other tables of a table's component."""
    return T.membership(*_of(spark, dataset)).where(F.col("name") == table).select("other")


@TOOLS.register
def neighbours(spark: SparkSession, dataset: str, table: str, hops: int = 1) -> DataFrame:
    return K.reach(K.undirected(_of(spark, dataset)[1], "fk_to"), _seed(spark, dataset, table), hops).where("depth > 0").select("node", "depth")


@TOOLS.register
def connected_components(spark: SparkSession, dataset: str) -> DataFrame:
    """(silo, n_tables, members) over references and derivations."""
    return T.silos(*_of(spark, dataset)).groupBy("silo").agg(F.count("*").alias("n_tables"), F.array_sort(F.collect_list("name")).alias("members"))


@TOOLS.register
def silo_size(spark: SparkSession, dataset: str, table: str) -> DataFrame:
    comp = T.silos(*_of(spark, dataset))
    return comp.join(comp.where(F.col("name") == table).select("silo"), "silo").groupBy("silo").agg(F.count("*").alias("n_tables"))


# Tools on rows: row edges are an argument, (src_table, src_row, dst_table, dst_row), by default the layered schema's.

def _row_edges(spark: SparkSession, edges: DataFrame | None) -> DataFrame:
    return P.layered_rows(published(spark)[1].where("dataset = 'syn_cross' AND edge_type = 'derived_from'"), published_dim(spark)) if edges is None else edges


def _row(spark: SparkSession, table: str, row: int) -> DataFrame:
    return spark.createDataFrame([(table, row)], "table string, row bigint")


@TOOLS.register
def query_table(spark: SparkSession, sf_dir: str, table: str, columns: list[str] | None = None, where: str | None = None, limit: int = 50) -> DataFrame:
    """Some columns of the first rows that a condition keeps."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return (df.where(where) if where else df).select(*(columns or ["*"])).limit(limit)


@TOOLS.register
def get_table_info(spark: SparkSession, sf_dir: str, table: str, samples: int = 3) -> DataFrame:
    """(table, n_rows, n_columns, columns, samples): what a manifest has, and some rows as JSON."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    few = [r[0] for r in df.select(F.to_json(F.struct("*"))).limit(samples).collect()]
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(table).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(df.columns).alias("columns"), F.lit(few).cast("array<string>").alias("samples"))


@TOOLS.register
def trace_row_lineage(spark: SparkSession, table: str, row: int, direction: str = "backward", edges: DataFrame | None = None, shown: int = 50) -> DataFrame:
    """backward: (table, rows) of direct sources; forward: the first `shown` targets and how many there are."""
    found = _row_edges(spark, edges)
    if direction == "backward":
        own = found.where((F.col("dst_table") == table) & (F.col("dst_row") == row))
        return own.groupBy(F.col("src_table").alias("table")).agg(F.sort_array(F.collect_list("src_row")).alias("rows"))
    own = found.where((F.col("src_table") == table) & (F.col("src_row") == row))
    refs = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("dst_table", "dst_row"))), 1, shown), lambda x: F.concat_ws(":row_", x["dst_table"], x["dst_row"]))
    return own.agg(refs.alias("targets"), F.count("*").alias("n_targets"))


@TOOLS.register
def get_cascade_count(spark: SparkSession, table: str, row: int, edges: DataFrame | None = None) -> DataFrame:
    """(table, n_rows) of distinct rows downstream; the total where table is null."""
    return P.cascade(_row_edges(spark, edges), _row(spark, table, row)).select("table", "n_rows")


@TOOLS.register
def get_row_provenance(spark: SparkSession, table: str, row: int, edges: DataFrame | None = None) -> DataFrame:
    """(table, rows) of all rows upstream."""
    found = P.trace(_row_edges(spark, edges), _row(spark, table, row), upstream=True)
    return found.groupBy("table").agg(F.sort_array(F.collect_list("row")).alias("rows"))
