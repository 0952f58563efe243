"""The tools as SQL table functions, for sessions that speak SQL alone: `SELECT * FROM trace_row('orders', 7, 'backward')`.

`register(spark, sf_dir)` makes temporary views of the given tables, of their rows' lineage (`row_edges`) and of the
warehouse drawn from them (`table_names`, `table_edges`), and the functions over these. A function's body is SQL, so
Catalyst pushes a call's arguments into the scan; `matching` takes any table and is a Python table function that gives the
table's own columns back. Calls join like tables: `FROM region r, LATERAL trace_row('region', r.r_regionkey, 'forward')`.

A name that is not there raises: a table by USER_RAISED_EXCEPTION that begins with UNKNOWN_TABLE, a direction likewise with
UNKNOWN_DIRECTION, a column of `matching` while the query is analysed with UNKNOWN_COLUMN. A row that is not there has no
lineage: no rows. Null arguments are names that are not there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from topolake.operators import provenance as P
from topolake.sources.graphs import load
from topolake.sources.storage import written

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
ROW_TABLES = ("region", "nation", "customer", "orders", "lineitem")

# Names are a catalogue's: they stand in the functions' text, as known when these are registered.
_RAISE_ROWS = "CASE WHEN tbl IN ({row_tables}) THEN false ELSE CAST(raise_error('UNKNOWN_TABLE ' || coalesce(tbl, 'null')) AS BOOLEAN) END"
_RAISE_WAY = "CASE WHEN direction IN ('forward', 'backward') THEN false ELSE CAST(raise_error('UNKNOWN_DIRECTION ' || coalesce(direction, 'null')) AS BOOLEAN) END"
_KNOWN = "CASE WHEN data || '.' || tbl IN ({tables}) AND id = 0 THEN tbl ELSE raise_error('UNKNOWN_TABLE ' || coalesce(data || '.' || tbl, 'null')) END"
_WAY = "CASE WHEN direction IN ('forward', 'backward') AND id = 0 THEN direction ELSE raise_error('UNKNOWN_DIRECTION ' || coalesce(direction, 'null')) END"

# Rows: arguments are conditions on the tables, so that a call with constant names reads those tables alone; names are checked by a
# branch that has no rows. Tables: arguments stand in one row `c`, which the tables are joined to. A checked name hangs on
# the row's own id and so is no constant to be copied into the tables' scans: one stage raises, not several.
FUNCTIONS = {
    "list_tables": "(data STRING) RETURNS TABLE(name STRING) RETURN SELECT t.name FROM table_names t WHERE t.dataset = data",
    "check_direct_fk": f"""(data STRING, tbl STRING, parent STRING) RETURNS TABLE(is_direct BOOLEAN)
        RETURN SELECT coalesce(bool_or(e.dst = c.parent), false) FROM (SELECT data AS data, {_KNOWN} AS name, parent AS parent FROM range(1)) c
        LEFT JOIN (SELECT * FROM table_edges WHERE edge_type = 'fk_to') e ON e.dataset = c.data AND e.src = c.name""",
    "lineage_of": f"""(data STRING, tbl STRING, direction STRING) RETURNS TABLE(name STRING)
        RETURN SELECT DISTINCT e.other FROM (SELECT data AS data, {_KNOWN} AS name, {_WAY} AS way FROM range(1)) c
        JOIN (SELECT dataset, 'forward' AS way, src AS own, dst AS other FROM table_edges WHERE edge_type = 'derived_from'
              UNION ALL SELECT dataset, 'backward', dst, src FROM table_edges WHERE edge_type = 'derived_from') e ON e.dataset = c.data AND e.way = c.way AND e.own = c.name""",
    "trace_row": f"""(tbl STRING, place BIGINT, direction STRING) RETURNS TABLE(other STRING, n_rows BIGINT, places ARRAY<BIGINT>)
        RETURN SELECT e.other, count(*), sort_array(collect_list(e.other_row)) FROM (SELECT 'backward' AS way, dst_table AS own, dst_row AS own_row, src_table AS other, src_row AS other_row FROM row_edges
              UNION ALL SELECT 'forward', src_table, src_row, dst_table, dst_row FROM row_edges) e
        WHERE e.way = direction AND e.own = tbl AND e.own_row = place GROUP BY e.other
        UNION ALL SELECT CAST(NULL AS STRING), 0L, CAST(NULL AS ARRAY<BIGINT>) FROM range(1) WHERE {_RAISE_ROWS} OR {_RAISE_WAY}""",
    "second_sources": f"""(tbl STRING, place BIGINT) RETURNS TABLE(other STRING, other_place BIGINT)
        RETURN SELECT DISTINCT f.src_table, f.src_row FROM row_edges e JOIN row_edges f ON f.dst_table = e.src_table AND f.dst_row = e.src_row
        WHERE e.dst_table = tbl AND e.dst_row = place
        UNION ALL SELECT CAST(NULL AS STRING), 0L FROM range(1) WHERE {_RAISE_ROWS}""",
}


class Matching:
    """matching(TABLE(t), column, value): rows of t whose cell prints as value; t's own columns."""

    @staticmethod
    def analyze(t: AnalyzeArgument, column: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        if not column.isConstantExpression or column.value not in t.dataType.names:
            raise ValueError(f"UNKNOWN_COLUMN {column.value}; there are {', '.join(t.dataType.names)}")
        return AnalyzeResult(StructType(t.dataType.fields))

    def eval(self, t: Row, column: str, value: str) -> Iterator[Row]:
        cell = t[column]
        if cell is not None and value is not None and (str(cell).lower() if isinstance(cell, bool) else str(cell)) == value:
            yield t


OF_TABLES = ("list_tables", "check_direct_fk", "lineage_of")


def register(spark: SparkSession, sf_dir: str, tables: bool = True) -> None:
    """Views and functions in the session; called again, those of the folder named last.

    Without `tables` those of rows alone, OF_TABLES left out: these need the table edges, drawn from all order lines.
    """
    for name in GIVEN:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    rows = P.star_edges(spark, sf_dir)
    rows.createOrReplaceTempView("row_edges")
    quoted = lambda names: ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names)
    known = ""
    if tables:
        nodes, edges = load(spark, sf_dir)
        nodes.select("dataset", "name").createOrReplaceTempView("table_names")
        written(edges.select("dataset", "src", "dst", "edge_type"), "table-edges").createOrReplaceTempView("table_edges")
        known = quoted(f"{r['dataset']}.{r['name']}" for r in nodes.select("dataset", "name").distinct().collect())
    for name, body in FUNCTIONS.items():
        if tables or name not in OF_TABLES:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body.replace('{tables}', known).replace('{row_tables}', quoted(ROW_TABLES))}")
    spark.udtf.register("matching", F.udtf(Matching))
