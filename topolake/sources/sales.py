"""The warehouse that the given star stands for: tables by region and layer, and which rows are made of which.

Suppliers, customers and parts are raw rows; order lines are staged from suppliers and parts; orders and the two
dimensions are core, and a mart has a row a nation. A line belongs to the region of its customer, so lines of one region
take suppliers of any other: the silos are joined as far as the sales join them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Kinds of tables a region has: prefix, layer, place within silo and layer. Parts are a silo of their own.
KINDS = (("raw_supplier", "raw", 0), ("raw_customer", "raw", 1), ("stg_lineitem", "staging", 0), ("dim_customer", "core", 0), ("dim_supplier", "core", 1), ("fact_orders", "core", 2), ("mart_nation", "mart", 0))
PARTS, GOODS = "raw_part_goods", "goods"
ROW_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with `row`: a number within the order after the order's own, unlike for any two."""
    w = Window.partitionBy("l_orderkey").orderBy(*map(F.asc_nulls_last, ROW_ORDER))
    return _t(spark, sf_dir, "lineitem").withColumn("row", F.col("l_orderkey") * 1000 + F.row_number().over(w))


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, row) of lines() without the lines' other columns: the numbers of an order's lines hang on how many there are alone."""
    n = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    return n.select("l_orderkey", F.explode(F.sequence(F.lit(1), "n")).alias("i")).select("l_orderkey", (F.col("l_orderkey") * 1000 + F.col("i")).alias("row"))


def _silo(name: str = "r_name") -> Column:
    return F.lower(F.translate(name, " ", "_"))


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nationkey, custkey, silo) of customers, (suppkey, from_silo) of suppliers, and orders with their customers' columns."""
    nation = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("bigint").alias("nationkey"), _silo().alias("silo"))
    cust = _t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("nationkey")).select(F.col("c_custkey").cast("bigint").alias("custkey"), "nationkey", "silo")
    supp = _t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("nationkey")).select(F.col("s_suppkey").cast("bigint").alias("suppkey"), F.col("silo").alias("from_silo"))
    orders = _t(spark, sf_dir, "orders").join(cust, F.col("o_custkey") == F.col("custkey")).select(F.col("o_orderkey").cast("bigint").alias("orderkey"), "custkey", "nationkey", "silo")
    return cust, supp, orders


def _name(kind: str, silo: str | None) -> Column:
    return F.concat(F.lit(f"{kind}_"), silo) if silo else F.lit(kind)


def _edge(src: str, of: str | None, src_row: str, dst: str, to: str, dst_row: str) -> Column:
    return F.struct(_name(src, of).alias("src_table"), F.col(src_row).alias("src_row"), _name(dst, to).alias("dst_table"), F.col(dst_row).alias("dst_row"))


def row_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_table, src_row, dst_table, dst_row): what each row of the warehouse is made of, source to target."""
    cust, supp, orders = _places(spark, sf_dir)
    line = lines(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("orderkey")).join(supp, F.col("l_suppkey") == F.col("suppkey"))
    line = line.withColumn("partkey", F.col("l_partkey").cast("bigint")).withColumn("row", F.col("row").cast("bigint"))
    many = lambda df, *edges: df.select(F.explode(F.array(*edges)).alias("e")).select("e.*")
    return (
        many(line, _edge("raw_supplier", "from_silo", "suppkey", "stg_lineitem", "silo", "row"), _edge(PARTS, None, "partkey", "stg_lineitem", "silo", "row"), _edge("stg_lineitem", "silo", "row", "fact_orders", "silo", "orderkey"))
        .unionByName(many(orders, _edge("dim_customer", "silo", "custkey", "fact_orders", "silo", "orderkey"), _edge("fact_orders", "silo", "orderkey", "mart_nation", "silo", "nationkey")))
        .unionByName(many(cust, _edge("raw_customer", "silo", "custkey", "dim_customer", "silo", "custkey")))
        .unionByName(many(supp, _edge("raw_supplier", "from_silo", "suppkey", "dim_supplier", "from_silo", "suppkey")))
    )


def keys_repeat(spark: SparkSession, sf_dir: str) -> bool:
    """Whether two rows of a table share a key, or an order has so many lines that their numbers run into the next one's."""
    keys = (("region", "r_regionkey", 1), ("nation", "n_nationkey", 1), ("customer", "c_custkey", 1), ("supplier", "s_suppkey", 1), ("orders", "o_orderkey", 1), ("lineitem", "l_orderkey", 999))
    # Null keys of rows count as alike; lines without an order are of none.
    over = [_t(spark, sf_dir, name).where(f"{key} IS NOT NULL OR {most} = 1").groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select("n") for name, key, most in keys]
    return not reduce(DataFrame.union, over).isEmpty()


def least(df: DataFrame, of: list[str], value: str, most: int, name: str) -> DataFrame:
    """(*of, name): the `most` smallest values of each group, a sorted bag, nulls last; others are dropped before they are shuffled."""
    few = df.withColumn("place", F.row_number().over(Window.partitionBy(*of).orderBy(F.asc_nulls_last(value)))).where(F.col("place") <= most)
    return few.groupBy(*of).agg(F.array_sort(F.transform(F.collect_list(F.struct(F.col(value).alias("v"))), lambda x: x["v"])).alias(name))


WIDE_SUPPLIERS = 2_000_000  # more are joined by a shuffle: each is some 60 bytes in an executor's memory


def first_sources(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """(dst_table, dst_row, src_table, src_rows): row_edges() with the `most` smallest sources of each target row and source table.

    Of tables whose keys do not repeat (keys_repeat). A line is then made of one supplier and one part, an order of one customer and
    the lines that lie beside it: these are mapped where they are, with no shuffle, sort or group but that which numbers lines.
    """
    cust, supp, orders = _places(spark, sf_dir)
    beside = F.broadcast(supp) if _t(spark, sf_dir, "supplier").count() <= WIDE_SUPPLIERS else supp
    line = lines(spark, sf_dir).select("l_orderkey", "l_suppkey", F.col("l_partkey").cast("bigint").alias("partkey"), F.col("row").cast("bigint").alias("row"))
    line = line.join(orders.select("orderkey", "silo"), F.col("l_orderkey") == F.col("orderkey")).join(beside, F.col("l_suppkey") == F.col("suppkey"))
    # No order in the window: the join has sorted by the key, and an order's lines are few.
    line = line.withColumn("rows", F.collect_list("row").over(Window.partitionBy("l_orderkey")))
    line = line.withColumn("rows", F.when(F.col("row") == F.array_min("rows"), F.slice(F.sort_array("rows"), 1, most)))
    marts = least(orders, ["silo", "nationkey"], "orderkey", most, "rows")

    def listed(src: str, of: str | None, src_rows: Column, dst: str, to: str, dst_row: str) -> Column:
        return F.struct(_name(dst, to).alias("dst_table"), F.col(dst_row).cast("bigint").alias("dst_row"), _name(src, of).alias("src_table"), src_rows.alias("src_rows"))

    many = lambda df, *each: df.select(F.explode(F.array(*each)).alias("e")).select("e.*")
    one = lambda c: F.array(F.col(c))
    return (
        many(line, listed("raw_supplier", "from_silo", one("suppkey"), "stg_lineitem", "silo", "row"), listed(PARTS, None, one("partkey"), "stg_lineitem", "silo", "row"), listed("stg_lineitem", "silo", F.col("rows"), "fact_orders", "silo", "l_orderkey")).where("src_rows IS NOT NULL")
        .unionByName(many(orders, listed("dim_customer", "silo", one("custkey"), "fact_orders", "silo", "orderkey")))
        .unionByName(many(marts, listed("fact_orders", "silo", F.col("rows"), "mart_nation", "silo", "nationkey")))
        .unionByName(many(cust, listed("raw_customer", "silo", one("custkey"), "dim_customer", "silo", "custkey")))
        .unionByName(many(supp, listed("raw_supplier", "from_silo", one("suppkey"), "dim_supplier", "from_silo", "suppkey")))
    )


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, silo, layer, ordinal) of the warehouse's tables: seven a region, and the parts."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(x).alias("layer"), F.lit(i).alias("ordinal")) for k, x, i in KINDS])
    each = _t(spark, sf_dir, "region").select(_silo().alias("silo"), F.explode(kinds).alias("k")).select(F.concat_ws("_", "k.kind", "silo").alias("name"), "silo", "k.layer", "k.ordinal")
    return each.unionByName(spark.range(1).select(F.lit(PARTS).alias("name"), F.lit(GOODS).alias("silo"), F.lit("raw").alias("layer"), F.lit(0).alias("ordinal")))


def table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, edge_type) of tables: what the rows' sales join, one row a pair, drawn from all lines."""
    cust, supp, orders = _places(spark, sf_dir)
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    flow = line.join(orders.select("orderkey", "silo"), F.col("l_orderkey") == F.col("orderkey")).join(supp, F.col("l_suppkey") == F.col("suppkey")).select("from_silo", "silo").distinct()
    name = lambda kind, silo="silo": F.concat(F.lit(f"{kind}_"), F.col(silo))
    pair = lambda kind, src, dst: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"))
    made = F.array(
        pair("derived_from", name("raw_supplier", "from_silo"), name("stg_lineitem")), pair("derived_from", F.lit(PARTS), name("stg_lineitem")), pair("derived_from", name("stg_lineitem"), name("fact_orders")),
        pair("derived_from", name("dim_customer"), name("fact_orders")), pair("derived_from", name("fact_orders"), name("mart_nation")), pair("derived_from", name("raw_customer"), name("dim_customer")),
        pair("derived_from", name("raw_supplier", "from_silo"), name("dim_supplier", "from_silo")), pair("fk_to", name("fact_orders"), name("dim_customer")),
        pair("fk_to", name("fact_orders"), name("dim_supplier", "from_silo")), pair("fk_to", name("stg_lineitem"), name("fact_orders")),
    )
    return flow.select(F.explode(made).alias("e")).select("e.*").distinct()


# The same in SQL.
_SILO = "lower(replace(r_name, ' ', '_'))"
PLACES_SQL = f"""nat AS (SELECT n_nationkey, {_SILO} AS silo FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey, n_nationkey, silo FROM customer JOIN nat ON c_nationkey = n_nationkey),
supp AS (SELECT s_suppkey, silo AS from_silo FROM supplier JOIN nat ON s_nationkey = n_nationkey),
ord AS (SELECT o_orderkey, c_custkey, n_nationkey, silo FROM orders JOIN cust ON o_custkey = c_custkey)"""
_TABLE_ROWS = ", ".join(f"('{k}', '{x}', {i})" for k, x, i in KINDS)
TABLES_SQL = f"""sales_tables AS (SELECT kind || '_' || {_SILO} AS name, {_SILO} AS silo, layer, ordinal FROM region, (VALUES {_TABLE_ROWS}) k(kind, layer, ordinal)
  UNION ALL SELECT '{PARTS}', '{GOODS}', 'raw', 0)"""


def _sql_edges(*pairs: str) -> str:
    """`kind: src > dst` with the silo's column after each name."""
    out = []
    for p in pairs:
        kind, _, ends = p.partition(": ")
        src, _, dst = ends.partition(" > ")
        name = lambda x: f"'{x}'" if " " not in x else f"'{x.split()[0]}_' || {x.split()[1]}"
        out.append(f"SELECT {name(src)} AS src, {name(dst)} AS dst, '{kind}' AS edge_type FROM flow")
    return " UNION ".join(out)


EDGES_SQL = "flow AS MATERIALIZED (SELECT DISTINCT from_silo, silo FROM lineitem JOIN ord ON l_orderkey = o_orderkey JOIN supp ON l_suppkey = s_suppkey),\nsales_edges AS MATERIALIZED (" + _sql_edges(
    "derived_from: raw_supplier from_silo > stg_lineitem silo", f"derived_from: {PARTS} > stg_lineitem silo", "derived_from: stg_lineitem silo > fact_orders silo",
    "derived_from: dim_customer silo > fact_orders silo", "derived_from: fact_orders silo > mart_nation silo", "derived_from: raw_customer silo > dim_customer silo",
    "derived_from: raw_supplier from_silo > dim_supplier from_silo", "fk_to: fact_orders silo > dim_customer silo", "fk_to: fact_orders silo > dim_supplier from_silo", "fk_to: stg_lineitem silo > fact_orders silo") + ")"
LINES_SQL = f"line AS (SELECT *, l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ROW_ORDER)}) AS row FROM lineitem)"
ROWS_SQL = f"""{LINES_SQL},
made AS (SELECT l_suppkey, l_partkey, l_orderkey, row, from_silo, silo FROM line JOIN ord ON l_orderkey = o_orderkey JOIN supp ON l_suppkey = s_suppkey),
re(src_table, src_row, dst_table, dst_row) AS MATERIALIZED (SELECT 'raw_supplier_' || from_silo, CAST(l_suppkey AS BIGINT), 'stg_lineitem_' || silo, row FROM made
  UNION ALL SELECT '{PARTS}', l_partkey, 'stg_lineitem_' || silo, row FROM made UNION ALL SELECT 'stg_lineitem_' || silo, row, 'fact_orders_' || silo, l_orderkey FROM made
  UNION ALL SELECT 'dim_customer_' || silo, c_custkey, 'fact_orders_' || silo, o_orderkey FROM ord UNION ALL SELECT 'fact_orders_' || silo, o_orderkey, 'mart_nation_' || silo, n_nationkey FROM ord
  UNION ALL SELECT 'raw_customer_' || silo, c_custkey, 'dim_customer_' || silo, c_custkey FROM cust UNION ALL SELECT 'raw_supplier_' || from_silo, s_suppkey, 'dim_supplier_' || from_silo, s_suppkey FROM supp)"""
