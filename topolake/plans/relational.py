"""Queries of the relational operators: filters, joins, windows, sets, scalars, sources and sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topolake.operators import kernel as K
from topolake.operators.ordinals import dense_ranked, numbered
from topolake.sources import batches as B
from topolake.sources import files as FI
from topolake.sources.graphs import load, load_dim, sql_with
from topolake.sources.storage import shared_dir

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


# Filters and projections

@query("SELECT o_orderkey, concat_ws('.', 'DW', 'dbo', o_orderpriority) AS qualified FROM orders WHERE o_orderstatus = 'F'")
def p1_p2_base_rows_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.concat_ws(".", F.lit("DW"), F.lit("dbo"), "o_orderpriority").alias("qualified"))


@query("SELECT c_custkey, c_name FROM (SELECT * FROM customer WHERE CAST(c_nationkey AS VARCHAR) = '7' ORDER BY c_custkey LIMIT 20)")
def p3_query_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equals(_t(spark, sf_dir, "customer"), "c_nationkey", "7", "c_custkey", 20).select("c_custkey", "c_name")


def equals(df: DataFrame, column: str, value: str, order: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose cell prints as value; none if there is no such column."""
    found = df.where(F.col(column).cast("string") == value) if column in df.columns else df.where(F.lit(False))
    found = found.orderBy(order) if order else found
    return found.limit(limit) if limit is not None else found


@query("SELECT c_custkey, c_name FROM customer WHERE CAST(c_mktsegment AS VARCHAR) = 'BUILDING'")
def p4_query_unlimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equals(_t(spark, sf_dir, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 17")
def p5_s8_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").where("o_orderkey = 17").select("o_orderkey", "o_custkey", "o_totalprice")


_LAYER = "CASE WHEN name LIKE 'raw\\_%' ESCAPE '\\' THEN 'raw' WHEN name LIKE 'stg\\_%' ESCAPE '\\' THEN 'staging' WHEN name LIKE 'dim\\_%' ESCAPE '\\' OR name LIKE 'fact\\_%' ESCAPE '\\' THEN 'core' WHEN name LIKE 'mart\\_%' ESCAPE '\\' THEN 'mart' ELSE 'unknown' END"


@query(sql_with() + f"SELECT dataset, name, {_LAYER} AS layer, coalesce((SELECT silo FROM dim d WHERE d.name = n.name), 'unknown') AS silo, split_part(name, '.', 1) AS schema FROM nodes n")
def p6_p9_layer_silo_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("name")
    layer = F.when(n.startswith("raw_"), "raw").when(n.startswith("stg_"), "staging").when(n.startswith("dim_") | n.startswith("fact_"), "core").when(n.startswith("mart_"), "mart").otherwise("unknown")
    silo = load_dim(spark, sf_dir).select("name", "silo")
    return load(spark, sf_dir)[0].join(F.broadcast(silo), "name", "left").select("dataset", "name", layer.alias("layer"), F.coalesce("silo", F.lit("unknown")).alias("silo"), F.split("name", r"\.")[0].alias("schema"))


@query("SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) <= 2 THEN 'easy' WHEN count(*) <= 3 THEN 'medium' ELSE 'hard' END AS difficulty, CASE WHEN count(*) >= 5 THEN 'long' WHEN count(*) >= 3 THEN 'mid' WHEN count(*) = 2 THEN 'short' ELSE 'none' END AS bucket FROM lineitem GROUP BY 1")
def p10_p15_difficulty_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    got = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return got.select("l_orderkey", "n", F.when(n <= 2, "easy").when(n <= 3, "medium").otherwise("hard").alias("difficulty"), F.when(n >= 5, "long").when(n >= 3, "mid").when(n == 2, "short").otherwise("none").alias("bucket"))


@query("SELECT p_partkey, CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'lineage' ELSE 'routing' END AS category FROM part WHERE p_size IN (1, 2, 3, 10, 20)")
def p12_p13_category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").where(F.col("p_size").isin(1, 2, 3, 10, 20)).select("p_partkey", F.when(F.col("p_brand").isin("Brand#11", "Brand#12"), "lineage").otherwise("routing").alias("category"))


@query("SELECT c_nationkey, CAST(count(*) AS BIGINT) AS n FROM customer GROUP BY 1 HAVING count(*) >= 10")
def p11_p14_group_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).where("n >= 10")


# Joins

@query(sql_with() + "SELECT e.dataset, a.node_id AS src_id, b.node_id AS dst_id, e.edge_type FROM edges e JOIN nodes a ON a.dataset = e.dataset AND a.name = e.src JOIN nodes b ON b.dataset = e.dataset AND b.name = e.dst")
def j1_name_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = load(spark, sf_dir)
    a = nodes.select("dataset", F.col("name").alias("src"), F.col("node_id").alias("src_id"))
    b = nodes.select("dataset", F.col("name").alias("dst"), F.col("node_id").alias("dst_id"))
    return edges.join(a, ["dataset", "src"]).join(b, ["dataset", "dst"]).select("dataset", "src_id", "dst_id", "edge_type")


@query("SELECT CAST(count(*) AS BIGINT) AS n_kept FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def j2_double_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    supp = _t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return _t(spark, sf_dir, "lineitem").join(part, "l_partkey", "left_semi").join(supp, "l_suppkey", "left_semi").agg(F.count("*").alias("n_kept"))


@query("""SELECT CASE WHEN p.p_partkey IS NULL THEN 'bad target' WHEN s.s_suppkey IS NULL THEN 'bad source' ELSE 'valid' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM lineitem
  LEFT JOIN (SELECT * FROM part WHERE p_size < 20) p ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON s_suppkey = l_suppkey GROUP BY 1""")
def j3_classify_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").where("p_size < 20").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("has_target"))
    supp = _t(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(1).alias("has_source"))
    both = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(part, "l_partkey", "left").join(supp, "l_suppkey", "left")
    verdict = F.when(F.col("has_target").isNull(), "bad target").when(F.col("has_source").isNull(), "bad source").otherwise("valid")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS DOUBLE), 0.0) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j4_left_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("quality"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j5_j6_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey").join(_t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT md5(text) AS text_md5, min(doc_id) AS first_id FROM documents GROUP BY text")
def j7_w2_first_of_equal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The least id of a text is a partial aggregate; a window over each text would gather its copies in one task.
    return _t(spark, sf_dir, "documents").groupBy(F.md5("text").alias("text_md5")).agg(F.min("doc_id").alias("first_id"))


@query("SELECT l.doc_id, l.toxic = (d.lang = 'en')::INT AS agrees FROM labels l JOIN documents d USING (doc_id)")
def j8_j9_id_join_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", (F.col("toxic") == (F.col("lang") == "en").cast("int")).alias("agrees"))


@query("SELECT a.r_name AS a, b.r_name AS b, a.r_regionkey < b.r_regionkey AS is_unordered FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey")
def j10_j12_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of the five regions, the unordered ones marked: a fixed catalogue."""
    r = _t(spark, sf_dir, "region")
    a, b = r.select(F.col("r_regionkey").alias("ka"), F.col("r_name").alias("a")), r.select(F.col("r_regionkey").alias("kb"), F.col("r_name").alias("b"))
    return a.crossJoin(b).where("ka <> kb").select("a", "b", (F.col("ka") < F.col("kb")).alias("is_unordered"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey = b.n_regionkey AS same_group FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def j13_j14_group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the 25 nations within and across regions: a fixed catalogue."""
    n = _t(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("ra")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("rb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (F.col("ra") == F.col("rb")).alias("same_group"))


@query(sql_with() + "SELECT a.dataset, a.name AS s, b.name AS t FROM nodes a JOIN nodes b ON a.dataset = b.dataset AND a.name <> b.name WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.dataset = a.dataset AND e.edge_type = 'fk_to' AND e.src = a.name AND e.dst = b.name)")
def j15_non_fk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = load(spark, sf_dir)
    a, b = nodes.select("dataset", F.col("name").alias("s")), nodes.select("dataset", F.col("name").alias("t"))
    return a.join(b, "dataset").where("s <> t").join(K.directed(edges, "fk_to").toDF("dataset", "s", "t"), ["dataset", "s", "t"], "left_anti")


@query("SELECT 'part' AS key_table, l_partkey AS key, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'supp', l_suppkey, count(*) FROM lineitem GROUP BY ALL")
def j18_j19_unpivot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))
    return keys.unpivot([], ["part", "supp"], "key_table", "key").groupBy("key_table", "key").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE c(conv_id, turn, depth) AS (SELECT conv_id, turn, 0 FROM conversations a WHERE NOT EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn - 1) UNION SELECT a.conv_id, a.turn, c.depth + 1 FROM c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1) SELECT conv_id, CAST(max(depth) AS BIGINT) AS longest FROM c GROUP BY 1")
def j20_parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest chain of turns: islands of consecutive numbers, so no round per step is needed."""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    island = F.col("turn") - F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    chains = turns.withColumn("island", island).groupBy("conv_id", "island").agg((F.count("*") - 1).alias("steps"))
    return chains.groupBy("conv_id").agg(F.max("steps").cast("bigint").alias("longest"))


@query("SELECT s.source, CAST(s.n AS BIGINT) AS n, s.n = e.n AS as_expected FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) s JOIN (VALUES ('src1', 50), ('src2', 50), ('src3', 49)) e(source, n) USING (source)")
def j22_expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = spark.createDataFrame([("src1", 50), ("src2", 50), ("src3", 49)], "source string, want bigint")
    return _t(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).join(F.broadcast(want), "source").select("source", "n", (F.col("n") == F.col("want")).alias("as_expected"))


# Windows, ranks, limits

@query("SELECT c_custkey, 'cust_' || lpad(CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS VARCHAR), 3, '0') AS seq_id FROM customer")
def w1_sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("string")
    return _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("cust_"), F.lpad(n, 3, "0")).alias("seq_id"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey || ':42'), o_orderkey) AS r FROM orders) WHERE r <= 4")
def w3_r1_sample_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":42"))), "o_orderkey")
    return _t(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 4").select("o_orderkey", "o_custkey")


@query("SELECT c_nationkey, CAST(r AS INTEGER) AS position, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def w4_w8_top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return _t(spark, sf_dir, "customer").withColumn("position", F.row_number().over(w)).where("position <= 5").select("c_nationkey", "position", "c_custkey")


@query("SELECT n_nationkey, CAST(dense_rank() OVER (ORDER BY n_regionkey) AS INTEGER) AS ordinal, CAST(coalesce(o.ord, 999999) AS INTEGER) AS ord FROM nation LEFT JOIN (VALUES (3, 1), (1, 2), (2, 3)) o(k, ord) ON o.k = n_regionkey")
def w5_w6_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals over the 25 nations: a fixed catalogue, so the one-partition window is bounded."""
    order = spark.createDataFrame([(3, 1), (1, 2), (2, 3)], "n_regionkey int, ord int")
    return _t(spark, sf_dir, "nation").join(F.broadcast(order), "n_regionkey", "left").select("n_nationkey", F.dense_rank().over(Window.orderBy("n_regionkey")).alias("ordinal"), F.coalesce("ord", F.lit(999999)).alias("ord"))


@query("SELECT p_brand, min_by(p_name, p_partkey) AS first_name, array_to_string(list(p_partkey ORDER BY len(p_name) DESC, p_partkey)[:5], ',') AS longest FROM part GROUP BY 1")
def w7_w9_order_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc(F.length("p_name")), "p_partkey")
    top = _t(spark, sf_dir, "part").withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "p_partkey"))), lambda x: x["p_partkey"].cast("string")), ",").alias("longest"))
    return _t(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("first_name")).join(top, "p_brand")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def w10_s9_top_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, 'ord_' || CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS VARCHAR) AS seq_id FROM orders")
def w1_sequential_ids_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals over the whole table, by ranges and counted offsets."""
    placed = numbered(_t(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"])
    return placed.select("o_orderkey", F.concat(F.lit("ord_"), (F.col("place") + 1).cast("string")).alias("seq_id"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(dense_rank() OVER (ORDER BY l_shipdate, l_returnflag) AS BIGINT) AS ordinal FROM lineitem")
def w5_dense_ordinals_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ordinals of all lines: equal keys share one, whichever ranges they fall in."""
    ranked = dense_ranked(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag"), ["l_shipdate", "l_returnflag"], "ordinal")
    return ranked.select("l_orderkey", "l_linenumber", "l_partkey", "ordinal")


# Sets

@query("""SELECT 'union' AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'difference', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'intersection', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
UNION ALL SELECT 'missing', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT 'bag', count(*) FROM lineitem WHERE l_returnflag IN ('R', 'A')""")
def u1_u6_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _t(spark, sf_dir, "lineitem")
    r, a = (line.where(F.col("l_returnflag") == x).select("l_partkey") for x in "RA")
    sets = {"union": r.union(a).distinct(), "difference": r.subtract(a), "intersection": r.intersect(a), "missing": a.subtract(r), "bag": r.unionByName(a)}
    out = None
    for kind, df in sets.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out


# Scalars

@query("""SELECT o_orderkey, lower(trim(' ' || o_orderpriority || ' ')) AS low, try_cast(split_part(o_orderpriority, '-', 1) AS BIGINT) AS lead, md5(o_orderpriority) AS hash,
  CASE WHEN o_orderkey // 26 > 0 THEN 'Table_' || chr(65 + CAST(o_orderkey % 26 AS INTEGER)) || (o_orderkey // 26) ELSE 'Table_' || chr(65 + CAST(o_orderkey % 26 AS INTEGER)) END AS letters,
  strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS later, substr(o_orderpriority, 1, 3) AS head, CAST(len(o_orderpriority) // 3 AS INTEGER) AS tokens FROM orders""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    letter = F.concat(F.lit("Table_"), F.char(65 + k % 26), F.when(k >= 26, F.expr("cast(o_orderkey div 26 as string)")).otherwise(""))
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", F.lower(F.trim(F.concat(F.lit(" "), p, F.lit(" ")))).alias("low"), F.trim(F.split(p, "-")[0]).try_cast("bigint").alias("lead"), F.md5(p).alias("hash"),
        letter.alias("letters"), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("later"), F.substring(p, 1, 3).alias("head"), F.expr("cast(length(o_orderpriority) div 3 as int)").alias("tokens"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def scalar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# Sources and sinks, each by a round trip

@query(sql_with() + "SELECT dataset, CAST(count(*) AS BIGINT) AS n_edges, CAST(count(*) FILTER (edge_type = 'fk_to') AS BIGINT) AS n_fk FROM edges GROUP BY 1")
def s1_k1_graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "graph")
    FI.save_graph(*load(spark, sf_dir), path)
    return FI.load_graph(spark, path)[1].groupBy("dataset").agg(F.count("*").alias("n_edges"), F.count_if(F.col("edge_type") == "fk_to").alias("n_fk"))


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS row_id, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def s5_s7_k2_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "csv")
    FI.write_tables({"nation": _t(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1)}, path)
    return FI.with_row_id(FI.read_csv(spark, f"{path}/nation")).select("row_id", "n_nationkey", "n_name")


@query("SELECT row_number() OVER (ORDER BY o_orderkey % 7, o_orderkey) - 1 AS row_id, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders")
def s7_row_ids_of_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of rows in seven CSV files of unlike sizes, in order of file name and line."""
    path = _folder(spark, "many")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey")
    for i in range(7):
        rows.where(F.col("o_orderkey") % 7 == i).orderBy("o_orderkey").coalesce(1).write.option("header", True).csv(f"{path}/part{i}")
    return FI.with_row_id(FI.read_csv(spark, f"{path}/part*")).select("row_id", "o_orderkey")


@query("""SELECT 'orders' AS "table", CAST(count(*) AS BIGINT) AS rows, 6 AS columns FROM orders UNION ALL SELECT 'nation', count(*), 3 FROM nation""")
def s11_k2_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "tables")
    return FI.write_tables({n: _t(spark, sf_dir, n) for n in ("orders", "nation")}, path).select("table", "rows", "columns")


@query("SELECT * FROM (VALUES ('A', 'B', 'x'), ('C', 'D', 'y')) v(src, dst, evidence)")
def s6_lineage_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "lineage")
    rows = [json.dumps([{"source": "A", "target": "B", "evidence": "x"}, {"oltp_source": "C", "dw_table": "D", "evidence": "y"}])]
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(path)
    return FI.read_lineage(spark, path)


@query("SELECT * FROM (VALUES ('t', 0::BIGINT, 's', 0::BIGINT), ('t', 1, 's', 0), ('s', 0, 'm', 0)) v(src_table, src_row, dst_table, dst_row)")
def s10_lineage_map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "map")
    text = json.dumps({"s": {"row_0": {"sources": [{"table": "t", "rows": [0, 1]}]}}, "m": {"row_0": {"sources": [{"table": "s", "rows": [0]}]}}})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return FI.read_lineage_map(spark, path)


@query("SELECT o_orderstatus AS baseline, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY 1")
def s12_s13_k4_k5_results_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "results")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("gold"), F.col("o_orderstatus").alias("baseline"), F.lit("original").alias("condition"), F.lit("star").alias("dataset"), F.lit("m").alias("model"))
    FI.write_results(rows, path)
    back = FI.read_results(spark, path, "id bigint, gold bigint, baseline string, condition string, dataset string, model string")
    return back.groupBy("baseline").agg(F.count("*").alias("n"), F.sum("gold").alias("s"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'new' WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM orders""")
def k6_k8_resume_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old results of even orders, stale where divisible by 5; all orders anew; what was done and is not stale stays."""
    every = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    old, stale = every.where("id % 2 = 0").withColumn("origin", F.lit("old")), every.where("id % 5 = 0")
    left = FI.resume(old.join(stale, "id", "left_anti"), every).withColumn("origin", F.lit("new"))
    return FI.merge(old, left, stale)


@query("SELECT o_orderkey AS id, o_orderstatus || ':' || o_custkey AS answer FROM orders")
def k6_committed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders answered in about eight batches by a run that fails at its fourth and is started again."""
    every = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_custkey")
    target, size = B.Target(spark, _folder(spark, "answers")), max(1, every.count() // 8)
    answered = lambda rows: rows.select("id", F.concat_ws(":", "o_orderstatus", "o_custkey").alias("answer"))

    def failing(rows: DataFrame) -> DataFrame:
        if len(target.committed()) == 3:
            raise RuntimeError("stopped")
        return answered(rows)

    try:
        B.run(target, every, failing, "id", size)
    except RuntimeError:
        B.run(target, every, answered, "id", size)
    return target.read("id bigint, answer string").drop("batch_")


_TABLE_ROWS = ("orders", "nation", "region")


@query("""SELECT 'orders' AS "table", CAST(count(*) AS BIGINT) AS rows, 6 AS columns, 'fact' AS layer FROM orders UNION ALL SELECT 'nation', count(*), 3, 'dim' FROM nation UNION ALL SELECT 'region', count(*), 2, 'dim' FROM region""")
def s11_k2_manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written as CSV, their manifest as a JSON file, and that read again."""
    path = _folder(spark, "manifest")
    rows = FI.write_tables({n: _t(spark, sf_dir, n) for n in _TABLE_ROWS}, f"{path}/tables")
    FI.write_manifest(rows.withColumns({"layer": F.when(F.col("table") == "orders", "fact").otherwise("dim"), "silo": F.lit("star")}), f"{path}/manifest")
    return FI.read_manifest(spark, f"{path}/manifest").select("table", "rows", "columns", "layer")


@query(sql_with() + """SELECT 'FK_' || e.src || '_' || e.dst AS fk, e.src AS child, e.dst AS parent, n.dataset AS child_schema FROM (SELECT DISTINCT dataset, src, dst FROM edges WHERE edge_type = 'fk_to' AND dataset = 'tpc_di') e
  JOIN nodes n ON n.dataset = e.dataset AND n.name = e.src JOIN nodes m ON m.dataset = e.dataset AND m.name = e.dst""")
def s5_k3_catalogue_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema's catalogue files written and read, each reference with both its tables in them."""
    path = _folder(spark, "catalogue")
    nodes, edges = (t.where("dataset = 'tpc_di'") for t in load(spark, sf_dir))
    FI.write_catalogue(nodes, edges.select("dataset", "src", "dst", "edge_type").distinct(), path)
    tables, keys = FI.read_catalogue(spark, path)
    child = keys.join(tables, keys.ChildTable == tables.TABLE_NAME).select(F.col("ForeignKeyName").alias("fk"), F.col("ChildTable").alias("child"), F.col("ParentTable").alias("parent"), F.col("TABLE_SCHEMA").alias("child_schema"))
    return child.join(tables.select(F.col("TABLE_NAME").alias("parent")), "parent", "left_semi").select("fk", "child", "parent", "child_schema")


@query("SELECT o_orderstatus AS baseline, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def s13_k5_consolidated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in a folder a baseline, those of two baselines found by a pattern, told by file name and written as one."""
    path = _folder(spark, "all-results")
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("gold"), F.col("o_orderstatus").alias("baseline"), F.lit("original").alias("condition"), F.lit("star").alias("dataset"), F.lit("m").alias("model"))
    FI.write_results(rows, f"{path}/each")
    found = FI.consolidated(spark, f"{path}/each/baseline=[FO]/condition=*/dataset=*/model=*/*.json", "id bigint, gold bigint")
    found.select("id", "gold", F.regexp_extract("file", "baseline=([^/]+)/", 1).alias("baseline")).write.json(f"{path}/one")
    return FI.read_results(spark, f"{path}/one", "id bigint, gold bigint, baseline string").groupBy("baseline").agg(F.count("*").alias("n"), F.sum("gold").alias("s"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def k8_subset_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _t(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return _t(spark, sf_dir, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query(sql_with() + "SELECT d.layer, CAST(count(*) AS BIGINT) AS n_edges FROM (SELECT DISTINCT dst FROM edges WHERE dataset = 'sales' AND edge_type = 'derived_from') e JOIN dim d ON d.name = e.dst GROUP BY 1")
def p7_layer_by_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = load(spark, sf_dir)[1].where("dataset = 'sales' AND edge_type = 'derived_from'").select(F.col("dst").alias("name")).distinct()
    return targets.join(load_dim(spark, sf_dir).select("name", "layer"), "name").groupBy("layer").agg(F.count("*").alias("n_edges"))


@query(sql_with() + "SELECT DISTINCT dst AS name FROM edges WHERE dataset = 'sales' AND edge_type = 'derived_from' AND dst NOT LIKE 'stg%' AND dst IN (SELECT name FROM dim WHERE layer = 'mart')")
def j6_unmapped_in_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage targets without a mapping that the manifest has; staging tables are the mapped ones here."""
    dim = load_dim(spark, sf_dir)
    targets = load(spark, sf_dir)[1].where("dataset = 'sales' AND edge_type = 'derived_from'").select(F.col("dst").alias("name")).distinct()
    return targets.join(dim.where(F.col("name").startswith("stg")).select("name"), "name", "left_anti").join(dim.where("layer = 'mart'").select("name"), "name", "left_semi")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'no source' WHEN o_orderkey % 3 = 0 THEN 'other' ELSE 'same' END AS verdict FROM orders")
def j8_normalised_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored gold, in capitals and with blanks, or wrong for every third order, against the source's, which only odd orders have."""
    o, key = _t(spark, sf_dir, "orders"), F.col("o_orderpriority")
    stored = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "none").otherwise(F.concat(F.lit(" "), F.upper(key))).alias("gold"))
    source = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("id"), key.alias("answer_key"))
    plain = lambda c: F.lower(F.trim(c))
    return stored.join(source, "id", "left").select("id", F.when(F.col("answer_key").isNull(), "no source").when(plain("gold") == plain("answer_key"), "same").otherwise("other").alias("verdict"))


@query(sql_with() + """SELECT n.name AS "table", CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT 'orders:row_' || o_orderkey AS r FROM orders UNION ALL SELECT 'customer:row_' || c_custkey FROM customer UNION ALL SELECT 'nowhere:row_1') x
  JOIN nodes n ON n.dataset = 'star' AND n.name = split_part(x.r, ':', 1) GROUP BY 1""")
def j19_row_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda table, key: _t(spark, sf_dir, table).select(F.concat(F.lit(f"{table}:row_"), key).alias("r"))
    rows = ref("orders", "o_orderkey").union(ref("customer", "c_custkey")).union(spark.createDataFrame([("nowhere:row_1",)], "r string"))
    tables = load(spark, sf_dir)[0].where("dataset = 'star'").select(F.col("name").alias("table"))
    return rows.withColumn("table", F.split_part("r", F.lit(":"), F.lit(1))).join(tables, "table").groupBy("table").agg(F.count("*").alias("n_rows"))


@query(sql_with() + r"""SELECT name, regexp_extract(name, '^(?:raw|stg|dim|fact|mart)_([a-z]+)', 1) AS silo_word,
  replace(replace(replace('foreign key of ' || name || ', key', 'foreign key', '@1@'), 'key', 'handle'), '@1@', 'foreign key') AS kept_phrase, CAST(ordinal AS BIGINT) AS row, printf('%.3f', ordinal / 7.0) AS third FROM dim""")
def scalar_names_and_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A silo's word from a name, words replaced but for a protected phrase, a printed dictionary read back, three places."""
    text = F.concat(F.lit("foreign key of "), "name", F.lit(", key"))
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    printed = F.concat(F.lit("{'table': '"), "name", F.lit("', 'row': "), "ordinal", F.lit("}"))
    return load_dim(spark, sf_dir).select(
        "name", F.regexp_extract("name", "^(?:raw|stg|dim|fact|mart)_([a-z]+)", 1).alias("silo_word"), swap(swap(swap(text, "foreign key", "@1@"), "key", "handle"), "@1@", "foreign key").alias("kept_phrase"),
        F.from_json(printed, "table string, row bigint", {"allowSingleQuotes": "true"})["row"].alias("row"), F.format_string("%.3f", F.col("ordinal") / 7.0).alias("third"))
