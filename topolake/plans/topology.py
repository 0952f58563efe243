"""Queries on table graphs: lineage, components, join paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topolake.operators import topology as T
from topolake.operators import kernel as K
from topolake.sources.graphs import load, load_dim, sql_with

# SQL twins: reachability and distances on the same fixtures.
_LIN = "lin AS (SELECT DISTINCT dataset, src, dst FROM edges WHERE edge_type = 'derived_from')"
_FK = "fk AS (SELECT DISTINCT dataset, src, dst FROM edges WHERE edge_type = 'fk_to')"
_CLOSE = """reach(dataset, seed, node) AS (SELECT dataset, src, dst FROM lin
  UNION SELECT r.dataset, r.seed, l.dst FROM reach r JOIN lin l ON l.dataset = r.dataset AND l.src = r.node)"""
_BOTH = """both_(dataset, a, b) AS (SELECT dataset, src, dst FROM edges UNION SELECT dataset, dst, src FROM edges)"""
_COMP = """walk(dataset, name, other) AS (SELECT dataset, name, name FROM nodes
  UNION SELECT w.dataset, w.name, e.b FROM walk w JOIN both_ e ON e.dataset = w.dataset AND e.a = w.other),
comp AS (SELECT w.dataset, w.name, min(n.node_id) AS comp FROM walk w JOIN nodes n ON n.dataset = w.dataset AND n.name = w.other GROUP BY ALL)"""
_UFK = "ufk(dataset, a, b) AS (SELECT dataset, src, dst FROM fk UNION SELECT dataset, dst, src FROM fk)"


def _dist(edges: str, hops: int = 14) -> str:
    return f"""dist_(dataset, s, t, d) AS (SELECT dataset, name, name, 0 FROM nodes
  UNION SELECT x.dataset, x.s, e.b, x.d + 1 FROM dist_ x JOIN {edges} e ON e.dataset = x.dataset AND e.a = x.t WHERE x.d < {hops}),
dist AS (SELECT dataset, s, t, min(d) AS d FROM dist_ GROUP BY ALL)"""


def _paths(edges: str) -> str:
    return f"""path_(dataset, s, t, d, p) AS (SELECT dataset, name, name, 0, name FROM nodes
  UNION ALL SELECT x.dataset, x.s, e.b, x.d + 1, x.p || '>' || e.b FROM path_ x JOIN {edges} e ON e.dataset = x.dataset AND e.a = x.t
  JOIN dist y ON y.dataset = x.dataset AND y.s = x.s AND y.t = e.b AND y.d = x.d + 1),
path AS (SELECT dataset, s, t, d, min(string_split(p, '>')) AS nodes_ FROM path_ GROUP BY ALL)"""


_J = "array_to_string(list_sort(list(DISTINCT {0})), ',')"
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _joined(df: DataFrame, by: list[str], col: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(col)), ",").alias(name))


@query(sql_with(_LIN) + f"SELECT dataset, src AS name, {_J.format('dst')} AS targets FROM lin GROUP BY ALL")
def g1_forward_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(T.forward(load(spark, sf_dir)[1]), ["dataset", "name"], "target", "targets")


@query(sql_with(_LIN) + f"SELECT dataset, dst AS name, {_J.format('src')} AS sources FROM lin GROUP BY ALL")
def g2_reverse_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(T.reverse(load(spark, sf_dir)[1]), ["dataset", "name"], "source", "sources")


@query(sql_with(_LIN, _CLOSE) + f"""SELECT r.dataset, seed AS name, {_J.format('node')} AS reached FROM reach r WHERE seed <> node
  AND EXISTS (SELECT 1 FROM reach x WHERE x.dataset = r.dataset AND x.seed = r.seed AND x.node <> x.seed
              AND NOT EXISTS (SELECT 1 FROM lin l WHERE l.dataset = x.dataset AND l.src = x.seed AND l.dst = x.node)) GROUP BY ALL""")
def g3_transitive_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(T.transitive(load(spark, sf_dir)[1]), ["dataset", "name"], "node", "reached")


@query(sql_with(_LIN, _CLOSE) + f"SELECT dataset, node AS name, {_J.format('seed')} AS ancestors FROM reach WHERE seed <> node GROUP BY ALL")
def g4_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(T.closure(load(spark, sf_dir)[1], upstream=True), ["dataset", "seed"], "node", "ancestors").withColumnRenamed("seed", "name")


@query(sql_with(_LIN, _CLOSE) + f"""SELECT node AS name, {_J.format('seed')} AS raw_sources FROM reach JOIN dim ON dim.name = seed
  WHERE dataset = 'sales' AND layer = 'raw' AND node <> seed GROUP BY node""")
def g5_raw_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = T.closure(load(spark, sf_dir)[1].where("dataset = 'sales'"), upstream=True, max_depth=10)
    raw = load_dim(spark, sf_dir).where("layer = 'raw'").select(F.col("name").alias("node"))
    return _joined(up.join(raw, "node", "left_semi"), ["seed"], "node", "raw_sources").withColumnRenamed("seed", "name")


@query(sql_with(_LIN, _CLOSE) + f"""SELECT seed AS name, {_J.format('node')} AS marts FROM reach
  WHERE dataset = 'sales' AND node LIKE 'mart%' AND seed LIKE 'raw%' GROUP BY seed""")
def g6_downstream_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    down = T.closure(load(spark, sf_dir)[1].where("dataset = 'sales'"), max_depth=10)
    return _joined(down.where(F.col("seed").startswith("raw") & F.col("node").startswith("mart")), ["seed"], "node", "marts").withColumnRenamed("seed", "name")


_L = "L AS (SELECT dataset, seed, node FROM reach WHERE seed <> node)"
_IMPACT = {
    "base": """near AS (SELECT dataset, seed, node FROM L UNION SELECT DISTINCT dataset, src, src FROM lin),
hit AS (SELECT n.dataset, n.seed, f.src AS node FROM near n JOIN fk f ON f.dataset = n.dataset AND f.dst = n.node WHERE f.src <> n.seed
        AND NOT EXISTS (SELECT 1 FROM L x WHERE x.dataset = n.dataset AND x.seed = n.seed AND x.node = f.src))""",
    "extended": """hit AS (SELECT n.dataset, n.seed, f.src AS node FROM L n JOIN fk f ON f.dataset = n.dataset AND f.dst = n.node WHERE f.src <> n.seed
        AND NOT EXISTS (SELECT 1 FROM L x WHERE x.dataset = n.dataset AND x.seed = n.seed AND x.node = f.src))""",
    "both_ways": """near AS (SELECT dataset, seed, node FROM L UNION SELECT DISTINCT dataset, src, src FROM lin),
hit AS (SELECT n.dataset, n.seed, f.b AS node FROM near n JOIN ufk f ON f.dataset = n.dataset AND f.a = n.node WHERE f.b <> n.seed)""",
    "full_search": """hit(dataset, seed, node) AS (SELECT dataset, seed, node FROM L
  UNION SELECT h.dataset, h.seed, f.b FROM hit h JOIN ufk f ON f.dataset = h.dataset AND f.a = h.node)""",
}


def _impact(variant: str):
    keep = {"base": "h.n > 0", "extended": "h.n > 0", "both_ways": "len(u.names) >= 3", "full_search": "true"}[variant]
    sql = sql_with(_LIN, _FK, _UFK, _CLOSE, _L, _IMPACT[variant]) + f"""SELECT u.dataset, u.seed AS name, array_to_string(u.names, ',') AS impacted FROM
  (SELECT dataset, seed, list_sort(list(DISTINCT node)) AS names FROM (SELECT * FROM L UNION SELECT * FROM hit) WHERE node <> seed GROUP BY ALL) u
  LEFT JOIN (SELECT dataset, seed, count(*) AS n FROM hit GROUP BY ALL) h USING (dataset, seed) WHERE {keep}"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = T.combined_impact(load(spark, sf_dir)[1], variant)
        return found.select("dataset", "name", F.array_join("impacted", ",").alias("impacted"))

    run.__name__ = f"g7_combined_impact_{variant}"
    query(sql)(run)


for _v in _IMPACT:
    _impact(_v)


@query(sql_with(_LIN) + f"SELECT dataset, dst AS name, {_J.format('src')} AS sources, CAST(count(DISTINCT src) AS BIGINT) AS n_sources FROM lin GROUP BY ALL HAVING count(DISTINCT src) >= 2")
def g8_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.multi_source(load(spark, sf_dir)[1], 2)
    return found.select("dataset", "name", F.array_join("sources", ",").alias("sources"), "n_sources")


@query(sql_with(_LIN) + f"SELECT dataset, dst AS name, {_J.format('src')} AS sources, CAST(count(DISTINCT src) AS BIGINT) AS n_sources FROM lin GROUP BY ALL HAVING count(DISTINCT src) >= 3")
def g8_multi_source_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.multi_source(load(spark, sf_dir)[1]).withColumn("sources", F.array_join("sources", ","))


@query(sql_with(_BOTH, _COMP) + "SELECT dataset, name, CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY comp) - 1 AS INTEGER) AS silo FROM comp")
def g9_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.silos(*load(spark, sf_dir)).select("dataset", "name", "silo")


@query(sql_with(_BOTH, _COMP) + f"SELECT dataset, CAST(comp AS INTEGER) AS comp, CAST(count(*) AS BIGINT) AS n_tables, {_J.format('name')} AS members FROM comp GROUP BY ALL")
def g10_component_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.components(*load(spark, sf_dir))
    return found.groupBy("dataset", "comp").agg(F.count("*").alias("n_tables"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("members"))


@query(sql_with(_BOTH, _COMP) + "SELECT dataset, CAST(count(DISTINCT comp) AS BIGINT) AS n_silos FROM comp GROUP BY dataset")
def g11_silo_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.components(*load(spark, sf_dir)).groupBy("dataset").agg(F.countDistinct("comp").alias("n_silos"))


@query(sql_with() + "SELECT silo, layer, CAST(count(*) AS BIGINT) AS n_tables FROM dim GROUP BY ROLLUP (silo, layer) HAVING silo IS NOT NULL")
def g12_tables_per_silo_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_dim(spark, sf_dir).rollup("silo", "layer").agg(F.count("*").alias("n_tables")).where("silo IS NOT NULL")


@query(sql_with(_BOTH, _COMP) + f"""SELECT a.dataset, a.name, {_J.format('b.name')} AS others, CAST(count(*) AS BIGINT) AS n_others
  FROM comp a JOIN comp b ON a.dataset = b.dataset AND a.comp = b.comp AND a.name <> b.name GROUP BY ALL""")
def g13_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.membership(*load(spark, sf_dir))
    return found.groupBy("dataset", "name").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("others"), F.count("*").alias("n_others"))


@query(sql_with() + "SELECT name, silo FROM dim")
def g14_silo_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = load(spark, sf_dir)[0].where("dataset = 'sales'").select("name")
    return nodes.join(load_dim(spark, sf_dir).select("name", "silo"), "name")


@query(sql_with(_BOTH, _COMP) + """SELECT a.dataset, a.name AS a, b.name AS b, a.comp = b.comp AS is_connected, a.comp <> b.comp AS is_isolated
  FROM comp a JOIN comp b ON a.dataset = b.dataset AND a.name < b.name""")
def g15_g16_g17_connected_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of each catalogue, once: the squared size of a schema graph, tens to hundreds of tables."""
    return T.connections(*load(spark, sf_dir))


@query(sql_with(_BOTH, _COMP) + f"""SELECT dataset, {_J.format('name')} AS members FROM comp c JOIN
  (SELECT dataset, min(comp) AS comp FROM (SELECT dataset, comp FROM comp GROUP BY ALL HAVING count(*) >= 10) GROUP BY dataset) f USING (dataset, comp) GROUP BY dataset""")
def g18_full_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.components(*load(spark, sf_dir)).groupBy("dataset", "comp").agg(F.array_sort(F.collect_list("name")).alias("m")).where(F.size("m") >= 10)
    return found.groupBy("dataset").agg(F.array_join(F.min_by("m", "comp"), ",").alias("members"))


@query(sql_with(_BOTH, _COMP) + f"""SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY n DESC, comp) AS INTEGER) AS position, n AS n_tables, members FROM
  (SELECT dataset, comp, CAST(count(*) AS BIGINT) AS n, {_J.format('name')} AS members FROM comp GROUP BY ALL HAVING count(*) >= 3)""")
def g19_largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.components(*load(spark, sf_dir)).groupBy("dataset", "comp").agg(F.count("*").alias("n_tables"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("members"))
    w = Window.partitionBy("dataset").orderBy(F.desc("n_tables"), "comp")
    return found.where("n_tables >= 3").select("dataset", F.row_number().over(w).cast("int").alias("position"), "n_tables", "members")


@query(sql_with(_BOTH, _COMP) + """SELECT a.dataset, a.comp AS comp_a, b.comp AS comp_b, 'no path' AS answer FROM
  (SELECT dataset, CAST(comp AS INTEGER) AS comp FROM comp GROUP BY ALL HAVING count(*) >= 3) a JOIN
  (SELECT dataset, CAST(comp AS INTEGER) AS comp FROM comp GROUP BY ALL HAVING count(*) >= 3) b ON a.dataset = b.dataset AND a.comp < b.comp""")
def g20_no_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = K.components(*load(spark, sf_dir)).groupBy("dataset", "comp").count().where("count >= 3")
    a, b = big.select("dataset", F.col("comp").alias("comp_a")), big.select("dataset", F.col("comp").alias("comp_b"))
    return a.join(b, "dataset").where("comp_a < comp_b").withColumn("answer", F.lit("no path"))


@query(sql_with(_FK, _UFK, _dist("ufk"), _paths("ufk")) + """SELECT a.dataset, a.name AS s, b.name AS t, array_to_string(coalesce(p.nodes_, []), '>') AS path
  FROM nodes a JOIN nodes b ON a.dataset = b.dataset LEFT JOIN path p ON p.dataset = a.dataset AND p.s = a.name AND p.t = b.name""")
def g21_join_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.join_paths(*load(spark, sf_dir), "fk_to")
    return found.select("dataset", "s", "t", F.array_join("path", ">").alias("path"))


@query(sql_with(_BOTH, _dist("both_")) + """SELECT a.dataset, a.name AS s, b.name AS t, CAST(coalesce(d.d, -1) AS INTEGER) AS hops FROM nodes a JOIN nodes b ON a.dataset = b.dataset
  LEFT JOIN dist d ON d.dataset = a.dataset AND d.s = a.name AND d.t = b.name""")
def g22_shortest_any_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hop_counts(*load(spark, sf_dir))


@query(sql_with(_FK, _UFK, _dist("ufk")) + """SELECT dataset, s, t, CAST(d AS INTEGER) AS hops FROM dist WHERE s < t""")
def g23_hop_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.hop_counts(*load(spark, sf_dir), "fk_to").where("s < t AND hops >= 0")


@query(sql_with(_BOTH, _dist("both_")) + """SELECT s, t, CAST(d AS INTEGER) AS hops FROM dist WHERE dataset = 'sales' AND s LIKE 'raw%' AND t LIKE 'mart%'""")
def g24_raw_to_mart_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = load(spark, sf_dir)
    found = T.hop_counts(nodes.where("dataset = 'sales'"), edges.where("dataset = 'sales'"), seeds=F.col("seed").startswith("raw"))
    return found.where(F.col("s").startswith("raw") & F.col("t").startswith("mart") & (F.col("hops") >= 0)).select("s", "t", "hops")


@query(sql_with(_FK) + """SELECT a.dataset, a.name AS s, b.name AS t, f.src IS NOT NULL AS is_direct FROM nodes a JOIN nodes b ON a.dataset = b.dataset AND a.name <> b.name
  LEFT JOIN fk f ON f.dataset = a.dataset AND f.src = a.name AND f.dst = b.name""")
def g25_direct_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.direct(*load(spark, sf_dir))


@query(sql_with(_FK, _UFK, _dist("ufk"), _paths("ufk")) + """SELECT dataset, s, t, array_to_string(nodes_, '>') AS path FROM
  (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY s, t) AS r FROM path WHERE s < t AND len(nodes_) >= 5) WHERE r <= 15""")
def g26_long_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("dataset").orderBy("s", "t")
    found = T.join_paths(*load(spark, sf_dir), "fk_to").where((F.col("s") < F.col("t")) & (F.size("path") >= 5))
    return found.withColumn("r", F.row_number().over(w)).where("r <= 15").select("dataset", "s", "t", F.array_join("path", ">").alias("path"))


@query(sql_with(_FK) + """SELECT d.silo, min_by(d.name, d.ordinal) AS via, a.dst AS s, b.dst AS t FROM fk a JOIN fk b ON b.dataset = a.dataset AND b.src = a.src JOIN dim d ON d.name = a.src
  JOIN dim x ON x.name = a.dst JOIN dim y ON y.name = b.dst AND x.ordinal < y.ordinal WHERE a.dataset = 'sales' GROUP BY d.silo, a.dst, b.dst""")
def g27_dim_to_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dim_pairs(load_dim(spark, sf_dir), load(spark, sf_dir)[1].where("dataset = 'sales'"))


@query(sql_with(_FK) + """SELECT d.silo, f.src AS s, f.dst AS t, f.src || '>' || f.dst AS path FROM fk f JOIN dim d ON d.name = f.src AND d.name LIKE 'fact%' JOIN dim e ON e.name = f.dst AND e.name LIKE 'dim%' WHERE f.dataset = 'sales'""")
def g27_fact_to_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.fact_paths(load_dim(spark, sf_dir), load(spark, sf_dir)[1].where("dataset = 'sales'")).withColumn("path", F.array_join("path", ">"))


@query(sql_with(_FK, _UFK, _dist("ufk", 3)) + f"SELECT dataset, s AS name, CAST(k AS INTEGER) AS k, {_J.format('t')} AS near FROM dist JOIN (VALUES (1), (2), (3)) h(k) ON d BETWEEN 1 AND k GROUP BY ALL")
def g28_k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.neighbours(*load(spark, sf_dir), 3, "fk_to").withColumn("k", F.explode(F.sequence("depth", F.lit(3))))
    return _joined(found, ["dataset", "seed", "k"], "node", "near").withColumnRenamed("seed", "name")


@query(sql_with(_BOTH, _dist("both_", 3)) + f"""SELECT dataset, CAST(d AS INTEGER) AS depth, {_J.format('t')} AS layer FROM
  (SELECT dataset, t, min(d) AS d FROM dist WHERE s IN (SELECT name FROM nodes n WHERE n.dataset = dist.dataset AND node_id < 2) GROUP BY ALL) GROUP BY ALL""")
def g29_layered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = load(spark, sf_dir)
    starts = nodes.where("node_id < 2").select("dataset", F.col("name").alias("seed"))
    found = K.reach(K.undirected(edges), starts, max_depth=3).groupBy("dataset", "node").agg(F.min("depth").alias("depth"))
    return _joined(found, ["dataset", "depth"], "node", "layer")


@query(sql_with() + "SELECT dataset, array_to_string(list(name ORDER BY node_id), ',') AS tables FROM nodes GROUP BY dataset")
def g30_list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.transform(F.array_sort(F.collect_list(F.struct("node_id", "name"))), lambda x: x["name"])
    return load(spark, sf_dir)[0].groupBy("dataset").agg(F.array_join(named, ",").alias("tables"))


@query(sql_with(_FK) + """, p AS (SELECT a.dataset, a.name AS s, b.name AS t, f.src IS NOT NULL AS is_direct FROM nodes a JOIN nodes b ON a.dataset = b.dataset AND a.name <> b.name
  LEFT JOIN fk f ON f.dataset = a.dataset AND f.src = a.name AND f.dst = b.name)
SELECT dataset, s, t, is_direct FROM (SELECT *, row_number() OVER (PARTITION BY dataset, is_direct ORDER BY md5(s || '>' || t || ':42'), s, t) AS r FROM p) WHERE r <= 20""")
def g31_balanced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("dataset", "is_direct").orderBy(F.md5(F.concat(F.col("s"), F.lit(">"), F.col("t"), F.lit(":42"))), "s", "t")
    return T.direct(*load(spark, sf_dir)).withColumn("r", F.row_number().over(w)).where("r <= 20").drop("r")


@query(sql_with(_FK, _UFK, "p(id, path) AS (VALUES (1, ['lineitem', 'orders', 'customer']), (2, ['lineitem', 'customer']), (3, ['region', 'nation', 'supplier', 'lineitem']), (4, ['region']), (5, ['nation', 'nowhere']))")
       + """SELECT id, (SELECT count(*) FROM (SELECT unnest(path[:-2]) AS a, unnest(path[2:]) AS b) h JOIN ufk u ON u.dataset = 'star' AND u.a = h.a AND u.b = h.b) = len(path) - 1 AS is_valid FROM p""")
def g32_path_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, ["lineitem", "orders", "customer"]), (2, ["lineitem", "customer"]), (3, ["region", "nation", "supplier", "lineitem"]), (4, ["region"]), (5, ["nation", "nowhere"])]
    return T.valid_paths(spark.createDataFrame(rows, "id int, path array<string>"), load(spark, sf_dir)[1].where("dataset = 'star'"))


_TRADE = """trade AS MATERIALIZED (SELECT DISTINCT 'order:' || l_orderkey AS a, 'part:' || l_partkey AS b FROM lineitem UNION SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey FROM lineitem
  UNION SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders),
both_(a, b) AS MATERIALIZED (SELECT a, b FROM trade UNION SELECT b, a FROM trade),
pair_ AS (SELECT n_nationkey AS pair, 'customer:' || min(c_custkey) AS s, 'supplier:' || max(s_suppkey) AS t FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
out_(pair, s, t, x, d) AS (SELECT pair, s, t, s, 0 FROM pair_ UNION SELECT o.pair, o.s, o.t, e.b, o.d + 1 FROM out_ o JOIN both_ e ON e.a = o.x WHERE o.d < 3),
in_(pair, x, d) AS (SELECT pair, t, 0 FROM pair_ UNION SELECT o.pair, e.b, o.d + 1 FROM in_ o JOIN both_ e ON e.a = o.x WHERE o.d < 3),
o AS MATERIALIZED (SELECT pair, s, t, x, min(d) AS d FROM out_ GROUP BY ALL), i AS MATERIALIZED (SELECT pair, x, min(d) AS d FROM in_ GROUP BY ALL),
len_ AS (SELECT o.pair, min(o.d + i.d) AS n FROM o JOIN i ON i.pair = o.pair AND i.x = o.x GROUP BY 1),
far_ AS MATERIALIZED (SELECT o.pair, o.x, o.d AS hop FROM o JOIN i ON i.pair = o.pair AND i.x = o.x JOIN len_ l ON l.pair = o.pair AND o.d + i.d = l.n),
walk_(pair, x, hop, p) AS (SELECT pair, s, 0, s FROM pair_ UNION ALL SELECT w.pair, f.x, f.hop, w.p || '>' || f.x FROM walk_ w JOIN both_ e ON e.a = w.x JOIN far_ f ON f.pair = w.pair AND f.x = e.b AND f.hop = w.hop + 1)"""


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, src, dst), both directions: customers and their orders, orders and their parts, parts and their suppliers."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    name = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    line, edge = t("lineitem"), F.struct
    each = line.select(F.explode(F.array(
        edge(name("order", "l_orderkey").alias("src"), name("part", "l_partkey").alias("dst")), edge(name("part", "l_partkey").alias("src"), name("supplier", "l_suppkey").alias("dst")))).alias("e")).select("e.*")
    one = each.union(t("orders").select(name("customer", "o_custkey"), name("order", "o_orderkey"))).withColumn("dataset", F.lit("trade"))
    return K.undirected(one.withColumn("edge_type", F.lit("trade")))


@query("WITH RECURSIVE " + _TRADE + " SELECT w.pair, array_to_string(min(string_split(w.p, '>')), '>') AS path, CAST(max(l.n) AS INTEGER) AS hops FROM walk_ w JOIN len_ l ON l.pair = w.pair AND l.n = w.hop GROUP BY w.pair")
def g21_paths_between_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each nation's first customer and last supplier are joined by trade: least shortest path, searched from both ends."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    first = t("customer").groupBy(F.col("c_nationkey").alias("pair")).agg(F.concat(F.lit("customer:"), F.min("c_custkey").cast("string")).alias("s"))
    last = t("supplier").groupBy(F.col("s_nationkey").alias("pair")).agg(F.concat(F.lit("supplier:"), F.max("s_suppkey").cast("string")).alias("t"))
    found = K.paths_between(trade_graph(spark, sf_dir), first.join(last, "pair").withColumn("dataset", F.lit("trade")))
    return found.select("pair", F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops"))
