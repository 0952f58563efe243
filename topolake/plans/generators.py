"""Queries of generators and validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topolake.operators import generate as G
from topolake.operators import kernel as K
from topolake.operators import validate as V
from topolake.sources.graphs import load, load_dim, sql_with

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _d(*parts: str) -> str:
    return "(('0x' || substr(md5(" + " || ':' || ".join(parts) + "), 1, 8))::BIGINT)"


_KIND = "CASE WHEN starts_with(name, 'raw_') THEN 'raw' WHEN starts_with(name, 'stg_') THEN 'staging' WHEN starts_with(name, 'dim_') THEN 'dim' WHEN starts_with(name, 'fact_') THEN 'fact' ELSE 'mart' END"
_LOW = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in G.RANGES.items()) + " END"
_SPAN = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v[1] - v[0] + 1}" for k, v in G.RANGES.items()) + " END"


@query(sql_with() + f"SELECT name, kind, CAST({_LOW} + {_d('name', chr(39) + '42' + chr(39))} % {_SPAN} AS BIGINT) AS rows FROM (SELECT name, {_KIND} AS kind FROM dim)")
def r3_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.row_counts(load_dim(spark, sf_dir))


_FAN = lambda i: "CASE d.kind " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in G.FAN_IN.items()) + " END"
_OF = lambda what: _d("dst", "k", "src", f"'{what}'", "'42'")


@query(sql_with(f"c AS (SELECT name, kind, CAST({_LOW} + {_d('name', chr(39) + '42' + chr(39))} % {_SPAN} AS BIGINT) AS rows FROM (SELECT name, {_KIND} AS kind FROM dim))",
    "e AS (SELECT DISTINCT src, dst FROM edges WHERE dataset = 'sales' AND edge_type = 'derived_from')",
    f"t AS (SELECT src, dst, n, k, start, fan, 1 + {_OF('step')} % greatest(1, n // fan) AS step FROM (SELECT src, dst, s.rows AS n, k, {_OF('start')} % s.rows AS start, least({_FAN(0)} + {_OF('fan')} % ({_FAN(1)} - {_FAN(0)} + 1), s.rows) AS fan FROM e JOIN c s ON s.name = src JOIN c d ON d.name = dst, range(0, 10000) r(k) WHERE k < d.rows))")
       + """SELECT dst AS "table", src AS source, CAST(count(DISTINCT k) AS BIGINT) AS n_rows, CAST(count(*) AS BIGINT) AS n_edges, CAST(count(DISTINCT k * 100000 + r) AS BIGINT) AS n_pairs, CAST(min(fan) AS BIGINT) AS least, CAST(max(fan) AS BIGINT) AS most, CAST(sum((k + 1) * r) AS BIGINT) AS total
  FROM (SELECT src, dst, k, fan, (start + j * step) % n AS r FROM t, range(0, 25) x(j) WHERE j < fan) GROUP BY ALL""")
def r6_row_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row edges of the whole layered schema at its generated row counts, told by pair of tables."""
    edges = G.row_lineage(load(spark, sf_dir)[1].where("dataset = 'sales' AND edge_type = 'derived_from'"), G.row_counts(load_dim(spark, sf_dir)))
    one = edges.groupBy("dst_table", "src_table", "dst_row").agg(F.count("*").alias("fan"), F.countDistinct("src_row").alias("own"), F.sum("src_row").alias("s"))
    return one.groupBy(F.col("dst_table").alias("table"), F.col("src_table").alias("source")).agg(
        F.count("*").alias("n_rows"), F.sum("fan").alias("n_edges"), F.sum("own").alias("n_pairs"), F.min("fan").alias("least"), F.max("fan").alias("most"), F.sum((F.col("dst_row") + 1) * F.col("s")).alias("total"))


_I = "CAST(id AS VARCHAR)"


@query(f"SELECT id, {_d(_I, chr(39) + 'src:42' + chr(39))} % 700 AS source_id, {_d(_I, chr(39) + 'flag:42' + chr(39))} % 10 < 9 AS validated_flag, round({_d(_I, chr(39) + 'q:42' + chr(39))} % 1000 / 1000.0, 3) AS quality_score, CAST({_d(_I, chr(39) + 'batch:42' + chr(39))} % 50 AS INTEGER) AS batch_id FROM range(3000) r(id)")
def r4_r5_staging_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.staging_rows(spark, 3000, 700)


@query(f"SELECT id AS surrogate_key, 'BK' || lpad(CAST(id AS VARCHAR), 6, '0') AS business_key, ['A', 'B', 'C', 'D', 'E'][{_d(_I, chr(39) + 'cat:42' + chr(39))} % 5 + 1] AS category, strftime(DATE '2020-01-01' + CAST({_d(_I, chr(39) + 'day:42' + chr(39))} % 1500 AS INTEGER), '%Y-%m-%d') AS effective_date, {_d(_I, chr(39) + 'cur:42' + chr(39))} % 5 > 0 AS is_current FROM range(800) r(id)")
def r5_dimension_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.dimension_rows(spark, 800)


@query(f"SELECT id AS fact_key, {_d(_I, chr(39) + 'dim_supplier:42' + chr(39))} % 600 AS dim_supplier_key, {_d(_I, chr(39) + 'dim_product:42' + chr(39))} % 900 AS dim_product_key, round({_d(_I, chr(39) + 'm1:42' + chr(39))} % 100000 / 100.0, 2) AS measure_1, CAST({_d(_I, chr(39) + 'm3:42' + chr(39))} % 100 AS INTEGER) AS measure_3 FROM range(2000) r(id)")
def r5_fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fact_rows(spark, 2000, {"dim_supplier": 600, "dim_product": 900})


@query(f"SELECT id AS metric_key, {_d(_I, chr(39) + 'dim:42' + chr(39))} % 500 AS dimension_key, round({_d(_I, chr(39) + 'kpi:42' + chr(39))} % 100000 / 100.0, 2) AS kpi_value, '2024-' || lpad(CAST({_d(_I, chr(39) + 'm:42' + chr(39))} % 12 + 1 AS VARCHAR), 2, '0') AS period FROM range(400) r(id)")
def r5_mart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mart_rows(spark, 400)


@query(f"SELECT id AS fact_key, k AS ref FROM (SELECT id, {_d(_I, chr(39) + 'dim_supplier:42' + chr(39))} % 600 AS k FROM range(2000) r(id)) WHERE k >= 600 OR k IN (SELECT id FROM range(0, 10) s(id))")
def r11_reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated keys outside their dimension, none, and those of its first ten rows."""
    fact = G.fact_rows(spark, 2000, {"dim_supplier": 600})
    few = G.dimension_rows(spark, 600).where("surrogate_key < 10").select(F.col("surrogate_key").alias("ref"), F.lit(True).alias("few"))
    return fact.select("fact_key", F.col("dim_supplier_key").alias("ref")).join(few, "ref", "left").where("ref >= 600 OR few").select("fact_key", "ref")


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'short' WHEN o_totalprice < 200000 THEN 'medium' ELSE 'long' END AS bucket, md5(o_orderkey || ':42') AS h FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, o_orderkey) AS r FROM b), f AS (SELECT * FROM r WHERE r <= 10)
SELECT o_orderkey, bucket FROM f UNION ALL SELECT o_orderkey, bucket FROM (SELECT * FROM r WHERE r > 10 ORDER BY h, o_orderkey LIMIT (SELECT greatest(0, 50 - count(*)) FROM f))""")
def r2_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(p < 50000, "short").when(p < 200000, "medium").otherwise("long").alias("bucket"))
    return G.stratified(rows, "bucket", "o_orderkey", 10, 50)


@query(sql_with() + """SELECT dataset, 'repeated' AS finding, src || '>' || dst AS subject FROM edges GROUP BY dataset, src, dst, edge_type HAVING count(*) > 1
UNION ALL SELECT DISTINCT f.dataset, 'opposed', f.src || '>' || f.dst FROM edges f JOIN edges d ON f.edge_type = 'fk_to' AND d.edge_type = 'derived_from' AND f.dataset = d.dataset AND f.src = d.dst AND f.dst = d.src
UNION ALL SELECT dataset, 'loop', src FROM edges WHERE src = dst""")
def x1_x9_graph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.graph_findings(*load(spark, sf_dir))


@query(sql_with() + """SELECT c.dataset, c.what, CAST(c.n AS BIGINT) AS n, CAST(o.official AS BIGINT) AS official FROM (SELECT dataset, 'tables' AS what, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT dataset, edge_type, count(*) FROM edges GROUP BY 1, 2) c
JOIN (VALUES ('tpc_ds', 'tables', 24), ('tpc_ds', 'fk_to', 70), ('omop_cdm', 'fk_to', 74), ('omop_cdm', 'derived_from', 21), ('tpc_di', 'fk_to', 29), ('syn_logistics', 'fk_to', 96)) o(dataset, what, official) USING (dataset, what) WHERE c.n <> o.official""")
def x7_official_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = load(spark, sf_dir)
    counts = nodes.groupBy("dataset").agg(F.count("*").alias("n")).withColumn("what", F.lit("tables")).select("dataset", "what", "n").union(edges.groupBy("dataset", "edge_type").agg(F.count("*").alias("n")))
    official = [("tpc_ds", "tables", 24), ("tpc_ds", "fk_to", 70), ("omop_cdm", "fk_to", 74), ("omop_cdm", "derived_from", 21), ("tpc_di", "fk_to", 29), ("syn_logistics", "fk_to", 96)]
    return V.count_findings(counts, spark.createDataFrame(official, "dataset string, what string, official bigint"))


def _closed(name: str, edges: str) -> str:
    return f"{name}(dataset, a, b) AS (SELECT dataset, src, dst FROM {edges} UNION SELECT r.dataset, r.a, x.dst FROM {name} r JOIN {edges} x ON x.dataset = r.dataset AND x.src = r.b)"


@query(sql_with("lin AS (SELECT DISTINCT dataset, src, dst FROM edges WHERE edge_type = 'derived_from')", "cut AS (SELECT * FROM lin l WHERE (src || '>' || dst) <> (SELECT min(src || '>' || dst) FROM lin WHERE dataset = l.dataset))", _closed("reach", "lin"), _closed("less", "cut"))
       + "SELECT r.dataset, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count(*) FILTER (l.a IS NULL) AS BIGINT) AS n_differing FROM reach r LEFT JOIN less l ON l.dataset = r.dataset AND l.a = r.a AND l.b = r.b WHERE r.a <> r.b GROUP BY r.dataset")
def x2_x4_duality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of all tables against ancestors of all tables where one derivation a dataset has been lost."""
    from topolake.operators import kernel as K

    edges = load(spark, sf_dir)[1].where("edge_type = 'derived_from'")
    pair = F.concat("src", F.lit(">"), "dst")
    cut = edges.withColumn("lost", F.min(pair).over(Window.partitionBy("dataset"))).where(pair != F.col("lost"))
    return V.closure_differences(K.directed(edges), K.directed(cut))


@query("SELECT * FROM (VALUES (2, 'no text'), (3, 'unknown answer type'), (4, 'no answer'), (5, 'repeated text')) v(id, finding)")
def x3_x6_question_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "a?", "list", "x"), (2, " ", "list", "x"), (3, "b?", "tuple", "x"), (4, "c?", "string", None), (5, "a?", "list", "y")]
    return V.question_findings(spark.createDataFrame(rows, "id int, question string, answer_type string, answer string"))


@query("""SELECT o_orderstatus AS baseline, o_orderpriority AS dataset, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_ids, CAST(1000 AS BIGINT) AS expected, CASE WHEN count(*) <> 1000 THEN 'wrong count' ELSE 'ok' END AS verdict FROM orders GROUP BY ALL""")
def x8_result_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("baseline"), F.col("o_orderpriority").alias("dataset"))
    want = o.select("dataset").distinct().withColumn("expected", F.lit(1000).cast("bigint"))
    return V.integrity(o, want)


@query("SELECT doc_id, CAST(1 AS BIGINT) AS n_left FROM documents WHERE doc_id % 7 = 0")
def x5_obfuscation_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that name a table after obfuscation, counted. Every text gets two names, every seventh one that the map lacks."""
    from topolake.operators import text as X

    names = X.obfuscation(load(spark, sf_dir)[0].where("dataset = 'omop_cdm'")).collect()
    mapping = {r["original"]: r["obfuscated"] for r in names}
    put = F.concat(F.lit("drug_exposure visit_occurrence "), F.when(F.col("doc_id") % 7 == 0, "person ").otherwise(""), "text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", put.alias("text"))
    found = X.mentions(X.obfuscate(docs, {k: v for k, v in mapping.items() if k != "person"}), list(mapping))
    return found.where(F.size("mentioned") > 0).select("doc_id", F.size("mentioned").cast("bigint").alias("n_left"))
