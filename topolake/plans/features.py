"""Feature queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolake.operators import features as X
from topolake.operators import kernel as K
from topolake.operators import topology as T
from topolake.sources.graphs import load, sql_with

from .topology import _BOTH, _COMP

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_E = "e AS (SELECT DISTINCT dataset, src, dst FROM edges WHERE edge_type = 'fk_to')"
_DEG = """deg AS (SELECT n.dataset, n.name, (SELECT count(*) FROM e WHERE e.dataset = n.dataset AND e.dst = n.name) AS in_deg, (SELECT count(*) FROM e WHERE e.dataset = n.dataset AND e.src = n.name) AS out_deg,
  count(*) OVER (PARTITION BY n.dataset) AS n FROM nodes n)"""


@query(sql_with(_E, _DEG) + "SELECT dataset, name, CAST(in_deg AS BIGINT) AS in_deg, CAST(out_deg AS BIGINT) AS out_deg, round((in_deg + out_deg) / (n - 1.0), 6) AS degree_c FROM deg")
def f1_f2_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.degrees(*load(spark, sf_dir), "fk_to").withColumn("degree_c", F.round("degree_c", 6))


@query(sql_with("e AS (SELECT DISTINCT dataset, src, dst FROM edges WHERE src <> dst)", """p_(dataset, s, t, d, n) AS (SELECT dataset, src, dst, 1, count(*) FROM e GROUP BY ALL)""") + """,
d1 AS (SELECT dataset, src AS s, dst AS t FROM e),
walk(dataset, s, t, d) AS (SELECT dataset, s, t, 1 FROM d1 UNION SELECT w.dataset, w.s, e.dst, w.d + 1 FROM walk w JOIN e ON e.dataset = w.dataset AND e.src = w.t WHERE w.d < 12),
dist AS (SELECT dataset, s, t, min(d) AS d FROM walk WHERE s <> t GROUP BY ALL),
route(dataset, s, t, d, p) AS (SELECT dataset, src, dst, 1, src || '>' || dst FROM e UNION ALL SELECT r.dataset, r.s, e.dst, r.d + 1, r.p || '>' || e.dst FROM route r JOIN e ON e.dataset = r.dataset AND e.src = r.t
  JOIN dist x ON x.dataset = r.dataset AND x.s = r.s AND x.t = e.dst AND x.d = r.d + 1),
cnt AS (SELECT dataset, s, t, d, count(*) AS n FROM route GROUP BY ALL),
via AS (SELECT a.dataset, a.t AS name, sum(a.n * b.n / c.n::DOUBLE) AS part FROM cnt a JOIN cnt b ON a.dataset = b.dataset AND a.t = b.s AND a.s <> b.t JOIN cnt c ON c.dataset = a.dataset AND c.s = a.s AND c.t = b.t AND c.d = a.d + b.d GROUP BY ALL)
SELECT n.dataset, n.name, round(coalesce(part, 0) / greatest(1, (m - 1) * (m - 2)), 6) AS betweenness FROM nodes n JOIN (SELECT dataset, count(*) AS m FROM nodes GROUP BY 1) z USING (dataset) LEFT JOIN via v ON v.dataset = n.dataset AND v.name = n.name""")
def f3_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.betweenness(*load(spark, sf_dir)).withColumn("betweenness", F.round("betweenness", 6))


@query(sql_with(_BOTH, "deg AS (SELECT dataset, a, count(*) AS k FROM both_ GROUP BY ALL)", "size_ AS (SELECT dataset, count(*) AS n FROM nodes GROUP BY 1)",
    """rank_(turn, dataset, name, r) AS (SELECT 0, nodes.dataset, name, 1.0::DOUBLE / n FROM nodes JOIN size_ USING (dataset)
  UNION ALL SELECT turn + 1, dataset, name, 0.15 / n + 0.85 * (coalesce(got, 0) + idle / n) FROM (
    SELECT x.turn, x.dataset, x.name, s.n, (SELECT sum(y.r / d.k) FROM rank_ y JOIN both_ b ON b.dataset = y.dataset AND b.a = y.name JOIN deg d ON d.dataset = y.dataset AND d.a = y.name WHERE b.dataset = x.dataset AND b.b = x.name) AS got,
      coalesce((SELECT sum(z.r) FROM rank_ z LEFT JOIN deg d ON d.dataset = z.dataset AND d.a = z.name WHERE z.dataset = x.dataset AND d.k IS NULL), 0) AS idle
    FROM rank_ x JOIN size_ s ON s.dataset = x.dataset WHERE x.turn < 60))""") + "SELECT dataset, name, round(r, 6) AS rank FROM rank_ WHERE turn = 60")
def f4_page_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.page_rank(*load(spark, sf_dir)).withColumn("rank", F.round("rank", 6))


@query(sql_with("both_(dataset, a, b) AS (SELECT dataset, src, dst FROM edges WHERE edge_type = 'fk_to' UNION SELECT dataset, dst, src FROM edges WHERE edge_type = 'fk_to')", _COMP)
       + "SELECT dataset, name, CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY comp) - 1 AS INTEGER) AS silo_id FROM comp")
def f5_silo_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = load(spark, sf_dir)
    return T.silos(nodes, edges.where("edge_type = 'fk_to'")).select("dataset", "name", F.col("silo").alias("silo_id"))


@query(sql_with() + """, d AS (SELECT n.dataset, n.name, (SELECT count(*) FROM edges e WHERE e.dataset = n.dataset AND e.edge_type = 'fk_to' AND e.src = n.name) AS o, (SELECT count(*) FROM edges e WHERE e.dataset = n.dataset AND e.edge_type = 'fk_to' AND e.dst = n.name) AS i,
  (SELECT count(*) FROM edges e WHERE e.dataset = n.dataset AND e.edge_type = 'derived_from' AND e.src = n.name) + (SELECT count(*) FROM edges e WHERE e.dataset = n.dataset AND e.edge_type = 'derived_from' AND e.dst = n.name) AS l,
  (SELECT count(*) FROM edges e WHERE e.dataset = n.dataset) AS e, (SELECT count(*) FROM nodes m WHERE m.dataset = n.dataset) AS n FROM nodes n),
m AS (SELECT *, greatest(max(o) OVER w, max(i) OVER w, 1) AS most FROM d WINDOW w AS (PARTITION BY dataset))
SELECT dataset, name, CAST(o AS BIGINT) AS out_deg, CAST(i AS BIGINT) AS in_deg, round((o + i) / most::DOUBLE, 6) AS norm, CAST(l AS BIGINT) AS lineage_deg, round((o + i) / most::DOUBLE / 2, 6) AS betweenness, round((i + 1) / (e + n)::DOUBLE, 6) AS rank FROM m""")
def f6_approximated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.approximated(*load(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("norm", "betweenness", "rank")})


@query(sql_with(_E, _DEG) + "SELECT dataset, CAST(position AS INTEGER) AS position, name, CAST(degree AS BIGINT) AS degree FROM (SELECT dataset, name, in_deg + out_deg AS degree, row_number() OVER (PARTITION BY dataset ORDER BY in_deg + out_deg DESC, name) AS position FROM deg) WHERE position <= 5")
def f7_top_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.top_degree(*load(spark, sf_dir))


Q["f8_feature_concat"] = lambda spark, sf_dir: feature_concat(spark, sf_dir)
SQL["f8_feature_concat"] = """SELECT vec_id, CAST(len(list_concat(embedding, [label::FLOAT, vec_id::FLOAT])) AS INTEGER) AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + label + vec_id, 4) AS total FROM embeddings"""


def feature_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding and structural numbers as one array; named columns keep each feature's meaning outside it."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    df = df.withColumn("x", F.concat("embedding", F.array(F.col("label").cast("float"), F.col("vec_id").cast("float"))))
    total = F.aggregate(F.slice("x", 1, F.size("embedding")), F.lit(0.0), lambda a, v: a + v.cast("double")) + F.col("label") + F.col("vec_id")
    return df.select("vec_id", F.size("x").alias("width"), F.round(total, 4).alias("total"))
