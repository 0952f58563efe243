"""Scoring and metric queries, on predictions made by rule from the driver's orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topolake.functions import answers as A
from topolake.operators import scoring as S
from topolake.sources.graphs import load, sql_with

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BASELINES = ("flat", "vector", "graph", "tools", "code")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for every order: its kind of answer by key, gold from its columns, the prediction a known distortion."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    ref = F.concat(F.lit("part:row_"), F.col("l_partkey"))
    loose = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("part: rows ["), F.col("l_partkey"), F.lit("]"))).otherwise(ref)
    lists = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.array_sort(F.collect_set(ref)).alias("gold_list"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "R", loose))).alias("pred_list"))
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "list").when(k % 4 == 1, "integer").when(k % 4 == 2, "boolean").otherwise("string")
    key, pri = F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    pred = F.when(kind == "integer", F.when(k % 3 == 0, F.concat(key, F.lit(".0"))).otherwise(F.concat(F.lit(" "), key))).when(
        kind == "boolean", F.when(k % 5 == 0, "Yes").otherwise("false")).when(kind == "string", F.when(k % 7 == 0, "other").otherwise(F.concat(F.upper(pri), F.lit(" "))))
    gold = F.when(kind == "integer", key).when(kind == "boolean", (F.col("o_totalprice") > 150000).cast("string")).when(kind == "string", pri)
    o = t("orders").select(
        k.alias("id"), kind.alias("answer_type"), kind.alias("type"), pri.alias("subtype"), F.col("o_orderstatus").alias("difficulty"),
        F.element_at(F.array(*[F.lit(b) for b in _BASELINES]), (k % 5 + 1).cast("int")).alias("baseline"), F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("model"),
        F.when(F.col("o_custkey") % 2 == 0, "original").otherwise("obfuscated").alias("condition"), F.concat(F.lit("d"), F.col("o_custkey") % 5).alias("dataset"),
        pred.alias("pred"), F.lit("str").alias("pred_kind"), gold.alias("gold"), F.when(kind == "integer", "int").when(kind == "boolean", "bool").otherwise("str").alias("gold_kind"),
    )
    return o.join(lists, "id", "left")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score(results(spark, sf_dir))


_SCORED = """
lists AS (SELECT l_orderkey AS id, list(DISTINCT l_partkey) AS g, list(DISTINCT l_partkey) FILTER (l_returnflag <> 'R') AS p FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'list' WHEN 1 THEN 'integer' WHEN 2 THEN 'boolean' ELSE 'string' END AS type,
  o_orderpriority AS subtype, o_orderstatus AS difficulty, ['flat', 'vector', 'graph', 'tools', 'code'][o_orderkey % 5 + 1] AS baseline, 'm' || (o_custkey % 3) AS model,
  CASE WHEN o_custkey % 2 = 0 THEN 'original' ELSE 'obfuscated' END AS condition, 'd' || (o_custkey % 5) AS dataset, o_totalprice > 150000 AS flag, g, coalesce(p, []) AS p,
  len(list_intersect(g, coalesce(p, []))) AS hit FROM orders LEFT JOIN lists ON id = o_orderkey),
s AS (SELECT *, CASE type WHEN 'list' THEN g IS NULL OR (hit = len(g) AND hit = len(p)) WHEN 'integer' THEN id % 3 <> 0 WHEN 'boolean' THEN flag = (id % 5 = 0) ELSE id % 7 <> 0 END AS exact_match,
  CASE WHEN type <> 'list' THEN NULL WHEN g IS NULL THEN 1.0 WHEN len(p) = 0 THEN 0.0 ELSE round(hit / len(p)::DOUBLE, 4) END AS precision,
  CASE WHEN type <> 'list' THEN NULL WHEN g IS NULL THEN 1.0 WHEN len(p) = 0 THEN 0.0 ELSE round(hit / len(g)::DOUBLE, 4) END AS recall,
  CASE WHEN g IS NULL THEN 1.0 WHEN hit = 0 THEN 0.0 ELSE round(2.0 * (hit / len(p)::DOUBLE) * (hit / len(g)::DOUBLE) / (hit / len(p)::DOUBLE + hit / len(g)::DOUBLE), 4) END AS lf FROM o),
scored AS (SELECT id, type, subtype, difficulty, baseline, model, condition, dataset, exact_match, precision, recall,
  CASE WHEN type = 'list' THEN lf ELSE exact_match::INT::DOUBLE END AS f1 FROM s)
"""
_W = "WITH " + _SCORED
_EM = "round(avg(exact_match::INT::DOUBLE), 4)"


def _em():
    return F.round(F.avg(F.col("exact_match").cast("int").cast("double")), 4)


_CASES = [
    ("Yes", "str", "true", "bool"), ("no", "str", "false", "bool"), ("maybe", "str", "true", "bool"), ("5", "str", "5", "int"), ("5.0", "str", "5", "int"), ("5.7", "float", "5", "int"),
    (" Foo", "str", "foo", "str"), (None, "null", "foo", "str"), ("true", "bool", "yes", "str"), ("7", "int", "8", "int"),
]


@query("SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, true), (4, false), (5, true), (6, true), (7, false), (8, true), (9, false)) v(id, exact)")
def c1_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(_CASES)], "id int, pred string, pred_kind string, gold string, gold_kind string")
    return rows.select("id", A.exact_match(*map(F.col, ("pred", "pred_kind", "gold", "gold_kind"))).alias("exact"))


@query("SELECT l_partkey AS id, 'part:row_' || l_partkey AS ref, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def c2_row_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("part: rows ["), k, F.lit("]"))).when(k % 4 == 1, F.concat(F.lit("part row_"), k)).when(
        k % 4 == 2, F.concat(F.lit(" part: row ("), k, F.lit(")"))).otherwise(F.concat(F.lit("part:row_"), k))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(k.alias("id"), A.row_ref(raw).alias("ref")).agg(F.count("*").alias("n"))


@query(_W + "SELECT id, exact_match, f1, precision, recall FROM scored")
def c3_c5_score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("id", "exact_match", "f1", "precision", "recall")


_FK = "fk AS (SELECT DISTINCT dataset, src, dst FROM edges WHERE edge_type = 'fk_to'), ufk(dataset, a, b) AS (SELECT dataset, src, dst FROM fk UNION SELECT dataset, dst, src FROM fk)"


@query(sql_with(_FK) + """SELECT x.dataset, x.a AS s, y.b AS t, true AS exact_match, 1.0 AS f1, min(x.b) = max(x.b) AS order_correct, min(x.b) <> max(x.b) AS valid_alt_path
  FROM ufk x JOIN ufk y ON x.dataset = y.dataset AND x.b = y.a AND x.a <> y.b AND x.a <> x.b AND y.a <> y.b
  WHERE NOT EXISTS (SELECT 1 FROM ufk z WHERE z.dataset = x.dataset AND z.a = x.a AND z.b = y.b) GROUP BY ALL""")
def c4_ordered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold is the least two-hop path by names, the prediction the greatest: another path counts if its hops are keys."""
    from topolake.operators import kernel as K

    edges = load(spark, sf_dir)[1]
    both = K.undirected(edges, "fk_to").where("src <> dst")
    x = both.select("dataset", F.col("src").alias("s"), F.col("dst").alias("mid"))
    two = x.join(both.select("dataset", F.col("src").alias("mid"), F.col("dst").alias("t")), ["dataset", "mid"]).where("s <> t")
    two = two.join(both.select("dataset", F.col("src").alias("s"), F.col("dst").alias("t")), ["dataset", "s", "t"], "left_anti")
    ends = two.groupBy("dataset", "s", "t").agg(F.array("s", F.min("mid"), "t").alias("gold_list"), F.array("s", F.max("mid"), "t").alias("pred_list"))
    rows = ends.withColumn("id", F.concat_ws(">", "dataset", "s", "t"))
    return S.score_paths(rows, edges).join(ends.withColumn("id", F.concat_ws(">", "dataset", "s", "t")).select("id", "s", "t"), "id").select(
        "dataset", "s", "t", "exact_match", "f1", "order_correct", "valid_alt_path")


@query(_W + "SELECT id, NOT exact_match AS stored, exact_match AS rescored FROM scored WHERE id % 97 = 0")
def c6_rescore_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored scores of which every 97th id's has been turned round: scoring again finds just these."""
    stored = scored(spark, sf_dir).select("id", F.when(F.col("id") % 97 == 0, ~F.col("exact_match")).otherwise(F.col("exact_match")).alias("exact_match"))
    return S.rescore(stored, results(spark, sf_dir))


@query("""WITH t AS (SELECT l_orderkey AS id, l_partkey AS k, l_returnflag <> 'R' AS said, min(l_partkey) OVER (PARTITION BY l_orderkey) AS target FROM lineitem)
SELECT id, count(DISTINCT k) = count(DISTINCT k) FILTER (said) AS exact, count(DISTINCT k) FILTER (k <> target) = count(DISTINCT k) FILTER (said AND k <> target) AS exact_without FROM t GROUP BY id""")
def c7_without_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's parts against those not returned, with and without the least part."""
    k = F.col("l_partkey").cast("string")
    lists = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_set(k).alias("gold_list"), F.collect_set(F.when(F.col("l_returnflag") != "R", k)).alias("pred_list"), F.min("l_partkey").cast("string").alias("target"))
    exact = lambda df, name: df.select("id", A.set_scores(A.as_set(F.col("pred_list")), A.as_set(F.col("gold_list")))["exact"].alias(name))
    return exact(lists, "exact").join(exact(S.without_target(lists, "target"), "exact_without"), "id")


_LEVELS = ("type", "difficulty", "subtype")
_GROUPS = " UNION ALL ".join(f"SELECT '{lv}' AS level, {lv} AS key, CAST(count(*) AS BIGINT) AS total, {_EM} AS exact_match, round(avg(f1), 4) AS avg_f1 FROM scored GROUP BY {lv}" for lv in _LEVELS)


@query(_W + _GROUPS + f" UNION ALL SELECT 'micro', 'all', CAST(count(*) AS BIGINT), {_EM}, round(avg(f1), 4) FROM scored")
def a1_a2_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.metrics(scored(spark, sf_dir))


@query(_W + f"SELECT round(avg(e), 4) AS macro_em, round(avg(f), 4) AS macro_f1 FROM (SELECT {_EM} AS e, round(avg(f1), 4) AS f FROM scored GROUP BY subtype)")
def a3_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.macro(scored(spark, sf_dir))


@query(_W + " UNION ALL ".join(f"SELECT dataset, '{lv}' AS level, {lv} AS key, CAST(count(*) AS BIGINT) AS total, {_EM} AS exact_match, round(avg(f1), 4) AS avg_f1 FROM scored GROUP BY dataset, {lv}" for lv in _LEVELS)
       + f" UNION ALL SELECT dataset, 'micro', 'all', CAST(count(*) AS BIGINT), {_EM}, round(avg(f1), 4) FROM scored GROUP BY dataset")
def a4_metrics_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.metrics(scored(spark, sf_dir), "dataset")


@query(_W + "SELECT subtype, CAST(count(*) FILTER (difficulty = 'F') AS BIGINT) AS n_f, CAST(count(*) FILTER (difficulty = 'O') AS BIGINT) AS n_o, CAST(count(*) FILTER (difficulty = 'P') AS BIGINT) AS n_p, CAST(count(*) AS BIGINT) AS total FROM scored GROUP BY ROLLUP (subtype)")
def a5_counts_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda d: F.count_if(F.col("difficulty") == d)
    return results(spark, sf_dir).rollup("subtype").agg(n("F").alias("n_f"), n("O").alias("n_o"), n("P").alias("n_p"), F.count("*").alias("total"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, count(*) < 30 AS is_thin FROM events GROUP BY 1")
def a6_counter_with_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), (F.count("*") < 30).alias("is_thin"))


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a7_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query(_W + """SELECT subtype, round(avg((gold_true)::INT::DOUBLE), 4) AS share, CASE WHEN avg(gold_true::INT) IN (0, 1) THEN 'constant' WHEN avg(gold_true::INT) < 0.2 OR avg(gold_true::INT) > 0.8 THEN 'skewed' ELSE 'balanced' END AS balance
  FROM (SELECT subtype, flag AS gold_true FROM o WHERE type = 'boolean') GROUP BY subtype""")
def a8_boolean_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.avg(A.truth(F.col("gold")).cast("int").cast("double"))
    got = results(spark, sf_dir).where("type = 'boolean'").groupBy("subtype").agg(share.alias("x"))
    return got.select("subtype", F.round("x", 4).alias("share"), F.when(F.col("x").isin(0.0, 1.0), "constant").when((F.col("x") < 0.2) | (F.col("x") > 0.8), "skewed").otherwise("balanced").alias("balance"))


@query("""SELECT CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, CAST(sum(n) AS BIGINT) AS total FROM
  (SELECT count(*) AS n FROM region UNION ALL SELECT count(*) FROM nation UNION ALL SELECT count(*) FROM customer UNION ALL SELECT count(*) FROM orders UNION ALL SELECT count(*) FROM lineitem)""")
def a9_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = None
    for name in ("region", "nation", "customer", "orders", "lineitem"):
        one = spark.read.parquet(f"{sf_dir}/{name}.parquet").agg(F.count("*").alias("n"))
        counts = one if counts is None else counts.union(one)
    return counts.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("total"))


@query("SELECT o_orderstatus AS target, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS sources, CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_customers FROM orders GROUP BY 1")
def a10_a11_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderstatus").alias("target")).agg(
        F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("sources"), F.countDistinct("o_custkey").alias("n_customers"))


@query(_W + "SELECT model, baseline, difficulty, round(100 * avg(exact_match::INT::DOUBLE), 2) AS em FROM scored GROUP BY ALL")
def a12_em_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("model", "baseline", "difficulty").agg(F.round(100 * F.avg(F.col("exact_match").cast("int").cast("double")), 2).alias("em"))


@query(_W + f", sub AS (SELECT model, baseline, subtype, {_EM} AS e FROM scored GROUP BY ALL) SELECT model, baseline, round(ma - mi, 4) AS delta FROM (SELECT model, baseline, avg(e) AS ma FROM sub GROUP BY ALL) JOIN (SELECT model, baseline, {_EM} AS mi FROM scored GROUP BY ALL) USING (model, baseline)")
def a13_macro_minus_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    ma = s.groupBy("model", "baseline", "subtype").agg(_em().alias("e")).groupBy("model", "baseline").agg(F.avg("e").alias("ma"))
    return ma.join(s.groupBy("model", "baseline").agg(_em().alias("mi")), ["model", "baseline"]).select("model", "baseline", F.round(F.col("ma") - F.col("mi"), 4).alias("delta"))


@query(_W + "SELECT model, baseline, round(100 * (avg(exact_match::INT::DOUBLE) FILTER (condition = 'obfuscated') - avg(exact_match::INT::DOUBLE) FILTER (condition = 'original')), 2) AS delta_pp FROM scored GROUP BY ALL")
def a14_obfuscation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda c: F.avg(F.when(F.col("condition") == c, F.col("exact_match").cast("int").cast("double")))
    return scored(spark, sf_dir).groupBy("model", "baseline").agg(F.round(100 * (of("obfuscated") - of("original")), 2).alias("delta_pp"))


@query(_W + f""", r AS (SELECT subtype, baseline, list_position(['flat', 'vector', 'graph', 'tools', 'code'], baseline) AS rank, {_EM} AS em FROM scored GROUP BY ALL)
SELECT subtype, baseline AS best, em, round(1 - em, 4) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY em DESC, rank) AS n FROM r) WHERE n = 1""")
def a15_best_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = scored(spark, sf_dir).groupBy("subtype", "baseline").agg(_em().alias("em")).withColumn("rank", F.array_position(F.array(*[F.lit(b) for b in _BASELINES]), F.col("baseline")))
    return S.best_baseline(rates).withColumn("gap", F.round(1 - F.col("em"), 4))


@query(_W + "SELECT baseline, subtype, errors, round(errors / sum(errors) OVER (PARTITION BY baseline), 4) AS share FROM (SELECT baseline, subtype, CAST(count(*) AS BIGINT) AS errors FROM scored WHERE NOT exact_match GROUP BY ALL)")
def a16_error_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scored(spark, sf_dir).where("NOT exact_match").groupBy("baseline", "subtype").agg(F.count("*").alias("errors"))
    return got.withColumn("share", F.round(F.col("errors") / F.sum("errors").over(Window.partitionBy("baseline")), 4))


@query(_W + """, p AS (SELECT subtype, 100 * avg(exact_match::INT::DOUBLE) FILTER (baseline = 'graph') AS g, 100 * avg(exact_match::INT::DOUBLE) FILTER (baseline = 'flat') AS f FROM scored GROUP BY 1)
SELECT subtype, CASE WHEN g - f > 5 THEN 'graph' WHEN f - g > 5 THEN 'flat' ELSE 'tie' END AS verdict FROM p""")
def a17_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = scored(spark, sf_dir).groupBy("subtype").pivot("baseline", ["graph", "flat"]).agg(100 * F.avg(F.col("exact_match").cast("int").cast("double")))
    return em.select("subtype", F.when(F.col("graph") - F.col("flat") > 5, "graph").when(F.col("flat") - F.col("graph") > 5, "flat").otherwise("tie").alias("verdict"))


@query(_W + f""", g AS (SELECT b.baseline, d.dataset, CAST(round(10000 * {_EM}) AS BIGINT) AS em FROM (SELECT DISTINCT baseline FROM scored) b, (SELECT DISTINCT dataset FROM scored UNION ALL SELECT 'missing') d
  LEFT JOIN scored s ON s.baseline = b.baseline AND s.dataset = d.dataset GROUP BY ALL) SELECT baseline, CAST((2 * sum(coalesce(em, 0)) + count(*)) // (2 * count(*)) AS DOUBLE) / 10000 AS mean_em FROM g GROUP BY 1""")
def a18_mean_over_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of four-place rates, in whole ten-thousandths, halves up: a mean of doubles can miss a tie."""
    s = scored(spark, sf_dir).groupBy("baseline", "dataset").agg(F.round(10000 * _em()).cast("long").alias("em"))
    sets = s.select("dataset").distinct().union(spark.createDataFrame([("missing",)], "dataset string"))
    # The grid of a handful of baselines by datasets.
    grid = s.select("baseline").distinct().crossJoin(sets)
    got = grid.join(s, ["baseline", "dataset"], "left").groupBy("baseline").agg(F.coalesce(F.sum("em"), F.lit(0)).alias("t"), F.count("*").alias("n"))
    return got.select("baseline", (F.expr("(2 * t + n) div (2 * n)").cast("double") / 10000).alias("mean_em"))


@query(_W + f"SELECT model, {_EM} AS em, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1")
def a19_pooled_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("model").agg(_em().alias("em"), F.count("*").alias("n"))


_MD5 = "('0x' || substr(md5({}), 1, {}))::BIGINT"


@query(_W + f""", c AS (SELECT baseline, {_MD5.format("id || ':bag'", 4)} % 100 AS bag, count(*) FILTER (exact_match) AS hits, count(*) AS n FROM scored GROUP BY ALL),
d AS (SELECT baseline, i, hits, n, {_MD5.format("baseline || ':' || bag || ':' || i || ':42'", 8)} AS u FROM c, range(1, 2001) r(i)),
m AS (SELECT baseline, i, sum(w * hits) / sum(w * n)::DOUBLE AS m FROM (SELECT *, {" + ".join(f"(u >= {t})::BIGINT" for t in S.POISSON)} AS w FROM d) GROUP BY ALL HAVING sum(w * n) > 0)
SELECT baseline, round(e.em, 6) AS em, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m JOIN (SELECT baseline, sum(hits) / sum(n)::DOUBLE AS em FROM c GROUP BY 1) e USING (baseline) GROUP BY baseline, e.em""")
def a20_bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bootstrap(scored(spark, sf_dir), "baseline")
