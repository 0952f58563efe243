"""Rows, lineage and questions made by rule: the same on every run and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a table by layer: least and most.
RANGES = {"raw": (5000, 10000), "staging": (3000, 8000), "dim": (500, 2000), "fact": (1000, 5000), "mart": (200, 1000)}


def digest(*parts: Column) -> Column:
    """A 32-bit number from md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def kind_of(name: Column) -> Column:
    return F.when(name.startswith("raw_"), "raw").when(name.startswith("stg_"), "staging").when(name.startswith("dim_"), "dim").when(name.startswith("fact_"), "fact").otherwise("mart")


def row_counts(tables: DataFrame, seed: int = 42) -> DataFrame:
    """(name, kind, rows): a number within the range of the table's kind, by a digest of name and seed."""
    kind = kind_of(F.col("name"))
    low = F.create_map(*[F.lit(x) for k, v in RANGES.items() for x in (k, v[0])])
    span = F.create_map(*[F.lit(x) for k, v in RANGES.items() for x in (k, v[1] - v[0] + 1)])
    return tables.select("name", kind.alias("kind")).withColumn("rows", (low[F.col("kind")] + digest(F.col("name"), F.lit(seed)) % span[F.col("kind")]).cast("bigint"))


def staging_rows(spark: SparkSession, n: int, sources: int, seed: int = 42) -> DataFrame:
    """(id, source_id, validated_flag, quality_score, batch_id) of a staging table."""
    ids = spark.range(n)
    d = lambda k: digest(F.col("id"), F.lit(k), F.lit(seed))
    return ids.select("id", (d("src") % sources).alias("source_id"), (d("flag") % 10 < 9).alias("validated_flag"), F.round(d("q") % 1000 / 1000.0, 3).alias("quality_score"), (d("batch") % 50).cast("int").alias("batch_id"))


def dimension_rows(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(surrogate_key, business_key, category, effective_date, is_current) of a dimension."""
    d = lambda k: digest(F.col("id"), F.lit(k), F.lit(seed))
    return spark.range(n).select(
        F.col("id").alias("surrogate_key"), F.concat(F.lit("BK"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("business_key"), F.element_at(F.array(*[F.lit(c) for c in "ABCDE"]), (d("cat") % 5 + 1).cast("int")).alias("category"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (d("day") % 1500).cast("int")), "yyyy-MM-dd").alias("effective_date"), (d("cur") % 5 > 0).alias("is_current"))


def fact_rows(spark: SparkSession, n: int, dims: dict[str, int], seed: int = 42) -> DataFrame:
    """(fact_key, <dim>_key.., measure_1, measure_3): keys within each dimension's rows."""
    d = lambda k: digest(F.col("id"), F.lit(k), F.lit(seed))
    keys = [(d(name) % size).alias(f"{name}_key") for name, size in dims.items()]
    return spark.range(n).select(F.col("id").alias("fact_key"), *keys, F.round(d("m1") % 100000 / 100.0, 2).alias("measure_1"), (d("m3") % 100).cast("int").alias("measure_3"))


def mart_rows(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """(metric_key, dimension_key, kpi_value, period) of a mart."""
    d = lambda k: digest(F.col("id"), F.lit(k), F.lit(seed))
    return spark.range(n).select(F.col("id").alias("metric_key"), (d("dim") % 500).alias("dimension_key"), F.round(d("kpi") % 100000 / 100.0, 2).alias("kpi_value"), F.concat(F.lit("2024-"), F.lpad((d("m") % 12 + 1).cast("string"), 2, "0")).alias("period"))


# Sources of a row by its table's kind: least and most.
FAN_IN = {"staging": (1, 3), "dim": (1, 3), "fact": (1, 2), "mart": (5, 25)}


def row_lineage(edges: DataFrame, counts: DataFrame, seed: int = 42) -> DataFrame:
    """(src_table, src_row, dst_table, dst_row) for every derivation (src, dst) and target row, by counts (name, kind, rows).

    A row has a number of sources within the range of its table's kind, none twice: they start at a digest and lie a
    digest's step apart, so short that the last does not come round to the first.
    """
    src = counts.select(F.col("name").alias("src"), F.col("rows").alias("n"))
    dst = counts.select(F.col("name").alias("dst"), F.col("kind"), F.col("rows").alias("m"))
    low, most = (F.create_map(*[F.lit(x) for k, v in FAN_IN.items() for x in (k, v[i])]) for i in (0, 1))
    rows = edges.select("src", "dst").distinct().join(src, "src").join(dst, "dst").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    d = lambda what: digest(F.col("dst"), F.col("k"), F.col("src"), F.lit(what), F.lit(seed))
    rows = rows.withColumn("fan", F.least(low[F.col("kind")] + d("fan") % (most[F.col("kind")] - low[F.col("kind")] + 1), F.col("n")))
    rows = rows.withColumns({"start": d("start") % F.col("n"), "step": 1 + d("step") % F.greatest(F.lit(1), F.floor(F.col("n") / F.col("fan")))})
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)))
    return rows.select(F.col("src").alias("src_table"), ((F.col("start") + F.col("j") * F.col("step")) % F.col("n")).alias("src_row"), F.col("dst").alias("dst_table"), F.col("k").alias("dst_row"))


def stratified(rows: DataFrame, bucket: str, key: str, per_bucket: int, total: int, seed: int = 42) -> DataFrame:
    """per_bucket rows of each bucket by hashed order, filled up to total from the rest."""
    from pyspark.sql import Window

    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(bucket).orderBy(order, key)))
    first = ranked.where(F.col("r") <= per_bucket).drop("r")
    fill = ranked.where(F.col("r") > per_bucket).orderBy(order, key).drop("r").limit(max(0, total - first.count()))
    return first.unionByName(fill)
