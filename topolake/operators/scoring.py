"""Scores of predictions and their grouped metrics."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topolake.functions import answers as A

from . import kernel as K


def score(rows: DataFrame) -> DataFrame:
    """rows (answer_type, pred, pred_kind, gold, gold_kind, pred_list, gold_list) with exact_match, f1, precision, recall."""
    lists = F.col("answer_type").isin("list", "ordered_list")
    match = A.exact_match(*map(F.col, ("pred", "pred_kind", "gold", "gold_kind")))
    rows = rows.withColumns({"p_": F.when(lists, A.as_set(F.col("pred_list"))), "g_": F.when(lists, A.as_set(F.col("gold_list")))})
    s = A.set_scores(F.col("p_"), F.col("g_"))
    rows = rows.withColumn("set_", F.when(lists, s)).withColumn("hit_", F.when(~lists, match))
    return rows.withColumns({
        "exact_match": F.when(lists, F.col("set_.exact")).otherwise(F.col("hit_")),
        "f1": F.when(lists, F.col("set_.f1")).otherwise(F.col("hit_").cast("double")),
        "precision": F.col("set_.precision"), "recall": F.col("set_.recall"),
    }).drop("set_", "hit_", "p_", "g_")


def score_paths(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (id, dataset, pred_list, gold_list) scored as ordered lists.

    Exactness is set equality; order_correct tells equality in order. A prediction of the same length and ends whose
    every hop is a reference, either way, is a valid other path and scores in full.
    """
    scored = rows.withColumns({"p_": A.as_set(F.col("pred_list")), "g_": A.as_set(F.col("gold_list"))})
    scored = scored.withColumn("s", A.set_scores(F.col("p_"), F.col("g_")))
    may = ~F.col("s.exact") & A.may_be_other_path(F.col("pred_list"), F.col("gold_list"))
    scored = scored.withColumn("may_", F.coalesce(may, F.lit(False)))
    hop = F.explode(F.zip_with(F.expr("slice(pred_list, 1, size(pred_list) - 1)"), F.expr("slice(pred_list, 2, size(pred_list) - 1)"), lambda a, b: F.struct(a.alias("src"), b.alias("dst"))))
    hops = scored.where("may_").select("id", "dataset", hop.alias("h")).select("id", "dataset", "h.src", "h.dst")
    met = hops.join(K.undirected(edges, "fk_to"), ["dataset", "src", "dst"]).groupBy("id").agg(F.count("*").alias("met"))
    scored = scored.join(met, "id", "left")
    alt = F.col("may_") & (F.coalesce("met", F.lit(0)) == F.size("pred_list") - 1)
    full = lambda c: F.when(F.col("alt_"), 1.0).otherwise(F.col(f"s.{c}"))
    return scored.withColumn("alt_", alt).select(
        "id", "dataset", (F.col("s.exact") | F.col("alt_")).alias("exact_match"), full("f1").alias("f1"), full("precision").alias("precision"),
        full("recall").alias("recall"), (F.col("pred_list") == F.col("gold_list")).alias("order_correct"), F.col("alt_").alias("valid_alt_path"),
    )


def metrics(scored: DataFrame, *extra: str) -> DataFrame:
    """(extra.., level, key, total, exact_match, avg_f1): one pass of grouping sets over type, difficulty, subtype and all."""
    levels = ("type", "difficulty", "subtype")
    first = lambda c, other: F.coalesce(*[F.when(F.grouping(lv) == 0, c(lv)) for lv in levels], F.lit(other))
    mean = lambda c: F.round(F.avg(c), 4)
    got = scored.groupingSets([*[[*extra, lv] for lv in levels], list(extra)], *extra, *levels).agg(
        first(F.lit, "micro").alias("level"), first(F.col, "all").alias("key"), F.count("*").alias("total"),
        mean(F.col("exact_match").cast("int").cast("double")).alias("exact_match"), mean(F.col("f1")).alias("avg_f1"),
    )
    return got.select(*extra, "level", "key", "total", "exact_match", "avg_f1")


def macro(scored: DataFrame) -> DataFrame:
    """(macro_em, macro_f1): means of the subtypes' rounded means."""
    one = metrics(scored).where("level = 'subtype'")
    return one.agg(F.round(F.avg("exact_match"), 4).alias("macro_em"), F.round(F.avg("avg_f1"), 4).alias("macro_f1"))


# Chances of a unit Poisson number to be above 0, 1, 2, ... in 32 bits.
POISSON = [int(sum(exp(-1) / factorial(j) for j in range(k + 1)) * 2**32) for k in range(12)]


def bootstrap(scored: DataFrame, by: str, key: str = "id", resamples: int = 2000, bags: int = 100, seed: int = 42) -> DataFrame:
    """(by, em, low, high): a 95 % interval of the mean exact match by Poisson resampling of bags.

    A group's rows are dealt into bags by md5 of their key; each resample weighs every bag by a unit Poisson number, the
    inverse of its distribution at a hash of group, bag, resample and seed. Rows are read once, and the draws cost the
    same however many there are.
    """
    number = lambda text, digits: F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")
    bag = number(F.concat(F.col(key).cast("string"), F.lit(":bag")), 4) % bags
    counts = scored.groupBy(by, bag.alias("bag")).agg(F.count_if("exact_match").alias("hits"), F.count("*").alias("n"))
    draw = counts.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = number(F.concat_ws(":", by, "bag", "i", F.lit(str(seed))), 8)
    draw = draw.withColumn("u", u).withColumn("w", sum((F.col("u") >= t).cast("long") for t in POISSON))
    means = draw.groupBy(by, "i").agg(F.sum(F.col("w") * F.col("hits")).alias("a"), F.sum(F.col("w") * F.col("n")).alias("b")).where("b > 0")
    spread = means.groupBy(by).agg(F.percentile(F.col("a") / F.col("b"), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = counts.groupBy(by).agg((F.sum("hits") / F.sum("n")).alias("em"))
    return whole.join(spread, by).select(by, F.round("em", 6).alias("em"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def rescore(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, stored, rescored) where a stored exact match is not what scoring the row again gives."""
    fresh = score(rows).select("id", F.col("exact_match").alias("rescored"))
    return stored.select("id", F.col("exact_match").alias("stored")).join(fresh, "id").where(~F.col("stored").eqNullSafe(F.col("rescored")))


def without_target(rows: DataFrame, target: str) -> DataFrame:
    """rows (pred_list, gold_list, target) without the node that a question names in either list."""
    return rows.withColumns({c: F.array_remove(c, F.col(target)) for c in ("pred_list", "gold_list")})


def best_baseline(rates: DataFrame) -> DataFrame:
    """rates (subtype, baseline, rank, em): (subtype, best, em); the first of equals by rank."""
    w = Window.partitionBy("subtype").orderBy(F.desc("em"), "rank")
    return rates.withColumn("r", F.row_number().over(w)).where("r = 1").select("subtype", F.col("baseline").alias("best"), "em")
