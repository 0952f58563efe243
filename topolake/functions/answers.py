"""Column expressions that compare predicted with gold answers.

An answer's text is what its value prints as; kind is one of bool, int, float, str and null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for true and false, and the two spellings of a row reference.
TRUE_WORDS, FALSE_WORDS = ("yes", "true"), ("no", "false")
ROW_IN_BRACKETS = r"(\w+)[\s:]+rows?\s*[\[\(]?(\d+)"
ROW_BY_NAME = r"(\w+)\s+row_(\d+)"


def truth(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def whole(text: Column, kind: Column) -> Column:
    """The integer that a value converts to; text with a fraction does not, a fractional number is cut."""
    of_text = F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("bigint"))
    return F.when(kind == "float", text.try_cast("double").try_cast("bigint")).when(kind == "bool", truth(text).cast("bigint")).otherwise(of_text)


def exact_match(pred: Column, pred_kind: Column, gold: Column, gold_kind: Column) -> Column:
    """Truth words first, then integers as integers, then text without case and outer space."""
    gb, pb = F.when(gold_kind.isin("bool", "str"), truth(gold)), F.when(pred_kind.isin("bool", "str"), truth(pred))
    return F.coalesce(
        F.when(gb.isNotNull() & pb.isNotNull(), gb == pb)
        .when(gold_kind == "bool", F.lit(False))
        .when(gold_kind == "int", whole(pred, pred_kind) == gold.try_cast("bigint"))
        .when(gold_kind == "str", (pred_kind != "null") & (F.lower(F.trim(pred)) == F.lower(F.trim(gold))))
        .otherwise(pred == gold),
        F.lit(False),
    )


def row_ref(ref: Column) -> Column:
    """`table: rows [N]`, `table row_N` and the like as table:row_N; anything else as it is."""
    text = F.trim(ref)
    made = lambda p: F.concat(F.regexp_extract(text, p, 1), F.lit(":row_"), F.regexp_extract(text, p, 2))
    return F.when(text.rlike(ROW_IN_BRACKETS), made(ROW_IN_BRACKETS)).when(text.rlike(ROW_BY_NAME), made(ROW_BY_NAME)).otherwise(text)


def as_set(items: Column) -> Column:
    """Distinct row references of a list, a missing one empty."""
    return F.array_distinct(F.transform(F.coalesce(items, F.array().cast("array<string>")), row_ref))


def set_scores(p: Column, g: Column) -> Column:
    """struct(precision, recall, f1, exact) of predicted and gold sets; an empty gold set is always met.

    Both are used several times: give columns that hold as_set(), not the expression.
    """
    hit, np_, ng = (F.size(x).cast("double") for x in (F.array_intersect(p, g), p, g))
    none = (ng == 0) | (np_ == 0)
    base = F.when(ng == 0, 1.0).otherwise(0.0)
    precision, recall = F.when(none, base).otherwise(hit / F.greatest(np_, F.lit(1.0))), F.when(none, base).otherwise(hit / F.greatest(ng, F.lit(1.0)))
    f1 = F.when(none, base).when(hit == 0, 0.0).otherwise(2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12)))
    return F.struct(
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
        F.when(ng == 0, True).otherwise((hit == np_) & (hit == ng)).alias("exact"),
    )


def may_be_other_path(pred: Column, gold: Column) -> Column:
    """Whether a list has the length and the ends of another, both of two or more, so that only its hops are in question."""
    return (F.size(pred) >= 2) & (F.size(gold) >= 2) & (F.size(pred) == F.size(gold)) & (F.get(pred, 0) == F.get(gold, 0)) & (F.element_at(pred, -1) == F.element_at(gold, -1))
