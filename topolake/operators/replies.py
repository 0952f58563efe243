"""Answers of any type in models' replies, as VARIANT: one column for texts, numbers, truths, nulls, lists and objects."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CUT_LIST, FENCED, QUOTED, RAW_LENGTH, STATED, STATED_LENGTH, THINKING, _balanced

# Kinds of a VARIANT's value by the first word of its schema.
KINDS = {"BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "ARRAY": "list", "OBJECT": "object"}

MARK = "end of the reply"


def _not_json(word: str) -> None:
    raise ValueError(word)


def object_text(body: str, parts: list[str]) -> str | None:
    """The first JSON object among a reply, its fenced parts and its braced parts, the longest first, as JSON text."""
    for part in [body, *parts, *_balanced(body)]:
        try:
            value = json.loads(part, parse_constant=_not_json)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            return json.dumps(value)
    return None


def _object(text: Column) -> Column:
    """The text as VARIANT where all of it is one object, else null.

    Spark's parser takes the first value and leaves what follows unread, so the text is parsed as the first of two items:
    the second is there, and is the mark, only if the text was read to its end.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{MARK}"]')))
    value = F.try_variant_get(pair, "$[0]", "variant")
    return F.when((F.try_variant_get(pair, "$[1]", "string") == MARK) & F.schema_of_variant(value).startswith("OBJECT"), value)


def recovered(text: Column) -> Column:
    """VARIANT: the object in a reply. Itself, fenced, the longest braced part, a list cut short, a stated answer, or raw text.

    Replies that parse as they are, or whose fenced part does, and those without a brace stay with Spark's own functions;
    braces are matched (and keys that an object repeats resolved, the last one wins) in Python for the rest alone, which
    gets nulls for all others. A null reply is null; an empty one is an empty answer. NaN and Infinity are no JSON.
    """

    @F.pandas_udf("string")
    def inside(body: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else object_text(b, list(p)) for b, p in zip(body, parts, strict=True)], dtype=object)

    body = F.regexp_replace(F.regexp_replace(text, THINKING, ""), r"^\s+|\s+$", "")
    fenced = F.regexp_extract_all(body, F.lit(FENCED), F.lit(1))
    plain = F.coalesce(_object(body), F.get(F.filter(F.transform(fenced, _object), lambda v: v.isNotNull()), 0))
    matched = F.try_parse_json(inside(F.when(plain.isNull() & F.contains(body, F.lit("{")), body), fenced))
    cut = F.when(F.regexp_like(body, F.lit(CUT_LIST)), F.to_json(F.struct(F.regexp_extract_all(F.regexp_extract(body, CUT_LIST, 1), F.lit(QUOTED), F.lit(1)).alias("answer_list"))))
    said = F.regexp_extract(body, STATED, 1)
    stated = F.when(said != "", F.substring(F.regexp_replace(F.rtrim(said), r"\.+$", ""), 1, STATED_LENGTH))
    answer = F.to_json(F.struct(F.coalesce(stated, F.substring(body, 1, RAW_LENGTH)).alias("answer")))
    return F.when(text.isNotNull(), F.coalesce(plain, matched, F.try_parse_json(F.coalesce(cut, answer))))


def kind(value: Column) -> Column:
    """integer, number, string, boolean, null, list or object; null where there is no value."""
    word = F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), word)


def item_text(item: Column) -> Column:
    """A list item as text: an object with table and row is table:row_k, another object or list its JSON, null is null."""
    table, row = F.try_variant_get(item, "$.table", "string"), F.try_variant_get(item, "$.row", "string")
    held = kind(item).isin("object", "list")
    return F.coalesce(F.when(kind(item) == "object", F.concat(table, F.lit(":row_"), row)), F.when(held, F.to_json(item)), F.try_variant_get(item, "$", "string"))


def typed(parsed: Column, answer_type: Column) -> Column:
    """struct(kind, text, list) of a recovered object: what `answer` is and says, and `answer_list` as texts.

    A lone value under `answer_list` is a list of one; a list under `answer` counts as `answer_list` where that is absent.
    Items of type `list` are sorted, nulls left out; other types keep their order.
    """
    answer, listed = F.try_variant_get(parsed, "$.answer", "variant"), F.try_variant_get(parsed, "$.answer_list", "variant")
    many = F.coalesce(listed, F.when(kind(answer) == "list", answer))
    items = F.coalesce(F.try_variant_get(many, "$", "array<variant>"), F.when(many.isNotNull() & (kind(many) != "null"), F.array(many)))
    texts = F.array_compact(F.transform(items, item_text))
    return F.struct(
        kind(answer).alias("kind"), item_text(answer).alias("text"), F.when(answer_type == "list", F.array_sort(texts)).otherwise(texts).alias("list"),
    )
