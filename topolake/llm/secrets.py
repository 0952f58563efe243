"""Secret scans, DataFrame functions only: base patterns, and multipart credentials linked within scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unwrapped, wrapped

# The base patterns, then the weak parts that count only beside a complement.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
BLOB = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"(?:https?|s3|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9][A-Za-z0-9.:@_/-]+"
KINDS = ("assign", "access", "hex", "blob", "endpoint")
SCOPE = 256

# A cheap sign of each pattern; a text without it is not searched for the pattern.
SIGNS = {"assign": r"[:=]", "access": "AKIA", "hex": r"[0-9a-f]{32}", "blob": r"[A-Za-z0-9+/]{40}", "endpoint": "://"}


def spans_of(text: Column, kind: str, pattern: str, size: Column | None = None) -> Column:
    """Sorted array of (start, end, kind) in code points, from what lies between the leftmost matches.

    The gaps split() gives and the matches regexp_extract_all() gives alternate, so running sums of their lengths are
    the places; `size` is the array of lengths that must reach 8 where a group is measured.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    n = F.size(found)
    steps = F.arrays_zip(F.transform(F.slice(gaps, 1, n), F.char_length).alias("gap"), F.transform(found, F.char_length).alias("len"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("all"))
    walked = F.aggregate(
        steps, start,
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["len"]).alias("at"),
            F.concat(acc["all"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["len"]).alias("end")))).alias("all"),
        ),
        lambda acc: acc["all"],
    )
    if size is not None:
        walked = F.filter(walked, lambda x, i: F.get(size, i) >= 8)
    none = F.array().cast("array<struct<start:int,end:int>>")
    placed = F.when(text.rlike(SIGNS[kind]), walked).otherwise(none)
    return F.transform(placed, lambda x: F.struct(x["start"], F.lit(KINDS.index(kind)).alias("kind"), x["end"]))


def _scopes(span: Column, margin: int = 0) -> Column:
    """Numbers of all scopes that a span, widened on both sides by the margin, lies in."""
    return F.sequence(F.floor((span["start"] - margin) / SCOPE).cast("int"), F.floor((span["end"] + margin) / SCOPE).cast("int"))


def _held(spans: Column, kinds: tuple[str, ...], margin: int = 0) -> Column:
    """Numbers of the scopes that hold a part of a span of these kinds, each once."""
    own = F.filter(spans, lambda x: x["kind"].isin([KINDS.index(k) for k in kinds]))
    return F.array_distinct(F.flatten(F.transform(own, lambda x: _scopes(x, margin))))


def _near(a: Column, b: Column) -> Column:
    return (a["start"] - b["end"] <= SCOPE) & (b["start"] - a["end"] <= SCOPE)


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with `secrets_`: all (start, kind, end) by start, then kind; and `base_`: those of the base kinds.

    Base spans (assign, access, hex) are always reported. A long blob counts as a secret only if an access identifier,
    and an endpoint only if an assigned, access or blob part, lies within SCOPE characters; a blob beside an endpoint
    alone stays weak. The interval join runs in a row's own arrays: scopes are fixed windows, a span
    lies in every window from its start to its end, a weak part meets only complements that lie in one of its windows
    once widened by SCOPE (hashed intersections), and the distance, end to start, is then taken exactly. No
    shuffle, no join between rows. Blobs within a base span are that span.

    Defined cases: a null text is an empty one; repeated rows stay; very long texts are searched whole; columns of the
    table named base_, weak_, strong_, keys_, near_access_, near_keys_ or secrets_ are replaced (redacted() keeps them).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    values = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), F.char_length)
    df = documents.withColumn("base_", F.concat(spans_of(t, "assign", ASSIGN, values), spans_of(t, "access", ACCESS), spans_of(t, "hex", HEX)))
    base = F.array_sort("base_")
    weak = F.when(F.size("base_") > 0, F.array_sort(F.concat(spans_of(t, "blob", BLOB), spans_of(t, "endpoint", ENDPOINT)))).otherwise(
        F.array().cast("array<struct<start:int,kind:int,end:int>>")
    )
    df = df.withColumn("base_", base).withColumn("weak_", weak)
    has = {"access": 1, "assign": 0, "blob": 3, "endpoint": 4}
    own = {
        "access": F.filter("base_", lambda x: x["kind"] == 1),
        "keys": F.filter("base_", lambda x: x["kind"].isin(0, 1)),
    }
    free = F.filter(
        "weak_",
        lambda x: (x["kind"] == has["endpoint"]) | ~F.exists("base_", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"]))
    )
    df = df.withColumn("weak_", free)
    df = df.withColumn("near_access_", F.array_intersect(_held(F.col("weak_"), ("blob",)), _held(F.col("base_"), ("access",), SCOPE)))
    strong = F.filter(
        "weak_",
        lambda x: (x["kind"] == has["blob"]) & F.arrays_overlap("near_access_", _scopes(x))
        & F.exists(own["access"], lambda b: _near(x, b))
    )
    df = df.withColumn("strong_", strong)
    keys = F.concat(own["keys"], F.col("strong_"))
    df = df.withColumn("keys_", keys)
    df = df.withColumn("near_keys_", F.array_intersect(_held(F.col("weak_"), ("endpoint",)), _held(F.col("keys_"), ("assign", "access", "blob"), SCOPE)))
    ends = F.filter(
        "weak_",
        lambda x: (x["kind"] == has["endpoint"]) & F.arrays_overlap("near_keys_", _scopes(x))
        & F.exists("keys_", lambda b: _near(x, b))
    )
    return df.withColumn("secrets_", F.array_sort(F.concat("base_", "strong_", ends))).drop("weak_", "near_access_", "near_keys_", "keys_", "strong_")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span, overlaps united, replaced by the mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(
        spans, start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["end"] <= acc["at"], acc["out"])
            .when(s["start"] < acc["at"], acc["out"])
            .otherwise(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))).alias("out"),
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with each found span replaced by the mark; n_chars, where there is such a column, set anew."""
    names = documents.columns
    found = scan(wrapped(documents, "text", "n_chars")).withColumn("clean_", redact(F.col("text"), F.col("secrets_"), mark))
    new = {"text": F.col("clean_")}
    if "n_chars" in names:
        size = F.char_length("clean_").cast(documents.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.size("secrets_") > 0, size).otherwise(F.col("n_chars"))
    return unwrapped(found, names, **new)
