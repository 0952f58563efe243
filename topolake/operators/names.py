"""Many names in many texts: candidates by each name's rarest run of characters, then confirmed in the text.

No table of names is gone through for a text, and no pattern holds them all. Both sides may be large: names meet texts by
an equi-join on runs of 8 bytes (shorter names: of 4, 2 or 1), and only on the run that the fewest texts have. A
name with a run that no text has is out before any text is searched for it. Texts send on only runs that are in a
filter of the names' runs, of about 16 bits a run from 2^20 to 2^24 bits; as it fills up more is sent, and nothing is lost.
Tasks hold a bounded number of runs, or texts with their names, at once; never a whole batch's.

Names are compared with case ignored; null and empty names are left out, repeats count once. Null and empty texts
hold nothing. Rows that share an id are answered each by its own text; null ids are ids. Offsets are code points of the
lower-cased text, end exclusive.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topolake.sources.storage import written

LEAST_BITS, MOST_BITS, LONGEST = 20, 24, 8
CHUNK_RUNS, CHUNK_TEXTS = 500_000, 256  # what a task holds at once; a longer text's runs are one chunk
# Characters that go on with a word, on its left and on its right.
BEFORE, AFTER = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"


def packed(text: str, widths: set[int]) -> np.ndarray:
    """The distinct runs of these widths (1, 2, 4 or 8 bytes of UTF-8) of a text, each packed into a number."""
    runs, width, found = np.frombuffer(text.encode(), np.uint8).astype(np.uint64), 1, []
    while len(runs):
        if width in widths:
            found.append(np.unique(runs))
        if width == LONGEST:
            break
        runs, width = (runs[:-width] << np.uint64(8 * width)) | runs[width:], 2 * width
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _spots(runs: np.ndarray, bits: int) -> np.ndarray:
    return ((runs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _name_width(name: str) -> int:
    return min(LONGEST, 1 << len(name.encode()).bit_length() - 1)


def _filter(runs: DataFrame) -> tuple[bytes, int]:
    """The bits of all runs' spots, at most 2 MB however many runs there are, and the bits of a spot's number."""
    n = runs.select("run").distinct().count()
    size = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))

    @F.pandas_udf("bigint")
    def spot(run: pd.Series) -> pd.Series:
        return pd.Series(_spots(run.to_numpy(np.int64).astype(np.uint64), size))

    words = runs.select(spot("run").alias("s")).groupBy(F.shiftright("s", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 AS int))")).alias("bits"))
    bits, found = np.zeros(1 << size - 5, "<u4"), words.toArrow()  # at most 2^19 numbers
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return bits.tobytes(), size


def _text_runs(texts: DataFrame, names: DataFrame, widths: set[int], counted: bool = False) -> DataFrame:
    """(id, run): runs of the texts that the names' filter lets through; counted: (run, n), a text once a run, in parts to be summed."""
    bits, size = _filter(names)

    def give(batch: pa.RecordBatch, rows: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        runs = np.concatenate(found)
        if counted:
            runs, n = np.unique(runs, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(n.astype(np.int64))], ["run", "n"])
        ids = batch.column(0).take(pa.array(np.repeat(rows, [len(x) for x in found])))
        return pa.RecordBatch.from_arrays([ids, pa.array(runs.view(np.int64))], ["id", "run"])

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            rows, found, held = [], [], 0
            for i, text in enumerate(batch.column(1)):
                runs = packed(text.as_py(), widths)
                runs = runs[inside[_spots(runs, size)]]
                rows.append(i)
                found.append(runs)
                held += len(runs)
                if held >= CHUNK_RUNS:
                    yield give(batch, rows, found)
                    rows, found, held = [], [], 0
            if held:
                yield give(batch, rows, found)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "low").mapInArrow(runs_of, "run bigint, n bigint" if counted else f"id {kind}, run bigint")


def candidates(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, names): for texts (id, low), names (name, low) that share their rarest run, as an array of (low, name)."""

    @F.pandas_udf("array<bigint>")
    def runs_of(low: pd.Series) -> pd.Series:
        return pd.Series([packed(n, {_name_width(n)}).astype(np.int64) for n in low], dtype=object)

    runs = written(names.select("low", "name", F.explode(runs_of("low")).alias("run")), "names")
    size = F.octet_length("low")
    width = F.when(size >= 8, 8).when(size >= 4, 4).when(size >= 2, 2).otherwise(1)
    widths = {r["width"] for r in runs.select(width.alias("width")).distinct().collect()}  # four at most
    seen = _text_runs(texts, runs, widths, counted=True).groupBy("run").agg(F.sum("n").alias("n"))
    rarest = runs.join(seen, "run", "left").groupBy("low", "name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("least"))
    anchors = written(rarest.where("least.n > 0").select("low", "name", F.col("least.run").alias("run")), "anchors")
    return _text_runs(texts, anchors, widths).join(anchors, "run").groupBy("id").agg(F.collect_set(F.struct("low", "name")).alias("names"))


def _met(texts: DataFrame, names: DataFrame, text: str, id: str, name: str) -> DataFrame:  # noqa: A002
    """(id, low, names): texts, lower-cased, beside their candidates."""
    low = texts.select(F.col(id).alias("id"), F.lower(text).alias("low")).where("low <> ''")
    known = names.where(F.length(name) > 0).select(F.col(name).alias("name"), F.lower(name).alias("low")).distinct()
    found = candidates(low.select("id", "low"), known).withColumnRenamed("id", "id_")
    return low.join(found, F.col("id").eqNullSafe(F.col("id_"))).drop("id_")


def contained(texts: DataFrame, names: DataFrame, text: str = "text", id: str = "id", name: str = "name") -> DataFrame:  # noqa: A002
    """(id, name): every name that a text contains, anywhere, case ignored; a row of texts gives each name once."""
    held = F.filter("names", lambda n: F.contains(F.col("low"), n["low"]))
    return _met(texts, names, text, id, name).select("id", F.explode(held).alias("n")).select("id", F.col("n.name").alias("name"))


def longest_first(low: str, names: list[tuple[str, str]], words: bool) -> list[tuple[int, int, str]]:
    """Places (start, end, name) of names (low, name): longer names first, then earlier ones, then by name; each character used once."""
    found = []
    for key, name in names:
        at = low.find(key)
        while at >= 0:
            end = at + len(key)
            if not words or not (at and low[at - 1] in BEFORE) and not (end < len(low) and low[end] in AFTER):
                found.append((at - end, at, name))
            at = low.find(key, at + 1)
    starts, taken = [], []
    for size, start, name in sorted(found):
        i = bisect_left(starts, start)
        if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= start - size):
            starts.insert(i, start)
            taken.insert(i, (start, start - size, name))
    return taken


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_TEXTS):
            yield batch.slice(at, CHUNK_TEXTS)


def _texts(part: pa.RecordBatch) -> Iterator[tuple[str | None, list[tuple[str, str]]]]:
    """Texts of (id, low, names), one at a time as Python objects, each with its names as (low, name)."""
    for low, held in zip(part.column(1), part.column(2), strict=True):
        yield low.as_py(), [(n["low"], n["name"]) for n in held.as_py() or []]


def places(texts: DataFrame, names: DataFrame, text: str = "text", id: str = "id", name: str = "name", words: bool = False) -> DataFrame:  # noqa: A002
    """(id, start, end, name): where names stand, the longest first, each character used once; `words`: only as whole words.

    Of names that differ in case only, the least by code point has the place.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            at = [(i, *p) for i, (low, held) in enumerate(_texts(part)) for p in longest_first(low, held, words)]
            if at:
                rows, start, end, name = zip(*at, strict=True)
                ids = part.column(0).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(name, pa.string())], ["id", "start", "end", "name"])

    met = _met(texts, names, text, id, name).select("id", "low", "names")
    return met.mapInArrow(find, f"id {met.schema['id'].dataType.simpleString()}, start int, end int, name string")


def replaced(texts: DataFrame, mapping: DataFrame, text: str = "text", id: str = "id") -> DataFrame:  # noqa: A002
    """(id, text): texts with whole names of mapping (original, obfuscated) replaced, the longest first, in one pass.

    Case counts here: a name stands for its own spelling only. An original that is mapped twice takes the least of its
    new names. All rows come back, null and empty texts as they are.
    """
    one = mapping.where(F.length("original") > 0).groupBy(F.col("original").alias("name")).agg(F.min("obfuscated").alias("new"))
    low = texts.select(F.col(id).alias("id"), F.col(text).alias("low"))
    found = candidates(low.where("low <> ''"), one.select("name", F.col("name").alias("low")))
    named = found.select("id", F.explode("names").alias("n")).join(one, F.col("n.name") == F.col("name"))
    named = named.groupBy(F.col("id").alias("id_")).agg(F.collect_list(F.struct(F.col("name").alias("low"), F.col("new").alias("name"))).alias("names"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            new = []
            for whole, held in _texts(part):
                done, parts = 0, []
                for start, end, name in longest_first(whole, held, True) if whole and held else []:
                    parts += [whole[done:start], name]
                    done = end
                new.append("".join([*parts, whole[done:]]) if parts else whole)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string())], ["id", "text"])

    both = low.join(named, F.col("id").eqNullSafe(F.col("id_")), "left").select("id", "low", "names")
    return both.mapInArrow(put, f"id {low.schema['id'].dataType.simpleString()}, text string")
