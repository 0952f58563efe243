"""Mixing sources to target weights: fixed-length blocks, multinomial draws and index permutations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, local_table, materialize, unwrapped, wrapped

WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2
BLOCK, SHARD_BLOCKS, GROUP_SHARDS, RUN_DOCS, SEED, STEPS = 128, 1024, 512, 8192, 3, 4
# Sources up to which their facts are broadcast, and slots that a task makes at a time.
BROADCAST_SOURCES, SLOTS = 100_000, 1 << 18


def targets(sizes: list[int], weights: list[float], total: float, limit: float = LIMIT) -> list[float]:
    """Shares of total by weight, none above limit times its size, the excess reshared until none is above."""
    out, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n], float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > limit * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(limit * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in over]
    return out


def draws(slots: list[int], parts: list[int], *seed: int):
    """Multinomial source counts of one output part after another, from what each source has still to give.

    The odds are the slots left, a count is held to them, a part's share of the slots is its size's, and the last part
    takes the rest: every source ends at exactly its slots, however few parts there are.
    """
    rng, left, open_ = np.random.default_rng(seed), np.array(slots, np.int64), sum(parts)
    for size in parts:
        want = -(-int(left.sum()) * size // open_)
        got = np.zeros_like(left)
        while want > got.sum():
            room = left - got
            got += np.minimum(rng.multinomial(want - got.sum(), room / room.sum()), room)
        left -= got
        open_ -= size
        yield got


class Permutation:
    """A pseudorandom permutation of 0..size-1 chosen by a key.

    Each step is one-to-one: a product with a prime that does not divide size, shifted by the key, then the part below
    a pivot turned round.
    """

    def __init__(self, size: int, *key: int) -> None:
        rng = np.random.default_rng(key)
        self.size, self.prime = size, next(p for p in (1000003, 1000033, 1000037) if size % p)
        self.steps = [(int(rng.integers(size)), int(rng.integers(size))) for _ in range(STEPS)]

    def at(self, index: np.ndarray) -> np.ndarray:
        for shift, pivot in self.steps:
            index = (index * self.prime + shift) % self.size
            index = np.where(index < pivot, pivot - 1 - index, index)
        return index

    def where(self, value: int) -> int:
        """The index that maps to value."""
        back = pow(self.prime, -1, self.size) if self.size > 1 else 0
        for shift, pivot in reversed(self.steps):
            value = pivot - 1 - value if value < pivot else value
            value = (value - shift) * back % self.size
        return value


def _sized(documents: DataFrame) -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return documents.withColumns({"size": size, "tag": F.xxhash64("doc_id", "source", "text")})


def _laid(sized: DataFrame, facts: DataFrame, runs: DataFrame, seed: int) -> DataFrame:
    """sized with its source's facts and start, the place of a document's first word in its source.

    Within a run by a window over about RUN_DOCS rows, by id and tag: rows that tie are alike, so whichever of them
    gets a place, the same words do.
    """
    docs = sized.join(facts, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    docs = docs.withColumn("run", F.pmod(F.xxhash64("tag", F.lit(seed)), F.col("runs")))
    inside = Window.partitionBy("src", "run").orderBy("doc_id", "tag", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(runs, ["src", "run"])
    return docs.withColumn("start", F.col("first") + F.col("before")).drop("first", "before", "runs", "run")


def mix(
    documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT,
    block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED,
) -> tuple[DataFrame, DataFrame, DataFrame, Callable[[DataFrame], DataFrame]]:
    """(docs, pieces, slots, lay): sizes and targets, the words of each block by document, and the mix's slots.

    docs: the documents with size, source_size, target and start; lay gives other columns of the documents theirs. Words of a source are laid end to end over runs of its
    documents and cut every `block` words; pieces has (src, block, doc key, words, at) for what each document gives a
    block. slots has (shard, slot, src, epoch, block, take): per output shard multinomial source counts, a source's n-th slot
    mapped through the permutation of its epoch n div blocks, so a block is used at most `limit` times; take cuts a
    source's last slots where its target ends inside a block.

    Sources are few against rows (their list and the draws by group of GROUP_SHARDS shards, two numbers a source and
    group, are on the driver; a group's task draws its shards); rows are never collected. Runs hold about RUN_DOCS
    documents chosen by a hash, so a source of any size is laid out in bounded tasks. Pieces and slots grow with the
    words and are never broadcast, however small a file or shuffle makes them look. Defined cases: null texts have size 0; null is
    a source of its own, the last; repeated rows each count; an empty table gives no rows; all choices follow from the
    seed and the rows.
    """
    docs = materialize(_sized(documents).select("doc_id", "source", "size", "tag"), "sizes")
    sources = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    # Code point order is the order of UTF-8 bytes; null last.
    sources.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes, spark = [r["size"] for r in sources], docs.sparkSession
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), limit)
    facts = local_table(
        spark, [(i, r["source"], r["size"], t, 1 + r["n"] // RUN_DOCS) for i, (r, t) in enumerate(zip(sources, wanted, strict=True))],
        src="int32", name="string", source_size="int64", target="double", runs="int64",
    )
    facts = F.broadcast(facts) if len(sources) <= BROADCAST_SOURCES else facts
    # Runs end to end by a window over run totals.
    run = F.pmod(F.xxhash64("tag", F.lit(seed)), F.col("runs")).alias("run")
    runs = docs.join(facts, F.col("source").eqNullSafe(F.col("name"))).select("src", run, "size")
    runs = runs.groupBy("src", "run").agg(F.sum("size").alias("words"))
    ends = Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.select("src", "run", F.coalesce(F.sum("words").over(ends), F.lit(0)).alias("first")), "runs")
    placed = materialize(_laid(docs, facts, runs, seed).select("doc_id", "src", "size", "source_size", "target", "start"), "placed")
    held = F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block")
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = placed.where("size > 0").select("src", "start", "size", held).select(
        "src", "block", "start", (high - low).alias("words"), (low - F.col("block") * block).alias("at")
    ).hint("merge")

    blocks = [-(-n // block) for n in sizes]
    quota = [int(round(t)) for t in wanted]
    totals = []
    for n, b, q in zip(sizes, blocks, quota, strict=True):
        # A whole epoch gives n words; what is left over is taken from the next epoch's blocks until it is met.
        whole, rest = divmod(q, n) if n else (0, 0)
        totals.append(whole * b + min(b, -(-rest // block) + (1 if rest else 0)))
    shards = max(1, -(-sum(totals) // shard_blocks))
    groups = [min(GROUP_SHARDS, shards - i) for i in range(0, shards, GROUP_SHARDS)]
    given, plan = np.zeros(len(totals), np.int64), []
    for g, got in enumerate(draws(totals, groups, seed)):
        plan.append((g * GROUP_SHARDS, groups[g], given.copy(), got))
        given += got
    longs = pa.list_(pa.int64())
    planned = local_table(spark, plan, shard="int64", shards="int32", first=longs, n=longs).repartition(len(plan))

    def drawn(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                counts = np.array(list(draws(r.n, [1] * r.shards, seed, r.shard + 1))).reshape(r.shards, -1)
                for src, (first, n) in enumerate(zip(r.first, r.n, strict=True)):
                    shard = r.shard + np.repeat(np.arange(r.shards), counts[:, src])
                    for at in range(0, n, SLOTS):
                        yield from chosen(src, np.arange(first + at, first + min(n, at + SLOTS)), shard[at : at + SLOTS])

    def chosen(src: int, slot: np.ndarray, shard: np.ndarray):
        """The blocks that a source's slots stand for, by epoch."""
        epochs, lacks = slot // blocks[src], blocks[src] * block - sizes[src]
        for epoch in np.unique(epochs).tolist():
            own = slot[epochs == epoch]
            order, spot = Permutation(blocks[src], seed, src, epoch), own - epoch * blocks[src]
            got = order.at(spot)
            # The short block is the source's last one; what its epoch gave before a slot shows where the target ends.
            before = epoch * sizes[src] + spot * block - np.where(spot > order.where(blocks[src] - 1), lacks, 0)
            holds = block - np.where(got == blocks[src] - 1, lacks, 0)
            take = np.clip(quota[src] - before, 0, holds)
            yield pd.DataFrame({"shard": shard[epochs == epoch], "slot": own, "src": src, "epoch": epoch, "block": got, "take": take})

    slots = planned.mapInPandas(drawn, "shard long, slot long, src int, epoch int, block long, take long").hint("merge")
    return placed, pieces, slots, lambda other: _laid(_sized(other), facts, runs, seed)


def taken(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes from each document, repeats counted."""
    placed, pieces, slots, _ = mix(documents, **options)
    uses = slots.where("take > 0").groupBy("src", "block").agg(F.collect_list("take").alias("takes"))
    part = F.aggregate("takes", F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.lit(0), F.least(F.col("words"), t - F.col("at"))))
    given = pieces.join(uses, ["src", "block"]).groupBy("src", "start").agg(F.sum(part).alias("taken")).hint("merge")
    # A document with words is alone at its place in its source; those without take nothing.
    spot = F.when(F.col("size") > 0, F.col("start"))
    return placed.withColumn("spot_", spot).join(given.withColumnRenamed("start", "spot_"), ["src", "spot_"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents: each once an epoch that takes words of it, with those words as its text.

    A document that an epoch takes whole keeps its text as it is; of one that it takes in part, the words taken follow
    in their order, a space between. n_chars, where there is such a column, is set anew. A document without words is in
    no mix.
    """
    names = documents.columns
    _, pieces, slots, lay = mix(documents, **options)
    n = F.least(F.col("words"), F.col("take") - F.col("at"))
    first = (F.col("block") * options.get("block", BLOCK) + F.col("at") - F.col("start")).cast("int")
    got = pieces.join(slots.where("take > 0"), ["src", "block"]).select("src", "start", "epoch", first.alias("from"), n.cast("int").alias("n"))
    got = got.where("n > 0").groupBy("src", "start", "epoch").agg(F.array_sort(F.collect_list(F.struct("from", "n"))).alias("parts"), F.sum("n").alias("words")).hint("merge")
    full = lay(wrapped(documents, "doc_id", "source", "text")).where("size > 0").join(got, ["src", "start"])
    found = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(found, p["from"] + 1, p["n"]))), " ")
    full = full.withColumn("mixed_", F.when(F.col("words") == F.col("size"), F.col("text")).otherwise(cut))
    new = {"text": F.col("mixed_")}
    if "n_chars" in names:
        new["n_chars"] = F.char_length("mixed_").cast(documents.schema["n_chars"].dataType)
    return unwrapped(full, names, **new)
