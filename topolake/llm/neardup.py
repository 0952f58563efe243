"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CAPITALS, SMALL, arrow_rows, materialize, unwrapped, wrapped
from .components import components

SHINGLE, BANDS, ROWS, LOW_BITS, SEED, NUM, DEN = 5, 32, 4, 4, 1, 75, 100
BLOCK_DOCS, FILE_DOCS, MARGIN, HOT, HOT_DOCS = 256, 50_000, 5.5, 10_000, 500
UNIT = "array<struct<lb:bigint,l:int,rb:bigint,r:int,side:int>>"

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(CAPITALS.encode(), SMALL.encode())


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; fewer words make one shingle, none an empty set."""
    found = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        out = (out ^ h[j : j + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def multipliers(bands: int, rows: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, odd: np.ndarray, bands: int, rows: int, low_bits: int) -> tuple[np.ndarray, bytes]:
    """Band keys from whole minima, and the minima's low bits packed."""
    minima = np.full(len(odd), np.uint64(2**64 - 1), np.uint64)
    for at in range(0, len(shingles), 512):
        minima = np.minimum(minima, (shingles[at : at + 512, None] * odd).min(0))
    # The high half of a product orders well, its low half does not: bits are kept from a mix of the minimum.
    mixed = (minima >> np.uint64(20)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    keys = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        keys = (keys ^ mixed.reshape(bands, rows)[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    low = (mixed & np.uint64((1 << low_bits) - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, None], axis=1, count=low_bits, bitorder="little")
    return keys.view(np.int64), np.packbits(bits.ravel(), bitorder="little").tobytes()


def estimates(packed: np.ndarray, others: np.ndarray, low_bits: int) -> np.ndarray:
    """Similarity of every packed signature with every other, by bit counts, corrected for chance collisions.

    Values agree where all their low bits do: the XOR's bits of a value are united and counted; unlike values agree in
    2**-low_bits of cases, which (agreement - c) / (1 - c) takes out.
    """
    return estimated(packed.view("<u8")[:, None, :] ^ others.view("<u8")[None, :, :], low_bits)


def estimated(x: np.ndarray, low_bits: int) -> np.ndarray:
    """Similarity from the XOR of packed signatures, 64 bits a word in the last dimension."""
    step, values = 1, x.shape[-1] * 64 // low_bits
    while step < low_bits:
        x = x | (x >> np.uint64(step))
        step *= 2
    mask = np.uint64(sum(1 << i for i in range(0, 64, low_bits)))
    differing = np.bitwise_count(x & mask).sum(-1, dtype=np.int64)
    chance = 2.0**-low_bits
    return ((1 - differing / values) - chance) / (1 - chance)


def least_estimate(values: int, low_bits: int, num: int, den: int, margin: float) -> float:
    """The estimate that lies margin deviations below the threshold."""
    share, chance = num / den, 2.0**-low_bits
    p = share + (1 - share) * chance
    return share - margin * (p * (1 - p) / values) ** 0.5 / (1 - chance)


def likely(unit: np.ndarray, node: np.ndarray, size: np.ndarray, sig: np.ndarray, low_bits: int, num: int, den: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes that keep together what is likely alike within a unit; rows stand in order of units.

    Rows of a small unit are compared with the next ones, those of a larger one all with all, and each of its rows is
    then paired with the first row that it hangs together with.
    """
    heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.empty(0, np.int64)
    many = np.diff(np.append(heads, len(unit)))
    ends, left, right = np.repeat(heads + many, many), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    fits = lambda a, b: np.minimum(size[a], size[b]) * den >= np.maximum(size[a], size[b]) * num
    few = np.repeat(many <= 8, many)
    for step in range(1, 8):
        a = np.flatnonzero(few & (np.arange(len(unit)) + step < ends))
        a = a[fits(a, a + step)]
        close = estimated(sig[a] ^ sig[a + step], low_bits) >= least
        left.append(node[a[close]])
        right.append(node[a[close] + step])
    for head, n in zip(heads[many > 8].tolist(), many[many > 8].tolist(), strict=True):
        own = np.arange(head, head + n)
        near = fits(own[:, None], own[None, :])
        for row in range(0, n, 32):
            near[row : row + 32] &= estimated(sig[own[row : row + 32], None, :] ^ sig[own][None, :, :], low_bits) >= least
        label, before = np.arange(n), None
        while before is None or (label != before).any():
            before, label = label, np.where(near, label[None, :], n).min(1)
        left.append(node[own[label != np.arange(n)]])
        right.append(node[own[label[label != np.arange(n)]]])
    return np.concatenate(left), np.concatenate(right)


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if den * low < num * high:
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return den * same >= num * (len(a) + len(b) - same)


def forest(left: list, right: list | None, low_bits: int, num: int, den: int, margin: float) -> list[tuple[int, int]]:
    """Links that join what a block, or two blocks, hold: (class, class) pairs, a spanning forest of all links.

    Members are (class, packed signature, set). Pairs whose estimate is margin deviations below the threshold are out;
    others, likeliest first, are confirmed on whole sets unless already joined.
    """
    members = left + (right or [])
    sig = np.stack([np.frombuffer(m[1], np.uint8) for m in members])
    est = estimates(sig, sig, low_bits) if right is None else estimates(sig[: len(left)], sig[len(left) :], low_bits)
    near = est >= least_estimate(sig.shape[1] * 8 // low_bits, low_bits, num, den, margin)
    if right is None:
        near &= np.triu(np.ones_like(near), 1)
    i, j = np.nonzero(near)
    order = np.argsort(-est[i, j], kind="stable")
    i, j = i[order], j[order] + (0 if right is None else len(left))
    parent = list(range(len(members)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb and _linked(members[a][2], members[b][2], num, den):
            parent[max(ra, rb)] = min(ra, rb)
            out.append((members[a][0], members[b][0]))
    return out


def near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, tag) for every document, as grouped() finds them."""
    return grouped(documents, **options).drop("group_")


def grouped(
    documents: DataFrame, words: int = SHINGLE, num: int = NUM, den: int = DEN, bands: int = BANDS, rows: int = ROWS,
    low_bits: int = LOW_BITS, block_docs: int = BLOCK_DOCS, margin: float = MARGIN, seed: int = SEED, least_hot: int = HOT_DOCS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, tag, group_) for every document: components of links of at least num / den.

    One pass makes each document's set size, class (a hash of its set; equal sets are one class), band keys and packed
    low bits. A band of four minima misses a pair at the threshold in 0.684 of cases, all 32 bands in 5 of a million, and
    most copies have more than one partner. Classes of one band key, a common key's in pairs of blocks of about
    block_docs, are compared by their packed bits, and what is likely alike, by an estimate `margin` deviations below the
    threshold at least, is a candidate pair; of those a key gives only what holds its groups together. A group of
    candidates is dealt into blocks of about block_docs classes by set size and hash; each pair of blocks whose sizes
    can link is one unit of work that holds two blocks' sets, so neither a hot group of copies (one class) nor one of near
    copies (many blocks) meets in one task, and only spanning links are emitted, never all pairs. Each link is confirmed
    on full sets.

    Defined cases: null, empty and blank texts have no shingles and are linked with nothing; a text of fewer words is
    one shingle; repeated rows and ids share a class, so all rows of a smallest id are kept; null ids are larger than
    others, and a component of null ids alone has a null component_id and keeps them; group_ tells components apart whatever their ids, null where a text has no shingles; very long texts are whole; an
    empty table gives no rows.
    """
    odd = multipliers(bands, rows, seed)

    @F.pandas_udf("n_shingles long, class_id long, bands array<long>, packed binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            s = shingle_set(t, words)
            keys, packed = signature(s, odd, bands, rows, low_bits) if len(s) else (None, None)
            out.append((len(s), xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63, keys, packed))
        return pd.DataFrame(out, columns=["n_shingles", "class_id", "bands", "packed"])

    docs = documents.select("doc_id", "text")
    sketched = materialize(docs.select("doc_id", F.xxhash64("text").alias("tag"), sketch(F.col("text")).alias("s")).select("doc_id", "tag", "s.*"), "sketches")
    # A file for each so many documents: the small tables between steps need no more, each file costs a task.
    total_docs = sketched.count()
    files = max(1, -(-total_docs // FILE_DOCS))
    classes = materialize(
        sketched.where("n_shingles > 0").groupBy("class_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("packed").alias("packed")).coalesce(files),
        "classes",
    )

    # Candidates: classes that share a band key and whose signatures are likely alike, a common key's in pairs of blocks.
    keyed = classes.select("class_id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    keyed = keyed.join(shared, "key").join(classes.select("class_id", "size", "packed"), "class_id")
    blocks, block = F.ceil(F.col("held") / block_docs).cast("int"), F.pmod(F.xxhash64("class_id"), F.ceil(F.col("held") / block_docs)).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda o: (blocks == 1) | (o != block))
    keyed = keyed.select("key", "class_id", "size", "packed", F.explode(F.transform(others, lambda o: F.struct(F.least(block, o).alias("l"), F.greatest(block, o).alias("r")))).alias("u"))
    parts = max(1, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = keyed.select(F.xxhash64("key", "u.l", "u.r").alias("unit"), "class_id", "size", "packed").repartition(parts, "unit").sortWithinPartitions("unit")
    least = least_estimate(bands * rows, low_bits, num, den, margin)

    def compare(batches):
        def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
            sig = np.frombuffer(b"".join(pdf["packed"]), "<u8").reshape(len(pdf), -1)
            a, b = likely(pdf["unit"].to_numpy(), pdf["class_id"].to_numpy(), pdf["size"].to_numpy(), sig, low_bits, num, den, least)
            return pd.DataFrame({"a": a, "b": b})

        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            unit = pdf["unit"].to_numpy()
            # The last unit may go on in the next batch.
            cut = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0
            rest = pdf.iloc[cut:]
            if cut:
                yield pairs(pdf.iloc[:cut])
        if rest is not None and len(rest):
            yield pairs(rest)

    near = keyed.mapInPandas(compare, "a long, b long")
    groups = materialize(components(near, "candidates", files).coalesce(files), "groups")

    # Blocks by set size (a class of sizes spans the threshold's ratio) and hash; small groups are one block.
    sized = groups.join(classes.select(F.col("class_id").alias("node"), "size", "least", "packed"), "node")
    step = 1.001 * float(np.log(den / num)) if num < den else 1e-9
    sized = sized.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / step))
    total = sized.groupBy("root").agg(F.count("*").alias("total"))
    many = sized.groupBy("root", "band").agg(F.count("*").alias("n")).join(total, "root")
    many = many.withColumn("blocks", F.when(F.col("total") <= block_docs, 1).otherwise(F.ceil(F.col("n") / block_docs)).cast("int"))
    many = many.withColumn("band", F.when(F.col("total") <= block_docs, 0).otherwise(F.col("band"))).groupBy("root", "band").agg(F.max("blocks").alias("blocks"), F.max("total").alias("total"))
    sized = sized.join(total, "root").withColumn("band", F.when(F.col("total") <= block_docs, 0).otherwise(F.col("band"))).drop("total")
    near = lambda by, name: many.select("root", (F.col("band") + by).alias("band"), F.col("blocks").alias(name))
    placed = sized.join(near(0, "own"), ["root", "band"]).join(near(1, "below"), ["root", "band"], "left").join(near(-1, "above"), ["root", "band"], "left")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
    # A unit is (group, left band, left block, right band, right block): own band with own band, and with the next.
    own = F.transform(
        F.sequence(F.lit(0), F.col("own") - 1),
        lambda o: F.struct(F.col("band").alias("lb"), F.least(F.col("block"), o).alias("l"), F.col("band").alias("rb"), F.greatest(F.col("block"), o).alias("r"), (F.col("block") > o).cast("int").alias("side")),
    )
    none = F.array().cast(UNIT)
    up = F.when(F.col("above").isNull(), none).otherwise(F.transform(
        F.sequence(F.lit(0), F.coalesce("above", F.lit(1)) - 1),
        lambda o: F.struct(F.col("band").alias("lb"), F.col("block").alias("l"), (F.col("band") + 1).alias("rb"), o.alias("r"), F.lit(0).alias("side")),
    ))
    down = F.when(F.col("below").isNull(), none).otherwise(F.transform(
        F.sequence(F.lit(0), F.coalesce("below", F.lit(1)) - 1),
        lambda o: F.struct((F.col("band") - 1).alias("lb"), o.alias("l"), F.col("band").alias("rb"), F.col("block").alias("r"), F.lit(1).alias("side")),
    ))
    units = placed.select("node", "root", "least", "packed", F.concat(own.cast(UNIT), up, down).alias("units"))
    units = materialize(units.coalesce(files), "units")

    # Whole sets, made again from the text of one document a class, only for classes in groups.
    wanted = units.select("node", "least").distinct()

    # Not a column's function: the join's test for nulls would pass below it and make each set in a second worker too.
    def whole(batches):
        for pdf in batches:
            sets = [shingle_set(t, words).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"class_id": [xxhash.xxh3_64_intdigest(s) - 2**63 for s in sets], "shingles": sets})

    chosen = docs.join(wanted.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    sets = chosen.select("text").mapInPandas(whole, "class_id long, shingles binary").dropDuplicates(["class_id"])
    work = units.join(sets, F.col("node") == F.col("class_id")).select("root", "node", "packed", "shingles", F.explode("units").alias("u"))
    unit = F.xxhash64("root", "u.lb", "u.l", "u.rb", "u.r")
    work = work.select(unit.alias("unit"), F.col("u.side").alias("side"), "node", "packed", "shingles").repartition(parts, "unit").sortWithinPartitions("unit")

    def confirm(batches):
        held: dict[int, list] = {0: [], 1: []}
        last, links = None, []

        def flush() -> None:
            if held[0] and held[1]:
                links.extend(forest(held[0], held[1], low_bits, num, den, margin))
            elif len(held[0]) + len(held[1]) > 1 and last is not None:
                links.extend(forest(held[0] or held[1], None, low_bits, num, den, margin))
            held[0], held[1] = [], []

        for pdf in batches:
            for u, side, node, packed, shingles in zip(pdf["unit"], pdf["side"], pdf["node"], pdf["packed"], pdf["shingles"], strict=True):
                if u != last:
                    flush()
                    last = u
                held[side].append((node, packed, np.frombuffer(shingles, np.uint64)))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
            links.clear()
        flush()
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    with arrow_rows(documents.sparkSession, 128):
        edges = materialize(work.mapInPandas(confirm, "a long, b long"), "edges")
    joined = components(edges, "links", files)
    named = joined.join(classes.select(F.col("class_id").alias("node"), "least"), "node")
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(names, "root").select(F.col("node").alias("class_id"), "root", F.col("component_id").alias("joined_"))
    # A class without links is its own component, named by its own smallest document.
    label = classes.select("class_id", "least").join(named, "class_id", "left").select("class_id", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("joined_")).alias("component_id"), F.coalesce("root", "class_id").alias("group_"))
    # A class of more than a HOT-th of all documents would be one task's rows: there are at most HOT of them, broadcast.
    crowd = classes.select("class_id", "copies").where(F.col("copies") > max(least_hot, total_docs // HOT)).select("class_id")
    crowd = label.join(crowd, "class_id").select("class_id", F.col("component_id").alias("hot_id"), F.col("group_").alias("hot_group"), F.lit(True).alias("hot"))
    rows = sketched.select("doc_id", "tag", "n_shingles", "class_id").join(F.broadcast(crowd), "class_id", "left")
    alone = rows.where("hot OR n_shingles = 0").withColumnsRenamed({"hot_id": "component_id", "hot_group": "group_"}).drop("hot")
    out = rows.where("hot IS NULL AND n_shingles > 0").drop("hot", "hot_id", "hot_group").join(label, "class_id", "left").unionByName(alone)
    own_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), F.col("doc_id").eqNullSafe(own_id).alias("kept"), "tag", "group_")


def without_copies(documents: DataFrame, **options) -> DataFrame:
    """documents, of each component one row: the least by id, a null id last, then by hash of text, then of the row.

    Texts without shingles are copies of nothing and all stay. Rows that share id and text cannot be told apart by key;
    only where such a key is chosen are its rows compared as wholes.
    """
    found = grouped(documents, **options)
    alone = found.where("group_ IS NULL").select(F.col("doc_id").alias("kept_id_"), F.col("tag").alias("kept_tag_"), F.lit(1).cast("long").alias("rows_")).distinct()
    keys = found.where("group_ IS NOT NULL").groupBy("group_", "doc_id", "tag").agg(F.count("*").alias("rows_"))
    least = keys.groupBy("group_").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "rows_")).alias("k"))
    kept = materialize(alone.unionByName(least.select(F.col("k.doc_id").alias("kept_id_"), F.col("k.tag").alias("kept_tag_"), F.col("k.rows_").alias("rows_"))), "kept")
    rows = wrapped(documents, "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id_")) & (F.xxhash64("text") == F.col("kept_tag_"))
    out = rows.join(kept.where("rows_ = 1"), same, "left_semi")
    repeated = kept.where("rows_ > 1")
    if not repeated.isEmpty():
        alike = rows.join(repeated, same, "left_semi")
        other = [F.col(f.name) for f in alike.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
        one = alike.groupBy("doc_id", F.xxhash64("text").alias("tag_")).agg(F.min_by(F.struct(*alike.columns), F.xxhash64(*other)).alias("row_"))
        out = out.unionByName(one.select("row_.*"))
    return unwrapped(out, documents.columns)
