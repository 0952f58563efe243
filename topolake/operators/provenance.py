"""Row-level lineage: provenance, impact and reachability over row edges in data-flow direction.

Row edges are (src_table, src_row, dst_table, dst_row), the source feeding the target; repeats are kept (a bag).
"""

from __future__ import annotations

from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topolake.sources import sales
from topolake.sources.storage import written

from . import kernel as K

ROW_EDGES = "src_table string, src_row bigint, dst_table string, dst_row bigint"
LINEAGE_MAP = "map<string,map<string,struct<sources:array<struct<table:string,rows:array<bigint>>>>>>"


def flatten_map(maps: DataFrame, column: str) -> DataFrame:
    """Row edges of nested lineage maps {target: {row_k: {sources: [{table, rows}]}}} held as JSON text."""
    one = maps.select(F.explode(F.from_json(column, LINEAGE_MAP)).alias("dst_table", "rows"))
    one = one.select("dst_table", F.explode("rows").alias("row", "s")).select("dst_table", "row", F.explode("s.sources").alias("s"))
    return one.select(F.col("s.table").alias("src_table"), F.explode("s.rows").alias("src_row"), "dst_table", F.regexp_extract("row", r"row_(\d+)", 1).cast("bigint").alias("dst_row"))


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row edges of the driver's star, parent row to child row; a line's number counts within its order."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    line = sales.line_rows(spark, sf_dir)

    def one(df: DataFrame, parent: str, key: str, child: str, row: str) -> DataFrame:
        return df.select(F.lit(parent).alias("src_table"), F.col(key).cast("bigint").alias("src_row"), F.lit(child).alias("dst_table"), F.col(row).cast("bigint").alias("dst_row"))

    parts = [
        one(t("nation"), "region", "n_regionkey", "nation", "n_nationkey"), one(t("customer"), "nation", "c_nationkey", "customer", "c_custkey"),
        one(t("orders"), "customer", "o_custkey", "orders", "o_orderkey"), one(line, "orders", "l_orderkey", "lineitem", "row"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# Rows of a table by layer, and how many rows of each source a row is made of.
LAYER_ROWS = {"raw": 40, "staging": 30, "core": 20, "mart": 10}
FAN_IN = {"staging": 2, "core": 2, "mart": 5}


def layered_rows(edges: DataFrame, dim: DataFrame) -> DataFrame:
    """Row edges of the layered schema by rule: target row k takes rows (7k + 3j + length of the source's name) mod n."""
    rows = F.create_map(*[F.lit(x) for kv in LAYER_ROWS.items() for x in kv])
    fan = F.create_map(*[F.lit(x) for kv in FAN_IN.items() for x in kv])
    src = dim.select(F.col("name").alias("src"), rows[F.col("layer")].alias("n"))
    dst = dim.select(F.col("name").alias("dst"), rows[F.col("layer")].alias("m"), fan[F.col("layer")].alias("fan"))
    picked = edges.select("src", "dst").distinct().join(src, "src").join(dst, "dst")
    picked = picked.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
    return picked.select(
        F.col("src").alias("src_table"), F.pmod(F.col("k") * 7 + F.col("j") * 3 + F.length("src"), F.col("n")).cast("bigint").alias("src_row"),
        F.col("dst").alias("dst_table"), F.col("k").cast("bigint").alias("dst_row"),
    ).distinct()


def _nodes(edges: DataFrame, upstream: bool) -> DataFrame:
    src, dst = F.struct(F.col("src_table").alias("table"), F.col("src_row").alias("row")), F.struct(F.col("dst_table").alias("table"), F.col("dst_row").alias("row"))
    a, b = (dst, src) if upstream else (src, dst)
    return edges.select(F.lit("rows").alias("dataset"), a.alias("src"), b.alias("dst"))


def trace(edges: DataFrame, seeds: DataFrame, upstream: bool) -> DataFrame:
    """(seed_table, seed_row, table, row, depth) of all ancestors or descendants of the seeds (table, row).

    All seeds at once; a seed is in its own trace only if a cycle leads back to it.
    """
    starts = seeds.select(F.lit("rows").alias("dataset"), F.struct("table", "row").alias("seed"))
    found = K.reach(_nodes(edges, upstream), starts, start_on_cycle=True, part=lambda node: node["table"])
    return found.select(F.col("seed.table").alias("seed_table"), F.col("seed.row").alias("seed_row"), "node.table", "node.row", "depth")


def _table_order(edges: DataFrame, upstream: bool, of: str = "") -> tuple[dict[str, set[str]], list[list[str]] | None]:
    """What tables those with this prefix lead to, directly: a catalogue's; and all in batches, each after those that it leads to.

    None instead of the batches if tables lead to one another in a circle.
    """
    a, b = ("dst_table", "src_table") if upstream else ("src_table", "dst_table")
    ways: dict[str, set[str]] = {}
    for x, y in edges.select(a, b).dropna().distinct().collect():
        ways.setdefault(x, set()).add(y)
    wanted, new = {}, {x for pair in ways.items() for x in (pair[0], *pair[1]) if x.startswith(of)}
    while new:
        wanted |= {x: ways.get(x, set()) for x in new}
        new = set().union(*(wanted[x] for x in new)) - set(wanted)
    order, batches = TopologicalSorter(wanted), []
    try:
        order.prepare()
    except CycleError:
        return wanted, None
    while order.is_active():
        batches.append(sorted(order.get_ready()))
        order.done(*batches[-1])
    return wanted, batches


def tables_reached(edges: DataFrame, upstream: bool, of: str, keep: str = "") -> DataFrame:
    """(seed_table, seed_row, tables): for each row of tables with prefix `of`, the tables with prefix `keep` that its trace
    has rows of, sorted; rows without such tables are left out.

    Sets of tables are handed along the edges from the tables where traces end, table by table, as bits of a row's words:
    an edge is read once, whatever the number of seeds, and no pair of a seed and a row is made. Tables that lead to one
    another in a circle are traced instead.
    """
    ways, batches = _table_order(edges, upstream, of)
    if batches is None:
        found = trace(edges, rows_of(edges).where(F.col("table").startswith(of)), upstream).where(F.col("table").startswith(keep))
        return found.groupBy("seed_table", "seed_row").agg(F.array_sort(F.collect_set("table")).alias("tables"))
    names = sorted(ways)
    place = {x: divmod(i, K.MASK) for i, x in enumerate(names)}
    words = [f"w{i}" for i in range(-(-len(names) // K.MASK))]
    number = lambda c: F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1
    a, b = ("dst", "src") if upstream else ("src", "dst")
    hop = edges.select(F.col(f"{a}_table").alias("at"), F.col(f"{a}_row").alias("row"), F.col(f"{b}_table").alias("to"), F.col(f"{b}_row").alias("next"))

    def bit(w: str) -> Column:
        at = F.col("t")
        return F.when(F.floor(at / K.MASK) == int(w[1:]), F.call_function("shiftleft", F.lit(1).cast("long"), (at % K.MASK).cast("int"))).otherwise(F.lit(0).cast("long"))

    sets: list[tuple[set[str], DataFrame]] = []
    for batch in batches:
        own = [x for x in batch if ways[x]]
        if not own:
            continue
        to = set().union(*(ways[x] for x in own))
        ends = {x for x in to if not ways[x]}
        some = lambda far, own=own: hop.where(F.col("at").isin(own) & F.col("to").isin(sorted(far))).select(number("at").alias("n"), "row", number("to").alias("t"), "next")
        parts = [some(ends).select("n", "row", *[bit(w).alias(w) for w in words])] if ends else []
        if to - ends:
            known = reduce(DataFrame.unionByName, [df for had, df in sets if had & to]).withColumnsRenamed({"n": "t", "row": "next"} | {w: f"_{w}" for w in words})
            both = some(to - ends).join(known, ["t", "next"], "left")
            parts.append(both.select("n", "row", *[bit(w).bitwiseOR(F.coalesce(f"_{w}", F.lit(0).cast("long"))).alias(w) for w in words]))
        level = reduce(DataFrame.unionByName, parts).groupBy("n", "row").agg(*[F.bit_or(w).alias(w) for w in words])
        sets.append((set(own), written(level, "tables")))
    if not sets:
        return edges.select(F.col("dst_table").alias("seed_table"), F.col("dst_row").alias("seed_row"), F.array("src_table").alias("tables")).limit(0)
    seeds = [i for i, x in enumerate(names) if x.startswith(of) and ways[x]]
    held = F.array_compact(F.array(*[F.when(F.col(words[place[x][0]]).bitwiseAND(F.lit(1 << place[x][1]).cast("long")) != 0, F.lit(x)) for x in names if x.startswith(keep)]).cast("array<string>"))
    found = reduce(DataFrame.unionByName, [df for had, df in sets if any(x.startswith(of) for x in had)]).where(F.col("n").isin(seeds))
    return found.select(F.element_at(F.array(*map(F.lit, names)), (F.col("n") + 1).cast("int")).alias("seed_table"), F.col("row").alias("seed_row"), held.alias("tables")).where(F.size("tables") > 0)


def sources(edges: DataFrame) -> DataFrame:
    """(table, row, sources, n_sources): direct sources as a sorted bag of table:row_N."""
    ref = F.concat_ws(":row_", "src_table", "src_row")
    return edges.groupBy(F.col("dst_table").alias("table"), F.col("dst_row").alias("row")).agg(F.sort_array(F.collect_list(ref)).alias("sources"), F.count("*").alias("n_sources"))


def first_sources(edges: DataFrame, most: int) -> DataFrame:
    """(dst_table, dst_row, src_table, src_rows): the `most` smallest source rows of each target row and source table, a sorted bag."""
    return sales.least(edges, ["dst_table", "dst_row", "src_table"], "src_row", most, "src_rows")


def rows_of(edges: DataFrame) -> DataFrame:
    """Distinct (table, row) on the edges."""
    return edges.select(F.col("src_table").alias("table"), F.col("src_row").alias("row")).union(edges.select("dst_table", "dst_row")).distinct()


def _all_cascades(edges: DataFrame, ways: dict[str, set[str]], batches: list[list[str]]) -> DataFrame:
    """cascade() of every row, of tables that come in an order (_table_order, downstream).

    A row that one row alone is made of has that row's counts and one more, so only rows with several next ones are
    searched from; their pairs with rows below go on table by table and are made distinct once a table. Tables are numbers.
    """
    names = sorted(ways)
    number = lambda c: (F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1).cast("int")
    numbers = lambda some: [names.index(x) for x in some]
    step = written(edges.select(number("src_table").alias("n"), F.col("src_row").alias("row"), number("dst_table").alias("t"), F.col("dst_row").alias("next")).distinct(), "edges", by="n")
    ends = written(step.groupBy("n", "row").agg(F.count("*").alias("c"), F.first("t").alias("t"), F.first("next").alias("next")), "ends", by="n")
    several = ends.where("c > 1").select("n", "row")
    forks = {names[r["n"]] for r in several.select("n").distinct().collect()}

    found, counted = [], []
    for batch in batches[::-1]:
        parts = []
        if own := sorted(x for x in forks if ways[x] & set(batch)):
            first = step.where(F.col("n").isin(numbers(own)) & F.col("t").isin(numbers(batch)))
            parts.append(first.join(several.where(F.col("n").isin(numbers(own))), ["n", "row"], "left_semi").select("n", "row", "t", "next"))
        for had, pairs in found:
            if over := sorted(x for x in had if ways[x] & set(batch)):
                on = step.where(F.col("n").isin(numbers(over)) & F.col("t").isin(numbers(batch))).select(F.col("n").alias("at"), F.col("row").alias("at_row"), "t", "next")
                before = pairs.where(F.col("t").isin(numbers(over))).select("n", "row", F.col("t").alias("at"), F.col("next").alias("at_row"))
                parts.append(before.join(on, ["at", "at_row"]).select("n", "row", "t", "next"))
        if not parts:
            continue
        new = parts[0] if len(parts) == 1 and not found else reduce(DataFrame.unionByName, parts).distinct()
        if any(ways[x] for x in batch):
            new = written(new, "pairs")
            found.append((set(batch), new))
        counted.append(written(new.groupBy("n", "row", "t").agg(F.count("*").alias("c")), "counts"))

    one = lambda n: F.struct("t", n.alias("n"))
    levels: list[tuple[set[str], DataFrame]] = []
    all_counts = written(reduce(DataFrame.unionByName, counted).groupBy("n", "row").agg(F.collect_list(one(F.col("c"))).alias("all")), "counts", by="n") if counted else None
    for batch in batches:
        own = [x for x in batch if ways[x]]
        if not own:
            continue
        single = ends.where(F.col("n").isin(numbers(own)) & (F.col("c") == 1)).select("n", "row", "t", "next")
        to, own_count = set().union(*(ways[x] for x in own)), F.array(one(F.lit(1).cast("long")))
        if below := [df for had, df in levels if had & to]:
            known = reduce(DataFrame.unionByName, below).withColumnsRenamed({"n": "t", "row": "next"})
            single = single.join(known, ["t", "next"], "left").select("n", "row", F.concat(own_count, F.coalesce("all", F.array().cast(known.schema["all"].dataType))).alias("all"))
        else:
            single = single.select("n", "row", own_count.alias("all"))
        level = single if all_counts is None else single.unionByName(all_counts.where(F.col("n").isin(numbers(own))).select("n", "row", "all"))
        levels.append((set(own), written(level, "cascade")))
    name = lambda c: F.when(c >= 0, F.element_at(F.array(*map(F.lit, names)), F.greatest(c + 1, F.lit(1))))
    # The total is of table -1: no null, which an array's type may deny.
    whole = F.array(F.struct(F.lit(-1).alias("t"), F.aggregate("all", F.lit(0).cast("long"), lambda x, y: x + y["n"]).alias("n")))
    each = reduce(DataFrame.unionByName, [df for _, df in levels]).select("n", "row", F.explode(F.concat("all", whole)).alias("x"))
    return each.select(name(F.col("n")).alias("seed_table"), F.col("row").alias("seed_row"), name(F.col("x.t")).alias("table"), F.col("x.n").alias("n_rows"))


def _seeds_cascades(edges: DataFrame, seeds: DataFrame, ways: dict[str, set[str]], batches: list[list[str]]) -> DataFrame:
    """cascade() of some rows (table, row), of tables that come in an order (_table_order, downstream).

    Bits of seeds are handed down table by table, 63 seeds a row: an edge is read once and joined once, and rows that
    nothing is made of are combined and counted without being kept. Tables are numbers.
    """
    names = sorted(ways)
    number = lambda c: (F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1).cast("int")
    placed = K.placed(seeds.select(F.lit("rows").alias("dataset"), F.struct("table", "row").alias("seed")))
    own = placed.select(number("seed.table").alias("n"), F.col("seed.row").alias("row"), "chunk", F.expr("shiftleft(1L, bit)").alias("mask"))
    levels: list[tuple[set[str], DataFrame]] = [({r[0] for r in seeds.select("table").distinct().collect()}, own)]
    counted = [own.select("chunk", "mask", F.col("n").alias("t"), F.lit(0).cast("long").alias("n")).limit(0)]
    for batch in batches[::-1]:
        of = {x for x in ways if ways[x] & set(batch)}
        held = [(had & of, df) for had, df in levels if had & of]
        if not held:
            continue
        some = sorted(set().union(*(had for had, _ in held)))
        step = edges.where(F.col("src_table").isin(some) & F.col("dst_table").isin(batch)).select(
            number("src_table").alias("n"), F.col("src_row").alias("row"), number("dst_table").alias("t"), F.col("dst_row").alias("next"))
        new = step.join(reduce(DataFrame.unionByName, [df for _, df in held]), ["n", "row"]).groupBy("t", "next", "chunk").agg(F.bit_or("mask").alias("mask"))
        if any(ways[x] for x in batch):
            new = written(new, "cascade")
            levels.append(({x for x in batch if ways[x] and any(x in ways[y] for y in some)}, new.select(F.col("t").alias("n"), F.col("next").alias("row"), "chunk", "mask")))
        counted.append(new.groupBy("chunk", "mask", "t").agg(F.count("*").alias("n")))
    counts = written(reduce(DataFrame.unionByName, counted).withColumn("dataset", F.lit("rows")), "counts")
    name = F.when(F.col("t") >= 0, F.element_at(F.array(*map(F.lit, names)), F.greatest(F.col("t") + 1, F.lit(1))))
    each = K.by_seed(counts, placed).groupBy("seed", "t").agg(F.sum("n").alias("n"))
    # The total is of table -1.
    whole = each.groupBy("seed").agg(F.lit(-1).alias("t"), F.sum("n").alias("n"))
    return each.unionByName(whole).select(F.col("seed.table").alias("seed_table"), F.col("seed.row").alias("seed_row"), name.alias("table"), F.col("n").alias("n_rows"))


def cascade(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(seed_table, seed_row, table, n_rows): distinct descendants by table; the total where table is null.

    Without seeds all rows are: then tables go in their order (_all_cascades), unless they lead to one another in a
    circle. With seeds, tables that come in an order are gone through from the seeds on (_seeds_cascades). Else rows that nothing
    is made of, most of a warehouse's, are not followed or kept: the search goes through the others alone, many seeds a row as
    bits of a mask, and rows without descendants join once: those of one parent as a count.
    """
    ways, batches = _table_order(edges, upstream=False)
    if batches and len(batches) > 1:
        return _all_cascades(edges, ways, batches) if seeds is None else _seeds_cascades(edges, seeds, ways, batches)
    seeds = rows_of(edges) if seeds is None else seeds
    pairs = written(edges.select(
        F.struct(F.col("src_table").alias("table"), F.col("src_row").alias("row")).alias("src"), F.struct(F.col("dst_table").alias("table"), F.col("dst_row").alias("row")).alias("dst"),
    ).distinct(), "row-edges").withColumn("dataset", F.lit("rows"))
    made = pairs.select(F.col("src").alias("dst")).distinct()
    starts = seeds.select(F.lit("rows").alias("dataset"), F.struct("table", "row").alias("seed")).distinct()
    masks, placed = K.reach_masks(pairs.join(made, "dst", "left_semi").select("dataset", "src", "dst"), starts)
    masks = written(masks.select("node", "chunk", "mask"), "cascade")
    own = placed.select(F.col("seed").alias("node"), "chunk", F.expr("shiftleft(1L, bit)").alias("mask"))
    # A leaf of one parent is counted with it, before the join; only leaves of several are combined after it.
    last = pairs.join(made, "dst", "left_anti")
    parents = last.groupBy("dst").agg(F.count("*").alias("n"), F.first("src").alias("node"))
    ways = masks.unionByName(own).groupBy("node", "chunk").agg(F.bit_or("mask").alias("mask"))
    single = parents.where("n = 1").groupBy("node", F.col("dst.table").alias("t")).agg(F.count("*").alias("n")).join(ways, "node").select("chunk", "mask", "t", "n")
    several = last.join(parents.where("n > 1").select("dst"), "dst", "left_semi").select("dst", F.col("src").alias("node"))
    several = several.join(ways, "node").groupBy("dst", "chunk").agg(F.bit_or("mask").alias("mask"))
    rows = masks.select("chunk", "mask", F.col("node.table").alias("t"), F.lit(1).cast("long").alias("n")).unionByName(single).unionByName(several.select("chunk", "mask", F.col("dst.table").alias("t"), F.lit(1).cast("long").alias("n")))
    counts = K.by_seed(rows.groupBy("chunk", "mask", "t").agg(F.sum("n").alias("n")).withColumn("dataset", F.lit("rows")), placed)
    return counts.groupBy("seed", "t").agg(F.sum("n").alias("n")).groupBy("seed").agg(F.collect_list(F.struct("t", "n")).alias("all"), F.sum("n").alias("total")).select(
        "seed", F.explode(F.concat("all", F.array(F.struct(F.lit(None).cast("string").alias("t"), F.col("total").alias("n"))))).alias("x")).select(
        F.col("seed.table").alias("seed_table"), F.col("seed.row").alias("seed_row"), F.col("x.t").alias("table"), F.col("x.n").alias("n_rows"))


def longest_depths(edges: DataFrame) -> DataFrame:
    """(table, row, depth): the longest chain of rows that each row is made by; a cycle raises a ValueError.

    Goes by tables, sources first: an edge is read once, and its row joined with its source's depth. Tables that lead to one
    another in a circle have their rows peeled off round by round instead.
    """
    ways, batches = _table_order(edges, upstream=True)
    if batches is None:
        return K.longest(_nodes(edges, upstream=False)).select("node.table", "node.row", "depth")
    names = sorted(ways)
    number = lambda c: (F.array_position(F.array(*map(F.lit, names)), F.col(c)) - 1).cast("int")
    as_source = edges.select(number("src_table").alias("n"), F.col("src_row").alias("row"), F.lit(0).alias("depth"))
    levels: list[tuple[set[str], DataFrame]] = []
    for batch in batches:
        # Rows that are sources only have depth 0, of whatever table they are.
        rows, own = as_source.where(F.col("src_table").isin(batch)), [x for x in batch if ways[x]]
        if own:
            of = edges.where(F.col("dst_table").isin(own))
            to = set().union(*(ways[x] for x in own))
            near = of.where(F.col("src_table").isin([x for x in to if not ways[x]])).select(number("dst_table").alias("n"), F.col("dst_row").alias("row"), F.lit(1).alias("depth"))
            rows = rows.unionByName(near)
            if far := [x for x in to if ways[x]]:
                below = reduce(DataFrame.unionByName, [df for had, df in levels if had & set(far)]).withColumnsRenamed({"n": "t", "row": "next", "depth": "under"})
                hop = of.where(F.col("src_table").isin(far)).select(number("dst_table").alias("n"), F.col("dst_row").alias("row"), number("src_table").alias("t"), F.col("src_row").alias("next"))
                rows = rows.unionByName(hop.join(below, ["t", "next"]).select("n", "row", (F.col("under") + 1).alias("depth")))
        levels.append((set(batch), written(rows.groupBy("n", "row").agg(F.max("depth").alias("depth")), "depths")))
    if not levels:
        return edges.select(F.col("dst_table").alias("table"), F.col("dst_row").alias("row"), F.lit(0).alias("depth")).limit(0)
    name = F.element_at(F.array(*map(F.lit, names)), F.col("n") + 1)
    return reduce(DataFrame.unionByName, [df for _, df in levels]).select(name.alias("table"), "row", "depth")


def _is_graded(ways: dict[str, set[str]], batches: list[list[str]]) -> bool:
    """Whether all ways from a table to another are equally long (_table_order)."""
    far: dict[str, dict[str, int]] = {}
    for x in (x for batch in batches for x in batch):
        far[x] = dict.fromkeys(ways[x], 1)
        for y in ways[x]:
            for z, n in far[y].items():
                if far[x].setdefault(z, n + 1) != n + 1:
                    return False
    return True


def depths(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(seed_table, seed_row, depth): the largest least distance to an ancestor, of all rows if no seeds are given.

    Where all ways from a table to another are equally long, so are those of their rows, and the longest chain is the depth
    (longest_depths): an edge is read once and no pair of rows is made. Chains that a null cuts are searched.
    """
    if seeds is None:
        ways, batches = _table_order(edges, upstream=True)
        cut = F.col("src_table").isNull() | F.col("dst_table").isNull() | (F.col("src_row").isNull() & F.col("src_table").isin([x for x in ways if ways[x]]))
        if batches is not None and _is_graded(ways, batches) and edges.where(cut).isEmpty():
            return longest_depths(edges).where("depth > 0").select(F.col("table").alias("seed_table"), F.col("row").alias("seed_row"), "depth")
    seeds = rows_of(edges) if seeds is None else seeds
    return trace(edges, seeds, upstream=True).groupBy("seed_table", "seed_row").agg(F.max("depth").alias("depth"))


def first_row_sources(edges: DataFrame, prefix: str) -> DataFrame:
    """(table, source): the tables in the provenance of the first row of each target table with this prefix."""
    found = tables_reached(edges, upstream=True, of=prefix)
    return found.groupBy(F.col("seed_table").alias("table")).agg(F.min_by("tables", "seed_row").alias("tables")).select("table", F.explode("tables").alias("source"))


def table_lineage(edges: DataFrame) -> DataFrame:
    """(table, direct, second): direct source tables and those of the sources."""
    pairs = edges.select(F.col("dst_table").alias("table"), F.col("src_table").alias("source")).distinct()
    second = pairs.join(pairs.select(F.col("table").alias("source"), F.col("source").alias("far")), "source").groupBy("table").agg(F.array_sort(F.collect_set("far")).alias("second"))
    return pairs.groupBy("table").agg(F.array_sort(F.collect_set("source")).alias("direct")).join(second, "table", "left")


def row_graph(tables: dict[str, tuple[DataFrame, str, dict[str, str]]], edges: DataFrame) -> DataFrame:
    """(src, dst, edge_type) of rows: belongs_to their table, fk_ref by key columns, derived_from_row target to source.

    tables: name to (rows, key column, {foreign key column: table it refers to}).
    """
    parts = []
    for name, (df, key, refs) in tables.items():
        me = F.concat(F.lit(f"{name}:row_"), F.col(key))
        parts.append(df.select(me.alias("src"), F.lit(name).alias("dst"), F.lit("belongs_to").alias("edge_type")))
        for column, target in refs.items():
            parts.append(df.where(F.col(column).isNotNull()).select(me.alias("src"), F.concat(F.lit(f"{target}:row_"), F.col(column)).alias("dst"), F.lit("fk_ref").alias("edge_type")))
    parts.append(edges.select(F.concat_ws(":row_", "dst_table", "dst_row").alias("src"), F.concat_ws(":row_", "src_table", "src_row").alias("dst"), F.lit("derived_from_row").alias("edge_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def hash_features(columns: list[str], width: int = 8):
    """Array of `width` numbers from 0 to 1: the first 32 bits of each cell's md5, padded with 0."""
    each = [F.conv(F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0 for c in columns]
    return F.slice(F.concat(F.array(*each), F.array_repeat(F.lit(0.0), width)), 1, width)
