"""The iterative part: reachability, shortest paths, components and rank on edge tables of any number of graphs.

Edges are (dataset, src, dst); every operator runs all graphs and all start nodes at once. A round is one equi-join of
the frontier with the edges, combined per node before the shuffle; its result is written, so plans stay one round deep.
Graphs counted to be small are searched whole, a dataset a task, instead (small.py).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolake.sources.storage import written

from . import small

MAX_ROUNDS = 200  # of components(), whose rounds grow with the logarithm of the diameter
FOLDED_ROUNDS = 50  # levels after which what was seen is written as one table


def directed(edges: DataFrame, *kinds: str) -> DataFrame:
    """Distinct (dataset, src, dst) of some edge types, all if none is named."""
    some = edges.where(F.col("edge_type").isin(*kinds)) if kinds else edges
    return some.select("dataset", "src", "dst").distinct()


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select("dataset", F.col("dst").alias("src"), F.col("src").alias("dst"))


def undirected(edges: DataFrame, *kinds: str) -> DataFrame:
    """Both directions of each edge, once."""
    one = directed(edges, *kinds)
    return one.union(flipped(one)).distinct()


def reach(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, start_on_cycle: bool = False, paths: bool = False, part: Callable[[Column], Column] | None = None
) -> DataFrame:
    """(dataset, seed, node, depth[, path]) of what the seeds (dataset, seed) reach, at least depth.

    The start is row depth 0 unless start_on_cycle, when it is a row only if a cycle leads back to it. path is the
    least one by names among the shortest, the start included. Without max_depth it goes on until nothing new is found. Frontier rows that were seen before are dropped, so
    each (seed, node) is expanded once, whatever the number of paths. part names a node's table, or other value that few
    there are of: a round reads the edges of the tables it has come to, and looks for rows seen before in rounds that may
    have come to the same ones, so that a graph of layers is read once and not once a round.
    """
    if small.fits(edges, seeds):
        node = edges.schema["src"].dataType.simpleString()
        schema = f"dataset string, seed {node}, node {node}, depth int" + (f", path array<{node}>" if paths else "")
        run = small.reacher(max_depth, start_on_cycle, paths)
        return edges.groupBy("dataset").cogroup(seeds.distinct().groupBy("dataset")).applyInPandas(run, schema)
    part = part or (lambda n: F.lit("all"))
    # Written once: what makes the edges is not made again each round.
    step = written(edges.select("dataset", F.col("src").alias("node"), F.col("dst").alias("next"), part(F.col("src")).alias("part")), "edges", by="part")
    ways = {tuple(r) for r in step.select("part", part(F.col("next"))).distinct().collect()}
    parts = {r[0] for r in seeds.select(part(F.col("seed"))).distinct().collect()}
    first = seeds.select("dataset", "seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).distinct()
    first = first.withColumn("path", F.array("seed")) if paths else first
    frontier, seen = first, [] if start_on_cycle else [(first, parts)]
    for depth in range(1, max_depth + 1) if max_depth else count(1):
        new = frontier.drop("depth").join(step.where(F.col("part").isin(list(parts - {None}))).drop("part"), ["dataset", "node"])
        parts = {b for a, b in ways if a in parts}
        keys = ["dataset", "seed", F.col("next").alias("node"), F.lit(depth).alias("depth")]
        if paths:
            new = new.groupBy(*keys).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        else:
            new = new.select(*keys).distinct()
        if before := [df for df, had in seen if had & parts]:
            new = new.join(_union(before).select("dataset", "seed", "node"), ["dataset", "seed", "node"], "left_anti").select(*new.columns)
        frontier = written(new, "frontier")
        if frontier.isEmpty():
            break
        seen.append((frontier, parts))
        if depth % FOLDED_ROUNDS == 0:
            seen = [(written(_union([df for df, _ in seen]), "seen"), set().union(*(had for _, had in seen)))]
    return _union([df for df, _ in seen]) if seen else frontier


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


MASK = 63  # seeds that one long has a bit for


def placed(seeds: DataFrame) -> DataFrame:
    """(dataset, seed, chunk, bit): the bit of a mask that each seed is."""
    # Places in the files of what is written: unlike for any two seeds, and close together within a file.
    one = written(seeds.select("dataset", "seed").distinct(), "seeds").withColumn("place", F.monotonically_increasing_id())
    return written(one.select("dataset", "seed", F.expr(f"place div {MASK}").alias("chunk"), (F.col("place") % MASK).cast("int").alias("bit")), "seeds")


def reach_masks(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the seeds reach over one or more edges, many seeds a row: ((dataset, node, chunk, mask), (dataset, seed, chunk, bit)).

    Seeds are numbered and take a bit each of a row's mask; a round joins the frontier with the edges and combines masks
    by OR before the shuffle, so seeds that share what they reach share its rows. Only bits that are new to a node go
    on. Without shared ground a row has one bit, as in reach(). Depths are not kept.
    """
    step = written(edges.select("dataset", F.col("src").alias("node"), F.col("dst").alias("next")), "edges")
    numbered = placed(seeds)
    own = numbered.select("dataset", F.col("seed").alias("node"), "chunk", F.expr("shiftleft(1L, bit)").alias("mask"))
    frontier, levels = own, []
    for depth in count(1):
        new = frontier.join(step, ["dataset", "node"]).groupBy("dataset", F.col("next").alias("node"), "chunk").agg(F.bit_or("mask").alias("mask"))
        if levels:
            seen = levels[0]
            for more in levels[1:]:
                seen = seen.unionByName(more)
            seen = seen.groupBy("dataset", "node", "chunk").agg(F.bit_or("mask").alias("had"))
            left = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long"))))
            new = new.join(seen, ["dataset", "node", "chunk"], "left").select("dataset", "node", "chunk", left.alias("mask")).where("mask <> 0")
        frontier = written(new, "masks")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        if depth % FOLDED_ROUNDS == 0:
            whole = levels[0]
            for more in levels[1:]:
                whole = whole.unionByName(more)
            levels = [written(whole.groupBy("dataset", "node", "chunk").agg(F.bit_or("mask").alias("mask")), "seen")]
    whole = frontier
    for more in levels:
        whole = whole.unionByName(more)
    return whole.groupBy("dataset", "node", "chunk").agg(F.bit_or("mask").alias("mask")), numbered


def by_seed(masks: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows with a mask, one a seed in it: `seed` in the place of `chunk` and `mask`."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(MASK - 1)), lambda b: F.call_function("shiftright", F.col("mask"), b).bitwiseAND(F.lit(1)) == 1)
    return masks.withColumn("bit", F.explode(bits)).join(placed, ["dataset", "chunk", "bit"]).drop("chunk", "mask", "bit")


def longest(edges: DataFrame) -> DataFrame:
    """(dataset, node, depth) of a graph without cycles: the length of the longest path that ends in each node.

    Nodes without sources are peeled off round by round; a node's round is its depth. What is left when nothing can be
    peeled lies on a cycle or behind one, which raises a ValueError that names some of it.
    """
    left = written(edges.select("dataset", "src", "dst").distinct(), "peel")
    found = None
    nodes = written(left.select("dataset", F.col("src").alias("node")).union(left.select("dataset", "dst")).distinct(), "peel-nodes")
    for depth in count():
        held = left.select("dataset", F.col("dst").alias("node")).distinct()
        ready = written(nodes.join(held, ["dataset", "node"], "left_anti").withColumn("depth", F.lit(depth)), "peeled")
        found = ready if found is None else found.unionByName(ready)
        if left.isEmpty():
            return found
        if ready.isEmpty():
            some = [tuple(r) for r in nodes.limit(5).collect()]
            raise ValueError(f"the graph has a cycle: {some}")
        gone = ready.select("dataset", F.col("node").alias("src"))
        left = written(left.join(gone, ["dataset", "src"], "left_anti").select("dataset", "src", "dst"), "peel")
        nodes = written(held, "peel-nodes")


def paths_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, path) for (dataset, pair, s, t): the least by names of the shortest paths from s to t; no row if there is none.

    Searched from both ends: each round moves the smaller frontier one level on, and a pair is done, its frontiers
    dropped, as soon as they meet. All shortest paths cross the meeting level in one node each, so the least path is
    the least of the least halves there.
    """
    step = written(edges.select("dataset", "src", "dst").distinct(), "edges")
    ways = (step.select("dataset", F.col("src").alias("node"), F.col("dst").alias("next")), step.select("dataset", F.col("dst").alias("node"), F.col("src").alias("next")))
    starts = written(pairs.select("dataset", "pair", "s", "t").distinct(), "pairs")
    fronts = [starts.select("dataset", "pair", F.col(x).alias("node"), F.array(x).alias("path")) for x in "st"]
    seen, sizes, found = list(fronts), [0, 0], []
    for turn in count():
        f, b = fronts
        met = f.join(b.select("pair", "node", F.col("path").alias("rest")), ["pair", "node"])
        met = written(met.groupBy("pair").agg(F.min(F.concat("path", F.slice("rest", 2, F.size("rest")))).alias("path")), "met")
        found.append(met)
        fronts = [x.join(met, "pair", "left_anti") for x in fronts]
        # A pair one of whose frontiers has ended has no path.
        fronts = [written(x.join(y, "pair", "left_semi"), "front") for x, y in (fronts, fronts[::-1])]
        sizes = [x.count() for x in fronts]
        if not min(sizes):
            break
        i = int(sizes[1] < sizes[0])
        least = F.min(F.concat("path", F.array("next")) if i == 0 else F.concat(F.array("next"), F.col("path")))
        new = fronts[i].join(ways[i], ["dataset", "node"]).groupBy("dataset", "pair", F.col("next").alias("node")).agg(least.alias("path"))
        fronts[i] = written(new.join(seen[i].select("pair", "node"), ["pair", "node"], "left_anti"), "front")
        seen[i] = seen[i].select("pair", "node").unionByName(fronts[i].select("pair", "node"))
        if turn % FOLDED_ROUNDS == FOLDED_ROUNDS - 1:
            seen = [written(x.select("pair", "node"), "seen") for x in seen]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, name, comp): comp is the least node number of the component; nodes without edges are their own.

    Each round takes the least label of a node's neighbourhood and then its label's label, so rounds grow with the
    logarithm of the diameter on the fixtures' shapes; it ends when no label changes.
    """
    if small.fits(edges) and small.fits(nodes):
        known = directed(edges)
        return nodes.select("dataset", "name", "node_id").groupBy("dataset").cogroup(known.groupBy("dataset")).applyInPandas(small.united, "dataset string, name string, comp int")
    both = undirected(edges)
    label = nodes.select("dataset", "name", F.col("node_id").alias("comp"))
    ids = label.select("dataset", F.col("comp").alias("id"), F.col("name").alias("id_name"))
    for _ in range(MAX_ROUNDS):
        near = both.join(label, (both.dataset == label.dataset) & (both.dst == label.name)).select(both.dataset, F.col("src").alias("name"), "comp")
        low = label.withColumn("was", F.lit(True)).unionByName(near.withColumn("was", F.lit(False))).groupBy("dataset", "name").agg(
            F.min("comp").alias("comp"), F.max(F.when(F.col("was"), F.col("comp"))).alias("before")
        )
        named = low.join(ids.withColumnRenamed("id", "comp"), ["dataset", "comp"])
        up = low.select("dataset", F.col("name").alias("id_name"), F.col("comp").alias("up"))
        new = written(named.join(up, ["dataset", "id_name"]).select("dataset", "name", "up", "before"), "labels")
        label = new.select("dataset", "name", F.col("up").alias("comp"))
        if new.where("up <> before").isEmpty():
            return label
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 60) -> DataFrame:
    """(dataset, name, rank) by power iteration on the undirected edges, dangling mass spread evenly; ranks sum to 1."""
    both = undirected(edges)
    if small.fits(both) and small.fits(nodes):
        return nodes.select("dataset", "name").groupBy("dataset").cogroup(both.groupBy("dataset")).applyInPandas(small.ranker(damping, rounds), "dataset string, name string, rank double")
    out = both.groupBy("dataset", F.col("src").alias("name")).agg(F.count("*").alias("deg"))
    total = nodes.groupBy("dataset").agg(F.count("*").alias("n"))
    base = nodes.select("dataset", "name").join(total, "dataset").join(out, ["dataset", "name"], "left")
    base = written(base.withColumn("deg", F.coalesce("deg", F.lit(0))), "rank-base")
    rank = base.select("dataset", "name", "n", "deg", (F.lit(1.0) / F.col("n")).alias("rank"))
    for turn in range(rounds):
        share = rank.where("deg > 0").select("dataset", F.col("name").alias("src"), (F.col("rank") / F.col("deg")).alias("give"))
        got = both.join(share, ["dataset", "src"]).groupBy("dataset", F.col("dst").alias("name")).agg(F.sum("give").alias("got"))
        idle = rank.groupBy("dataset").agg(F.coalesce(F.sum(F.when(F.col("deg") == 0, F.col("rank"))), F.lit(0.0)).alias("idle"))
        rank = base.join(got, ["dataset", "name"], "left").join(idle, "dataset").select(
            "dataset", "name", "n", "deg",
            ((1 - damping) / F.col("n") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("idle") / F.col("n"))).alias("rank"),
        )
        if turn % 5 == 4:
            rank = written(rank, "rank")
    return rank.select("dataset", "name", "rank")


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, name, betweenness), directed and normalised by (n - 1)(n - 2).

    Forward, level by level: distances and path counts from every node. Backward, from the farthest level: a node
    gives each node one step nearer to the start the share of its paths that come through it, times one and what it
    has itself been given. Rows are pairs of a start and an edge, never pairs of pairs. A dataset counted to be small is
    one task's.
    """
    one = directed(edges).where("src <> dst")
    if small.fits(one, nodes):
        part = nodes.select("dataset", "name").groupBy("dataset").cogroup(one.groupBy("dataset")).applyInPandas(small.between, "dataset string, name string, part double")
        return _of_pairs(nodes, part)
    step = written(one.select("dataset", F.col("src").alias("t"), F.col("dst").alias("next")), "edges")
    start = nodes.select("dataset", F.col("name").alias("s"), F.col("name").alias("t"), F.lit(1).cast("double").alias("n"))
    levels, seen = [start], start.select("dataset", "s", "t")
    for depth in count(1):
        new = levels[-1].join(step, ["dataset", "t"]).groupBy("dataset", "s", F.col("next").alias("t")).agg(F.sum("n").alias("n"))
        level = written(new.join(seen, ["dataset", "s", "t"], "left_anti"), "paths")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("dataset", "s", "t"))
        if depth % FOLDED_ROUNDS == 0:
            seen = written(seen, "seen")
    back, given, parts = step.select("dataset", "t", F.col("next").alias("far")), None, []
    for level, below in zip(levels[:0:-1], levels[-2::-1], strict=True):
        far = level if given is None else level.join(given, ["dataset", "s", "t"], "left")
        got = F.lit(0.0) if given is None else F.coalesce("got", F.lit(0.0))
        far = far.select("dataset", "s", F.col("t").alias("far"), ((1 + got) / F.col("n")).alias("unit"))
        share = far.join(back, ["dataset", "far"]).join(below, ["dataset", "s", "t"])
        given = written(share.groupBy("dataset", "s", "t").agg(F.sum(F.col("n") * F.col("unit")).alias("got")), "given")
        parts.append(given.where("s <> t").groupBy("dataset", F.col("t").alias("name")).agg(F.sum("got").alias("part")))
    part = nodes.select("dataset", "name", F.lit(0.0).alias("part")).where("false")
    for more in parts:
        part = part.unionByName(more)
    return _of_pairs(nodes, part.groupBy("dataset", "name").agg(F.sum("part").alias("part")))


def _of_pairs(nodes: DataFrame, part: DataFrame) -> DataFrame:
    """Shares of paths through each node by the number of pairs of others."""
    total = nodes.groupBy("dataset").agg(F.count("*").alias("size"))
    pairs = F.greatest(F.lit(1), (F.col("size") - 1) * (F.col("size") - 2))
    return nodes.select("dataset", "name").join(total, "dataset").join(part, ["dataset", "name"], "left").select(
        "dataset", "name", (F.coalesce("part", F.lit(0.0)) / pairs).alias("betweenness")
    )
