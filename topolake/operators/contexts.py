"""Contexts of questions about one schema: retrieved chunks, graph surroundings, and values with row lineage.

A context is rows of lines, put in order at the end. Names of tables are a catalogue; questions are a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features as S
from . import kernel as K
from . import text as X
from . import topology as T


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _line(rows: DataFrame, part: int, line: Column, at: Column | None = None) -> DataFrame:
    return rows.select("id", F.lit(part).alias("part"), (F.lit(0) if at is None else at).cast("int").alias("at"), line.alias("line"))


def _joined(parts: list[DataFrame]) -> DataFrame:
    """(id, context): lines by part, place and text."""
    return X.lines(reduce(DataFrame.unionByName, parts), ["id"], F.col("line"), ["part", "at"], "context")


def _arrows(edges: DataFrame) -> DataFrame:
    """edges with `arrow`, each distinct edge once."""
    word = F.when(F.col("edge_type") == "fk_to", " --FK--> ").otherwise(" --DERIVED_FROM--> ")
    return edges.select("src", "dst", "edge_type").distinct().withColumn("arrow", F.concat(F.lit("  "), "src", word, "dst"))


def chunk_texts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, text): a table with all edges at it, references and derivations; an isolated table says so."""
    arrows = _arrows(edges)
    at = arrows.select(F.col("src").alias("name"), "arrow").union(arrows.select(F.col("dst").alias("name"), "arrow"))
    held = at.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("arrow")), "\n").alias("held"))
    text = F.coalesce(_say("Relationships:\n", F.col("held")), F.lit("No relationships (isolated table)"))
    return nodes.select("name").join(held, "name", "left").select("name", _say("Table: ", F.col("name"), "\n", text).alias("text"))


def retrieved(questions: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 15) -> DataFrame:
    """(id, context): for each question (id, vec) the texts of its k nearest chunks (name, text, vec), then all derivations.

    Vectors are input columns, of whatever model; equal cosines go by name.
    """
    near = X.nearest(questions.select(F.col("id").alias("q"), "vec"), chunks.select(F.col("name").alias("id"), "vec"), k)
    found = near.select(F.col("q").alias("id"), "position", F.col("id").alias("name")).join(chunks.select("name", "text"), "name")
    total = chunks.agg(F.count("*").alias("n"))
    head = found.groupBy("id").agg(F.count("*").alias("k")).crossJoin(F.broadcast(total))
    said = _say("DATABASE SCHEMA (showing ", F.col("k").cast("string"), " most relevant tables out of ", F.col("n").cast("string"), " total)")
    lineage = _arrows(edges.where("edge_type = 'derived_from'")).agg(F.array_join(F.array_sort(F.collect_set("arrow")), "\n").alias("all")).where("all <> ''")
    # The derivations of one schema, a line each: one row.
    every = questions.select("id").crossJoin(F.broadcast(lineage))
    return _joined([
        _line(head, 0, said), _line(found, 1, _say("\n", F.col("text")), F.col("position")), _line(every, 2, _say("\nALL LINEAGE RELATIONSHIPS (global):\n", F.col("all"))),
    ])


def surroundings(questions: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """(id, mentioned, relevant, context) for questions (id, text) about one dataset.

    Mentioned tables are contained names, case ignored. Relevant are the tables within `hops` references or derivations
    of them, all tables if none is mentioned. The context names all components, the relevant tables' features, every
    edge that touches a relevant table, and the shortest path of each pair of mentioned tables.
    """
    names = nodes.select("dataset", "node_id", "name")
    both = K.undirected(edges)
    hit = questions.join(F.broadcast(names), F.contains(F.lower("text"), F.lower("name"))).select("id", "node_id", F.col("name").alias("seed"), "dataset")
    seeds = hit.select("dataset", "seed").distinct()
    near = hit.join(K.reach(both, seeds, max_depth=hops).select("seed", "node"), "seed").select("id", F.col("node").alias("name")).distinct()
    # A question without a table by every table of a catalogue.
    whole = questions.select("id").join(hit.select("id"), "id", "left_anti").crossJoin(F.broadcast(names.select("name")))
    relevant = near.unionByName(whole)
    silos = T.silos(nodes, edges).groupBy("silo").agg(F.array_sort(F.collect_list("name")).alias("held"))
    every = questions.select("id").crossJoin(F.broadcast(silos))
    told = _say("  Component ", (F.col("silo") + 1).cast("string"), " (", F.size("held").cast("string"), " tables): ", F.array_join("held", ", "))
    size = names.agg(F.count("*").alias("n")).crossJoin(silos.agg(F.count("*").alias("c")))
    head = questions.select("id").crossJoin(F.broadcast(size))
    said = _say("GRAPH STRUCTURE (", F.col("n").cast("string"), " tables, ", F.col("c").cast("string"), " connected components)\n\nConnected Components (Silos):")
    ids = questions.select("id")
    f = S.approximated(nodes, edges)
    shown = [("out_degree", "out_deg"), ("in_degree", "in_deg"), ("norm_degree", "norm"), ("lineage_degree", "lineage_deg"), ("betweenness", "betweenness"), ("pagerank", "rank")]
    feature = F.format_string("  %s: " + ", ".join(f"{n}=%.3f" for n, _ in shown), "name", *[F.col(c).cast("double") for _, c in shown])
    of = relevant.join(f, "name").select("id", feature.alias("line"))
    arrows = _arrows(edges)
    touched = relevant.join(arrows.withColumn("name", F.explode(F.array("src", "dst"))), "name").select("id", "edge_type", "arrow").distinct()
    pair = hit.select("id", F.col("node_id").alias("i"), F.col("seed").alias("a")).join(hit.select("id", F.col("node_id").alias("j"), F.col("seed").alias("b")), "id").where("i < j")
    routes = K.reach(both, seeds, paths=True)
    pair = pair.join(routes.select(F.col("seed").alias("a"), F.col("node").alias("b"), "path"), ["a", "b"], "left")
    ends = _say("  ", F.col("a"), " → ", F.col("b"), ": ")
    way = F.coalesce(_say(F.array_join("path", " → "), " (", (F.size("path") - 1).cast("string"), " hops)"), F.lit("no path exists"))
    # Pairs in the catalogue's order: node numbers of both, as one place.
    place = F.col("i") * nodes.count() + F.col("j")
    derived = touched.where("edge_type = 'derived_from'")
    any_derived = ids.crossJoin(F.broadcast(edges.where("edge_type = 'derived_from'").limit(1).select("src")))
    context = _joined([
        _line(head, 0, said), _line(every, 1, told, F.col("silo")),
        _line(ids, 2, F.lit("\nTable Structural Features:")), _line(of, 3, F.col("line")),
        _line(ids, 4, F.lit("\nFK Relationships (relevant tables):")), _line(touched.where("edge_type = 'fk_to'"), 5, F.col("arrow")),
        _line(any_derived, 6, F.lit("\nLineage Relationships (derived_from):")), _line(derived, 7, F.col("arrow")),
        _line(pair.select("id").distinct(), 8, F.lit("\nShortest Paths Between Mentioned Tables:")), _line(pair, 9, F.concat(ends, way), place),
    ])
    named = hit.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "seed"))), lambda x: x["seed"]).alias("mentioned"))
    tables = relevant.groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("relevant"))
    none = F.array().cast("array<string>")
    return context.join(named, "id", "left").join(tables, "id").select("id", F.coalesce("mentioned", none).alias("mentioned"), "relevant", "context")


def consumed(text: Column, names: list[str]) -> Column:
    """Names contained in the text, case ignored, the longest first; one place of each is used up."""
    ordered = F.array(*[F.lit(n) for n in sorted(names, key=len, reverse=True)])
    start = F.struct(F.lower(text).alias("rest"), F.array().cast("array<string>").alias("found"))
    at = lambda acc, n: F.call_function("locate", F.lower(n), acc["rest"])
    return F.aggregate(
        ordered, start,
        lambda acc, n: F.when(
            at(acc, n) > 0,
            F.struct(F.overlay(acc["rest"], F.lit("___"), at(acc, n), F.char_length(n)).alias("rest"), F.concat(acc["found"], F.array(n)).alias("found")),
        ).otherwise(acc),
        lambda acc: acc["found"],
    )


def lineage_chains(row_edges: DataFrame) -> DataFrame:
    """(table, chain): a table's source tables, and a line for each source that has some itself."""
    pairs = row_edges.select(F.col("dst_table").alias("table"), F.col("src_table").alias("source")).distinct()
    direct = pairs.groupBy("table").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("listed"))
    own = direct.select("table", F.lit("").alias("source"), _say("  Sources → ", F.col("table"), ": ", F.col("listed")).alias("line"))
    far = pairs.join(direct.withColumnRenamed("table", "source"), "source").select("table", "source", _say("    Sources → ", F.col("source"), ": ", F.col("listed")).alias("line"))
    return X.lines(own.unionByName(far), ["table"], F.col("line"), ["source"], "chain")


def values(questions: DataFrame, dim: DataFrame, row_edges: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, mentioned, context) for questions (id, text): silos, lineage chains, value samples and the lineage of a row.

    dim is the catalogue in order (place, name, silo), row_edges the row lineage, samples (table, n_rows, rows) each table's
    size and first rows as texts. A question that names no table gets the chains of all marts. A question that holds
    row_N gets that row's sources in its longest mentioned table, the first ten of each source table, an ellipsis after.
    """
    # The catalogue is a short list of names, not rows.
    known = dim.orderBy("place").select("name", "silo").collect()
    silos = list(dict.fromkeys(r["silo"] for r in known))
    head = [f"SCHEMA: {len(known)} tables across {len(silos)} silos ({', '.join(silos)})", "Layers: raw → staging → core (dim/fact) → mart", "", "SILOS:"]
    head += [f"  {s}: {', '.join(r['name'] for r in known if r['silo'] == s)}" for s in silos]
    asked = questions.select("id", "text", consumed(F.col("text"), [r["name"] for r in known]).alias("mentioned"))
    some, none = asked.where(F.size("mentioned") > 0), asked.where(F.size("mentioned") == 0)
    each = some.select("id", F.posexplode("mentioned").alias("at", "table"))
    marts = dim.where(F.col("name").startswith("mart_")).select(F.col("place").alias("at"), F.col("name").alias("table"))
    chains = lineage_chains(row_edges)
    sample = each.join(samples, "table").join(F.broadcast(dim.select(F.col("name").alias("table"), "silo")), "table").where(F.size("rows") > 0)
    shown = _say("  ", F.col("table"), " (", F.col("n_rows").cast("string"), " rows, silo=", F.col("silo"), "):\n", F.array_join(F.transform("rows", lambda r: F.concat(F.lit("    "), r)), "\n"))
    row = some.select("id", F.get("mentioned", 0).alias("dst_table"), F.regexp_extract("text", r"row_(\d+)", 1).try_cast("bigint").alias("dst_row")).where("dst_row IS NOT NULL")
    lists = row.join(row_edges, ["dst_table", "dst_row"]).groupBy("id", "dst_table", "dst_row", "src_table").agg(F.sort_array(F.collect_list("src_row")).alias("rows"))
    more = F.when(F.size("rows") > 10, "...").otherwise("")
    source = _say("  ← ", F.col("src_table"), ": rows [", F.array_join(F.slice("rows", 1, 10).cast("array<string>"), ", "), "]", more)
    title = lists.select("id", "dst_table", "dst_row").distinct()
    context = _joined([
        _line(asked, 0, F.lit("\n".join(head))),
        _line(some, 1, F.lit("\nLINEAGE CHAINS:")), _line(none, 1, F.lit("\nLINEAGE OVERVIEW (all mart tables):")),
        _line(each.join(chains, "table"), 2, F.col("chain"), F.col("at")), _line(none.select("id").crossJoin(F.broadcast(marts)).join(chains, "table"), 2, F.col("chain"), F.col("at")),
        _line(some, 3, F.lit("\nVALUE SAMPLES:")), _line(sample, 4, shown, F.col("at")),
        _line(title, 5, _say("\nROW LINEAGE for ", F.col("dst_table"), " row_", F.col("dst_row").cast("string"), ":")), _line(lists, 6, source),
    ])
    return asked.select("id", "mentioned").join(context, "id")
