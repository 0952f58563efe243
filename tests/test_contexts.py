"""Contexts of questions against plain versions of the same rules, and the cases that a smaller job leaves out."""

from collections import deque

from pyspark.sql import functions as F

from topolake.operators import contexts as C
from topolake.plans import text as queries
from topolake.sources.graphs import graphs, published


def _graph(spark, dataset):
    nodes, edges = (t.where(F.col("dataset") == dataset) for t in published(spark))
    names = [n for d, _, n in sorted(graphs()[0], key=lambda r: r[1]) if d == dataset]
    return nodes, edges, names, [(a, b, k) for d, a, b, k in graphs()[1] if d == dataset]


def _distances(start, beside):
    far, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for x in beside[at]:
            if x not in far:
                far[x] = far[at] + 1
                queue.append(x)
    return far


def test_chunks_are_the_nearest_of_each_question(spark):
    nodes, edges, names, arrows = _graph(spark, "tpc_di")
    rows = C.chunk_texts(nodes, edges).withColumn("vec", queries._words_vector("text")).localCheckpoint()
    asked = spark.createDataFrame([(1, "DimTrade and DimBroker"), (2, "TaxRate derived from SRC TaxRate")], "id int, text string").withColumn("vec", queries._words_vector("text"))
    got = {r["id"]: r["context"] for r in C.retrieved(asked, rows, edges, 4).collect()}
    held = [(r["name"], r["text"], r["vec"]) for r in rows.collect()]
    lineage = sorted({f"  {a} --DERIVED_FROM--> {b}" for a, b, k in arrows if k == "derived_from"})
    for r in asked.collect():
        cosine = lambda v: sum(x * y for x, y in zip(v, r["vec"], strict=True)) / sum(x * x for x in v) ** 0.5 / sum(x * x for x in r["vec"]) ** 0.5  # noqa: B023, E731
        near = sorted(held, key=lambda c: (-round(cosine(c[2]), 6), c[0]))[:4]
        assert got[r["id"]] == "\n".join([f"DATABASE SCHEMA (showing 4 most relevant tables out of {len(names)} total)", *["\n" + c[1] for c in near], "\nALL LINEAGE RELATIONSHIPS (global):", *lineage])
    assert got[1] != got[2]


def test_surroundings_are_whole(spark):
    nodes, edges, names, arrows = _graph(spark, "tpc_di")
    beside = {n: {b for a, b, _ in arrows if a == n} | {a for a, b, _ in arrows if b == n} for n in names}
    texts = {1: "Is DimTrade fed by SRC.HR or Industry?", 2: "What is near industry?", 3: "Nothing here"}
    asked = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {r["id"]: r for r in C.surroundings(asked, nodes, edges, hops=1).collect()}
    assert sorted(got) == [1, 2, 3]
    for i, text in texts.items():
        hit = [n for n in names if n.lower() in text.lower()]
        near = {x for n in hit for x, d in _distances(n, beside).items() if d <= 1} if hit else set(names)
        assert got[i]["mentioned"] == hit and got[i]["relevant"] == sorted(near)
        said = got[i]["context"].split("\n")
        for kind, word in (("fk_to", "FK"), ("derived_from", "DERIVED_FROM")):
            assert [x for x in said if f"--{word}-->" in x] == sorted({f"  {a} --{word}--> {b}" for a, b, k in arrows if k == kind and (a in near or b in near)})
        parts = {tuple(sorted(_distances(n, beside))) for n in names}
        assert sorted(x.split(": ")[1] for x in said if x.startswith("  Component ")) == sorted(", ".join(p) for p in parts)
        assert [x.split(":")[0].strip() for x in said if "pagerank=" in x] == sorted(near)
        pairs = [(a, b) for k, a in enumerate(hit) for b in hit[k + 1 :]]
        paths = [x for x in said if " → " in x]
        assert len(paths) == len(pairs)
        for (a, b), x in zip(pairs, paths, strict=True):
            far = _distances(a, beside).get(b)
            assert x.startswith(f"  {a} → {b}: ") and x.endswith("no path exists" if far is None else f"({far} hops)")
    assert "Shortest Paths" in got[1]["context"] and "Shortest Paths" not in got[2]["context"]


def test_values_hold_samples_and_row_lineage(spark):
    dim = spark.createDataFrame([(0, "raw_a", "s1"), (1, "stg_a", "s1"), (2, "mart_a", "s2"), (3, "mart_a_b", "s2")], "place int, name string, silo string")
    rows = [("raw_a", k, "stg_a", 0) for k in range(12)] + [("stg_a", 0, "mart_a", 0), ("stg_a", 0, "mart_a_b", 1)]
    edges = spark.createDataFrame(rows, "src_table string, src_row long, dst_table string, dst_row long")
    samples = spark.createDataFrame([("stg_a", 7, ["x", "y"]), ("mart_a_b", 2, ["z"]), ("raw_a", 9, [])], "table string, n_rows long, rows array<string>")
    asked = spark.createDataFrame([(1, "row_0 of STG_A?"), (2, "mart_a_b row_1"), (3, "All silos?"), (4, "raw_a and stg_a, row_99")], "id int, text string")
    got = {r["id"]: (r["mentioned"], r["context"]) for r in C.values(asked, dim, edges, samples).collect()}
    head = "SCHEMA: 4 tables across 2 silos (s1, s2)\nLayers: raw → staging → core (dim/fact) → mart\n\nSILOS:\n  s1: raw_a, stg_a\n  s2: mart_a, mart_a_b\n\n"
    assert got[1] == (["stg_a"], head + "LINEAGE CHAINS:\n  Sources → stg_a: raw_a\n\nVALUE SAMPLES:\n  stg_a (7 rows, silo=s1):\n    x\n    y\n\nROW LINEAGE for stg_a row_0:\n  ← raw_a: rows [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]...")
    assert got[2] == (["mart_a_b"], head + "LINEAGE CHAINS:\n  Sources → mart_a_b: stg_a\n    Sources → stg_a: raw_a\n\nVALUE SAMPLES:\n  mart_a_b (2 rows, silo=s2):\n    z\n\nROW LINEAGE for mart_a_b row_1:\n  ← stg_a: rows [0]")
    assert got[3] == ([], head + "LINEAGE OVERVIEW (all mart tables):\n  Sources → mart_a: stg_a\n    Sources → stg_a: raw_a\n  Sources → mart_a_b: stg_a\n    Sources → stg_a: raw_a")
    assert got[4] == (["raw_a", "stg_a"], head + "LINEAGE CHAINS:\n  Sources → stg_a: raw_a\n\nVALUE SAMPLES:\n  stg_a (7 rows, silo=s1):\n    x\n    y")


def test_registered_contexts_answer_every_question(spark, sf_dir):
    for name, n in (("t5_question_context", 5), ("t6_question_context", 5), ("t7_question_context", 3)):
        found = queries.Q[name](spark, sf_dir).collect()
        assert sorted(r["id"] for r in found) == list(range(1, n + 1)) and all(r["context"] for r in found)
