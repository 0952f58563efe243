"""Names in texts against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from topolake.operators import names as N


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abA .é😀") for _ in range(n))
    texts = [(i, word(rng.randint(0, 60))) for i in range(120)] + [(None, "abab Ab"), (7, "ab ba"), (500, None), (501, ""), (502, "ab " * 5000)]
    names = sorted({word(rng.randint(1, 7)) for _ in range(150)}) + ["zzzz", "", None, "ab"]
    return texts, names, spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in names], "name string")


def test_contained_names_are_all_found(mixed):
    texts, names, t, n = mixed
    want = sorted((str(i), m) for i, x in texts if x for m in {m for m in names if m} if m.lower() in x.lower())
    assert sorted((str(r["id"]), r["name"]) for r in N.contained(t, n).collect()) == want


def plain_places(text, names, words, fold=str.lower):
    """Each length from the longest, each place from the left, marks a used character."""
    low, used, out = fold(text), [False] * len(text), []
    for size in sorted({len(n) for n in names}, reverse=True):
        for at in range(len(low) - size + 1):
            here = sorted(n for n in names if len(n) == size and fold(n) == low[at : at + size])
            free = not any(used[at : at + size])
            whole = not words or not (at and low[at - 1] in N.BEFORE) and not (at + size < len(low) and low[at + size] in N.AFTER)
            if here and free and whole:
                used[at : at + size] = [True] * size
                out.append((at, at + size, here[0]))
    return out


@pytest.mark.parametrize("words", [False, True])
def test_places_equal_the_plain_search(mixed, words):
    texts, names, t, n = mixed
    known = {m for m in names if m}
    want = sorted((str(i), *p) for i, x in texts if x and i != 502 for p in plain_places(x, known, words))
    got = N.places(t, n, words=words).where("id IS NULL OR id <> 502").collect()
    assert sorted((str(r["id"]), r["start"], r["end"], r["name"]) for r in got) == want


def test_replaced_keeps_rows_and_other_words(mixed, spark):
    texts, names, t, n = mixed
    known = {m: f"<{i}>" for i, m in enumerate(sorted({m for m in names if m}))}
    mapping = spark.createDataFrame([*known.items(), ("ab", "~later")], "original string, obfuscated string")

    def plain(x):
        if not x:
            return x
        out, done = "", 0
        for start, end, name in sorted(plain_places(x, set(known), True, fold=str)):
            out, done = out + x[done:start] + known[name], end
        return out + x[done:]

    got = sorted((str(r["id"]), str(r["text"])) for r in N.replaced(t, mapping).collect())
    assert got == sorted((str(i), str(plain(x))) for i, x in texts)


def test_no_names_and_no_texts(mixed):
    _, _, t, n = mixed
    assert N.contained(t, n.limit(0)).count() == 0
    assert N.contained(t.limit(0), n).count() == 0
    assert N.places(t.limit(0), n).count() == 0


def test_plan_has_no_search_of_every_name_in_every_text(mixed):
    plan = N.contained(mixed[2], mixed[3])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "contains(" not in "".join(line for line in plan.splitlines() if "Join" in line)


def test_a_task_holds_a_bounded_number_of_runs(spark, monkeypatch):
    # Every run of these texts is let through: a batch's runs go on in chunks, and counts of chunks add up.
    monkeypatch.setattr(N, "CHUNK_RUNS", 50)
    texts = spark.createDataFrame([(i, f"text number {i % 7} of many words {i}") for i in range(40)] + [(None, "text number 3")], "id bigint, low string").coalesce(1)
    runs = spark.createDataFrame([(int(r),) for i in range(40) for r in N.packed(f"text number {i % 7} of many words {i}", {8}).view("int64")], "run bigint")
    found = N._text_runs(texts, runs, {8})
    sizes = found.groupBy(F.spark_partition_id()).count().count()
    assert sizes == 1 and found.where("id IS NULL").count() == 6
    counts = N._text_runs(texts, runs, {8}, counted=True)
    assert counts.count() > counts.select("run").distinct().count()  # several chunks of one batch
    want = {(r["run"], r["count"]) for r in found.groupBy("run").count().collect()}
    assert {(r["run"], r["n"]) for r in counts.groupBy("run").agg(F.sum("n").alias("n")).collect()} == want
