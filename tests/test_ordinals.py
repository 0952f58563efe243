"""Places in a total order and rows' places in files, over partitions and files of unlike sizes."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from topolake.operators.ordinals import dense_ranked, numbered
from topolake.sources import files


def rows(n, seed=1):
    r = random.Random(seed)
    return [(r.choice([None, "a", "b", "a"]), None if r.random() < 0.05 else r.randint(0, 40), i) for i in range(n)]


def key(*values):
    return tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in values)


@pytest.mark.parametrize("n", [0, 1, 700])
def test_places_follow_the_order(spark, n):
    data = rows(n)
    df = spark.createDataFrame(data, "g string, x int, `i.d` int").repartition(7)
    found = numbered(df, ["x", F.desc("`i.d`")])
    assert found.columns == ["g", "x", "i.d", "place"]
    want = sorted(data, key=lambda r: (key(r[1]), -r[2]))
    assert [tuple(r)[:3] for r in sorted(found.collect(), key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in found.collect()) == list(range(n))


def test_places_within_groups_that_span_ranges(spark):
    data = [("hot", i % 50, i) for i in range(3000)] + rows(200)
    df = spark.createDataFrame(data, "g string, x int, i int").repartition(5)
    found = sorted((tuple(r) for r in numbered(df, ["x", "i"], ["g"]).collect()), key=lambda r: (key(r[0]), r[3]))
    want = []
    for g in {r[0] for r in data}:
        want += [(*r, k) for k, r in enumerate(sorted((r for r in data if r[0] == g), key=lambda r: (key(r[1]), r[2])))]
    assert found == sorted(want, key=lambda r: (key(r[0]), r[3]))


def test_dense_ranks_cross_ranges(spark):
    data = rows(600, 3)
    found = dense_ranked(spark.createDataFrame(data, "g string, x int, i int").repartition(6), ["g", "x"]).collect()
    order = sorted({(r[0], r[1]) for r in data}, key=lambda k: ((k[0] is not None, k[0] or ""), (k[1] is not None, k[1] or 0)))
    assert len(found) == 600 and all(order[r["rank"] - 1] == (r["g"], r["x"]) for r in found)


SIZES = (10, 4990, 3, 0, 700, 1, 60, 2500, 8, 15, 9, 40, 1200, 5, 5, 5, 33, 77, 2, 640)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_row_ids_over_many_files(spark, tmp_path, kind):
    want, at = [], 0
    for i, n in enumerate(SIZES):
        values = list(range(at, at + n))
        at += n
        want += values
        if kind == "csv":
            (tmp_path / f"f{i:02}.csv").write_text("v\n" + "".join(f"{v}\n" for v in values))
        else:
            pq.write_table(pa.table({"v": pa.array(values, pa.int64())}), tmp_path / f"f{i:02}.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        df = files.read_csv(spark, str(tmp_path), "v bigint") if kind == "csv" else spark.read.parquet(str(tmp_path))
        found = files.with_row_id(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["row_id"], r["v"]) for r in found) == list(enumerate(want))
