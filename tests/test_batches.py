"""Batches that are killed at each step and started again."""

import pytest

from topolake.sources import batches as B
from topolake.sources.batches import Target


@pytest.fixture
def rows(spark):
    return spark.range(40).selectExpr("nullif(id, 39) AS id", "id * id AS x")


def kept(target):
    return sorted(str(tuple(r)) for r in target.read("id bigint, x bigint").drop("batch_").collect())


@pytest.mark.parametrize("step", ["before write", "after write", "after draft", "after commit"])
def test_killed_runs_lose_and_repeat_nothing(spark, rows, tmp_path, monkeypatch, step):
    target, calls = Target(spark, f"{tmp_path}/t"), []
    write, commit = Target.write, Target.commit

    def stop():
        calls.append(step)
        if len(calls) == 2:
            raise KeyboardInterrupt

    def write_(self, df, batch):
        if step == "before write":
            stop()
        write(self, df, batch)

    def commit_(self, batch, note=None):
        if step == "after write":
            stop()
        if step == "after draft":
            self._fs.create(self._path(f"log/.{batch}.draft"), True).close()
            stop()
        commit(self, batch, note)
        if step == "after commit":
            stop()

    monkeypatch.setattr(Target, "write", write_)
    monkeypatch.setattr(Target, "commit", commit_)
    with pytest.raises(KeyboardInterrupt):
        B.run(target, rows, lambda df: df, "id", 10)
    assert len(target.committed()) == (2 if step == "after commit" else 1)
    assert len(kept(target)) < 40
    monkeypatch.undo()
    assert B.run(target, rows, lambda df: df, "id", 10) == 4 - len(calls) + (step != "after commit")
    assert B.run(target, rows, lambda df: df, "id", 10) == 0
    assert kept(target) == sorted(str(tuple(r)) for r in rows.collect())


def test_a_batch_is_added_once_and_read_by_name(spark, rows, tmp_path):
    target = Target(spark, f"{tmp_path}/t")
    assert kept(target) == []
    assert target.add(rows, "a.1") and not target.add(rows, "a.1")
    target.write(rows, "b")  # never committed
    assert target.add(rows.limit(0), "empty")
    assert {r["batch_"] for r in target.read("id bigint, x bigint").collect()} == {"a.1"} and len(kept(target)) == 40
    for bad in ("", ".a", "a/b", "../a"):
        with pytest.raises(ValueError):
            target.add(rows, bad)


def test_stream_repeats_nothing(spark, tmp_path):
    source, target = f"{tmp_path}/in", Target(spark, f"{tmp_path}/out")
    for _ in range(2):
        spark.sql("SELECT id % 5 AS id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS at FROM range(10)").coalesce(1).write.mode("append").parquet(source)
        B.append_stream(spark.readStream.schema("id bigint, at timestamp").parquet(source), target, key="id", time="at")
    assert sorted(r["id"] for r in target.read("id bigint, at timestamp").collect()) == [0, 1, 2, 3, 4]
