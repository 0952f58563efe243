"""Streams whose results grow with their events."""

from topolake.plans import streams
from topolake.streaming import events as E


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sessions_are_written_not_held_by_the_driver(spark, sf_dir, duck):
    got = streams.stream_sessions(spark, sf_dir)
    assert got.inputFiles() and _rows(got) == sorted(duck.execute(streams.SQL["stream_sessions"]).fetchall())


def test_a_stream_without_files_has_no_rows(spark, tmp_path):
    assert _rows(E.run_written(E.sessions(spark.readStream.schema("user_id bigint, ts timestamp").parquet(str(tmp_path))), "sessions")) == []
