"""Vector searches against brute force, and their defined cases."""

import numpy as np
import pytest

from topolake.llm import ann, topk

INF, NAN = float("inf"), float("nan")


@pytest.fixture(scope="session")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 16)).astype(np.float32))]
    same = rows[50][1]
    rows += [(1000 + k, same) for k in range(30)] + [(2000, None), (2050, []), (2100, [0.0] * 16), (2150, [NAN] * 16), (2200, [INF] + [0.0] * 15), (2250, [None] * 16), (2300, [1.0, 2.0]), (None, same), (0, rows[0][1])]
    return spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")


def _usable(df, zero_ok):
    out = []
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero_ok or any(v)):
            out.append((r["vec_id"], np.array(v, float)))
    return out


def test_exact_top_k_equals_brute_force(spark, vectors):
    rows = [(i, np.floor(256 * v)) for i, v in _usable(vectors, True)]
    want = {}
    for at, (q, v) in enumerate(rows):
        if q % 50 == 0:
            scored = sorted((-int(v @ x), i) for k, (i, x) in enumerate(rows) if k != at and len(x) == len(v))
            want[q] = [(i, -s) for s, i in scored[:5]]
    got = {}
    for r in sorted(topk.exact_top_k(vectors).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    # Id 0 stands twice; each of its rows has the answer, the other row in it.
    got[0] = got[0][::2]
    assert got == {q: w for q, w in want.items() if w}


def test_large_integers_stay_exact(spark):
    df = spark.createDataFrame([(0, [1e6, 1.0]), (1, [1e6, 2.0]), (2, [1e300, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in topk.exact_top_k(df).collect()}
    assert got == {1: (256 * 1_000_000) ** 2 + 256 * 512, 2: 2**63 - 1}


def test_small_tables_leave_no_query_short(spark):
    rng = np.random.default_rng(8)
    for dim in (2, 8, 64):
        rows = [(50 * i, v.tolist()) for i, v in enumerate(rng.normal(size=(6, dim)))] + [(1000 + i, rng.normal(size=dim + 1).tolist()) for i in range(3)]
        found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        got = {}
        for r in found.collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        same = {i for i, _ in rows if i < 1000}
        assert {q: s for q, s in got.items() if q < 1000} == {q: same - {q} for q in same}


def test_nearest_recall_and_scores(spark, vectors):
    rows = _usable(vectors, False)
    hits = total = 0
    got = {}
    for r in ann.nearest(vectors).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for q, v in rows:
        if q % 50 == 0 and len(v) == 16 and q != 0:
            cos = {i: v @ x / np.linalg.norm(v) / np.linalg.norm(x) for i, x in rows if i != q and len(x) == 16}
            best = {i for _, i in sorted((-round(c, 12), i) for i, c in cos.items())[:5]}
            assert all(abs(cos[i] - s) < 1e-12 for i, s in got[q].items())
            hits, total = hits + len(best & set(got[q])), total + 5
    assert hits / total >= 0.9


def test_many_shards_and_chunks(spark):
    """Clustered vectors over several shards and chunks: exact, and most ranges are skipped."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 3
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.05).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vecs = np.array([v for _, v in rows])
    whole = np.floor(256 * vecs)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    exact = near = 0
    top = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(df, shard_rows=150, chunk_rows=7).collect()}
    found = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, shard_rows=150, chunk_rows=7).collect()}
    for q in range(0, 1200, 50):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        exact += sum(top[q, k + 1] == (i, -s) for k, (s, i) in enumerate(best))
        near += sum((q, i) in found for i in [i for i in np.argsort(-(unit @ unit[q]), kind="stable") if i != q][:5])
    assert exact == 120 and near >= 108
    scored = [done for _, _, _, done in topk.ranked(whole, whole[::50], 6, np.full(24, -np.inf), 8)]
    assert max(scored) <= 0.25 * (1200 / 8)


def test_floors_never_stand_above_a_score():
    from topolake.llm.vector_blocks import floor_of

    scores = np.array([5, 2**53 + 1, -(2**60) - 1, 2**62 + 3], np.int64)
    assert all(int(f) <= int(s) for f, s in zip(floor_of(scores), scores, strict=True)) and floor_of(scores)[0] == 5


def test_empty_and_single(spark, vectors):
    assert ann.nearest(vectors.where("false")).count() == 0 and topk.exact_top_k(vectors.where("false")).count() == 0
    assert ann.nearest(vectors.where("vec_id = 100")).count() == 0


def test_copies_are_told_by_smaller_ids(spark, vectors):
    got = [r["vec_id"] for r in sorted(ann.nearest(vectors).where("query_id = 50").collect(), key=lambda r: r["rank"])]
    assert got == [1000, 1001, 1002, 1003, 1004]


def test_probes_come_in_order_of_success():
    steps = ann.probe_order(np.array([[0.1, 0.5]]), 3)[0].tolist()
    assert steps == [[0, 0], [-1, 0], [0, -1]]
