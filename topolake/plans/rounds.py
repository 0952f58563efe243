"""Queries of the kernel with no graph counted as small: every round is a join, as on graphs of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topolake.operators import small

from . import features, provenance, topology

Q: dict = {}
SQL: dict[str, str] = {}


def _by_rounds(f: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with small.never():
            return f(spark, sf_dir)

    return run


for _module, _names in (
    (topology, ("g3_transitive_lineage", "g9_components", "g21_join_path", "g22_shortest_any_edge", "g29_layered_search")),
    (features, ("f3_betweenness",)), (provenance, ("v3_full_provenance", "v5_cascade_count_layered")),
):
    for _name in _names:
        Q[f"{_name}_rounds"], SQL[f"{_name}_rounds"] = _by_rounds(_module.Q[_name]), _module.SQL[_name]
