"""Compares toxicity's constants inside the training folds alone: python tests/llm/choose_toxicity.py SF_DIR [FOLD ...].

The held-out fifth (crc32 of the id modulo 5 is 0) is never read. Of the other four, each named fold is scored by a fit on
the rest. Prints, for each pair of constants, the least share of toxic texts caught and the largest of clean ones marked.
"""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

GRID = ((2.0, 5), (1.5, 5), (2.5, 5), (2.0, 3), (2.0, 8))


def main(sf_dir: str, folds: list[int]) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from topolake.llm import toxicity
    from topolake.llm.common import fold, table

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & ~fold("doc_id", 5, 0))
    docs = table(spark, sf_dir, "documents").join(labels.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    for odds, support in GRID:
        toxicity.LEAST_ODDS, toxicity.SUPPORT = odds, support
        for k in folds:
            weights, logistic = toxicity.fit(toxicity.labelled(docs, labels.where(~fold("doc_id", 5, k))))
            rated = toxicity.score(docs.where(fold("doc_id", 5, k)), weights, logistic).join(labels, "doc_id")
            shares = {r["toxic"]: (r["share"], r["n"]) for r in rated.groupBy("toxic").agg(F.avg((F.col("toxicity") >= 0.5).cast("int")).alias("share"), F.count("*").alias("n")).collect()}
            print(odds, support, "fold", k, "toxic marked %.3f of %d, clean marked %.4f of %d" % (*shares[1], *shares[0]), flush=True)


if __name__ == "__main__":
    main(sys.argv[1], [int(x) for x in sys.argv[2:]] or [1, 2, 3, 4])
