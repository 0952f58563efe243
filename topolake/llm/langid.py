"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS, BITS, SMOOTHING, TRAIN_DOCS, PIECES = (1, 2, 3), 15, 0.1, 20_000, 16


def grams(texts: list[str], bits: int = BITS, orders: tuple[int, ...] = ORDERS):
    """Blocks of (document numbers, starts, hashed n-grams by order): about a million characters each, texts whole.

    Characters are code points of the lower-cased text between two spaces; an n-gram that would leave its text gets
    the spare bucket 2**bits.
    """
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= 1_000_000):
            size += len(texts[end])
            end += 1
        padded = [f" {t.lower()} " for t in texts[at:end]]
        chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.array([len(t) for t in padded])
        starts = np.cumsum(sizes) - sizes
        left = np.repeat(starts + sizes, sizes) - np.arange(len(chars))
        hashed = []
        for n in orders:
            h = np.full(len(chars), n, np.uint64)
            for j in range(n):
                h[: len(h) - j] = (h[: len(h) - j] ^ chars[j:]) * np.uint64(0x9E3779B97F4A7C15)
            h = (h >> np.uint64(64 - bits)).astype(np.int64)
            h[left < n] = 1 << bits
            hashed.append(h)
        yield np.arange(at, end), starts, hashed
        at = end


def _counted(batches):
    """Partial n-gram counts of each language in compressed pieces, to be added up by (lang, piece)."""
    for pdf in batches:
        for lang, own in pdf.groupby("lang"):
            total = np.zeros((1 << BITS) + 1, np.int64)
            for _, _, hashed in grams(list(own["text"])):
                for h in hashed:
                    total += np.bincount(h, minlength=len(total))
            for piece, part in enumerate(np.split(total[:-1], PIECES)):
                yield pd.DataFrame({"lang": [lang], "piece": [piece], "docs": [len(own)], "counts": [zlib.compress(part.tobytes(), 1)]})


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in pdf["counts"])
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "piece": [pdf["piece"].iloc[0]], "docs": [pdf["docs"].sum()], "counts": [total.tobytes()]})


def train(labelled: DataFrame, max_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their (bucket, language) log-probabilities, the priors in the last row.

    Learns from whole texts of at most about `max_docs` rows, taken by a hash of id and text over all labelled rows;
    the model has 2**BITS rows whatever the table's size.
    """
    n = labelled.count()
    share = min(1.0, max_docs / max(n, 1))
    picked = labelled if share >= 1 else labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    partial = picked.select("lang", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_counted, "lang string, piece int, docs long, counts binary")
    sums = partial.groupBy("lang", "piece").applyInPandas(_added, "lang string, piece int, docs long, counts binary").toPandas()
    langs = sorted(sums["lang"].unique())
    model = np.zeros(((1 << BITS) + 1, len(langs)), np.float32)
    docs = np.array([sums[(sums["lang"] == x) & (sums["piece"] == 0)]["docs"].sum() for x in langs], float)
    for j, lang in enumerate(langs):
        own = sums[sums["lang"] == lang].sort_values("piece")
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in own["counts"]]) + SMOOTHING
        model[:-1, j] = np.log(counts / counts.sum())
    return langs, np.vstack([model, np.log(docs / docs.sum())[None].astype(np.float32)]) if langs else model


def identify(documents: DataFrame, train_rows: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """documents with lang_pred and score, the posterior of the predicted language; other columns stay.

    train_rows has doc_id, text and a non-null lang. The log-probability matrix is broadcast: 2**BITS rows by one
    column a language. Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text
    if nothing was learned; an empty table gives no rows; equal posteriors go to the first language in order.
    """
    langs, model = train(train_rows.where(F.col("lang").isNotNull()), max_docs)
    shared = documents.sparkSession.sparkContext.broadcast((langs, model))

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        names, logs = shared.value
        whole = [t if t is not None else "" for t in texts]
        pred, score = np.full(len(whole), "und", object), np.zeros(len(whole))
        known = [i for i, t in enumerate(whole) if names and any(map(str.isalpha, t))]
        for docs, starts, hashed in grams([whole[i] for i in known]):
            sums = np.zeros((len(docs), len(names))) + logs[-1].astype(float)
            for h in hashed:
                sums += np.add.reduceat(logs[h], starts, axis=0, dtype=np.float64)
            best = sums.argmax(1)
            own = np.exp(sums - sums.max(1, keepdims=True))
            rows = np.array([known[d] for d in docs])
            pred[rows] = np.array(names, object)[best]
            score[rows] = own[np.arange(len(docs)), best] / own.sum(1)
        return pd.DataFrame({"lang_pred": pred, "score": score})

    return documents.withColumn("guessed_", guess(F.col("text"))).select(
        *[F.col(f"`{c}`") for c in documents.columns if c not in ("lang_pred", "score")],
        F.col("guessed_.lang_pred").alias("lang_pred"), F.col("guessed_.score").alias("score"),
    )
