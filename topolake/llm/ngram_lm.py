"""Bigram language model by deleted interpolation, counted and looked up through packed exchanges."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CAPITALS, SMALL, materialize, tidy
from .parts import parts_of

GROUP_BYTES, BUCKET_BYTES = 6_000_000, 24_000_000
BUCKETS, LEVELS, LOG_LOW, LOG_STEP = 16, 4096, -15.0, 0.01
EM_ROUNDS = 200

_LOWER = bytes.maketrans(CAPITALS.encode(), SMALL.encode())
_END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))  # no word holds white space


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


class Group:
    """The tokens of some texts with local numbers, in an order that both passes over the texts agree on.

    words: hashes of distinct tokens, ascending by (bucket, hash); tokens and contexts: numbers of each token and of
    the one before it (the end token before a text's first); pairs: distinct (context, token), ascending, so that a
    bucket's words and the pairs of its contexts are contiguous.
    """

    def __init__(self, texts: list[str | None], buckets: int) -> None:
        seen: dict[bytes, int] = defaultdict(count(1).__next__)
        numbers, ends, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for of, parts, cuts in parts_of([(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]):
            numbers.append(np.fromiter(map(seen.__getitem__, parts), np.int64, len(parts))[of])
            ends.append(n + cuts)
            n += len(of)
        ends = np.concatenate(ends) + np.arange(len(texts))
        raw = np.zeros(n + len(texts), np.int64)
        word = np.ones(len(raw), bool)
        word[ends] = False
        raw[word] = np.concatenate(numbers)
        hashes = np.empty(len(seen) + 1, np.uint64)
        hashes[0] = _END
        hashes[1:] = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
        bucket = (hashes >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((hashes, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words, self.bucket = hashes[order], bucket[order].astype(np.int64)
        self.tokens = place[raw]
        self.contexts = np.empty_like(self.tokens)
        self.contexts[1:] = self.tokens[:-1]
        self.contexts[:1] = place[0]
        self.sizes = np.diff(ends, prepend=-1)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pairs, self.pair_of = np.unique(self.contexts * len(order) + self.tokens, return_inverse=True)
        self.word_cuts = np.searchsorted(self.bucket, np.arange(buckets + 1))
        self.pair_cuts = np.searchsorted(self.pairs, self.word_cuts * len(order))


def _request(g: int, group: Group, train: np.ndarray, buckets: int):
    """A blob a bucket: word hashes and training counts, then for its contexts the followers and theirs."""
    n = len(group.words)
    mine = np.repeat(train, group.sizes)
    uni = np.bincount(group.tokens[mine], minlength=n).astype(np.uint32)
    two = np.bincount(group.pair_of[mine], minlength=len(group.pairs)).astype(np.uint32)
    context, follower = group.pairs // n, group.words[group.pairs % n]
    followers = np.bincount(context, minlength=n).astype(np.uint32)
    rows = []
    for b in range(buckets):
        w, p = slice(*group.word_cuts[b : b + 2]), slice(*group.pair_cuts[b : b + 2])
        if group.word_cuts[b + 1] > group.word_cuts[b]:
            head = np.array([w.stop - w.start, p.stop - p.start], np.int64)
            low, high = follower[p].astype(np.uint32), (follower[p] >> np.uint64(32)).astype(np.uint16)
            rows.append((b, g, _squeeze(head, group.words[w], uni[w], followers[w], low, two[p], high)))
    return rows


def _sum_bucket(blobs: list[tuple[int, bytes]]):
    """Totals of a bucket in each request's own order, and the bucket's training tokens and distinct ones."""
    words, uni, context, follow, two, marks = [], [], [], [], [], []
    for _, blob in blobs:
        raw = zstandard.decompress(blob)
        nw, np_ = np.frombuffer(raw, np.int64, 2)
        at, took = 16, []
        for kind, n in ((np.uint64, nw), (np.uint32, nw), (np.uint32, nw), (np.uint32, np_), (np.uint32, np_), (np.uint16, np_)):
            took.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        words.append(took[0])
        uni.append(took[1])
        context.append(np.repeat(np.arange(nw), took[2]) + sum(len(x) for x in words[:-1]))
        follow.append(took[3].astype(np.int64) | took[5].astype(np.int64) << 32)
        two.append(took[4])
        marks.append((nw, np_))
    distinct, at_word = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at_word, np.concatenate(uni), len(distinct)).astype(np.int64)
    # Pairs in order of (context, follower), by two sorts of one number each.
    context, follow = at_word[np.concatenate(context)], np.concatenate(follow)
    by = np.argsort(follow, kind="stable")
    by = by[np.argsort(context[by], kind="stable")]
    new = np.ones(len(by), bool)
    new[1:] = (context[by][1:] != context[by][:-1]) | (follow[by][1:] != follow[by][:-1])
    at_pair = np.empty(len(by), np.int64)
    at_pair[by] = np.cumsum(new) - 1
    pair_total = np.bincount(at_pair, np.concatenate(two)).astype(np.int64)
    w = p = 0
    for (g, _), (nw, np_) in zip(blobs, marks, strict=True):
        yield g, _squeeze(total[at_word[w : w + nw]].astype(np.uint64), pair_total[at_pair[p : p + np_]].astype(np.uint64))
        w, p = w + nw, p + np_
    yield -1, _squeeze(np.array([total.sum(), np.count_nonzero(total)], np.int64))


def _levels(p2: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """log(p2 / p1) as one of LEVELS steps of LOG_STEP; 0 where p2 is 0."""
    with np.errstate(divide="ignore"):
        log = np.log(p2) - np.log(p1)
    return np.where(p2 > 0, np.clip(np.round((log - LOG_LOW) / LOG_STEP), 1, LEVELS - 1), 0).astype(np.int64)


def _frequency(c: np.ndarray) -> np.ndarray:
    """Buckets of contexts by frequency: 0, then doubling widths."""
    return np.minimum(np.floor(np.log2(np.maximum(c, 0) + 1)), BUCKETS - 1).astype(np.int64)


RATIOS = np.concatenate([[0.0], np.exp(LOG_LOW + LOG_STEP * np.arange(1, LEVELS))])


def mixture(held_out: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights of the bigram estimate by context bucket: expectation-maximisation on counts of likelihood ratios."""
    out = np.zeros(BUCKETS)
    for b in range(BUCKETS):
        h, n = held_out[b], held_out[b].sum()
        if n:
            lam = 0.5
            for _ in range(rounds):
                lam = float((h * (lam * RATIOS / (lam * RATIOS + 1 - lam))).sum() / n)
                lam = min(max(lam, 1e-9), 1 - 1e-9)
            out[b] = lam
    return out


def score_texts(
    documents: DataFrame, train: str, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for documents with a boolean column `train`.

    Model: P(w | v) = l p2 + (1 - l) p1, p2 = c(v, w) / c(v), p1 = (c(w) + 0.5) / (N + 0.5 (V + 1)), l by the frequency
    bucket of v. l is learnt by EM on deleted counts: every training token once with itself taken out of all counts.

    Counting: documents are dealt by hash into groups of about group_bytes of text. A group sends each bucket of words
    one blob, its distinct words and the distinct pairs that start with them, with training counts; a bucket, of about
    bucket_bytes of text, adds them up and answers each group in the group's own order, so hashes travel once and no
    row is made for a token. Frequent words are one entry a group, however frequent. Two more passes make the same
    numbers from the texts again: one counts the deleted training tokens by context bucket and log of p2 / p1, to one in
    a hundred, which is all that the mixture is learnt from; the other makes the scores, from the counts themselves.
    Followers are told apart by 48 bits beneath a word's 64.

    Defined cases: a null or empty text is its end token alone; very long texts are whole, in one group; repeated rows
    each count; without training rows N and V are 0 and every token has probability 1; an empty table gives no rows.
    """
    spark = documents.sparkSession
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, buckets = max(1, -(-size // group_bytes)), max(1, -(-size // bucket_bytes))
    id_type = documents.schema["doc_id"].dataType
    rows = documents.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"),
        F.col("doc_id").cast("string").alias("key"), F.coalesce(train, F.lit(False)).alias("train"), "text",
    )
    by_group = ["key", "train", "text"]

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by_group, ignore_index=True)
        group = Group(list(pdf["text"]), buckets)
        return pd.DataFrame(_request(int(pdf["g"].iloc[0]), group, pdf["train"].to_numpy(bool), buckets), columns=["bucket", "g", "blob"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        out = _sum_bucket(list(zip(pdf["g"], pdf["blob"], strict=True)))
        return pd.DataFrame([(g, b, blob) for g, blob in out], columns=["g", "bucket", "blob"])

    asked = rows.groupBy("g").applyInPandas(ask, "bucket int, g int, blob binary")
    totals = materialize(asked.groupBy("bucket").applyInPandas(add, "g int, bucket int, blob binary"), "totals")
    tidy(spark)

    @F.pandas_udf("n long, v long")
    def counted(blobs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([np.frombuffer(zstandard.decompress(x), np.int64) for x in blobs], columns=["n", "v"])

    n, v = totals.where("g < 0").select(counted(F.col("blob")).alias("s")).agg(F.coalesce(F.sum("s.n"), F.lit(0)), F.coalesce(F.sum("s.v"), F.lit(0))).first()

    def counts(pdf: pd.DataFrame, answers: pd.DataFrame) -> tuple[pd.DataFrame, Group, np.ndarray, np.ndarray, np.ndarray]:
        """A group's documents and, for every token, the counts of it, of its context and of both."""
        pdf = pdf.sort_values(by_group, ignore_index=True)
        group = Group(list(pdf["text"]), buckets)
        uni, two = np.zeros(len(group.words)), np.zeros(len(group.pairs))
        for b, blob in zip(answers["bucket"], answers["blob"], strict=True):
            w, p = group.word_cuts[b : b + 2], group.pair_cuts[b : b + 2]
            got = np.frombuffer(zstandard.decompress(blob), np.uint64)
            uni[w[0] : w[1]], two[p[0] : p[1]] = got[: w[1] - w[0]], got[w[1] - w[0] :]
        return pdf, group, uni[group.tokens], uni[group.contexts], two[group.pair_of]

    all_ = n + 0.5 * (v + 1)

    def learn(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pdf, group, c, c1, c2 = counts(pdf, answers)
        # Deleted counts: a training token's own occurrence is taken out.
        mine = np.repeat(pdf["train"].to_numpy(bool), group.sizes) & (c1 > 1)
        c, c1, c2 = c[mine] - 1, c1[mine] - 1, c2[mine] - 1
        cell = _frequency(c1) * LEVELS + _levels(c2 / c1, (c + 0.5) / (all_ - 1))
        hist = np.bincount(cell, minlength=BUCKETS * LEVELS).astype(np.int64)
        return pd.DataFrame({"part": [int(pdf["g"].iloc[0]) % 64], "blob": [_squeeze(hist)]})

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in pdf["blob"])
        return pd.DataFrame({"blob": [_squeeze(total)]})

    answers = totals.where("g >= 0")
    learnt = rows.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(learn, "part int, blob binary")
    parts = learnt.groupBy("part").applyInPandas(add_up, "blob binary").collect()
    tidy(spark)
    held = sum((np.frombuffer(zstandard.decompress(r["blob"]), np.int64) for r in parts), np.zeros(BUCKETS * LEVELS, np.int64))
    lam = mixture(held.reshape(BUCKETS, LEVELS))

    def score(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pdf, group, c, c1, c2 = counts(pdf, answers)
        p1 = (c + 0.5) / all_ if n else np.ones(len(c))
        p2 = np.divide(c2, c1, out=np.zeros(len(c1)), where=c1 > 0)
        share = np.where(c1 > 0, lam[_frequency(c1)], 0.0)
        known, base = np.add.reduceat((c > 0).astype(np.int64), group.starts), np.add.reduceat(np.log10(p1), group.starts)
        found = np.add.reduceat(np.log10(share * p2 + (1 - share) * p1), group.starts)
        return pd.DataFrame({"key": pdf["key"], "train": pdf["train"], "n_tokens": group.sizes, "n_known": known, "base_score": base, "score": found})

    seen = rows.groupBy("g").cogroup(answers.groupBy("g")).applyInPandas(
        score, "key string, train boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return seen.select(F.col("key").cast(id_type).alias("doc_id"), "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
