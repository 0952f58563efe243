"""Source divergence audit: terms counted in radix tries of bytes, merged by ranges of prefixes, compared in one traversal."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, drop, materialize
from .parts import parts_of

# What stands between terms, the scale and smoothing of shares, the documents a term needs, ranks of terms.
GAPS = bytes([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLDED = bytes.maketrans(GAPS + bytes(range(0x41, 0x5B)), b"\n" * len(GAPS) + bytes(range(0x61, 0x7B)))  # gaps as white space, A-Z as a-z
THOUSANDS, ADDED, LEAST_DOCS, TOP = 3, 2, 10, 10

LEAVES, RANGE, SAMPLE, EDGE, WIDE, TILE, CHUNK = 1_500_000, 400_000, 2_000, 64, 32, 256, 2048
_COLUMNS = ("sources", "shared", "sizes", "tails", "docs", "width", "source_no", "times")
_PACKED = "sources array<string>, shared array<int>, sizes array<int>, tails binary, docs array<long>, width array<int>, source_no array<int>, times array<long>"


def _shared(terms: list[bytes]) -> np.ndarray:
    """How many bytes each of the terms, in order, has in common with the one before."""
    if not terms:
        return np.zeros(0, np.int32)
    sizes = np.array([len(t) for t in terms])
    heads = np.array(terms, f"S{WIDE}") if sizes.max() <= WIDE else np.array([t[:WIDE] for t in terms], f"S{WIDE}")
    heads = heads.view(np.uint8).reshape(-1, WIDE)
    same = heads[1:] == heads[:-1]
    out = np.where(same.all(1), WIDE, same.argmin(1))
    out = np.minimum(out, np.minimum(sizes[1:], sizes[:-1]))
    for i in np.flatnonzero((out == WIDE) & (sizes[1:] > WIDE) & (sizes[:-1] > WIDE)).tolist():
        out[i] = _common(terms[i], terms[i + 1])
    return np.concatenate([[0], out]).astype(np.int32)


def _common(a: bytes, b: bytes) -> int:
    """By halves, as terms can be long."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


class Trie:
    """A radix trie of terms' bytes, laid out in preorder: each term is the depth at which its path leaves the path of the
    one before, and the bytes of its own edge from there. A leaf has the number of documents that its term is in, and a
    counter of occurrences for each source that has it.
    """

    def __init__(self, sources: list[str], terms: list[bytes], docs: np.ndarray, width: np.ndarray, source_no: np.ndarray, times: np.ndarray) -> None:
        self.sources, self.terms, self.docs, self.width, self.source_no, self.times = sources, terms, docs, width, source_no, times

    @classmethod
    def of(cls, sources: list[str], terms: list[bytes], docs: np.ndarray, leaf_term: np.ndarray, leaf_source: np.ndarray, times: np.ndarray) -> Trie:
        """From terms in any order and counters (term number, source number, times), which may repeat."""
        order = sorted(range(len(terms)), key=terms.__getitem__)
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        keys, times = _added(place[leaf_term] * max(1, len(sources)) + leaf_source, times)
        at, source_no = np.divmod(keys, max(1, len(sources)))
        return cls(sources, [terms[i] for i in order], docs[order] if len(order) else docs, np.bincount(at, minlength=len(terms)), source_no, times)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """One trie with the paths and the counters of all."""
        sources, terms = {}, {}
        docs, leaf_term, leaf_source, times = [], [], [], []
        for t in tries:
            mine = np.array([sources.setdefault(s, len(sources)) for s in t.sources], np.int64)
            own = np.array([terms.setdefault(x, len(terms)) for x in t.terms], np.int64)
            docs.append((own, t.docs))
            leaf_term.append(np.repeat(own, t.width))
            leaf_source.append(mine[t.source_no])
            times.append(t.times)
        total = np.zeros(len(terms), np.int64)
        for own, n in docs:
            total[own] += n
        joined = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        return cls.of(list(sources), list(terms), total, joined(leaf_term), joined(leaf_source), joined(times))

    def between(self, low: int, high: int) -> dict:
        """The terms from one place to another as columns of a row."""
        first = np.concatenate([[0], np.cumsum(self.width)])
        terms, inside = self.terms[low:high], slice(first[low], first[high])
        shared = _shared(terms)
        used, no = np.unique(self.source_no[inside], return_inverse=True)
        return {
            "sources": [self.sources[s] for s in used], "shared": shared, "sizes": np.array([len(t) for t in terms], np.int32) - shared,
            "tails": b"".join([t[k:] for t, k in zip(terms, shared.tolist(), strict=True)]), "docs": self.docs[low:high], "width": self.width[low:high].astype(np.int32),
            "source_no": no.astype(np.int32), "times": self.times[inside],
        }

    @classmethod
    def read(cls, row) -> Trie:
        """From a row with these columns."""
        at, term, tails, terms = 0, b"", bytes(row.tails), []
        for k, n in zip(row.shared.tolist(), row.sizes.tolist(), strict=True):
            term = term[:k] + tails[at : at + n]
            terms.append(term)
            at += n
        return cls(list(row.sources), terms, row.docs, row.width, row.source_no, row.times)


def _added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the exact sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times[order], first)


class _Counts:
    """One language's terms and counters so far."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.leaves: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, texts: list[bytes], sources: np.ndarray) -> None:
        """Counts the folded texts of sources with these numbers; a text that goes through several slices is one document."""
        open_terms: set[bytes] = set()  # of the text that the last slice left unfinished
        done = 0
        for of, parts, ends in parts_of(texts):
            n = max(1, len(parts))
            doc = np.searchsorted(ends, np.arange(len(of)), side="right")
            pairs, times = np.unique(doc * n + of, return_counts=True)
            where, which = np.divmod(pairs, n)
            docs = np.bincount(which, minlength=len(parts))
            if open_terms:
                for i in which[where == 0].tolist():
                    docs[i] -= parts[i] in open_terms
            if len(ends):
                open_terms = set()
            open_terms |= {parts[i] for i in which[where == len(ends)].tolist()}
            keys, times = _added(sources[np.minimum(done + where, len(sources) - 1)] * n + which, times)
            mine = np.array([self.terms.setdefault(t, len(self.terms)) for t in parts], np.int64)
            self.docs.append((mine, docs))
            self.leaves.append((mine[keys % n], keys // n, times))
            self.size += len(keys)
            done += len(ends)

    def trie(self, sources: list[str]) -> Trie:
        docs = np.zeros(len(self.terms), np.int64)
        for mine, n in self.docs:
            docs[mine] += n
        return Trie.of(sources, list(self.terms), docs, *[np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*self.leaves, strict=True)])


def _counter(edges: list[tuple[bytes, bytes]], leaves: int):
    """Tries of a partition's terms, one a language, cut at the edges of ranges; given out and begun anew at so many counters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, _Counts] = {}
        names: dict[str, int] = {}

        def emptied() -> Iterator[pd.DataFrame]:
            for lang, own in counts.items():
                trie = own.trie(list(names))
                key = lang.encode()
                at = [i for i, (x, _) in enumerate(edges) if x == key]
                cuts = [0, *[bisect_left(trie.terms, edges[i][1]) for i in at], len(trie.terms)]
                first = bisect_left(edges, (key, b""))
                for i, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if low < high:
                        yield pd.DataFrame([{"range": first + i, "lang": lang} | trie.between(low, high)])
            counts.clear()
            names.clear()

        for pdf in batches:
            for lang, own in pdf.groupby("lang", sort=True):
                numbers = np.array([names.setdefault(s, len(names)) for s in own["source"]], np.int64)
                counts.setdefault(lang, _Counts()).add([t.encode().translate(FOLDED) for t in own["text"]], numbers)
            if sum(c.size for c in counts.values()) >= leaves:
                yield from emptied()
        yield from emptied()

    return run


def _sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Some two hundred of each text's distinct terms, evenly spaced in their order, and no more of each than an edge needs."""
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            terms = sorted({p for _, parts, _ in parts_of([text.encode().translate(FOLDED)]) for p in parts})
            yield pd.DataFrame({"lang": lang, "term": [t[:EDGE] for t in terms[:: 1 + len(terms) // 200]]})


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One range's tries as one a language; terms of too few documents go."""
    out = []
    for lang, own in pdf.groupby("lang", sort=True):
        trie = Trie.merged([Trie.read(row) for row in own.itertuples(index=False)])
        kept = trie.docs >= LEAST_DOCS
        leaf = np.repeat(kept, trie.width)
        less = Trie(trie.sources, [t for t, k in zip(trie.terms, kept.tolist(), strict=True) if k], trie.docs[kept], trie.width[kept], trie.source_no[leaf], trie.times[leaf])
        if less.terms:
            row = less.between(0, len(less.terms))
            _, sums = _added(row["source_no"], row["times"])
            out.append({"lang": lang, "kept": len(less.terms), "sums": sums} | row)
    return pd.DataFrame(out, columns=["lang", "kept", "sums", *_COLUMNS])


def shares(counts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (counts + 2) / size), exact: three digits at a time, so that nothing leaves 64 bits."""
    left, out = counts + ADDED, np.zeros(np.broadcast(counts, size).shape, np.int64)
    for _ in range(THOUSANDS):
        left = left * 1000
        digits = left // size
        out, left = out * 1000 + digits, left - digits * size
    return out + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _comparer(chunk: int):
    """One range's terms and two tiles of a language's sources: sums of pairs, and each source's best terms."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                sources = [x["source"] for x in row.groups]
                sizes = np.array([x["n"] for x in row.groups], np.int64) + 2 * row.v
                total = int(sum(x["n"] for x in row.groups)) + 2 * row.v
                tiles = [np.arange(t * row.tile, min((t + 1) * row.tile, len(sources))) for t in (row.i, row.j)]
                sums, found = np.zeros((len(tiles[0]), len(tiles[1])), np.int64), []
                if row.tails is not None:
                    place = {s: i for i, s in enumerate(sources)}
                    mine = np.array([place[s] for s in row.sources])
                    terms, first = Trie.read(row).terms, np.concatenate([[0], np.cumsum(row.width)])
                    best: list[list[tuple[int, bytes]]] = [[] for _ in tiles[0]]
                    for at in range(0, len(terms), chunk):
                        end = min(at + chunk, len(terms))
                        inside = slice(first[at], first[end])
                        which = np.repeat(np.arange(end - at), np.diff(first[at : end + 1]))
                        who, times = mine[row.source_no[inside]], row.times[inside]
                        every = np.zeros(end - at, np.int64)
                        np.add.at(every, which, times)
                        q = shares(every, total)
                        dense = []
                        for tile in tiles:
                            c = np.zeros((end - at, len(tile)), np.int64)
                            own = (who >= tile[0]) & (who <= tile[-1])
                            c[which[own], who[own] - tile[0]] = times[own]
                            dense.append((c, shares(c, sizes[tile][None])))
                        (c, p), (_, other) = dense
                        for k in range(len(tiles[0])):
                            sums[k] += _gap(p[:, k : k + 1], other).sum(0)
                        if row.i == row.j:
                            for k in range(len(tiles[0])):
                                high = np.flatnonzero((c[:, k] > 0) & (p[:, k] > q))
                                value = _gap(p[high, k], q[high])
                                top = np.argsort(-value, kind="stable")[:TOP]  # in order of bytes, so ties stay so
                                best[k] = sorted(best[k] + [(-int(value[t]), terms[at + high[t]]) for t in top])[:TOP]
                    if row.i == row.j:
                        found = [(row.lang, sources[s], "term", term.decode(), -v) for s, b in zip(tiles[0], best, strict=True) for v, term in b]
                for a, one in enumerate(tiles[0]):
                    for b, two in enumerate(tiles[1]):
                        if one != two:
                            found.append((row.lang, sources[one], "pair", sources[two], int(sums[a, b])))
                            if row.i != row.j:
                                found.append((row.lang, sources[two], "pair", sources[one], int(sums[a, b])))
                yield pd.DataFrame(found, columns=["lang", "source", "part", "item", "value"])

    return run


def audit(documents: DataFrame, tile: int = TILE, leaves: int = LEAVES, size: int = RANGE, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language are apart, and by which terms.

    Each partition counts terms into radix tries, one a language, whose leaves count documents and, by source,
    occurrences. Tries are cut at the edges of ranges of prefixes, which are quantiles of the terms of a bounded sample of
    documents and decide balance and nothing else. Each range is merged as one trie, and terms in at least 10
    documents of the language stay; a second pass over these alone, in the order of their UTF-8 bytes, adds up every
    pair of sources and keeps ten terms a source and range, whose order is settled by value and then bytes. Sources are
    compared in tiles.

    A term that a third of all words are is one leaf a partition. Defined cases: null text, lang and source are empty
    strings; a language without terms, or without any in 10 documents, has pairs of value 0 and no terms; a repeated row
    is a document of its own; an empty table gives no rows; other columns do not matter.
    """
    spark = documents.sparkSession
    docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    n = docs.count()
    some = docs.select("lang", "text")
    if n > SAMPLE:
        some = some.where(F.pmod(F.xxhash64("lang", "text", F.lit(1)), F.lit(1 << 30)) < max(1, (SAMPLE << 30) // n))
    terms = sorted({(r["lang"].encode(), bytes(r["term"])) for r in some.limit(2 * SAMPLE).mapInPandas(_sampled, "lang string, term binary").distinct().collect()})
    ranges = max(1, min(4096, len(terms), n * 200 // size))
    edges = sorted({terms[len(terms) * i // ranges] for i in range(1, ranges)})
    with arrow_rows(spark, 500):
        parts = materialize(docs.mapInPandas(_counter(edges, leaves), f"range int, lang string, {_PACKED}"), "tries")
    with arrow_rows(spark, 16):
        kept = materialize(parts.groupBy("range").applyInPandas(_merged, f"lang string, kept long, sums array<long>, {_PACKED}"), "merged-tries")
    sums = kept.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("groups")).join(kept.groupBy("lang").agg(F.sum("kept").alias("v")), "lang", "left")
    langs = materialize(langs.select("lang", "groups", F.coalesce("v", F.lit(0)).alias("v")), "languages")
    # A language's own row without terms gives its pairs where it has none.
    rows = langs.join(kept.select("lang", *_COLUMNS), "lang").unionByName(langs, allowMissingColumns=True)
    tiles = F.sequence(F.lit(0), F.floor((F.size("groups") - 1) / tile).cast("int"))
    rows = rows.withColumn("i", F.explode(tiles)).withColumn("j", F.explode(F.filter(tiles, lambda x: x >= F.col("i")))).withColumn("tile", F.lit(tile))
    with arrow_rows(spark, 4):
        found = materialize(rows.repartition(max(1, min(4096, 2 * len(edges) + 2)), F.xxhash64("lang", "i", "j", "tails")).mapInPandas(_comparer(chunk), "lang string, source string, part string, item string, value long"), "divergences")
    for done in (parts, kept, langs):
        drop(done)
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(w))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP)
    return pairs.unionByName(terms)
