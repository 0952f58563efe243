"""Exact repeats across documents by a collection Burrows-Wheeler transform, built column by column."""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

LENGTH, ANCHOR, GROUP_BYTES, BUCKET_BYTES, CHUNK_SEGMENTS = 50, 24, 6_000_000, 10_000_000, 5_000
_PLACE = np.uint64((1 << 26) - 1)
_FIRST, _FACTOR, _OVER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95), np.uint64(0xC4CEB9FE1A85EC53)
# Kinds of blobs: distinct anchors, those shared, or marks of a group's runs; least holders of windows.
ANCHORS, WINDOWS, MARKS = 0, 1, 2


def _spread(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class Columns:
    """The transform's columns, preceding symbols and common prefixes, as files that each round rewrites in order.

    Two files a column take turns and stay open: columns only grow, so nothing is ever cut off or flushed early.
    """

    def __init__(self, folder: str, kind: type = np.uint8) -> None:
        self.files = {(name, turn): (Path(folder) / f"{name}{turn}").open("w+b", buffering=0) for name in ("symbol", "prefix") for turn in (0, 1)}
        self.kinds, self.turn, self.rows = {"symbol": kind, "prefix": np.uint8}, 0, 0

    def write(self, symbol: np.ndarray, prefix: np.ndarray) -> None:
        self.turn, self.rows = 1 - self.turn, len(symbol)
        for name, column in (("symbol", symbol), ("prefix", prefix)):
            file = self.files[name, self.turn]
            file.seek(0)
            column.tofile(file)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for name in ("symbol", "prefix"):
            file = self.files[name, self.turn]
            file.seek(0)
            out.append(np.fromfile(file, self.kinds[name], self.rows))
        return out[0], out[1]

    def close(self) -> None:
        for file in self.files.values():
            file.close()


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high]) of each range, low < high; a part of the ranges at a time."""
    sizes = (high - low).astype(np.int64)
    ends, out, at = np.cumsum(sizes), np.empty(len(low), values.dtype), 0
    while at < len(low):
        base = int(ends[at] - sizes[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + 4_000_000, "right")))
        first = ends[at:stop] - sizes[at:stop] - base
        flat = np.arange(int(ends[stop - 1]) - base, dtype=np.int32)
        flat += np.repeat((low[at:stop] - first).astype(np.int32), sizes[at:stop])
        out[at:stop] = np.minimum.reduceat(values[flat], first)
        at = stop
    return out


def _by_symbol(symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a symbol by (symbol, row), and where a new symbol begins among them, the end included."""
    counts = np.bincount(symbol)
    order = np.argsort(symbol, kind="stable")[counts[0] :].astype(np.int32)
    heads = np.zeros(len(order) + 1, bool)
    heads[0] = True
    heads[np.cumsum(counts[1:])] = True
    return order, heads


def collection_transform(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, files: Columns) -> None:
    """Builds the transform and common prefixes of all suffixes of the segments, one symbol a segment each round.

    Round j inserts every segment's suffix of length j. Its place follows from the symbol that stood before the suffix
    of length j - 1: after all smaller symbols, and after as many equal ones as stand before it in the transform. Its
    common prefix with its neighbours is one more than the least between the two equal symbols. Earlier suffixes keep
    their order, so each column is merged with the insertions in one sequential rewrite. Segments have symbols from 1;
    0 stands before a whole segment. Ends differ and sort by segment. Prefixes are held at 255.
    """
    m = len(starts)
    files.write(symbols[starts + sizes - 1], np.zeros(m, np.uint8))
    place, now = np.arange(m), np.arange(m)
    for j in range(1, int(sizes.max()) + 1):
        symbol, prefix = files.read()
        live = sizes[now] >= j
        now, place = now[live], place[live]
        order, heads = _by_symbol(symbol)
        rank = np.empty(len(symbol), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        mine = rank[place]  # among all suffixes with a first symbol
        touched = np.zeros(len(order) + 1, bool)
        touched[mine] = touched[mine + 1] = True
        touched[-1] = False
        inner = np.flatnonzero(touched & ~heads)
        kept = np.ones(m + len(order), bool)
        kept[m + mine] = False
        left = sizes[now] - j
        column = np.empty(len(kept), symbol.dtype)
        column[kept] = symbol
        column[m + mine] = np.where(left > 0, symbols[starts[now] + np.maximum(left - 1, 0)], 0)
        common = np.empty(len(kept), np.uint8)
        common[kept] = prefix
        common[m + np.flatnonzero(touched & heads)] = 0
        if len(inner):
            common[m + inner] = np.minimum(_range_min(prefix, order[inner - 1] + 1, order[inner] + 1), 254) + 1
        files.write(column, common)
        place = m + mine


def least_holders(data: bytes, sizes: np.ndarray, holder: np.ndarray, length: int) -> np.ndarray:
    """For each `length`-byte window of each segment, in order, the least holder of a segment with that window.

    Segments lie one after another in data. After the transform, each segment is followed back through it from its end
    to find the rows of its suffixes; rows between which the common prefix falls below `length` are other windows.
    """
    raw = np.frombuffer(data, np.uint8)
    used, codes = np.unique(raw, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    first = np.cumsum(windows) - windows
    with tempfile.TemporaryDirectory(prefix="transform-") as folder:
        kind = np.uint16 if len(used) > 254 else np.uint8
        files = Columns(folder, kind)
        collection_transform((codes + 1).astype(kind), starts, sizes, files)
        symbol, prefix = files.read()
        files.close()
    order, _ = _by_symbol(symbol)
    back = np.empty(len(symbol), np.int64)
    back[order] = np.arange(len(order)) + len(starts)
    row, now, found = np.arange(len(starts)), np.arange(len(starts)), []
    for j in range(1, int(sizes.max()) + 1):
        live = sizes[now] >= j
        now, row = now[live], back[row[live]]
        if j >= length:
            found.append((row, now, first[now] + sizes[now] - j))
    rows, owner, spot = (np.concatenate(x) for x in zip(*found, strict=True))
    held = np.full(len(prefix), 2**63 - 1, np.int64)
    held[rows] = holder[owner]
    other = prefix < length
    least = np.minimum.reduceat(held, np.flatnonzero(other))
    out = np.empty(int(windows.sum()), np.int64)
    out[spot] = least[np.cumsum(other)[rows] - 1]
    return out


class Windows:
    """Some texts' windows of `length` bytes, each in the run of windows that share its anchor.

    The anchor of a window is its ANCHOR-byte string of least hash, the leftmost of equal ones, so equal windows have
    equal anchors wherever they stand. Runs: first window, number of windows, anchor hash, document. `marks`, what
    marks() gave of the same texts before, saves the search: two bytes a run, from which anchors are hashed where they stand.
    """

    def __init__(self, texts: list[bytes], length: int, anchor: int, marks: bytes | None = None) -> None:
        self.length = length
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        if marks is None:
            self._search(texts, anchor)
        else:
            self._recall(np.frombuffer(marks, np.uint8).reshape(2, -1), anchor)
        # Anchors have small hashes; another product spreads them over the buckets.
        self.anchors *= _OVER

    def marks(self) -> bytes:
        """Each run's number of windows and its anchor's distance from its first window."""
        return np.stack([self.runs[:, 1], self.offsets]).astype(np.uint8).tobytes()

    def _recall(self, marks: np.ndarray, anchor: int) -> None:
        count = marks[0].astype(np.int64)
        first, windows = np.cumsum(count) - count, np.maximum(self.sizes - self.length + 1, 0)
        ends = np.cumsum(windows)
        doc = np.searchsorted(ends, first, "right")
        start = first + (self.starts - (ends - windows))[doc]
        self.runs, self.anchors = np.column_stack([start, count, doc]), np.empty(len(count), np.uint64)
        for low in range(0, len(count), 1 << 14):
            own = slice(low, low + (1 << 14))
            self.anchors[own] = self._hash_at(start[own] + marks[1][own], anchor)

    def _hash_at(self, place: np.ndarray, anchor: int) -> np.ndarray:
        """The hash that _runs() gives the strings at some places, from the parts alone that make it up."""
        parts = [(self.data[place + i].astype(np.uint64) + np.uint64(1)) * _FIRST for i in range(anchor)]
        power, h = 1, np.zeros(len(place), np.uint64)
        while parts:
            if anchor & power:
                h = h * _FACTOR + parts.pop(0)
                h ^= h >> np.uint64(31)
            parts = [a * _FACTOR + (b ^ (b >> np.uint64(29))) for a, b in zip(parts[::2], parts[1::2], strict=True)]
            power *= 2
        return _spread(h)

    def _search(self, texts: list[bytes], anchor: int) -> None:
        found, hashes, offsets = [np.empty((0, 3), np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + self.sizes[stop] <= 150_000):
                size += int(self.sizes[stop])
                stop += 1
            # One text beyond the place bits is cut; cuts overlap by a window less one byte.
            base = int(self.starts[at])
            for low in range(0, max(1, size - self.length + 1), 1 << 25):
                runs, h, offset = self._runs(base + low, min(base + size, base + low + (1 << 25) + self.length - 1), at, stop, anchor)
                found.append(runs)
                hashes.append(h)
                offsets.append(offset)
            at = stop
        self.runs, self.anchors, self.offsets = np.concatenate(found), np.concatenate(hashes), np.concatenate(offsets)

    def _runs(self, low: int, high: int, first: int, last: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.empty((0, 3), np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        n, span = high - low, self.length - anchor + 1
        if n < self.length:
            return none
        # The string's hash by doubling: parts of 1, 2, 4, ... bytes joined as anchor's binary digits ask.
        part = (self.data[low:high].astype(np.uint64) + np.uint64(1)) * _FIRST
        power, done, h = 1, 0, np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            while True:
                if anchor & power:
                    tail = np.zeros(n, np.uint64)
                    tail[: n - done] = part[done:]
                    h = h * _FACTOR + tail
                    h ^= h >> np.uint64(31)
                    done += power
                if done >= anchor:
                    break
                nxt = part * _FACTOR
                nxt[: n - power] += part[power:] ^ (part[power:] >> np.uint64(29))
                part, power = nxt, power * 2
            h = _spread(h)
        least = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least[: n - width] = np.minimum(least[: n - width], least[width:])
            width *= 2
        if span > width:
            gap = span - width
            least[: n - gap] = np.minimum(least[: n - gap], least[gap:])
        doc_ends = (self.starts + self.sizes)[first:last]
        doc = np.repeat(np.arange(first, last), self.sizes[first:last])[low - int(self.starts[first]) :][:n]
        fits = np.arange(low, high) + self.length <= np.minimum(doc_ends[doc - first], high)
        at = np.flatnonzero(fits)
        if not len(at):
            return none
        place = (least[at] & _PLACE).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(new)
        counts = np.diff(np.append(heads, len(at)))
        return np.column_stack([low + at[heads], counts, doc[at[heads]]]), h[place[heads]], place[heads] - at[heads]


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, so that what is in order of hashes is in order of buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def _anchors(w: Windows, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors in order, whether two or more of the group's documents have each, and bucket cuts."""
    order = np.argsort(w.anchors, kind="stable")  # runs are in order of documents
    h, d = w.anchors[order], w.runs[order, 2]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    many = d[np.append(head[1:], len(h)) - 1] != d[head] if len(h) else np.empty(0, bool)
    h = h[head]
    return h, many, np.searchsorted(_buckets(h, buckets), np.arange(buckets + 1))


class Segments:
    """The distinct texts of a group's runs with shared anchors, by anchor, and each run's own."""

    def __init__(self, w: Windows, shared: np.ndarray, buckets: int) -> None:
        shared = np.sort(shared)
        spot = np.searchsorted(shared, w.anchors)
        spot[spot == len(shared)] = 0
        at = np.flatnonzero(shared[spot] == w.anchors) if len(shared) else np.empty(0, np.int64)
        at = at[np.argsort(w.anchors[at], kind="stable")]
        self.runs, anchors = w.runs[at], w.anchors[at]
        data, number = w.data.tobytes(), {}
        first, last = self.runs[:, 0], self.runs[:, 0] + self.runs[:, 1] - 1 + w.length
        texts = [data[i:j] for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        self.of = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
        heads = np.unique(self.of, return_index=True)[1]
        self.texts, self.anchors, self.windows = list(number), anchors[heads], self.runs[heads, 1]
        self.cuts = np.searchsorted(_buckets(self.anchors, buckets), np.arange(buckets + 1))


def _resolve(blobs: list[tuple[int, bytes]], length: int, chunk: int):
    """Each request's segments, in its order, with the least holder of every window.

    A text that several groups sent is one segment with its least holder. Equal windows have equal anchors, so the
    segments of one anchor are a collection of their own, and chunks of the transform hold whole collections; one that
    has a single member is known without it.
    """
    number: dict[bytes, int] = {}
    asked, hashes, leasts = [], [], []
    for g, blob in blobs:
        raw = zstandard.decompress(blob)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        hashes.append(np.frombuffer(raw, np.uint64, n, 8))
        leasts.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
        ends = np.cumsum(np.frombuffer(raw, np.uint8, n, 8 + 16 * n).astype(np.int64)) + 8 + 17 * n
        cuts = [8 + 17 * n, *ends.tolist()]
        asked.append((g, np.fromiter((number.setdefault(raw[i:j], len(number)) for i, j in zip(cuts, cuts[1:], strict=False)), np.int64, n)))
    texts, owns = list(number), np.concatenate([own for _, own in asked])
    holder = np.full(len(texts), 2**63 - 1, np.int64)
    np.minimum.at(holder, owns, np.concatenate(leasts))
    anchors = np.empty(len(texts), np.uint64)
    anchors[owns] = np.concatenate(hashes)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    windows = sizes - length + 1
    first = np.cumsum(windows) - windows
    out = np.repeat(holder, windows)
    order = np.argsort(anchors, kind="stable")
    heads = np.flatnonzero(np.append(True, anchors[order][1:] != anchors[order][:-1]))
    alone = np.diff(np.append(heads, len(order))) == 1
    order = order[np.repeat(~alone, np.diff(np.append(heads, len(order))))]
    heads = np.append(np.flatnonzero(np.append(True, anchors[order][1:] != anchors[order][:-1])), len(order)) if len(order) else np.zeros(1, np.int64)
    at = 0
    while at < len(order):
        j = np.searchsorted(heads, at + chunk, "right") - 1
        stop = int(heads[j]) if heads[j] > at else int(heads[j + 1])
        part = order[at:stop]
        count = windows[part]
        got = least_holders(b"".join(texts[i] for i in part.tolist()), sizes[part], holder[part], length)
        out[np.repeat(first[part] - (np.cumsum(count) - count), count) + np.arange(len(got))] = got
        at = stop
    for g, own in asked:
        count = windows[own]
        spot = np.repeat(first[own] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        yield g, _squeeze(out[spot])


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_bytes: int = GROUP_BYTES,
    bucket_bytes: int = BUCKET_BYTES, chunk: int = CHUNK_SEGMENTS,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every document: bytes covered by a `length`-byte string that
    also starts in a document of smaller id are removed.

    The column-wise transform needs a round for each symbol of its longest member, so members are short: runs of
    windows that share an anchor, at most 2 * length - anchor bytes, each window of a text in just one. Documents are
    dealt by hash into groups of about group_bytes; a group finds its runs once (two bytes a run are kept for the later
    passes), asks the bucket of each anchor hash whether another document has it (8 bytes a distinct anchor), sends runs of such anchors, each distinct text once with its least
    document, and is told the least document of every window. A bucket, about bucket_bytes of text, builds the
    transform of its distinct runs chunk by chunk; windows with a common prefix of `length` are equal. Passages that
    many documents share are one run a group, so no task meets all copies.

    Defined cases: a null text is empty; texts shorter than `length` keep all; equal ids are not smaller than each
    other; a null id is larger than all others; very long texts are whole, in one group; an empty table gives no rows.
    """
    spark = documents.sparkSession
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, buckets = max(1, -(-size // group_bytes)), max(1, -(-size // bucket_bytes))
    id_type = documents.schema["doc_id"].dataType
    rows = documents.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"),
        F.col("doc_id").cast("string").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("at"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    blob = "bucket int, g int, kind int, blob binary"
    names = ["bucket", "g", "kind", "blob"]

    def opened(pdf: pd.DataFrame, answers: pd.DataFrame | None = None) -> tuple[pd.DataFrame, Windows]:
        pdf = pdf.sort_values(["at", "text"], ignore_index=True)
        marks = None if answers is None else b"".join(map(zstandard.decompress, answers.loc[answers["kind"] == MARKS, "blob"]))
        return pdf, Windows(list(pdf["text"]), length, anchor, marks)

    def shared_of(answers: pd.DataFrame) -> np.ndarray:
        found = answers.loc[answers["kind"] == ANCHORS, "blob"]
        return np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(zstandard.decompress(x), np.uint64) for x in found)])

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        g, w = int(pdf["g"].iloc[0]), opened(pdf)[1]
        h, many, cuts = _anchors(w, buckets)
        rows = [(b, g, ANCHORS, _squeeze(h[i:j], many[i:j].astype(np.uint8))) for b, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if j > i]
        return pd.DataFrame([*rows, (g % buckets, g, MARKS, zstandard.compress(w.marks(), 3))], columns=names)

    def tell(pdf: pd.DataFrame) -> pd.DataFrame:
        marks, pdf = pdf[pdf["kind"] == MARKS], pdf[pdf["kind"] == ANCHORS]
        if pdf.empty:
            return marks
        hs, many = [], []
        for x in pdf["blob"]:
            raw = zstandard.decompress(x)
            n = len(raw) // 9
            hs.append(np.frombuffer(raw, np.uint64, n))
            many.append(np.frombuffer(raw, np.uint8, n, 8 * n))
        distinct, at = np.unique(np.concatenate(hs), return_inverse=True)
        docs = np.bincount(at, 1 + np.concatenate(many), len(distinct)) >= 2
        cuts = np.cumsum([0, *map(len, hs)])
        blobs = [_squeeze(h[docs[at[i:j]]]) for h, i, j in zip(hs, cuts, cuts[1:], strict=False)]
        return pd.concat([pdf.assign(blob=blobs), marks])

    asked = rows.groupBy("g").applyInPandas(ask, blob)
    shared = materialize(asked.groupBy("bucket").applyInPandas(tell, blob), "anchors")
    tidy(spark)

    def send(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf["g"].iloc[0])
        pdf, w = opened(pdf, answers)
        s = Segments(w, shared_of(answers), buckets)
        least = np.full(len(s.texts), 2**63 - 1, np.int64)
        np.minimum.at(least, s.of, pdf["at"].to_numpy(np.int64)[s.runs[:, 2]])
        sizes = (s.windows + length - 1).astype(np.uint8)
        out = []
        for b, (i, j) in enumerate(zip(s.cuts, s.cuts[1:], strict=False)):
            if j > i:
                text = np.frombuffer(b"".join(s.texts[i:j]), np.uint8)
                out.append((b, g, WINDOWS, _squeeze(np.array([j - i], np.int64), s.anchors[i:j], least[i:j], sizes[i:j], text)))
        return pd.DataFrame(out, columns=names)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        got = _resolve(list(zip(pdf["g"], pdf["blob"], strict=True)), length, chunk)
        return pd.DataFrame([(b, g, WINDOWS, x) for g, x in got], columns=names)

    sent = rows.groupBy("g").cogroup(shared.groupBy("g")).applyInPandas(send, blob)
    told = materialize(sent.groupBy("bucket").applyInPandas(answer, blob), "windows")
    tidy(spark)

    def cut(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        pdf, w = opened(pdf, answers)
        s = Segments(w, shared_of(answers), buckets)
        least = np.empty(int(s.windows.sum()), np.int64)
        first = np.cumsum(s.windows) - s.windows
        bounds = np.append(first, len(least))[s.cuts]
        for b, x in zip(*answers.loc[answers["kind"] == WINDOWS, ["bucket", "blob"]].to_numpy().T, strict=True):
            least[bounds[b] : bounds[b + 1]] = np.frombuffer(zstandard.decompress(x), np.int64)
        count = s.runs[:, 1]
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        mine = np.repeat(pdf["at"].to_numpy(np.int64)[s.runs[:, 2]], count)
        again = least[np.repeat(first[s.of], count) + inside] < mine
        edge = np.zeros(len(w.data) + 1, np.int32)
        spots = (np.repeat(s.runs[:, 0], count) + inside)[again]
        np.add.at(edge, spots, 1)
        np.subtract.at(edge, spots + length, 1)
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for i, n in zip(w.starts.tolist(), w.sizes.tolist(), strict=True):
            own = gone[i : i + n]
            runs = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()) if n else 0
            out.append((n, int(own.sum()), runs, w.data[i : i + n][~own].tobytes() if runs else w.data[i : i + n].tobytes()))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"]).assign(key=pdf["key"])

    done = rows.groupBy("g").cogroup(shared.unionByName(told).groupBy("g")).applyInPandas(cut, "key string, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(F.col("key").cast(id_type).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")

