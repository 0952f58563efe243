"""Best-fit packing of tokenised documents, with bound-certified repacking across partitions."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import drop, materialize
from .parts import parts_of

CAPACITY, END_ID, PART_TOKENS = 2048, 0, 8_000_000
MAX_WORD, MAX_CACHED = 64, 700_000


def _ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those of first[1], and so on."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordTokenizer:
    """Token ids of whole texts, by memory of what stands between ASCII white space.

    The tokenizer drops white space, lowers capitals and never joins text across white space, so a text's ids are those
    of its parts, lower-cased, in turn. Nor does it join a letter and a mark after it: one of MARKS at the end of a part,
    after an ASCII letter, is a part of its own. A slice's distinct parts are found by a hash of all of them at once,
    compared byte by byte, and only they are looked up. New parts of letters alone are one word each to the tokenizer;
    many are coded as one text and told apart by its tokens that end a word. Parts of over MAX_WORD bytes are not
    remembered, and at MAX_CACHED parts the memory is begun anew.

    With `special`, the tokenizer's special tokens where a text spells them are single ids, as in the tokenizer left at
    its defaults, which cuts a text at them before all else; without it they are text like any other.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        self.tokenizer, self.ends = _loaded(path)
        added = self.tokenizer.get_added_tokens_decoder() if special else {}
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items() if t.special}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.first, self.count = np.empty(1 << 20, "<u4"), np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.used = self.parts = 0

    def _keep(self, ids: np.ndarray, count: np.ndarray) -> int:
        """Appends the ids of some parts; the number of the first of them."""
        for name, at, n in (("flat", self.used, len(ids)), ("first", self.parts, len(count)), ("count", self.parts, len(count))):
            old = getattr(self, name)
            if at + n > len(old):
                grown = np.empty(max(at + n, 2 * len(old)), old.dtype)
                grown[:at] = old[:at]
                setattr(self, name, grown)
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[self.parts : self.parts + len(count)] = count
        self.first[self.parts : self.parts + len(count)] = self.used + np.cumsum(count) - count
        number = self.parts
        self.used, self.parts = self.used + len(ids), self.parts + len(count)
        return number

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [c.ids for c in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], "<u4"), np.array([len(x) for x in ids], np.int64)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words of letters, and how many each has."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(words) and cuts[-1] == len(ids) else self._each(words)

    def _learn(self, parts: list[bytes]) -> np.ndarray:
        """Numbers of new parts; what is short enough is remembered."""
        texts = [w.decode("utf-8", "replace") for w in parts]
        short = np.fromiter(map(len, parts), np.int64, len(parts)) <= MAX_WORD
        plain = np.fromiter(map(str.isalpha, texts), bool, len(parts)) & short
        numbers = np.empty(len(parts), np.int64)
        for mine, code, step in ((plain, self._words, 100), (~plain & short, self._each, 1000), (~short, self._each, 100)):
            at = np.flatnonzero(mine)
            for i in range(0, len(at), step):
                own = at[i : i + step]
                numbers[own] = self._keep(*code([texts[k] for k in own.tolist()])) + np.arange(len(own))
        at = np.flatnonzero(short)
        self.known.update(zip([parts[k] for k in at.tolist()], numbers[at].tolist(), strict=True))
        return numbers

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if not any(m in t for m in self.special for t in texts):
            return self._plain(texts)
        # Every second part is a special token.
        parts = [self.cut.split(t) for t in texts]
        coded = iter(self._plain([p for ps in parts for p in ps[::2]]))
        return [b"".join(self.special[p] if i % 2 else next(coded) for i, p in enumerate(ps)) for ps in parts]

    def _plain(self, texts: list[str]) -> list[bytes]:
        found, cuts, n = [np.empty(0, "<u4")], [np.zeros(1, np.int64)], 0
        for of, parts, ends in parts_of([t.encode("utf-8", "surrogatepass").lower() for t in texts], marks=True):
            ids, count = self._coded(of, parts)
            cuts.append(n + np.append(0, np.cumsum(count))[ends])
            found.append(ids)
            n += len(ids)
        raw, cut = np.concatenate(found).tobytes(), (4 * np.concatenate(cuts)).tolist()
        return [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)]

    def _coded(self, of: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's parts in turn, and how many each has."""
        if self.parts > MAX_CACHED:
            self._forget()
        number = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(number < 0)
        number[new] = self._learn([parts[i] for i in new.tolist()])
        own = number[of]
        count = self.count[own]
        ids = self.flat[_ragged(self.first[own], count)]
        if self.parts > len(self.known):
            # Long parts came last and are let go.
            self.parts = len(self.known)
            self.used = int(self.first[self.parts])
        return ids, count


_tokenizers: dict[str, tuple] = {}  # of a Python worker: the library's tokenizer as loaded, without what a task learns


def _loaded(path: str) -> tuple:
    """The tokenizer of a file and, by id, whether a token ends a word."""
    # A worker has one core; the library's own threads would compete for it.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        made = Tokenizer.from_file(path)
        # What lies between special tokens never holds one, but lower-casing can spell one, and that is text.
        made.encode_special_tokens = True
        ends = np.zeros(made.get_vocab_size() + 1, bool)
        for token, i in made.get_vocab().items():
            ends[i] = token.endswith("</w>")
        _tokenizers[path] = made, ends
    return _tokenizers[path]


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, special: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and END_ID, cut only where longer than a sequence."""
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def groups(texts: list[str]) -> Iterator[list[str]]:
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size < 4_000_000):
                size += len(texts[stop])
                stop += 1
            yield texts[at:stop]
            at = stop

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer(tokenizer_path, special)
        for batch in batches:
            row, made = 0, []
            for texts in groups([t if t is not None else "" for t in batch.column(1).to_pylist()]):
                for ids in tok.encode(texts):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        made.append((row, piece, start, len(part) // 4, zlib.crc32(part)))
                    row += 1
            rows, *rest = np.array(made, np.int64).reshape(-1, 5).T
            rest = [pa.array(x, pa.int32() if i == 0 else pa.int64()) for i, x in enumerate(rest)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *rest], names=names)

    longs = [StructField(n, LongType()) for n in names[2:]]
    schema = StructType([documents.schema["doc_id"], StructField("piece", IntegerType()), *longs])
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and place of each item, longest first into the fullest bin that holds it; and the number of bins."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: a bin with r left
    bins, places, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fitting = open_ >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_ &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], places[i], left = b, capacity - room, room - size
        if left:
            rooms[left].append(b)
            open_ |= 1 << left
    return bins, places, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual feasible functions, total length among them.

    Threshold functions: an item above capacity - t counts as a whole bin, one under t as none, others by length.
    Rounding functions: shares x = length / capacity map to floor((k + 1) x) / k, whole products kept as x.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int(lengths.sum()) // capacity)
    for t in np.unique(np.minimum(sizes, capacity // 2)):
        value = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, 20):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def pack(items: DataFrame, capacity: int = CAPACITY, part_tokens: int = PART_TOKENS) -> DataFrame:
    """items with sequence_id and offset.

    Each partition, of about part_tokens tokens and chosen by a hash of the item, packs its own documents best fit
    decreasing and compares its bins with its lower bound. A partition without a gap is certified optimal and done.
    Partitions with gaps keep their full bins and exchange the documents of the others: these are dealt over new
    partitions, as large as before and thus fewer, and packed again, until all are certified, one partition is left or
    a round settles less than half of what it was given; what is left then stays as it was packed. Only items move,
    never text; a partition's size does not grow with the table.
    """
    total = items.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(1, round(total / part_tokens))
    # pandas has no null long: a missing id travels as the least long beside a mark.
    items = items.withColumns({"doc_id": F.coalesce("doc_id", F.lit(-(2**63))), "no_id_": F.col("doc_id").isNull()})
    names = items.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema.fields)
    done, pool, used = [], items, 0
    for turn in count():
        # Pickled by materialize() within this turn, so the names below are this turn's.
        base = used

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
            size = pdf["length"].to_numpy(np.int64)
            bins, places, n = best_fit(size, capacity)
            full = np.bincount(bins, size, n) == capacity
            settled = np.ones(len(pdf), bool) if n <= lower_bound(size, capacity) else full[bins]
            out = pdf[names].copy()
            out["sequence_id"] = (base + int(pdf["part_"].iloc[0])) << 32 | bins
            out["offset"] = places
            out["settled_"] = settled
            return out

        keyed = pool.select(*names).withColumn("part_", F.pmod(F.xxhash64(*names, F.lit(turn)), F.lit(parts)))
        filled = materialize(keyed.groupBy("part_").applyInPandas(fill, schema + ", sequence_id long, offset long, settled_ boolean"), "packed")
        used += parts
        left = filled.where("NOT settled_").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        if not left or parts == 1 or 2 * left > total:
            done.append(filled.drop("settled_"))
            break
        done.append(filled.where("settled_").drop("settled_"))
        pool, total, parts = filled.where("NOT settled_"), left, max(1, round(left / part_tokens))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("doc_id", F.when(~F.col("no_id_"), F.col("doc_id"))).drop("no_id_")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, part_tokens: int = PART_TOKENS, special: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all documents.

    Texts are tokenised once and only sizes are kept. Defined cases: a null or empty text is the end id alone; a text
    longer than a sequence is cut into whole pieces and a rest; repeated rows and ids are packed one by one; a null id
    stays null; an empty table gives no rows; special tokens spelt in a text are single ids only with `special`, as op7 and
    the pipeline have it. tokenizer_path must exist on every executor.
    """
    cut = materialize(pieces(documents, tokenizer_path, capacity, special), "pieces")
    packed = pack(cut, capacity, part_tokens)
    drop(cut)
    return packed
