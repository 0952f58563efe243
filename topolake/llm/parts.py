"""What stands between ASCII white space in many texts, its distinct parts found without a look at each one's string."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SLICE, WHITE, MARKS = 1 << 20, b" \t\n\r\x0b\x0c", b".,;:!?"


def _of(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS_WHITE, _IS_MARK, _IS_LETTER, _GAP = _of(WHITE), _of(MARKS), _of(bytes(range(97, 123))), re.compile(b"[" + WHITE + b"]")
_SPREAD = np.random.default_rng(0).integers(1, 2**63, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_made: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64; those of a usual slice are made once."""

    def made(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    if n > 2 * SLICE:
        return [made(_BASE, n), made(pow(_BASE, -1, 1 << 64), n)]
    if not _made:
        _made.extend([made(_BASE, 2 * SLICE), made(pow(_BASE, -1, 1 << 64), 2 * SLICE)])
    return _made


def distinct_parts(data: bytes, marks: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Where each part begins, which of the distinct parts it is, and these.

    Parts are told apart by a polynomial hash, and each is then compared with the first of its hash byte by byte; if any
    differs, they are told apart as strings. With `marks`, one of MARKS at the end of a part, after a small ASCII letter,
    is a part of its own.
    """
    raw = np.frombuffer(data, np.uint8)
    inked = np.zeros(len(raw) + 2, bool)
    inked[1:-1] = ~_IS_WHITE[raw]
    before, here, after = inked[:-2], inked[1:-1], inked[2:]
    cut = np.zeros(len(raw) + 1, bool)
    if marks:
        cut[1:-1] = _IS_MARK[raw[1:]] & _IS_LETTER[raw[:-1]] & ~after[1:]
    starts, ends = np.flatnonzero(here & (~before | cut[:-1])), np.flatnonzero(here & (~after | cut[1:])) + 1
    if not len(starts):
        return starts, starts, []
    sizes = ends - starts
    power, back = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SPREAD[raw] * power[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * back[starts]
    _, first, of = np.unique(h ^ (h >> np.uint64(32)), return_index=True, return_inverse=True)
    same = (sizes == sizes[first][of]).all()
    if same:
        own = np.flatnonzero(here)
        same = (raw[own] == raw[own - np.repeat(starts - starts[first][of], sizes)]).all()
    if same:
        return starts, of, [data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    seen: dict[bytes, int] = {}
    found = (data[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True))
    of = np.fromiter((seen.setdefault(w, len(seen)) for w in found), np.int64, len(starts))
    return starts, of, list(seen)


def parts_of(texts: list[bytes], marks: bool = False) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Texts in slices cut at white space: each part's number among the slice's distinct parts, these, and for every
    text that ends in the slice, how many of the slice's parts stand before its end."""
    data, ends = b"\n".join(texts), np.cumsum([len(t) + 1 for t in texts])
    at = 0
    while at < len(data):
        stop = len(data)
        if at + SLICE < stop:
            gap = _GAP.search(data, at + SLICE)
            stop = gap.start() if gap else stop
        starts, of, parts = distinct_parts(data[at:stop], marks)
        mine = ends[(ends > at) & ((ends <= stop) | (stop == len(data)))]
        yield of, parts, np.searchsorted(starts, mine - at)
        at = stop
    if texts and not data:
        yield np.empty(0, np.int64), [], np.zeros(1, np.int64)
