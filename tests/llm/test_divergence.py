"""Divergence audit against plain counting, by few and many ranges, pieces and tiles."""

import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from topolake.llm import divergence, parts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain(rows):
    docs, times, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, text = (x or "" for x in (lang, source, text))
        words = TERM.findall(text.translate(FOLD))
        groups.add((lang, source))
        times[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 10)
        mine = sorted(s for g, s in groups if g == lang)
        count = {s: [times[lang, s][t] for t in kept] for s in mine}

        def p(counts):
            return [1 + 10**9 * (c + 2) // (sum(counts) + 2 * len(kept)) for c in counts]

        share, q = {s: p(count[s]) for s in mine}, p([sum(c) for c in zip(*count.values(), strict=True)])
        for s in mine:
            pairs = [(-sum((a - b) ** 2 // (a + b) for a, b in zip(share[s], share[o], strict=True)), o.encode()) for o in mine if o != s]
            terms = [(-((a - b) ** 2 // (a + b)), t.encode()) for a, b, c, t in zip(share[s], q, count[s], kept, strict=True) if c > 0 and a > b]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def texts(seed, n=400, vocabulary=120):
    r = random.Random(seed)
    letters = ["a", "b", "ab", "é", "ß", "Z", "日本", "\U0001f600", "xyz" * 30]
    words = ["".join(r.choices(letters, k=r.randint(1, 4))) for _ in range(vocabulary)]
    rows = [(r.choice(["en", "de", None]), r.choice(["s1", "s2", "s10", None, "é"]), " -,7_".join([""] + r.choices(words, k=r.randint(0, 30)) + [""])) for _ in range(n)]
    return rows + [("fr", "s1", "once only"), ("fr", "s2", None), ("it", "", ""), (None, None, None)] + rows[:20]


def checked(spark, rows, **sizes):
    df = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, rank int, value int").repartition(5)
    found = divergence.audit(df, **sizes)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in found.collect()) == plain(rows)


def test_audit_equals_plain_counting(spark):
    checked(spark, texts(1))


def test_many_ranges_tries_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SAMPLE", 30)
    checked(spark, texts(2, 200), tile=2, leaves=100, chunk=5, size=2000)


def test_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(parts, "SLICE", 64)
    counts, rows = divergence._Counts(), [t or "" for _, _, t in texts(3, 60)] + ["same word " * 100]
    counts.add([t.encode().translate(divergence.FOLDED) for t in rows], np.arange(len(rows)) % 2)
    trie = counts.trie(["even", "odd"])
    want = [Counter(w for t in rows[i::2] for w in TERM.findall(t.translate(FOLD))) for i in range(2)]
    docs = Counter(w for t in rows for w in set(TERM.findall(t.translate(FOLD))))
    assert dict(zip((t.decode() for t in trie.terms), trie.docs.tolist(), strict=True)) == docs
    keys = zip(np.repeat(np.arange(len(trie.terms)), trie.width).tolist(), trie.source_no.tolist(), trie.times.tolist(), strict=True)
    assert {(trie.terms[t].decode(), s): n for t, s, n in keys} == {(t, s): n for s in range(2) for t, n in want[s].items()}


@pytest.mark.parametrize("seed", range(5))
def test_tries_merge_and_come_back_from_rows(seed):
    r = random.Random(seed)
    word = lambda: bytes(r.choices(range(97, 100), k=r.choice([1, 2, 5, 31, 32, 33, 40, 80])))
    made, total = [], Counter()
    for _ in range(4):
        words = [w for w in {word() for _ in range(200)}]
        n = np.array([r.randint(1, 5) for _ in words])
        total.update(dict(zip(words, n.tolist(), strict=True)))
        names = r.sample(["x", "y", "z"], 2)
        made.append(divergence.Trie.of(names, words, n, np.arange(len(words)), np.arange(len(words)) % 2, n))
    rows = [SimpleNamespace(**t.between(0, len(t.terms))) for t in made]
    both = divergence.Trie.merged([divergence.Trie.read(x) for x in rows])
    assert both.terms == sorted(total) and both.docs.tolist() == [total[t] for t in both.terms]
    assert both.times.sum() == sum(total.values()) and both.width.sum() == len(both.times)


def test_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).count() == 0


def test_shares_stay_exact():
    for count, size in ((0, 5), (10**15, 10**15 + 2), (123456789012, 987654321098765), (1, 3)):
        assert int(divergence.shares(np.array([count]), np.int64(size))[0]) == 1 + 10**9 * (count + 2) // size
