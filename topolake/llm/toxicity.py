"""Toxicity: a weighted lexicon, part of it learned, matched by Aho-Corasick on folded text, normalised by length, with exceptions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abusive words that every fit starts from, and harmless phrases that hold one of them.
LEXICON = (
    "idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "loser", "losers", "worthless", "pathetic",
    "trash", "scum", "scumbag", "clown", "disgusting", "imbecile", "dumbass", "bastard", "asshole", "retard", "filth",
    "vermin", "dummkopf", "arschloch", "abschaum", "schwachkopf", "connard", "imbécile", "débile", "ordure", "gilipollas",
    "imbécil", "estúpido", "basura humana", "escoria",
)
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "class clown", "pond scum", "soap scum", "sore loser rule")
# Characters that look like Latin letters, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "ս": "u", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ѵ": "v", "ԝ": "w",
    "А": "a", "В": "b", "С": "c", "Е": "e", "Н": "h", "І": "i", "Ј": "j", "К": "k", "М": "m", "О": "o", "Р": "p", "Ѕ": "s",
    "Т": "t", "У": "y", "Х": "x", "Α": "a", "Β": "b", "Ε": "e", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p",
    "Τ": "t", "Χ": "x",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
ACCENTS = {"áàâäãå": "a", "éèêë": "e", "íìîï": "i", "óòôöõ": "o", "úùûü": "u", "ñ": "n", "ç": "c"}

# Rows of a fit at most, about; toxic texts that an entry must stand in; its least log-odds; the fixed lexicon's least weight.
MAX_FIT_DOCS, SUPPORT, LEAST_ODDS, FLOOR = 20_000, 5, 2.0, 1.0
# Lengths of learned beginnings of words, and entries up to which they are broadcast.
BEGINNING, LONGEST, BROADCAST_ENTRIES = 5, 16, 500_000


def _table() -> dict[int, str]:
    out = {ord(a): b for a, b in (HOMOGLYPHS | SIGNS).items()}
    for chars, to in ACCENTS.items():
        out |= {ord(c): to for x in chars for c in (x, x.upper())}
    out |= {c: chr(c + 32) for c in range(65, 91)}
    out |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
    # A small l and the digit 1 may stand for either of i and l.
    out |= {ord(c): "i" for c in "lL" + "ӏ"}
    return out


FOLD = _table()


def fold(text: str) -> str:
    """Character by character, so that offsets stay: look-alikes, accents, digits and capitals to small letters."""
    return text.translate(FOLD)


def automaton(entries: Iterable[str], exceptions: tuple[str, ...] = EXCEPTIONS):
    """Finds the entries, whole words or, with a star at the end, beginnings of words, and exception phrases."""
    values: dict[str, list] = {}
    for entry in entries:
        begins = entry.endswith("*")
        values.setdefault(fold(entry.rstrip("*")), [None, None, False])[begins] = entry
    for phrase in exceptions:
        values.setdefault(fold(phrase), [None, None, False])[2] = True
    a = ahocorasick.Automaton()
    for text, (whole, begins, spared) in values.items():
        a.add_word(text, (len(text), whole, begins, spared))
    a.make_automaton()
    return a


def hits(text: str, a, weight: Callable[[str], float]) -> list[tuple[int, int, str]]:
    """(start, end, entry) of the heaviest entry at each start of a word, outside exception phrases.

    A word starts where no letter stands before, and a whole one has none after it; digits and signs beside it are no
    part of a word. Entries without a positive weight are no hits.
    """
    best, spared = {}, []
    for last, (size, whole, begins, exception) in a.iter(fold(text)):
        start, end = last - size + 1, last + 1
        if start and text[start - 1].isalpha():
            continue
        ended = end == len(text) or not text[end].isalpha()
        if exception and ended:
            spared.append((start, end))
        for entry in (begins, whole if ended else None):
            if entry is not None and (w := weight(entry)) > best.get(start, (0, 0.0, ""))[1]:
                best[start] = (end, w, entry)
    reach, j, out = -1, 0, []
    spared.sort()
    for start, (end, _, entry) in sorted(best.items()):
        while j < len(spared) and spared[j][0] <= start:
            reach = max(reach, spared[j][1])
            j += 1
        if reach < end:
            out.append((start, end, entry))
    return out


def features(text: str, found: list[tuple[int, int, str]], weight: Callable[[str], float]) -> tuple[float, float]:
    """Weight of the distinct entries found by the root of the text's length, and the heaviest one's by the fourth root.

    Lengths are in hundreds of words, one more than there are. Clean text has more chance hits the longer it is, but
    each of them is a light one.
    """
    each = [weight(entry) for entry in {entry for _, _, entry in found}]
    length = 1 + len(text.split()) / 100
    return (sum(each) / length**0.5, max(each) / length**0.25) if each else (0.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the intercept, last, is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    w, shrink = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (p - y) + shrink @ w)
    return w


def _words(text: Column) -> Column:
    """Distinct words of three letters and more of the folded text."""
    chars = {chr(k): v for k, v in FOLD.items()}
    words = F.array_distinct(F.split(F.translate(text, "".join(chars), "".join(chars.values())), r"[^\p{L}]+"))
    return F.filter(words, lambda w: F.length(w) >= 3)


def _entries(text: Column) -> Column:
    """Those words, and their beginnings of BEGINNING to LONGEST letters with a star."""
    words = _words(text)
    lengths = lambda w: F.sequence(F.lit(BEGINNING), F.least(F.length(w), F.lit(LONGEST)))
    begun = F.transform(F.filter(words, lambda w: F.length(w) >= BEGINNING), lambda w: F.transform(lengths(w), lambda n: F.concat(w.substr(F.lit(1), n), F.lit("*"))))
    return F.array_distinct(F.concat(words, F.flatten(begun)))


def fit(train_rows: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon weights and the logistic's weights from rows (text, toxic), at most about MAX_FIT_DOCS of them.

    An entry is a folded word or beginning of words; its weight is its smoothed log-odds over distinct texts. It joins the
    fixed lexicon, whose words weigh at least FLOOR, if SUPPORT toxic texts have it and its log-odds reach LEAST_ODDS. There
    is no other bound on them: a text's entries are about its length, and each entry learned stands in SUPPORT texts. The
    logistic, of a text's rate and of its heaviest entry, is fitted with each text's own part in the weights taken back, so
    that it meets texts as unseen ones.
    """
    rows = train_rows.where(F.col("text").isNotNull() & F.col("toxic").isNotNull()).select("text", "toxic")
    rows = rows.groupBy("text").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).cache()
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    fixed = {fold(w) for w in LEXICON}

    def odds(p: int, own: int, out: int = 0, out_toxic: int = 0) -> float:
        """Log-odds of an entry in own texts, p of them toxic, with out texts, out_toxic of them toxic, taken back."""
        return math.log((p - out_toxic + 0.5) / (pos - out_toxic + 1)) - math.log((own - p - out + out_toxic + 0.5) / (n - pos - out + out_toxic + 1))

    # Beginnings and words of toxic texts first: all texts are then searched for these alone.
    toxic = rows.where("toxic > 0").select(F.explode(_entries(F.col("text"))).alias("entry")).groupBy("entry").agg(F.count("*").alias("p")).where(F.col("p") >= SUPPORT).cache()
    few = toxic.count() <= BROADCAST_ENTRIES
    clean = rows.where("toxic = 0").select(F.explode(_entries(F.col("text"))).alias("entry"))
    clean = clean.join(F.broadcast(toxic.select("entry")) if few else toxic.select("entry"), "entry", "left_semi").groupBy("entry").agg(F.count("*").alias("c"))
    likely = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.coalesce("c", F.lit(0)) + 0.5) / (n - pos + 1)) >= LEAST_ODDS
    found = toxic.join(clean, "entry", "left").where(likely | F.col("entry").isin(list(fixed))).select("entry", "p", F.coalesce("c", F.lit(0)).alias("c")).collect()
    counts = {r["entry"]: (r["p"], r["p"] + r["c"]) for r in found}
    toxic.unpersist()
    floor = lambda entry: FLOOR if entry in fixed else 0.0
    weights = dict.fromkeys(fixed, FLOOR) | {e: max(floor(e), odds(*c)) for e, c in counts.items()}
    a = automaton(weights)

    def unseen(toxic: int, words: str) -> Callable[[str], float]:
        """Weights without a text of that label and these words, each between spaces; what is no entry without it has none.

        A hit may begin inside a folded word, after a digit or a sign; the text is then not among that entry's own.
        """

        def weight(entry: str) -> float:
            if entry not in counts:
                return floor(entry)
            p, own = counts[entry]
            out = int((f" {entry[:-1]}" if entry.endswith("*") else f" {entry} ") in words)
            value = odds(p, own, out, out * toxic)
            return max(floor(entry), value if p - out * toxic >= SUPPORT and value >= LEAST_ODDS else 0.0)

        return weight

    def measured(batches):
        for pdf in batches:
            pairs = ((t, unseen(int(y), w)) for t, y, w in zip(pdf["text"], pdf["toxic"], pdf["words"], strict=True))
            both = [features(t, hits(t, a, w), w) for t, w in pairs]
            yield pd.DataFrame({"rate": [x[0] for x in both], "top": [x[1] for x in both], "toxic": pdf["toxic"].astype("int32")})

    spaced = F.concat(F.lit(" "), F.array_join(_words(F.col("text")), " "), F.lit(" "))
    got = rows.withColumn("words", spaced).mapInPandas(measured, "rate double, top double, toxic int").toPandas()
    rows.unpersist()
    # Two priors: clean text without a hit, toxic text with some.
    x = np.vstack([got[["rate", "top"]].to_numpy(float), [[0.0, 0.0]] * 5, [[2.0, 2.0]] * 5])
    y = np.concatenate([got["toxic"].to_numpy(float), [0.0] * 5, [1.0] * 5])
    return weights, _logistic(x, y)


def score(documents: DataFrame, weights: dict[str, float], logistic: np.ndarray) -> DataFrame:
    """documents with toxicity (0 to 1) and n_toxic_hits; other columns stay.

    The automaton is built from what fit() gives, whose size its bounded rows bound. Null and empty texts have no match
    and score as such a text does; very long texts are matched whole.
    """
    plain = {str(k): float(v) for k, v in weights.items()}
    of_rate, of_top, intercept = (float(x) for x in logistic)
    built: dict[str, object] = {}

    @F.pandas_udf("score double, hits int")
    def rated(texts: pd.Series) -> pd.DataFrame:
        a = built.get("a") or built.setdefault("a", automaton(plain))
        out = []
        for t in texts:
            found = hits(t, a, plain.__getitem__) if t else []
            rate, top = features(t, found, plain.__getitem__) if found else (0.0, 0.0)
            z = of_rate * rate + of_top * top + intercept
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(found)))
        return pd.DataFrame(out, columns=["score", "hits"])

    keep = [F.col(f"`{c}`") for c in documents.columns if c not in ("toxicity", "n_toxic_hits")]
    return documents.withColumn("rated_", rated(F.col("text"))).select(
        *keep, F.col("rated_.score").alias("toxicity"), F.col("rated_.hits").alias("n_toxic_hits")
    )


def labelled(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_FIT_DOCS) -> DataFrame:
    """(text, toxic) of at most about max_docs labelled documents, chosen by a hash of the id over all labels.

    One label an id (the highest of repeated ones). The picked labels are counted before they are broadcast; if a
    heavy repetition leaves more than twice the bound, the join is an ordinary one.
    """
    good = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = int(min(1.0, max_docs / max(1, good.count())) * (1 << 20))
    picked = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    side = F.broadcast(picked) if picked.count() <= 2 * max_docs else picked
    return documents.select("doc_id", "text").join(side, "doc_id").select("text", "toxic")
