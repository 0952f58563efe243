"""Main text of web pages: blocks labelled by a recurrent network that reads the whole page in both directions."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labeller
from .blocks import WORD_BUCKETS, blocks, path_buckets, stats, word_buckets
from .common import text_batches, wrapped

TRAIN_PAGES, TRAIN_BLOCKS, MADE_PAGES, CELLS = 250, 300, 2_000, 40_000

# How markup usually names the parts of a page, and what stands in those that are not its article.
ARTICLE = ("article", "main")
BODY_NAMES = ("content", "post", "entry", "article", "story", "body", "text", "main", "page", "prose", "blog", "news", "detail")
PARTS = {
    "nav": ("nav", "menu navbar navigation breadcrumb breadcrumbs topbar toc pagination links tabs", "Home|About|Contact|News|Products|Startseite|Kontakt|Accueil|Inicio|Blog|Next|Previous|Search|Archive"),
    "header": ("header", "header masthead banner brand logo site top tagline", "The daily site|Welcome|Sign in|Register|Your account|Willkommen|Bienvenue"),
    "footer": ("footer", "footer bottom copyright legal colophon imprint", "© 2024 All rights reserved.|Privacy policy|Terms of use|Impressum|Mentions légales|Aviso legal|Powered by"),
    "aside": ("aside", "sidebar side aside widget related recommended popular trending rail teaser more", "Related articles|Most read|You may also like|Tags|Categories|Recent posts|Mehr zum Thema|À lire aussi"),
    "notice": ("div", "cookie cookies consent notice gdpr alert modal popup overlay paywall toast", "We use cookies to improve your experience.|Accept all|Reject|This site uses cookies.|Diese Seite verwendet Cookies.|Ce site utilise des cookies."),
    "ad": ("div", "ad ads advert advertisement sponsored sponsor promo promotion banner commercial adsense", "Advertisement|Sponsored|Buy now and save 50%|Anzeige|Publicité|Publicidad|Shop the sale today!"),
    "form": ("form", "form newsletter subscribe signup login search contact", "Subscribe to our newsletter|Your email|Send|Submit|Name|Password|Abonnieren|S'inscrire"),
    "comments": ("section", "comments comment discussion replies reply disqus responses respond thread", "3 comments|Reply|Great post, thanks!|Log in to comment|I do not agree.|Kommentare|Commentaires|Anonymous says"),
    "share": ("div", "share social follow sharing buttons toolbar meta byline author", "Share|Tweet|Follow us|Email this|Print|Teilen|Partager"),
}
# The tags that say by themselves that something is not the article.
OUTSIDE = frozenset({"nav", "header", "footer", "aside", "form", "button", "dialog", "menu"})


def _known(path: tuple[str, ...]) -> bool | None:
    """What plain markup says of a block: in an article or main and in nothing else, or not; None of a page without either."""
    for name in ARTICLE:
        if name in path:
            inner = path[path.index(name) + 1 :]
            odd = {"." + w for _, names, _ in PARTS.values() for w in names.split()}
            return not OUTSIDE & set(inner) and not odd & set(inner) and name not in inner
    return False


def _features(text: str, linked: float) -> tuple[np.ndarray, list[float]]:
    return word_buckets(text), stats(text, linked)


def _examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages with an article or main in plain markup: of each block its path, what it is, and its features."""
    for pdf in batches:
        for html in pdf["html"]:
            found = blocks(html or "")
            if 0 < len(found) <= TRAIN_BLOCKS and any(t in p for p, _, _ in found for t in ARTICLE):
                each = [_features(t, x) for _, t, x in found]
                yield pd.DataFrame([{
                    "paths": ["\n".join(p) for p, _, _ in found], "truth": [bool(_known(p)) for p, _, _ in found],
                    "words": np.concatenate([w for w, _ in each]), "stats": np.concatenate([s for _, s in each]).astype(np.float32),
                }])


def _made_page(r: random.Random, texts: list, rest: list) -> list:
    """Blocks (path, features, truth) of a page with parts in usual order and markup, from blocks of real pages."""
    root = ("html", "body", *(("div", "." + r.choice(["wrapper", "container", "page", "layout", "app", "x"])) if r.random() < 0.5 else ()))

    def names(words: str | tuple) -> tuple[str, ...]:
        words = words.split() if isinstance(words, str) else words
        picked = r.sample(list(words), r.choice([1, 1, 1, 2]))
        return tuple("." + w for w in dict.fromkeys(picked + ([r.choice(["box", "wrap", "inner", "list", "item", "block", "area"])] if r.random() < 0.3 else [])))

    def part(kind: str, base: tuple = root) -> list:
        tag, words, phrases = PARTS[kind]
        plain = r.random()
        path = (*base, tag, *(names(words) if plain < 0.5 else ())) if plain < 0.65 and tag != "div" else (*base, r.choice(["div", "div", "section", "ul", "table"]), *names(words))
        out = []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8])):
            leaf = r.choice([(), ("p",), ("ul", "li"), ("div",), ("h3",), ("span",), ("div", "p")] + ([("article", ".comment"), ("li", "p"), ("article", "p")] if kind == "comments" else [("label",), ("button",)] if kind == "form" else []))
            leaf = tuple(x for x in leaf if x != "span")
            roll = r.random()
            own = r.choice(rest) if rest and roll < 0.3 else r.choice(texts) if roll < (0.7 if kind in ("comments", "aside", "ad", "notice") else 0.45) else _features(r.choice(phrases.split("|")), float(kind == "nav" or r.random() < 0.3))
            out.append(((*path, *leaf), own, False))
        return out

    style = r.random()
    body = (*root, "article") if style < 0.35 else (*root, "main") if style < 0.5 else (*root, "main", "article") if style < 0.6 else (*root, r.choice(["div", "div", "section"]), *names(BODY_NAMES))
    if style < 0.6 and r.random() < 0.4:
        body = (*body, *names(BODY_NAMES))
    if r.random() < 0.4:
        body = (*body, "div", *(names(BODY_NAMES) if r.random() < 0.6 else ()))
    out = []
    for kind, share in (("notice", 0.3), ("header", 0.5), ("nav", 0.8), ("ad", 0.4), ("aside", 0.2)):
        if r.random() < share:
            out += part(kind)
    head = [(*body, "header", "h1") if r.random() < 0.15 and style < 0.6 else (*body, "h1")]
    if r.random() < 0.85:
        out.append((head[0], r.choice(texts), True))
    for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
        leaf = r.choice([("p",)] * 8 + [("h2",), ("ul", "li"), ("blockquote", "p"), ("pre",), ("figure", "figcaption"), ("table", "tr", "td"), ()])
        out.append(((*body, *leaf), r.choice(texts), True))
        if r.random() < 0.18:
            out += part(r.choice(["ad", "ad", "share", "aside", "form", "notice"]), body)
    for kind, share in (("share", 0.2), ("comments", 0.4), ("aside", 0.35), ("form", 0.3), ("ad", 0.3), ("nav", 0.15), ("footer", 0.8)):
        if r.random() < share:
            out += part(kind, body if kind in ("share", "comments") and r.random() < 0.5 else root)
    return out


def train(pages: DataFrame, most: int = TRAIN_PAGES, made: int = MADE_PAGES, seed: int = 7) -> dict[str, np.ndarray]:
    """The labeller, fitted on at most `most` pages whose plain markup tells what is what and on made ones of their blocks.

    The pages are those of the least hashes; one of more than TRAIN_BLOCKS blocks is not learned from. Made pages name
    and order their parts in many ways, and mix real blocks with usual phrases, so that names alone do not decide; some
    blocks' words are left out, so that words alone do not either.
    """
    some = pages.where("html is not null").select("html").withColumn("h", F.xxhash64("html")).orderBy("h").limit(most).select("html")
    found = some.mapInPandas(_examples, "paths array<string>, truth array<boolean>, words array<float>, stats array<float>").collect()
    real = []
    for row in found:
        n = len(row["paths"])
        each = zip(np.array(row["words"]).reshape(n, -1), np.array(row["stats"]).reshape(n, -1), strict=True)
        real.append([(tuple(p.split("\n")) if p else (), f, t) for p, f, t in zip(row["paths"], each, row["truth"], strict=True)])
    texts = [f for page in real for _, f, t in page if t] or [_features("Some words of an article, and more of them.", 0.0)]
    rest = [f for page in real for _, f, t in page if not t]
    r = random.Random(seed)
    examples, unread = [], np.zeros(WORD_BUCKETS, np.float32)
    for page in [*real, *[_made_page(r, texts, rest) for _ in range(made)]]:
        examples.append(([path_buckets(p) for p, _, _ in page], np.array([unread if r.random() < 0.4 else f[0] for _, f, _ in page]), np.array([f[1] for _, f, _ in page]), np.array([float(t) for _, _, t in page])))
    return labeller.fit(examples, seed=seed)


def _labels(model: dict, pages: list[list]) -> list[np.ndarray]:
    """For each page's blocks whether they are of the article; pages of like length are read together."""
    out, known = [np.zeros(0, bool)] * len(pages), {}
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(pages[order[end]]) <= CELLS:
            end += 1
        own = order[at:end]
        flat = [b for i in own for b in pages[i]]
        for p, _, _ in flat:
            if p not in known:
                known[p] = path_buckets(p)
        z = labeller.embedded(model, [known[p] for p, _, _ in flat], np.array([word_buckets(t) for _, t, _ in flat]), np.array([stats(t, x) for _, t, x in flat]))
        sizes = np.array([len(pages[i]) for i in own])
        for i, part in zip(own, np.split(labeller.logits(model, z, sizes)[0] > 0, np.cumsum(sizes)[:-1]), strict=True):
            out[i] = part
        at = end
    return out


def extract(pages: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """pages with `text`, the blocks of the article in page order joined by line feeds, in the place of `html`.

    Every page is read whole. Defined cases: a null or empty page, or one without a block of an article, has an empty
    text; markup may be broken anywhere; repeated rows are read each; an empty table gives no rows; other columns stay,
    a column called text excepted.
    """
    text_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.items()})

    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        found = [blocks(x) if x else [] for x in html]
        kept = _labels(shared.value, found)
        return pd.Series(["\n".join(t for (_, t, _), k in zip(page, own, strict=True) if k) for page, own in zip(found, kept, strict=True)], dtype=object)

    names = [c for c in pages.columns if c not in ("html", "text")]
    held = wrapped(pages, "html").withColumn("text", main_text(F.col("html")))
    placed = [f"row_{i}_" for i, c in enumerate(pages.columns) if c in names]
    return held.select(*[F.col(p).alias(c) for p, c in zip(placed, names, strict=True)], "text")
