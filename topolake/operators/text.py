"""Text about graphs: descriptions, mentions, retrieval, response parsing and name obfuscation."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K

def lines(rows: DataFrame, by: list[str], text: Column, order: list, name: str) -> DataFrame:
    """Each group's texts in order, one a line."""
    held = F.array_sort(F.collect_list(F.struct(*order, text.alias("line"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(held, lambda x: x["line"]), "\n").alias(name))


def schema_text(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, text): tables, then references, then derivations, one a line by name."""
    a = nodes.select("dataset", F.lit(0).alias("part"), F.concat(F.lit("TABLE "), "name").alias("line"))
    word = F.when(F.col("edge_type") == "fk_to", " FK_TO ").otherwise(" DERIVED_FROM ")
    ends = F.when(F.col("edge_type") == "fk_to", F.concat("src", word, "dst")).otherwise(F.concat("dst", word, "src"))
    b = edges.distinct().select("dataset", F.when(F.col("edge_type") == "fk_to", 1).otherwise(2).alias("part"), ends.alias("line"))
    return lines(a.unionByName(b), ["dataset"], F.col("line"), ["part"], "text")


def chunks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, name, text): what each table refers to and is referred to by; an isolated table says so."""
    one = K.directed(edges, "fk_to")
    out = one.select("dataset", F.col("src").alias("name"), F.concat(F.lit("references "), "dst").alias("line"))
    into = one.select("dataset", F.col("dst").alias("name"), F.concat(F.lit("referenced by "), "src").alias("line"))
    held = out.unionByName(into).groupBy("dataset", "name").agg(F.array_join(F.array_sort(F.collect_set("line")), "; ").alias("text"))
    return nodes.select("dataset", "name").join(held, ["dataset", "name"], "left").select("dataset", "name", F.concat("name", F.lit(": "), F.coalesce("text", F.lit("isolated"))).alias("text"))


def _trie(names: list[str]) -> str:
    """A pattern of all names that tries the longest first; its cost at a place is a name's length, however many there are."""
    root: dict = {}
    for name in names:
        at = root
        for c in name:
            at = at.setdefault(c, {})
        at[""] = {}
    # Depth first without recursion: names may be long.
    done: dict[int, str] = {}
    stack = [root]
    while stack:
        node = stack[-1]
        todo = [n for c, n in node.items() if c and id(n) not in done]
        if todo:
            stack += todo
            continue
        stack.pop()
        ways = [re.escape(c) + done[id(n)] for c, n in sorted(node.items()) if c]
        own = ways[0] if len(ways) == 1 and "" not in node else f"(?:{'|'.join(ways)})" + ("?" if "" in node else "") if ways else ""
        done[id(node)] = own
    return done[id(root)]


def _alternation(names: list[str]) -> str:
    """One pattern of all names, the longest first, whole words only; a guard character before is part of the match."""
    return "(^|[^A-Za-z0-9_.])(" + _trie(sorted(set(names))) + ")(?![A-Za-z0-9_])"


def mentions(texts: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """texts with `mentioned`: names found, longest first and each place used once, in order, without repeats."""
    found = F.regexp_extract_all(F.col(text), F.lit(_alternation(names)), F.lit(2)) if names else F.array().cast("array<string>")
    return texts.withColumn("mentioned", F.array_distinct(found))


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 10_000) -> DataFrame:
    """(q, position, id, similarity): the k rows of largest cosine for each query (q, vec) against rows (id, vec).

    Queries are dealt into blocks of about `block`, counted before one is broadcast; each block is scored in one pass
    over the rows, and only k a query and task move on.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    blocks = max(1, -(-queries.count() // block))
    dealt = queries.select("q", F.col("vec").alias("q_vec"), F.pmod(F.xxhash64("q", "vec"), F.lit(blocks)).alias("block_"))
    q, v, w = F.col("q_vec"), F.col("vec"), Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
    out = None
    for turn in range(blocks):
        both = rows.join(F.broadcast(dealt.where(F.col("block_") == turn)), F.size("vec") == F.size("q_vec"))
        scored = both.select("q", "id", F.round(dot(q, v) / F.sqrt(dot(q, q)) / F.sqrt(dot(v, v)), 6).alias("similarity"))
        best = scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)
        out = best if out is None else out.unionByName(best)
    return out.select("q", "position", "id", "similarity")


def leakage(texts: DataFrame, marks: DataFrame, words: int = 4, least: int = 5, block: int = 5_000) -> DataFrame:
    """(doc_id, item_id) of texts (doc_id, text) that hold a mark (item_id, text) of `least` characters or more whole.

    A mark's words but its first and last stand in a text that holds it as words too, between the same blanks. One run
    of `words` of them, the one of least hash, is its anchor: texts are met by the hashes of their runs, and only those
    that share an anchor are searched. Marks too short to have one are searched for in blocks of `block`, in every
    text. Null texts hold nothing; rows that repeat each count.
    """
    split = lambda text: F.split(F.col(text), " ", -1)
    run = lambda at: F.xxhash64(*[F.get("words_", at + i) for i in range(words)])
    every = lambda first, last: F.transform(F.sequence(first, last), run)
    held = marks.where(F.length("text") >= least).groupBy("item_id", F.col("text").alias("mark")).agg(F.count("*").alias("times")).withColumn("words_", split("mark"))
    long = held.where(F.size("words_") >= words + 2).withColumn("anchor", F.array_min(every(F.lit(1), F.size("words_") - 1 - words))).drop("words_")
    runs = texts.where("text IS NOT NULL").select("doc_id", split("text").alias("words_")).where(F.size("words_") >= words + 2)
    runs = runs.select("doc_id", F.explode(F.array_distinct(every(F.lit(1), F.size("words_") - 1 - words))).alias("anchor"))
    met = runs.join(long, "anchor").select("doc_id", "item_id", "mark", "times").distinct()
    out = texts.withColumnRenamed("doc_id", "id_").join(met, F.col("id_").eqNullSafe(F.col("doc_id"))).where(F.contains("text", "mark")).select("doc_id", "item_id", "times")
    short = held.where(F.size("words_") < words + 2).select("item_id", "mark", "times", F.xxhash64("mark").alias("h_"))
    blocks = -(-short.count() // block)
    for turn in range(blocks):
        part = F.broadcast(short.where(F.pmod("h_", F.lit(blocks)) == turn))
        out = out.unionByName(texts.join(part, F.contains("text", "mark")).select("doc_id", "item_id", "times"))
    return out.select("doc_id", "item_id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time_")).drop("time_")


def _balanced(text: str, depth: int = 3) -> list[str]:
    """Top-level {...} parts of at most `depth` levels, the longest first."""
    found, level, start, deepest = [], 0, 0, 0
    for i, c in enumerate(text):
        if c == "{":
            start, level = (i, 1) if level == 0 else (start, level + 1)
            deepest = max(deepest, level) if level > 1 else 1
        elif c == "}" and level:
            level -= 1
            if level == 0 and deepest <= depth:
                found.append(text[start : i + 1])
    return sorted(found, key=len, reverse=True)


# Where a reply's thinking, fenced parts, cut lists and stated answers lie, and how much of it is kept.
THINKING, FENCED, CUT_LIST, QUOTED = r"(?s)<think>.*?</think>", r"(?s)```(?:json)?\s*(.*?)```", r'(?s)"answer_list"\s*:\s*\[(.*)', r'"([^"]+)"'
STATED, STATED_LENGTH, RAW_LENGTH = r"(?i)\banswer\s*(?:is|:)\s*(\S[^\n]*)", 200, 300


def recover_json(text: str | None) -> str | None:
    """The JSON object in a reply: itself, fenced, the longest braced part, a list cut short, a stated answer, or raw text."""
    if text is None:
        return None
    body = re.sub(THINKING, "", text).strip()
    fenced = re.findall(FENCED, body)
    for part in [body, *fenced, *_balanced(body)]:
        try:
            value = json.loads(part)
        except ValueError:
            continue
        if isinstance(value, dict):
            return json.dumps(value, sort_keys=True)
    if cut := re.search(CUT_LIST, body):
        return json.dumps({"answer_list": re.findall(QUOTED, cut[1])})
    if said := re.search(STATED, body):
        return json.dumps({"answer": said[1].strip().rstrip(".")[:STATED_LENGTH]})
    return json.dumps({"answer": body[:RAW_LENGTH]})


def recovered(text: str) -> Column:
    """recover_json of a column: brace matching has no column expression."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(recover_json, na_action="ignore")

    return run(F.col(text))


def typed_answer(parsed: Column, answer_type: Column) -> Column:
    """struct(text, list) of a recovered object: list items that are objects read table:row_k; unordered lists sorted."""
    item = F.from_json(parsed, "answer string, answer_list array<string>")
    ref = lambda x: F.coalesce(F.concat(F.get_json_object(x, "$.table"), F.lit(":row_"), F.get_json_object(x, "$.row")), x)
    listed = F.transform(item["answer_list"], ref)
    return F.struct(item["answer"].alias("text"), F.when(answer_type == "list", F.array_sort(listed)).otherwise(listed).alias("list"))


def obfuscation(nodes: DataFrame, seed: str = "42") -> DataFrame:
    """(dataset, original, obfuscated): Table_A..Z, then with a number, by a hashed order: one to one in a dataset."""
    w = Window.partitionBy("dataset").orderBy(F.md5(F.concat_ws(":", "name", F.lit(seed))), "name")
    i = F.row_number().over(w) - 1
    letter = F.concat(F.lit("Table_"), F.char(65 + i % 26), F.when(i >= 26, (i / 26).cast("int").cast("string")).otherwise(""))
    return nodes.select("dataset", F.col("name").alias("original"), letter.alias("obfuscated"))


def obfuscate(texts: DataFrame, mapping: dict[str, str], column: str = "text") -> DataFrame:
    """texts with whole names replaced, longest first, in one pass: matches and what lies between, put together again."""
    pattern = _alternation(list(mapping)).replace("(^|[^A-Za-z0-9_.])", "(?<![A-Za-z0-9_.])")
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    gaps, found = F.split(F.col(column), pattern, -1), F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))
    put = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.try_element_at(table, m), F.lit(""))))
    return texts.withColumn(column, F.array_join(put, ""))


def solvable(questions: DataFrame) -> DataFrame:
    """questions (id, text, answer_type, n_answers) with flags: names a table, not too long an answer, ends as a question."""
    flags = F.array(
        F.when(~F.col("text").rlike(r"[A-Za-z]+_[A-Za-z]+"), "no table named"), F.when(F.col("n_answers") > 50, "too many answers"), F.when(~F.col("text").endswith("?"), "not a question")
    )
    return questions.withColumn("flags", F.array_compact(flags))
