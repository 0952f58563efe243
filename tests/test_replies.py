"""Replies as VARIANT against the plain recovery, and answers by type."""

import json

from pyspark.sql import functions as F

from topolake.operators import replies as R
from topolake.operators import text as X

REPLIES = [
    '{"answer": 5}', ' \n{"answer": [1, 2]}\n', 'Sure:\n```json\n{"answer": "yes"}\n```', "```\n[1]\n```\n```\n{\"a\": 1}\n```", 'so {"a": {"b": 1}} or {"c": 2}', '{"a": {"b": {"c": {"d": 1}}}} x {"e": 1}',
    '{"answer_list": ["x", "y", "z', "<think>{\"answer\": 1}</think>The answer is 7.", "ANSWER: yes... ", "no idea", "", "   ", "{", "}{", '{"answer": "é\\u00e9 😀"}', '{"a": 1, "a": 2}', "[1, 2]", "5", '"text"',
    "null", "answer is", "x" * 1000, '{"answer": 1e400}', 'say {"x": "}"} then', "answer: " + "y" * 500, '{"answer_list": []', "<think>open", '{"answer": ' + '"' + "z" * 50000 + '"}', "the answer is\n7",
]


def test_variant_holds_what_the_plain_recovery_finds(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(REPLIES)], "id int, text string")
    for r in rows.select("id", F.to_json(R.recovered(F.col("text"))).alias("got")).collect():
        want = json.loads(X.recover_json(REPLIES[r["id"]]))
        if "1e400" not in REPLIES[r["id"]]:
            assert json.loads(r["got"]) == want, REPLIES[r["id"]][:80]


def test_null_replies_and_no_replies(spark):
    rows = spark.createDataFrame([(None,)], "text string").select(R.recovered(F.col("text")).alias("v"))
    assert rows.where("v IS NULL").count() == 1
    assert rows.limit(0).count() == 0


def test_answers_by_type(spark):
    cases = [
        ('{"answer": 5}', "integer", ("integer", "5", None)), ('{"answer": 1.5}', "integer", ("number", "1.5", None)), ('{"answer": true}', "boolean", ("boolean", "true", None)),
        ('{"answer": null}', "string", ("null", None, None)), ('{"other": 1}', "string", (None, None, None)), ('{"answer": ["b", "a", null]}', "list", ("list", '["b","a",null]', ["a", "b"])),
        ('{"answer_list": ["y", {"table": "x", "row": 2}, 3]}', "list", (None, None, ["3", "x:row_2", "y"])), ('{"answer_list": ["b", "a"]}', "ordered_list", (None, None, ["b", "a"])),
        ('{"answer_list": "one"}', "list", (None, None, ["one"])), ('{"answer_list": [{"k": [1]}, [2]]}', "path", (None, None, ['{"k":[1]}', "[2]"])), ('{"answer_list": null}', "list", (None, None, None)),
    ]
    rows = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(cases)], "id int, text string, answer_type string")
    for r in rows.select("id", R.typed(R.recovered(F.col("text")), F.col("answer_type")).alias("t")).collect():
        assert (r["t"]["kind"], r["t"]["text"], r["t"]["list"]) == cases[r["id"]][2], cases[r["id"]][0]
