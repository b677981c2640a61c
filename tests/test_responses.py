import json
import math

import pytest
from pyspark.sql import functions as F

from groundshift.functions import data_url_parts, first_text, interpolate, strip_fences, to_data_url
from groundshift.operators import responses as RE


def parse(spark, texts):
    rows = [(i, t, None) for i, t in enumerate(texts)]
    return RE.parse_responses(spark.createDataFrame(rows, "k int, raw_text string, error string"))


OK = [
    '5', '"text"', 'true', '[1, 2]', '{}', '{"changes":null}', '{"changes":[]}', '  {"summary":"s"} \n',
    '```json\n{"changes":[]}\n```', '```{"changes":[]}```', '{"a":1,"a":2}', '{"summary":"x","summary":"y"}',
]
BAD = [
    '', 'not json', 'null', '{"changes":{}}', '{"changes":"x"}', '{"changes":5}', '{"changes":false}',
    '{"changes":[null]}', '{"changes":[1,null]}', '{"a":1} x', "{'a':1}", '{"a":01}', '{"a":1},{"b":2}',
    '{"a":1', '{"a":NaN}', '```js\n{}\n```', '{"a":1}]', '{"a":1}] x', '1],[2', '5]', '[', None, '{"a":"line\nbreak"}',
]


@pytest.mark.parametrize("texts,failed", [(OK, False), (BAD, True)])
def test_strictness(spark, texts, failed):
    rows = {r.k: r for r in parse(spark, texts).collect()}
    assert [i for i in rows if rows[i].failed != failed] == []
    assert all((r.failure is not None) == failed for r in rows.values())


def test_failure_keeps_an_excerpt(spark):
    row = parse(spark, ["x" * 1000]).first()
    assert row.failure == "Detector did not return valid JSON. Raw: " + "x" * 300


def test_call_error_wins(spark):
    df = spark.createDataFrame([('{"changes":[{}]}', "boom")], "raw_text string, error string")
    row = RE.parse_responses(df).first()
    assert row.failed and row.failure == "boom" and row.changes is None and row.summary == ""


def test_summary_values(spark):
    texts = ['{"summary":"a"}', '{"summary":null}', '{"summary":0}', '{"summary":false}', '{"summary":12}',
             '{"summary":""}', '{"summary":"0"}', '{"summary":"x","summary":"y"}']
    got = [r.summary for r in parse(spark, texts).orderBy("k").collect()]
    assert got == ["a", "", "", "", "12", "", "0", "y"]


def changes(spark, entries):
    text = json.dumps({"changes": entries})
    rows = RE.normalise_changes(RE.explode_changes(parse(spark, [text]))).orderBy("pos").collect()
    return [(r.category, r.change_type, r.description, r.confidence, (r.x, r.y, r.w, r.h)) for r in rows]


def test_field_defaults(spark):
    got = changes(spark, [
        {}, 5, "word", [], {"category": None, "change_type": "added", "confidence": "high", "description": None},
        {"category": "silo", "change_type": "ADDED", "confidence": 3}, {"category": 5, "change_type": ["added"]},
    ])
    blank = ("other", "modified", "", "medium", (0.0, 0.0, 0.0, 0.0))
    assert got[:4] == [blank] * 4
    assert got[4][:4] == ("other", "added", "", "high")
    assert got[5][:4] == ("silo", "modified", "", "medium")
    assert got[6][:2] == ("5", "modified")


@pytest.mark.parametrize("bbox,expected", [
    ([0.25, 0.25, 0.5, 0.5], (0.25, 0.25, 0.5, 0.5)),
    ([-1, 2, 3, 4, 9], (0.0, 1.0, 1.0, 0.0)),
    ([0.5, "0.25", None, True], (0.5, 0.25, 0.0, 0.75)),
    ("x", (0.0, 0.0, 0.0, 0.0)),
    ({"x": 1}, (0.0, 0.0, 0.0, 0.0)),
    ([0.5], (0.5, 0.0, 0.0, 0.0)),
    (["1d", 0.5, 0.5, 0.5], (0.0, 0.5, 0.0, 0.5)),
    ([0.5, "abc", 0.25, 0.5], (0.5, 0.0, 0.25, 0.0)),
    (["", " 0.5 ", "0x1", "1e-1"], (0.0, 0.5, 1.0, 0.1)),
    ([0.25, 0.25, "no", 0.5], (0.25, 0.25, 0.0, 0.5)),
    ([[], [0.5], [0.25], ["0.25"]], (0.0, 0.5, 0.25, 0.25)),
    ([[0.1, 0.2], 0.5, 0.5, 0.5], (0.0, 0.5, 0.0, 0.5)),
    (["Infinity", 0, 1, 1], (1.0, 0.0, 0.0, 1.0)),
    ([False, True, 0.5, 0.5], (0.0, 1.0, 0.5, 0.0)),
])
def test_bbox_coercion(spark, bbox, expected):
    assert changes(spark, [{"bbox": bbox}])[0][4] == pytest.approx(expected)


def test_positions_and_local_ids(spark):
    parsed = parse(spark, ['{"changes":[{},{},{}]}', '{"changes":[]}'])
    rows = RE.with_local_id(RE.explode_changes(parsed)).orderBy("pos").collect()
    assert [(r.k, r.pos, r.id) for r in rows] == [(0, 0, "chg-1"), (0, 1, "chg-2"), (0, 2, "chg-3")]


def test_parsing_happens_once(spark):
    plan = RE.explode_changes(parse(spark, ["{}"]).where("not failed"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1


def test_auth_classification(spark):
    rows = [(401, "x"), (500, "HTTP 403 there"), (500, "code 4031"), (500, "API key NOT valid"), (None, "Permission"),
            (200, None), (500, "reset"), (403, "y")]
    df = spark.createDataFrame(rows, "http_status int, error string")
    got = [r.error_class for r in RE.classify_errors(df).collect()]
    assert got == ["auth", "auth", "other", "auth", "auth", None, "other", "auth"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("﻿ a  ",)], "t string")
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("t").alias("text")))
    row = df.select(
        first_text(blocks).alias("a"),
        strip_fences(F.lit("  plain ")).alias("b"), strip_fences(F.lit(" ```\n```x``` \n``` ")).alias("c"),
        data_url_parts(F.lit("data:image/png;base64,AA\nBB;base64,C")).alias("d"),
        data_url_parts(F.lit("data:image/png,AA")).alias("e"), data_url_parts(F.lit("data:image/;base64,AA")).alias("f"),
        to_data_url(F.encode(F.lit("z" * 300), "utf-8")).alias("g"),
        interpolate(F.lit("{n} of {total} {n} {x} $1"), {"n": F.lit(3), "total": F.lit("{n}\\")}).alias("h"),
    ).first()
    assert row.a == "a" and row.b == "  plain " and row.c == "```x```"
    assert tuple(row.d) == ("image/png", "AA\nBB;base64,C") and row.e is None and row.f is None
    assert "\n" not in row.g and len(row.g) == len("data:image/jpeg;base64,") + 400
    assert row.h == "3 of {n}\\ 3 {x} $1"


def test_request_body(spark):
    df = spark.createDataFrame([("m", ("image/png", "QQ=="), ("image/jpeg", "Qg=="))],
                               "resolved_model string, earlier struct<media_type:string,data:string>,"
                               " later struct<media_type:string,data:string>")
    plain = json.loads(RE.build_requests(df).first().request_json)
    german = json.loads(RE.build_requests(df, "de").first().request_json)
    blocks = plain["messages"][0]["content"]
    assert [b["type"] for b in blocks] == ["text", "image", "text", "image", "text"]
    assert blocks[1]["source"] == {"type": "base64", "media_type": "image/png", "data": "QQ=="}
    assert german["messages"][0]["content"][4]["text"] == blocks[4]["text"] + RE.RequestText().language_suffix["de"]
    assert plain["output_config"]["format"]["schema"] == RE.response_schema()
    assert math.isclose(plain["max_tokens"], 8000)
