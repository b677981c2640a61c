"""Requests to a model service: built from tiles, sent once, answers merged."""

import base64
import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from groundshift.functions.text import to_data_url
from groundshift.operators import raster as R
from groundshift.operators.raster import tile_images, tile_pieces
from groundshift.plans.change_run import run_requests

PROVIDERS = [("north", ["n-small", "n-large"], "n-large"), ("south", ["s-one"], "s-one")]


def providers(spark):
    return spark.createDataFrame(PROVIDERS, "provider string, models array<string>, default_model string")


def service():
    """A service that answers with the sizes of both images, refuses one model and rambles about empty images."""
    def make_send():
        def send(request: str) -> str:
            asked = json.loads(request)
            if asked["model"] == "s-one":
                raise PermissionError("403 forbidden")
            blocks = asked["messages"][0]["content"]
            sizes = [len(base64.b64decode(b["source"]["data"])) for b in blocks if b["type"] == "image"]
            if not sizes[0]:
                return "no JSON"
            answer = {"summary": blocks[-1]["text"][-10:], "changes": [
                {"category": "road", "change_type": "added", "description": f"{sizes}", "confidence": "high", "bbox": [0, 0, 1, 1]}]}
            return json.dumps({"content": [{"type": "thinking"}, {"type": "text", "text": f" ```json\n{json.dumps(answer)}\n``` "}]})
        return send
    return make_send


def read_png(body: bytes) -> np.ndarray:
    assert body[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, head = 8, b"", None
    while at < len(body):
        size, kind = struct.unpack(">I4s", body[at:at + 8])
        part = body[at + 8:at + 8 + size]
        assert struct.unpack(">I", body[at + 8 + size:at + 12 + size])[0] == zlib.crc32(kind + part)
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        data += part if kind == b"IDAT" else b""
        at += 12 + size
    w, h, bands = head[0], head[1], {0: 1, 2: 3}[head[3]]
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * bands)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(h, w, bands)


def test_requests_answers_and_rejects(spark, tmp_path):
    rows = [
        (1, 0, b"abc", b"de", "north", "n-small"), (2, 0, b"a", b"", "nobody", "other"), (3, 0, b"a", b"b", "south", None),
        (4, 0, None, b"b", "north", None), (5, 0, b"", b"b", "north", None),
    ]
    data = spark.createDataFrame(rows, "scene_id bigint, task_idx int, a binary, b binary, provider string, model string")
    tasks = data.select(
        "scene_id", "task_idx", *[F.lit(v).alias(n) for n, v in (("gx", 0.0), ("gy", 0.0), ("gw", 0.5), ("gh", 1.0))],
        to_data_url(F.col("a")).alias("reference"), to_data_url(F.col("b")).alias("target"), "provider", "model",
        F.lit("x").alias("reject_note"))
    tasks = tasks.unionByName(tasks.where("scene_id = 1").withColumns({"scene_id": F.lit(6).cast("bigint"), "target": F.lit("http://x")}))
    for answers in (None, str(tmp_path / "answers")):
        run = run_requests(tasks, providers(spark), "north", service(), "de", answers=answers)
        got = {r.scene_id: (r.model, r.failed, r.error_class) for r in run.responses.collect()}
        assert got == {
            1: ("n-small", False, None), 2: ("n-large", False, None), 3: ("s-one", True, "auth"), 4: ("n-large", True, "other"),
            5: ("n-large", True, None), 6: ("n-small", True, "other"),
        }
        changes = {r.scene_id: (r.description, r.w) for r in run.changes.collect()}
        assert changes == {1: ("[3, 2]", 0.5), 2: ("[1, 0]", 0.5)}
        assert {r.scene_id: r.failed for r in run.responses.where("error is not null").collect()} == {3: True, 4: True, 6: True}


def test_tiles_become_images(spark):
    rng = np.random.default_rng(2)
    want = {"earlier": rng.integers(0, 256, (5, 7, 3)), "later": rng.integers(0, 256, (5, 7, 1))}
    rows = [(0, e, k, x, y, float(s[y, x, k])) for e, s in want.items() for y in range(5) for x in range(7) for k in range(s.shape[2])]
    blocks = R.to_blocks(spark.createDataFrame(rows, "scene_id int, epoch string, band int, px int, py int, v double"), 4)
    pieces = tile_pieces(blocks.withColumn("task_idx", F.lit(0)))
    tasks = pieces.select("scene_id", "task_idx", F.lit(7).alias("out_w"), F.lit(5).alias("out_h"), "pieces")
    empty = tasks.withColumns({"scene_id": F.lit(1), "pieces": F.lit(None).cast(tasks.schema["pieces"].dataType)})
    got = {r.scene_id: r for r in tile_images(tasks.unionByName(empty), 4).collect()}
    for name, epoch in (("reference", "earlier"), ("target", "later")):
        url = got[0][name]
        assert url.startswith("data:image/png;base64,")
        assert (read_png(base64.b64decode(url.split(",")[1])) == want[epoch]).all()
    assert got[1].reference is None and got[1].target is None
