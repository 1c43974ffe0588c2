"""Late data in streams; broken bytes in scans."""

import base64
import struct

from pyspark.sql import functions as F

from tilewright.sources import tiles
from tilewright.streaming import jobs


def test_late_events_are_left_out(spark, tmp_path):
    src = f"{tmp_path}/e"
    row = "struct(id as event_id, cast('2024-01-01 00:00:00' as timestamp) + make_interval(0, 0, 0, 0, 0, {m}, 0) as ts, 'succeeded' as event) as s"
    for k, m in enumerate((0, 60, 61, 5)):  # the last file is 56 minutes late, the allowed delay is 10; a batch's watermark drops rows from the second batch after it on
        spark.range(k, k + 1).selectExpr(row.format(m=m)).select("s.*").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("event_id long, ts timestamp, event string").option("maxFilesPerTrigger", 1).parquet(src)
    got = jobs.latest(jobs.run_available(jobs.throughput(stream), "update", where=f"file://{tmp_path}/out"), "minute")
    assert sorted(r["minute"].minute for r in got.collect()) == [0, 0, 1]


def test_an_empty_stream_gives_an_empty_table(spark, tmp_path):
    src = f"{tmp_path}/none"
    spark.createDataFrame([], "event_id long, ts timestamp, event string").write.parquet(src)
    stream = spark.readStream.schema("event_id long, ts timestamp, event string").parquet(src)
    assert jobs.run_available(stream, where=f"file://{tmp_path}/out").count() == 0


def test_catalogue_names_the_first_broken_rule(spark):
    good = b"b3dm" + struct.pack("<6I", 1, 28 + 20 + 12, 20, 0, 0, 0) + b" " * 20 + b"glTF" + struct.pack("<2I", 2, 12)
    rows = [(0, good), (1, None), (2, b"b3dm"), (3, good[:-1]), (4, good[:48] + b"glTX" + good[52:]), (5, good[:4] + struct.pack("<I", 2) + good[8:])]
    out = tiles.catalogue(spark.createDataFrame(rows, "id int, content binary"))
    assert {r["id"]: r["code"] for r in out.collect()} == {0: "OK", 1: "TOO_SHORT", 2: "TOO_SHORT", 3: "BAD_LENGTH", 4: "BAD_INNER", 5: "BAD_VERSION"}


def test_rings_of_both_byte_orders_and_broken_texts(spark):
    def polygon(o, *rings):
        return struct.pack(o + "BII", o == "<", 3, len(rings)) + b"".join(struct.pack(o + "I", len(r)) + b"".join(struct.pack(o + "dd", *p) for p in r) for r in rings)

    square, hole = [(0, 0), (4, 0), (4, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    many = struct.pack("<BIII", 1, 6 | tiles.SRID_FLAG, 4490, 2) + polygon(">", square, hole) + polygon("<", square)
    rows = [(0, base64.b64encode(polygon(">", square)).decode()), (1, base64.b64encode(many).decode()), (2, "not base64!"), (3, None), (4, base64.b64encode(polygon("<", square) + b"x").decode())]
    out = tiles.scope_rings(spark.createDataFrame(rows, "id long, wkb string"), "id")
    seen = out.groupBy("id").agg(F.count("lon").alias("n"), F.max("fault").alias("fault"), F.max("srid").alias("srid")).collect()
    assert sorted((r["id"], r["n"], r["fault"], r["srid"]) for r in seen) == [(0, 4, None, None), (1, 12, None, 4490), (2, 0, "WKB", None), (3, 0, "WKB", None), (4, 0, "WKB", None)]


def test_mesh_faults(spark):
    v = struct.pack("<6f", 1, 2, 3, 4, 5, 6)
    rows = [(0, '{"count":2,"offset":0}', v), (1, '{"count":3,"offset":0}', v), (2, "{", v), (3, None, None), (4, '{"count":1,"offset":0}', struct.pack("<3f", 1, float("nan"), 1))]
    out = tiles.mesh(spark.createDataFrame(rows, "id long, layout string, content binary"), "id").collect()
    assert sorted((r["id"], r["x"] or 0.0, r["fault"] or "") for r in out) == [(0, 1.0, ""), (0, 4.0, ""), (1, 0.0, "RANGE"), (2, 0.0, "LAYOUT"), (3, 0.0, "LAYOUT"), (4, 0.0, "NOT_FINITE")]


def test_accessors_of_every_kind_and_their_faults(spark):
    import json

    from tilewright.sources import accessors

    def one(n=3, stride=None, length=None, kind=5126, at=0, **more):
        return {"count": n, "componentType": kind, "length": 36 if length is None else length, "at": at, "stride": stride, **more}

    raw = struct.pack("<9f", *range(9)) + bytes([2, 1, 0, 0])
    short = {"count": 3, "componentType": 5121, "offset": 36, "length": 3}
    cases = {
        0: ({"attributes": {"POSITION": one()}, "indices": short}, None), 1: ({"attributes": {"POSITION": one()}}, None), 2: ({"attributes": {"POSITION": one(stride=8)}}, "STRIDE"), 3: ({"attributes": {"POSITION": one(stride=14)}}, "STRIDE"),
        4: ({"attributes": {"POSITION": one(n=2, stride=256)}}, "STRIDE"), 5: ({"attributes": {"POSITION": one(n=0)}}, "COUNT"), 6: ({"attributes": {"POSITION": one(n=4)}}, "RANGE"), 7: ({"attributes": {"POSITION": one(length=400, n=4)}}, "RANGE"),
        8: ({"attributes": {"POSITION": one(kind=5123)}}, "TYPE"), 9: ({"attributes": {"NORMAL": one()}}, "NO_POSITION"), 10: ({"attributes": {"POSITION": one(sparse={"a": 1})}}, "UNSUPPORTED"), 11: ({"attributes": {"POSITION": one(), "TANGENT": one()}}, "UNSUPPORTED"),
        12: ({"attributes": {"POSITION": one(), "NORMAL": one(n=2)}}, "COUNTS_DIFFER"), 13: ({}, "LAYOUT"), 14: ({"attributes": {"POSITION": {"count": "x"}}}, "TYPE"), 15: ({"attributes": {"POSITION": one(normalized=True)}}, "UNSUPPORTED"),
    }
    rows = [(k, json.dumps(layout), raw) for k, (layout, _) in cases.items()] + [(20, "{", raw), (21, None, raw), (22, json.dumps(cases[0][0]), None), (23, json.dumps(cases[0][0]), struct.pack("<9f", *[float("inf")] * 9) + b"\0\0\0\0")]
    faults = {k: f for k, (_, f) in cases.items()} | {20: "LAYOUT", 21: "LAYOUT", 22: "LAYOUT", 23: "NOT_FINITE"}
    df = spark.createDataFrame(rows, "id long, layout string, content binary")
    got = accessors.vertices(df, "id").collect()
    assert {r.id: r.fault for r in got} == faults
    assert sorted((r.id, r.vid, tuple(r.position)) for r in got if not r.fault) == [(k, v, (3.0 * v, 3.0 * v + 1, 3.0 * v + 2)) for k in (0, 1) for v in range(3)]
    tri = accessors.index(df, "id").collect()
    assert {r.id: r.fault for r in tri} == faults and sorted((r.id, r.i0, r.i1, r.i2) for r in tri if not r.fault) == [(0, 2, 1, 0), (1, 0, 1, 2)]
    large = spark.createDataFrame([(1, json.dumps({"attributes": {"POSITION": one(n=200_001, length=12 * 200_001)}}), bytes(12 * 200_001))], "id long, layout string, content binary")
    assert accessors.vertices(large, "id").agg(F.count("*"), F.max("vid")).first()[:] == (200_001, 200_000) and accessors.index(large, "id").count() == 66_667
