"""Folders of files to accepted and refused rows, and tables that are written a batch at a time."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tilewright.plans import intake
from tilewright.sources import folders, sinks


def test_refused_sizes_cost_no_content(spark, tmp_path):
    os.makedirs(f"{tmp_path}/deep")
    for name, content in (("a.b3dm", b"b3dm"), ("deep/b.b3dm", b"x" * 100), ("c.b3dm", b""), ("d.txt", b"y")):
        (tmp_path / name).write_bytes(content)
    good, bad = folders.tile_files(spark, str(tmp_path), most=50)
    assert [(os.path.basename(r.path), r.length, bytes(r.content)) for r in good.collect()] == [("a.b3dm", 4, b"b3dm")]
    assert sorted((r.item, r.code, r.detail) for r in bad.collect()) == [("b.b3dm", "SIZE", "100")]
    expected = spark.createDataFrame([("a.b3dm",), ("b.b3dm",), ("c.b3dm",), ("e.b3dm",)], "item string")
    assert sorted((r.item, r.code) for r in folders.absent(expected, good, bad).collect()) == [("c.b3dm", "ABSENT"), ("e.b3dm", "ABSENT")]
    plan = good._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,50)" in plan and "GreaterThanOrEqual(length,1)" in plan
    scan = [line for line in bad._jdf.queryExecution().toString().split("Physical Plan")[1].splitlines() if "ReadSchema" in line]
    assert scan and all("content" not in line.split("ReadSchema")[1] for line in scan)


def task(**changes):
    body = {
        "assetId": "a", "leaseToken": "t", "leaseExpireTime": "", "sourceDownloadUrl": "u", "sourceEtag": "", "outputUploadUrl": "o", "scopeWkbBase64": "AQ==", "scopeSrid": 4490, "gltfUpAxis": "Z", "contentFormat": "b3dm",
        "worldTransform": [1.5] + list(range(15)), "clipOptions": {"maskTextures": True, "compactFeatureMetadata": True, "capSurface": False},
    }
    body.update(changes)
    return json.dumps({k: v for k, v in body.items() if v is not ...})


TASKS = [
    (task(assetId="ok"), None), (task(assetId="y", gltfUpAxis="Y", surplus=[1]), None), (task(worldTransform=[1, 0, 0]), "MATRIX_SHAPE worldTransform"), (task(gltfUpAxis=...), "MISSING_FIELD gltfUpAxis"), (task(gltfUpAxis="X"), "UNKNOWN_VALUE gltfUpAxis"),
    (task(gltfUpAxis="z"), "UNKNOWN_VALUE gltfUpAxis"), (task(gltfUpAxis=""), "UNKNOWN_VALUE gltfUpAxis"), (task(gltfUpAxis=1), "WRONG_TYPE gltfUpAxis"), (task(scopeSrid="4490"), "WRONG_TYPE scopeSrid"), (task(scopeSrid=1.5), "WRONG_TYPE scopeSrid"),
    (task(scopeSrid=None), "MISSING_FIELD scopeSrid"), (task(assetId=" \t\n"), "BLANK assetId"), (task(clipOptions=[]), "MISSING_FIELD clipOptions.maskTextures"), (task(clipOptions={"maskTextures": 1, "compactFeatureMetadata": True, "capSurface": True}), "WRONG_TYPE clipOptions.maskTextures"),
    (task(worldTransform=["1"] * 16), "WRONG_TYPE worldTransform"), (task()[:-1], "UNREADABLE document"), ("[1]", "UNREADABLE document"), ("null", "UNREADABLE document"), ("  ", "none"),
]


def test_task_documents(spark, tmp_path):
    (tmp_path / "t.json").write_text("\n".join(t for t, _ in TASKS))
    good, bad = folders.task_documents(spark, str(tmp_path))
    assert sorted((r.item, r.gltfUpAxis, sum(r.worldTransform), r.clipOptions.capSurface) for r in good.collect()) == [("ok", "Z", 106.5, False), ("y", "Y", 106.5, False)]
    assert sorted(f"{r.code} {r.detail}" for r in bad.collect()) == sorted(c for _, c in TASKS if c not in (None, "none"))


def test_task_documents_of_any_length(spark, tmp_path):
    long = {n: "A" * n for n in (21_000_000, 65 << 20)}  # above what a plain parse reads in one value, and above 64 MiB
    odd = [json.dumps({"assetId": "odd", "surplus": long[21_000_000]}).replace('"odd"', x) for x in ("'odd'", "NaN", '"odd", "assetId": "odd"')]
    (tmp_path / "t.json").write_text("\n".join([task(assetId="a", scopeWkbBase64=long[21_000_000]), task(assetId="b", scopeWkbBase64=long[65 << 20]), task(assetId=None, surplus=long[65 << 20]), *odd]))
    good, bad = folders.task_documents(spark, str(tmp_path))
    assert sorted((r.item, r.n) for r in good.select("item", F.length("scopeWkbBase64").alias("n")).collect()) == [("a", 21_000_000), ("b", 65 << 20)]
    assert sorted(f"{r.code} {r.detail}" for r in bad.collect()) == ["MISSING_FIELD assetId", *["UNREADABLE document"] * 3]


def test_event_lines(spark, tmp_path):
    lines = ['{"timestamp":"2026-01-01T00:00:00.123Z","level":"INFO","event":"claimed","assetId":"a","open":1,"deep":{"x":[1]}}', '{"timestamp":"2026', '{"timestamp":"x","level":"I","event":"e"}', '{"level":"I","event":"e"}', "", "7"]
    (tmp_path / "e.log").write_text("\n".join(lines))
    good, bad = folders.event_lines(spark, str(tmp_path))
    (row,) = good.collect()
    assert row.timestamp.microsecond == 123000 and row.event == "claimed" and row.open == {"open": "1", "deep": '{"x":[1]}'}
    assert sorted(r.code for r in bad.collect()) == ["BAD_TIMESTAMP", "MISSING_FIELD", "UNREADABLE", "UNREADABLE"]


REPORT = "asset_id long, result string, output_etag string, output_sha256 string, output_size long"


def test_ready_has_an_object_and_empty_has_none(spark):
    rows = [(1, "READY", "e", "s", 5), (2, "EMPTY", None, None, None), (3, "READY", "e", None, 5), (4, "READY", "e", "s", 0), (5, "EMPTY", " ", "s", None), (6, None, None, None, None), (7, "EMPTY", "", "", 0), (8, "READY", " ", "s", 5)]
    good, bad = sinks.checked(spark.createDataFrame(rows, REPORT))
    assert sorted(r.asset_id for r in good.collect()) == [1, 2, 7]
    assert {(r.item, r.code) for r in bad.collect()} == {("3", "READY_WITHOUT_OBJECT"), ("4", "READY_WITHOUT_OBJECT"), ("8", "READY_WITHOUT_OBJECT"), ("5", "EMPTY_WITH_OBJECT"), ("6", "UNKNOWN_RESULT")}
    texts = {r.asset_id: json.loads(r.j) for r in good.withColumn("j", sinks.report_json()).collect()}
    assert texts[1] == {"result": "READY", "outputEtag": "e", "outputSha256": "s", "outputSize": 5} and texts[2] == {"result": "EMPTY"}


def test_a_batch_replaces_itself_only(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "READY", "e", "s", 5), (2, "EMPTY", None, None, None)], REPORT)
    for batch, df in (("a", rows), ("b", rows), ("a", rows), ("b", rows.where("asset_id = 1")), ("c", rows), ("c", rows.limit(0))):
        sinks.write_batch(df, folder, batch)
    assert sorted((r.batch, r.asset_id) for r in sinks.read_batches(spark, folder, rows.schema).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_books_that_are_not_closed(spark):
    items = lambda *x: spark.createDataFrame([(i,) for i in x], "item string")
    assert sinks.accounted(items("a", "b", None), items("a"), items("b", None)).count() == 0
    open_ = {r.item: (r.given, r.taken, r.left_out) for r in sinks.accounted(items("a", "b", "c", "c"), items("a", "b", "c"), items("b", "x")).collect()}
    assert open_ == {"b": (1, 1, 1), "c": (2, 1, 0), "x": (0, 0, 1)}


def test_accounting_sees_a_lost_row(spark):
    data = "/root/testdata/sf0.001"
    good, bad = folders.task_documents(spark, intake._task_folder(spark, data), "taskId")
    given = good.select("item").unionByName(bad.select("item"))
    lost = good.where("item <> 'task-2'")
    assert [r.item for r in sinks.accounted(given, lost, bad).collect()] == ["task-2"]


def test_objects_are_written_whole(spark, tmp_path):
    objects = spark.createDataFrame([("a", bytearray(b"xy")), ("b", None)], "name string, content binary")
    for _ in range(2):
        told = folders.write_objects(objects, f"file://{tmp_path}/o").collect()
    assert sorted((r.name, r.size) for r in told) == [("a", 2), ("b", 0)]
    assert sorted(os.listdir(f"{tmp_path}/o")) == ["a", "b"] and (tmp_path / "o/a").read_bytes() == b"xy"


@pytest.mark.parametrize("stage", ["transfer", "task", "other"])
def test_quarantine_names_the_error(spark, stage):
    row = sinks.quarantine(spark.createDataFrame([(stage, "1", " ", None)], "stage string, item string, code string, detail string")).first()
    assert (row.error_code, row.retryable, row.message) == {"transfer": ("TRANSFER_FAILED", True), "task": ("TASK_INVALID", False), "other": ("PROCESSING_FAILED", False)}[stage] + ("processing failed",)
