"""Steps that took longer the larger the tables: what is computed once, dealt to tasks, or kept small."""

import json

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import functions as F

from tilewright.operators import geometry, meshes, projection, raster
from tilewright.plans import composed, intake, registry
from tilewright.sources import derived, folders
from tilewright.streaming import leases


def test_a_task_document_is_parsed_once(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"assetId": "a"}))
    for side in folders.task_documents(spark, str(tmp_path)):
        plan = side._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1


USE = "use_id long, image long, u0 double, v0 double, u1 double, v1 double, u2 double, v2 double, wrap_s int, wrap_t int"


def test_uses_of_one_file_are_dealt_to_tasks(spark):
    rows = [(k, 0, 0.1, 0.1, 0.9, 0.1, 0.1, 0.9, raster.CLAMP, raster.CLAMP) for k in range(64)]
    seen = raster.touched(spark.createDataFrame(rows, USE).coalesce(1), 16, 16)
    tasks = {r.p for r in seen.selectExpr("spark_partition_id() AS p").distinct().collect()}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_box_is_looked_at_in_parts():
    side = 1024  # four times AT_ONCE pixels
    tri = [(10.0, 20.0), (1000.0, 30.0), (300.0, 1010.0)]
    columns = [[7], [8], [0], [side - 1], [0], [side - 1], *[[v] for corner in tri for v in corner]]
    b = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f"c{k}" for k in range(12)])
    parts = list(raster._pixels(iter([b])))
    y, x = np.divmod(np.arange(side * side), side)
    hit = raster.pixel_inside_or_near(x + 0.5, y + 0.5, tri)
    assert len(parts) == 4 and sum(p.num_rows for p in parts) == hit.sum()
    assert [v for p in parts for v in (p["y"].to_numpy() * side + p["x"].to_numpy()).tolist()] == np.flatnonzero(hit).tolist()


def test_only_the_srid_of_a_task_is_mistyped(spark, tmp_path):
    # Keys that hold the digits of the SRID themselves, the last ones with the surplus key (% 41) too.
    keys = [k for step, most in ((43, 1_000_000), (43 * 41, 9_000_000)) for k in range(0, most, step) if "4490" in str(k)]
    orders = spark.createDataFrame([(k, 1) for k in sorted(set(keys))], "o_orderkey long, o_custkey long")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("rule_required_fields", "task_manifest_scan", "rule_json_allowlist"):
        rows = composed.QUERIES[name](spark, str(tmp_path))
        want = duckdb.connect()
        want.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet')")
        assert sorted(map(repr, (tuple(r) for r in rows.collect()))) == sorted(map(repr, want.execute(registry.ORACLE_SQL[name]).fetchall())), name


def test_an_asset_has_one_timer_however_many_leases():
    timers, rows = [], []

    class State:
        get = lambda self: iter(rows)
        exists = lambda self: bool(rows)
        clear = lambda self: rows.clear()

        def put(self, new):
            rows[:] = new

    class Handle:
        getListState = lambda self, *_: State()
        registerTimer = lambda self, at: timers.append(at)
        deleteTimer = lambda self, at: timers.remove(at)

    class Watermark:
        getCurrentWatermarkInMs = lambda self: 400
        getExpiryTimeInMs = lambda self: timers[0]

    lease = leases.LeaseTimer(10_000)
    lease.init(Handle())
    ts = pd.to_datetime(pd.Series([0, 100_000, 200_000, 900_000, 905_000]), unit="us")
    assert list(lease.handleInputRows((1,), iter([pd.DataFrame({"ts": ts})]), Watermark())) == [] and timers == [10]
    (out,) = lease.handleExpiredTimer((1,), Watermark(), Watermark())
    assert out["heartbeats"].tolist() == [1, 1, 1] and (out["expired"].astype("datetime64[us]").astype("int64") - 10_000).tolist() == [0, 100_000, 200_000]
    assert rows == [(900_000, 905_000, 2)] and timers[1:] == [915]


def test_accounts_store_what_they_count_twice(spark):
    data = "/root/testdata/sf0.001"
    plan = intake.QUERIES["intake_accounting"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson" not in plan and "posexplode" not in plan and "catalogue" not in plan and "binaryFile" not in plan
    assert intake._objects(spark, data).selectExpr("spark_partition_id() AS p").distinct().count() > 1


def test_points_are_projected_in_batches_and_once(spark):
    v = spark.range(6).selectExpr("1L AS asset", "id AS vid", "CAST(id * id AS DOUBLE) AS x", "CAST(id % 3 AS DOUBLE) AS y", "0D AS z", "array(1D) AS payload")
    v = meshes.projected(v.withColumn("world", F.array(*[F.lit(e) for e in meshes.east_north_up(120.0, 30.0)])), "world", "120D", "30D")
    t = meshes.triangles(v, spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 3, 4, 5), (1, 2, 3, 4, 9)], "asset long, tri_id int, i0 int, i1 int, i2 int"), ["asset"])
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan and "collect_list" not in plan
    assert {r.tri_id: [c.p for c in r.poly] for r in t.collect()} == {0: [[0, 0, 0, 1], [1, 1, 0, 1], [4, 2, 0, 1]], 1: [[9, 0, 0, 1], [16, 1, 0, 1], [25, 2, 0, 1]]}
    nulls = spark.sql("SELECT double(null) AS lon, 30D AS lat").select(projection.local_project("lon", "lat", "120D", "30D").alias("p")).first().p
    assert nulls.x is None and nulls.y is None


def test_batches_are_clipped_as_rows_are(spark):
    rng, rows = np.random.default_rng(5), []
    for k in range(300):
        poly = [(*(float(v) for v in rng.uniform(-8, 8, 3)), [float(v) for v in rng.uniform(0, 9, 2 + k % 50 // 49)]) for _ in range(3 + k % 3)]
        turns = np.sort(rng.uniform(0, 2 * np.pi, 3 + k % 4))
        rows.append((k, poly, [(float(5 * np.cos(a)), float(5 * np.sin(a))) for a in turns]))
    whole = rows[0][1]
    rows += [(1000, None, rows[0][2]), (1001, [], rows[0][2]), (1002, [*whole[:2], (None, 1.0, 1.0, [1.0, 2.0])], rows[0][2]), (1003, [*whole[:2], (1.0, float("nan"), 1.0, [1.0, 2.0])], rows[0][2]), (1004, [*whole[:2], (1.0, 1.0, 1.0, None)], rows[0][2])]
    df = spark.createDataFrame(rows, f"id int, poly array<{geometry.CARRYING}>, corners array<struct<x: double, y: double>>").coalesce(1)
    for point in (geometry.CARRYING, geometry.POINT):
        flat = df if point == geometry.CARRYING else df.withColumn("poly", F.transform("poly", lambda v: F.struct(v["x"], v["y"], v["z"])))
        both = flat.select("id", geometry.clip("poly", "corners", point).alias("fast"), geometry.clip_by_lambdas("poly", "corners", point).alias("slow")).collect()
        assert len(both) == len(rows) and all(repr(r.fast) == repr(r.slow) for r in both)
        assert len({len(r.fast) for r in both if r.fast}) > 3


def test_a_clip_is_not_done_again_for_its_size(spark):
    pairs = spark.createDataFrame([([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)], [(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0)])], f"poly array<{geometry.POINT}>, corners array<struct<x: double, y: double>>")
    plan = geometry.fragments(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("coalesce(") == 1


def test_orders_are_dealt_in_parts_of_bounded_size(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{data}/lineitem.parquet").count()
    monkeypatch.setattr(derived, "PART_ROWS", 500)
    rows = registry.QUERIES["rule_section_bounds"](spark, data)
    assert rows.selectExpr("spark_partition_id() AS p").distinct().count() > lines // 500 // 2 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = duckdb.connect()
    for name in ("lineitem", "orders"):
        want.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    assert sorted(map(tuple, rows.collect())) == sorted(want.execute(registry.ORACLE_SQL["rule_section_bounds"]).fetchall())
