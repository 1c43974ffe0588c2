"""Queries over folders of files: written by Spark from the supplied tables, read by `sources.folders`, ended by `sources.sinks`."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.storage import shared_folder, stored
from tilewright.operators import polygons, raster
from tilewright.sources import folders, sinks, tiles
from tilewright.sources.derived import derived

from . import composed, scans

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tilewright-{name}-{uuid.uuid4().hex}"


# --- Tiles --------------------------------------------------------------------------------------------------------


def _tile(k: int) -> bytes:
    """A tile with a feature table of 20, 24 or 26 bytes and a chain of chunks that is whole or broken, by its number."""
    if k % 13 == 0:
        return b""
    feature = b'{"BATCH_LENGTH":1}'.ljust(26 if k % 11 == 0 else 24 if k % 3 == 0 else 20)
    chunk = lambda kind, body: struct.pack("<II", len(body), kind) + body
    js = chunk(tiles.CHUNK_JSON, b'{"asset":{}}'.ljust(14 if k % 7 == 3 else 12))
    body = chunk(tiles.CHUNK_BIN, b"\xab" * (4 * (k % 6)))
    chain = {1: body + js, 2: js + body + body, 4: js + bytes(4), 5: js, 6: js + js}.get(k % 7, js + body)
    inner = b"glTF" + struct.pack("<II", 2, tiles.INNER_HEADER + len(chain)) + chain
    sizes = struct.pack("<6I", 1, tiles.TILE_HEADER + len(feature) + len(inner), len(feature), 0, 0, 0)
    return (b"nope" if k % 23 == 0 else b"b3dm") + sizes + feature + inner


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile file a supplier, name and content; some are broken, some empty, some no tiles by their name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            names = [f"s{k}{'.txt' if k % 29 == 0 else '.b3dm'}" for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([_tile(k) for k in keys], pa.binary())], names=["name", "content"])

    # Dealt to tasks: the table is one file, which a single task would read, writing all objects one after another.
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.mapInArrow(run, "name string, content binary")


def _tile_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark, "tiles")
    stored(folders.write_objects(_objects(spark, sf_dir), folder))
    return folder


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").where(k % 29 != 0).select(F.concat(F.lit("s"), k, F.lit(".b3dm")).alias("item"))


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tiles of the folder with up to 100 bytes, and those larger, empty or absent."""
    files, large = folders.tile_files(spark, _tile_folder(spark, sf_dir), most=100)
    return files, large.unionByName(folders.absent(_expected(spark, sf_dir), files, large))


_TILES = """t AS (SELECT s_suppkey AS k, 's' || CAST(s_suppkey AS VARCHAR) || '.b3dm' AS item, 28 + CASE WHEN s_suppkey % 11 = 0 THEN 26 WHEN s_suppkey % 3 = 0 THEN 24 ELSE 20 END AS pos,
    20 + CASE WHEN s_suppkey % 7 = 3 THEN 2 ELSE 0 END AS js, 8 + 4 * (s_suppkey % 6) AS body, s_suppkey % 7 AS r FROM supplier WHERE s_suppkey % 29 <> 0),
sized AS (SELECT *, pos + 12 + js + CASE WHEN r IN (0, 1, 3) THEN body WHEN r = 2 THEN 2 * body WHEN r = 4 THEN 4 WHEN r = 5 THEN 0 ELSE js END AS actual FROM t),
judged AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'ABSENT' WHEN actual > 100 THEN 'SIZE' WHEN k % 23 = 0 THEN 'BAD_MAGIC' WHEN k % 11 = 0 THEN 'MISALIGNED' WHEN pos % 8 <> 0 THEN 'COMPATIBLE' ELSE 'OK' END AS code FROM sized)"""


@query(f"WITH {_TILES} SELECT item, code, CASE WHEN code IN ('OK', 'COMPATIBLE') THEN CAST(pos AS BIGINT) END AS inner_offset, CAST(CASE WHEN code <> 'ABSENT' THEN actual END AS BIGINT) AS bytes FROM judged")
def tile_folder_scan(spark, sf_dir):
    """Catalogue of a folder of tiles, with those refused by their size or their header."""
    files, small = _listed(spark, sf_dir)
    good, bad = folders.tile_catalogue(files)
    taken = good.select(folders.file_name("path").alias("item"), "code", "inner_offset", F.col("actual").alias("bytes"))
    refused = small.unionByName(bad).select("item", "code", F.lit(None).cast("long").alias("inner_offset"), F.col("detail").cast("long").alias("bytes"))
    return taken.unionByName(refused)


@query(f"""WITH {_TILES}, good AS (SELECT * FROM judged WHERE code IN ('OK', 'COMPATIBLE'))
SELECT item, 0 AS chunk, 'JSON' AS kind, CAST(pos + 20 AS BIGINT) AS "offset", CAST(js - 8 AS BIGINT) AS length, CAST(NULL AS VARCHAR) AS code FROM good WHERE r IN (0, 5)
UNION ALL SELECT item, 1, 'BIN', CAST(pos + 20 + js AS BIGINT), CAST(body - 8 AS BIGINT), NULL FROM good WHERE r = 0
UNION ALL SELECT item, NULL, NULL, NULL, NULL, CASE r WHEN 1 THEN 'CHUNK_ORDER' WHEN 3 THEN 'CHUNK_ALIGNMENT' WHEN 4 THEN 'CHUNK_END' ELSE 'CHUNK_UNSUPPORTED' END FROM good WHERE r NOT IN (0, 5)""")
def tile_folder_chunks(spark, sf_dir):
    """Chunks of whole chains in a folder of tiles, and what breaks the others."""
    files, _ = _listed(spark, sf_dir)
    listed, broken = folders.tile_chunks(files)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("chunk", "int"), ("kind", "string"), ("offset", "long"), ("length", "long"))]
    return listed.select(folders.file_name("path").alias("item"), "chunk", "kind", "offset", "length", F.lit(None).cast("string").alias("code")).unionByName(broken.select("item", *none, "code"))


# --- Task documents -----------------------------------------------------------------------------------------------


def _task_folder(spark: SparkSession, sf_dir: str) -> str:
    """Task documents as JSON lines: missing, null, mistyped, blank, unsupported and surplus fields, short matrices, cut lines."""
    t = derived(spark, sf_dir, "task")
    k = F.col("task_id")
    options = F.struct(F.col("mask_textures").alias("maskTextures"), F.col("compact_metadata").alias("compactFeatureMetadata"), F.when(k % 53 != 0, F.col("cap_surface")).alias("capSurface"))
    text = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    body = F.to_json(F.struct(
        text("task-").alias("taskId"), F.when(k % 31 != 0, F.col("asset")).alias("assetId"), text("lease-").alias("leaseToken"), F.lit("2026-01-01T00:00:00Z").alias("leaseExpireTime"), text("https://source/").alias("sourceDownloadUrl"),
        F.lit('"etag"').alias("sourceEtag"), text("https://output/").alias("outputUploadUrl"), F.when(k % 59 == 0, "  ").otherwise("AQMAAAA=").alias("scopeWkbBase64"), F.when(k % 37 != 0, F.col("srid")).alias("scopeSrid"), F.col("up_axis").alias("gltfUpAxis"),
        F.col("content_format").alias("contentFormat"), F.sequence(F.lit(1), F.col("matrix_length")).cast("array<double>").alias("worldTransform"), options.alias("clipOptions"), F.when(k % 41 == 0, "debug").alias("surplus"),
    ))
    line = F.when(k % 47 == 0, F.substring(body, 1, 40)).when(k % 43 == 0, F.regexp_replace(body, '"scopeSrid":([0-9]+)', '"scopeSrid":"$1"')).otherwise(body)
    folder = _folder(spark, "tasks")
    t.select(line.alias("value")).write.text(folder)
    return folder


_TASKS = r"""j AS (SELECT *, CASE WHEN task_id % 47 = 0 THEN 'UNREADABLE document' WHEN task_id % 31 = 0 OR asset IS NULL THEN 'MISSING_FIELD assetId' WHEN task_id % 37 = 0 THEN 'MISSING_FIELD scopeSrid' WHEN task_id % 53 = 0 THEN 'MISSING_FIELD clipOptions.capSurface'
    WHEN task_id % 43 = 0 THEN 'WRONG_TYPE scopeSrid' WHEN trim(replace(asset, chr(9), ' ')) = '' THEN 'BLANK assetId' WHEN task_id % 59 = 0 THEN 'BLANK scopeWkbBase64' WHEN up_axis NOT IN ('Y', 'Z') THEN 'UNKNOWN_VALUE gltfUpAxis' WHEN content_format <> 'b3dm' THEN 'UNKNOWN_VALUE contentFormat'
    WHEN matrix_length <> 16 THEN 'MATRIX_SHAPE worldTransform' ELSE 'OK' END AS code FROM task)"""


@query(f"""WITH {_TASKS} SELECT CASE WHEN task_id % 47 <> 0 THEN 'task-' || CAST(task_id AS VARCHAR) END AS item, code, CASE WHEN code = 'OK' THEN asset END AS asset, CASE WHEN code = 'OK' THEN CAST(srid AS BIGINT) END AS srid, CASE WHEN code = 'OK' THEN up_axis END AS up_axis,
    CASE WHEN code = 'OK' THEN 136.0::double END AS matrix_sum, CASE WHEN code = 'OK' THEN mask_textures END AS mask_textures FROM j""")
def task_folder_scan(spark, sf_dir):
    """Every task document of a folder: its typed fields, or the rule and field that refuse it."""
    good, bad = folders.task_documents(spark, _task_folder(spark, sf_dir), "taskId")
    total = F.aggregate("worldTransform", F.lit(0.0), lambda s, x: s + x)
    taken = good.select("item", F.lit("OK").alias("code"), F.col("assetId").alias("asset"), F.col("scopeSrid").alias("srid"), F.col("gltfUpAxis").alias("up_axis"), total.alias("matrix_sum"), F.col("clipOptions.maskTextures").alias("mask_textures"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("asset", "string"), ("srid", "long"), ("up_axis", "string"), ("matrix_sum", "double"), ("mask_textures", "boolean"))]
    return taken.unionByName(bad.select("item", F.concat_ws(" ", "code", "detail").alias("code"), *none))


# --- Event lines --------------------------------------------------------------------------------------------------


def _event_folder(spark: SparkSession, sf_dir: str) -> str:
    """Lifecycle events as JSON lines; every tenth is cut, some lack the event, some have no time that can be read."""
    e = derived(spark, sf_dir, "task_event")
    k = F.col("event_id")
    text = lambda c: F.col(c).cast("string")
    body = F.to_json(F.struct(F.when(k % 17 == 5, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")).alias("timestamp"), "level", F.when(k % 13 != 4, F.col("event")).alias("event"), text("worker_id").alias("workerId"), text("asset_id").alias("assetId"), text("event_id").alias("eventId"), text("duration_ms").alias("durationMs")))
    folder = _folder(spark, "events")
    e.select(F.when(k % 10 == 3, F.substring(body, 1, 30)).otherwise(body).alias("value")).write.text(folder)
    return folder


_EVENTS = "e AS (SELECT *, CASE WHEN event_id % 10 = 3 THEN 'UNREADABLE' WHEN event_id % 13 = 4 THEN 'MISSING_FIELD' WHEN event_id % 17 = 5 THEN 'BAD_TIMESTAMP' ELSE 'OK' END AS code FROM task_event)"


@query(f"""WITH {_EVENTS} SELECT code, event, CAST(count(*) AS BIGINT) AS events, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, min(event_id) AS first_event, min(date_trunc('second', ts)) AS first_time FROM e WHERE code = 'OK' GROUP BY code, event
    UNION ALL SELECT code, NULL, count(*), NULL, NULL, NULL FROM e WHERE code <> 'OK' GROUP BY code""")
def event_folder_scan(spark, sf_dir):
    """Events of a folder of lines by kind, with open fields, and the refused lines by rule."""
    good, bad = folders.event_lines(spark, _event_folder(spark, sf_dir))
    long = lambda f: F.col("open")[f].cast("long")
    taken = good.groupBy(F.lit("OK").alias("code"), "event").agg(F.count("*").alias("events"), F.sum(long("durationMs")).alias("duration_ms"), F.min(long("eventId")).alias("first_event"), F.min(F.date_trunc("second", "timestamp")).cast("timestamp_ntz").alias("first_time"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("event", "string"), ("duration_ms", "long"), ("first_event", "long"), ("first_time", "timestamp_ntz"))]
    return taken.unionByName(bad.groupBy("code").agg(F.count("*").alias("events")).select("code", "events", *none))


# --- Sinks --------------------------------------------------------------------------------------------------------


def clip_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A completion an asset from the clip itself: READY names the object of its fragments, EMPTY none; assets above 190 report wrongly.

    The object's digest is a hash of hashes, so no asset's fragments meet in one task; its size is that of three float32
    corners a fragment.
    """
    tri = derived(spark, sf_dir, "tri").groupBy("asset_id").agg(F.count("*").alias("triangles_before"))
    parts = composed._fragments(spark, sf_dir).groupBy("asset_id").agg(F.count("*").alias("n"), F.hex(F.bit_xor(F.xxhash64("tri_id", "piece_id", "frag_id", "area"))).alias("mark"))
    n = F.coalesce("n", F.lit(0))
    rows = tri.join(parts, "asset_id", "left").withColumn("result", F.when(n > 0, "READY").otherwise("EMPTY"))
    has = (F.col("result") == "READY") != (F.col("asset_id") > 190)
    return rows.select("asset_id", "result", F.when(has, F.coalesce("mark", F.lit("0"))).alias("output_etag"), F.when(has, F.sha2(F.coalesce("mark", F.lit("0")), 256)).alias("output_sha256"), F.when(has, 108 * n + F.when(n == 0, 1).otherwise(0)).alias("output_size"), "triangles_before", n.alias("triangles_after"))


_REPORTS = composed._STATS.replace("@AREA@", "CAST(coalesce(n, 0) AS BIGINT) AS n")
_REPORTS = f"SELECT asset_id, n, triangles_before, CASE WHEN n > 0 THEN 'READY' ELSE 'EMPTY' END AS result FROM ({_REPORTS}) s"


@query(f"SELECT asset_id, result, CASE WHEN n > 0 THEN CAST(108 * n AS BIGINT) END AS output_size, n > 0 AS named, CAST(triangles_before AS BIGINT) AS triangles_before, CAST(n AS BIGINT) AS triangles_after, 'run-1' AS batch FROM ({_REPORTS}) r WHERE asset_id <= 190")
def report_sink(spark, sf_dir):
    """The table of results after a batch was written twice and another one once and emptied again."""
    good, _ = sinks.checked(clip_reports(spark, sf_dir))
    good, folder = stored(good), _folder(spark, "results")
    for batch, rows in (("run-1", good), ("run-0", good), ("run-1", good), ("run-0", good.limit(0))):
        sinks.write_batch(rows, folder, batch)
    rows = sinks.read_batches(spark, folder, good.schema)
    return rows.select("asset_id", "result", "output_size", (F.col("output_etag").isNotNull() & (F.length("output_sha256") == 64)).alias("named"), "triangles_before", "triangles_after", "batch")


def _refused(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Every branch that refuses rows, over files and tables."""
    files, small = _listed(spark, sf_dir)
    wide = derived(spark, sf_dir, "uv_use").withColumn("u1", F.when(F.col("use_id") % 9 == 4, F.col("u1") + 200).otherwise(F.col("u1")))
    far = derived(spark, sf_dir, "scope_geo").withColumn("lon", F.when((F.col("scope_id") % 8 == 3) & (F.col("seq") == 1), F.col("lon") + 40).otherwise(F.col("lon")))
    rings = polygons.ring_rejects(far).groupBy(*polygons.RING).agg(F.first("code").alias("code"), F.min("seq").alias("seq"))
    meshes = tiles.mesh(scans._binary_chunks(spark, sf_dir), "vec_id").where("fault IS NOT NULL")
    scopes = tiles.scope_rings(scans._wkb(spark, sf_dir), "tri_id").where("fault IS NOT NULL")
    return [
        small, folders.tile_catalogue(files)[1], folders.tile_chunks(files)[1],
        folders.task_documents(spark, _task_folder(spark, sf_dir), "taskId")[1], folders.event_lines(spark, _event_folder(spark, sf_dir))[1],
        folders.rejects(meshes, "mesh", F.col("vec_id"), F.col("fault")), folders.rejects(scopes, "scope", F.col("tri_id"), F.col("fault")),
        folders.rejects(rings, "ring", F.concat_ws("/", *polygons.RING), F.col("code"), F.col("seq")), folders.rejects(raster.uv_rejects(wide), "uv", F.col("use_id"), F.col("code")),
        sinks.checked(clip_reports(spark, sf_dir))[1],
    ]


@query(f"""WITH {_TILES}, {_TASKS}, {_EVENTS}, all_ AS (SELECT 'tile' AS stage, code FROM judged WHERE code NOT IN ('OK', 'COMPATIBLE')
    UNION ALL SELECT 'chunk', CASE r WHEN 1 THEN 'CHUNK_ORDER' WHEN 3 THEN 'CHUNK_ALIGNMENT' WHEN 4 THEN 'CHUNK_END' ELSE 'CHUNK_UNSUPPORTED' END FROM judged WHERE code IN ('OK', 'COMPATIBLE') AND r NOT IN (0, 5)
    UNION ALL SELECT 'task', split_part(code, ' ', 1) FROM j WHERE code <> 'OK' UNION ALL SELECT 'event', code FROM e WHERE code <> 'OK'
    UNION ALL SELECT 'mesh', 'RANGE' FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT 'scope', 'WKB' FROM tri WHERE tri_id % 31 = 0
    UNION ALL SELECT 'ring', 'TOO_MANY_STEPS' FROM (SELECT DISTINCT scope_id, ring_id FROM scope_geo WHERE scope_id % 8 = 3) g
    UNION ALL SELECT 'uv', 'UV_SPAN_TOO_WIDE' FROM uv_use WHERE use_id % 9 = 4 AND wrap_s <> 33071
    UNION ALL SELECT 'report', CASE result WHEN 'READY' THEN 'READY_WITHOUT_OBJECT' ELSE 'EMPTY_WITH_OBJECT' END FROM ({_REPORTS}) r WHERE asset_id > 190)
SELECT stage, code, CASE stage WHEN 'task' THEN 'TASK_INVALID' WHEN 'event' THEN 'EVENT_INVALID' WHEN 'scope' THEN 'SCOPE_INVALID' WHEN 'ring' THEN 'SCOPE_INVALID' WHEN 'report' THEN 'PROCESSING_FAILED' ELSE 'SOURCE_FORMAT_INVALID' END AS error_code, false AS retryable, count(*) AS refused, count(*) AS explained FROM all_ GROUP BY stage, code""")
def quarantine_sink(spark, sf_dir):
    """The table of all refused rows, written twice, by stage and rule."""
    rows, folder = stored(sinks.quarantine(*_refused(spark, sf_dir))), _folder(spark, "quarantine")
    for _ in range(2):
        sinks.write_batch(rows, folder, "run-1")
    table = sinks.read_batches(spark, folder, rows.schema)
    return table.groupBy("stage", "code", "error_code", "retryable").agg(F.count("*").alias("refused"), F.count_if(F.col("message").startswith(F.col("code"))).alias("explained"))


@query(f"""WITH {_TILES}, {_TASKS}, given AS (SELECT 'task' AS stage, code = 'OK' AS taken FROM j UNION ALL SELECT 'tile', code IN ('OK', 'COMPATIBLE') FROM judged UNION ALL SELECT 'report', asset_id <= 190 FROM ({_REPORTS}) r)
SELECT stage, count(*) AS given, count(*) FILTER (WHERE taken) AS taken, count(*) FILTER (WHERE NOT taken) AS left_out, CAST(0 AS BIGINT) AS open_ FROM given GROUP BY stage""")
def intake_accounting(spark, sf_dir):
    """Every input of three stages is accepted or refused once: the sizes, and the items for which that fails."""
    # Both the sizes and the items are counted, so what names the items is stored once.
    tasks = [stored(side.select("item")) for side in folders.task_documents(spark, _task_folder(spark, sf_dir), "taskId")]
    k = F.col("task_id")
    task_items = derived(spark, sf_dir, "task").select(F.when(k % 47 != 0, F.concat(F.lit("task-"), k.cast("string"))).alias("item"))
    files, small = _listed(spark, sf_dir)
    good, bad = folders.tile_catalogue(files)
    names = _expected(spark, sf_dir)
    good, left = stored(good.select(folders.file_name("path").alias("item"))), stored(small.unionByName(bad).select("item"))
    reports = stored(clip_reports(spark, sf_dir))
    checked = sinks.checked(reports)
    books = {
        "task": (task_items, tasks[0], tasks[1]), "tile": (names, good, left),
        "report": (reports.select(F.col("asset_id").alias("item")), checked[0].select(F.col("asset_id").alias("item")), checked[1]),
    }
    out = None
    for stage, sides in books.items():
        sizes = [df.agg(F.count("*").alias(name)) for df, name in zip(sides, ("given", "taken", "left_out"))]
        open_ = sinks.accounted(*sides).agg(F.count("*").alias("open_"))
        row = sizes[0].join(sizes[1]).join(sizes[2]).join(open_).select(F.lit(stage).alias("stage"), "given", "taken", "left_out", "open_")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
