"""Folders of files: binary tiles, task documents and event lines, each split into what is accepted and what is refused.

Every reader gives two DataFrames. Refused rows have the columns of ``REJECT``: where they came from, which item, the
first broken rule and a detail; they are never joined to results again. ``sinks.quarantine`` gathers them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tiles

REJECT = ("stage", "item", "code", "detail")
#: Fixed value: bytes of an input object at most.
MOST_OBJECT = 64 * 1024 * 1024


def rejects(df: DataFrame, stage: str, item: Column, code: Column, detail: Column | None = None) -> DataFrame:
    text = F.lit(None) if detail is None else detail
    return df.select(F.lit(stage).alias("stage"), item.cast("string").alias("item"), code.cast("string").alias("code"), text.cast("string").alias("detail"))


# --- Tiles --------------------------------------------------------------------------------------------------------


def tile_files(spark: SparkSession, folder: str, pattern: str = "*.b3dm", most: int = MOST_OBJECT) -> tuple[DataFrame, DataFrame]:
    """(path, length, content) of files of 1 to ``most`` bytes, and rejects (SIZE) for the others, whose bytes are not read.

    The filter on ``length`` reaches the listing, so a refused file costs an entry of the listing; so does a filter
    on ``path`` or ``modificationTime`` that the caller adds. Folders below are searched too. Spark's file scans pass
    over files without a byte: ``absent`` finds them, given what is expected.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    accepted = files.where((F.col("length") >= 1) & (F.col("length") <= most)).select("path", "length", "content")
    refused = files.select("path", "length").where((F.col("length") < 1) | (F.col("length") > most))
    return accepted, rejects(refused, "tile", file_name("path"), F.lit("SIZE"), F.col("length"))


def file_name(path: str) -> Column:
    return F.substring_index(path, "/", -1)


def absent(expected: DataFrame, *seen: DataFrame) -> DataFrame:
    """Rejects (ABSENT) for expected names (column item) of which no listing has a file, or only an empty one.

    ``seen`` are the two sides of ``tile_files``.
    """
    names = None
    for df in seen:
        part = df.select("item") if "item" in df.columns else df.select(file_name("path").alias("item"))
        names = part if names is None else names.unionByName(part)
    return rejects(expected.select("item").distinct().join(names, "item", "left_anti"), "tile", F.col("item"), F.lit("ABSENT"))


def tile_catalogue(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header rows of tiles that keep every rule, and rejects with the first broken one. No content in either."""
    rows = tiles.catalogue(files)
    good = F.col("code").isin("OK", "COMPATIBLE")
    return rows.where(good), rejects(rows.where(~good), "tile", file_name("path"), F.col("code"), F.col("actual"))


def tile_chunks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (path, chunk, kind, offset, length) of containers whose chain is whole, and rejects for broken chains.

    Only tiles that pass the catalogue are looked into.
    """
    head = tiles.catalogue(files.withColumn("_kept", F.col("content")))
    whole = head.where(F.col("code").isin("OK", "COMPATIBLE")).select("path", "inner_offset", F.col("_kept").alias("content"))
    judged = whole.withColumn("fault", tiles.chain_fault(F.col("content"), F.col("inner_offset")))
    listed = tiles.chunks(judged.where("fault IS NULL").drop("fault")).drop("inner_offset")
    return listed, rejects(judged.where("fault IS NOT NULL"), "chunk", file_name("path"), F.col("fault"))


def write_objects(objects: DataFrame, folder: str) -> DataFrame:
    """Writes each row's ``content`` to ``folder``/``name`` and gives (name, size, sha256) of what was written.

    Files are moved into place when whole, so a task that runs again leaves the same file; names must be distinct.
    Runs when the result is used; store it to run it once. Any file system that Arrow knows by its address.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import uuid

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for b in batches:
            names, contents = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name, content in zip(names, contents):
                draft = f"{root}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as out:
                    out.write(content or b"")
                files.move(draft, f"{root}/{name}")
            sizes, sums = [len(c or b"") for c in contents], [hashlib.sha256(c or b"").hexdigest() for c in contents]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.string())], names=["name", "size", "sha256"])

    return objects.select("name", "content").mapInArrow(run, "name string, size long, sha256 string")


# --- Task documents -----------------------------------------------------------------------------------------------

# Fields of a task document with their types, those that must not be blank, and the values that are supported.
TASK_FIELDS = {"assetId": "STRING", "leaseToken": "STRING", "leaseExpireTime": "STRING", "sourceDownloadUrl": "STRING", "sourceEtag": "STRING", "outputUploadUrl": "STRING", "scopeWkbBase64": "STRING", "scopeSrid": "BIGINT", "gltfUpAxis": "STRING", "contentFormat": "STRING"}
TASK_OPTIONS = ("maskTextures", "compactFeatureMetadata", "capSurface")
NOT_BLANK = ("assetId", "leaseToken", "sourceDownloadUrl", "outputUploadUrl", "scopeWkbBase64")
AXES, FORMATS, MATRIX = ("Y", "Z"), ("b3dm",), 16
_NUMBERS = r"^ARRAY<(BIGINT|DECIMAL\(.*\)|DOUBLE|FLOAT)>$"
#: Characters of one value that ``try_parse_json`` reads; it takes a longer one for unreadable.
_PLAIN = 20_000_000
_ANY_LENGTH = {"maxStringLen": str(2**31 - 1), "allowNonNumericNumbers": "false", "allowSingleQuotes": "false"}


def task_documents(spark: SparkSession, folder: str, item: str = "assetId") -> tuple[DataFrame, DataFrame]:
    """Typed task rows from JSON lines, and rejects with the first broken rule and the field that breaks it.

    The rules in order: UNREADABLE (no JSON object, or a repeated key), MISSING_FIELD (absent or null), WRONG_TYPE (no
    silent conversion: "4490" is no number), BLANK, UNKNOWN_VALUE, MATRIX_SHAPE. Surplus fields are ignored. Lines of
    white space are no documents. ``item`` names the field that rejects are known by. Secrets (token, addresses) stay in
    the accepted rows and never enter a reject's detail. Documents of any length are judged; those that Spark can't hold
    as a variant (128 MiB) are UNREADABLE.
    """
    lines = spark.read.text(folder).where(F.trim("value") != "")
    document = F.when(F.octet_length("value") <= _PLAIN, F.try_parse_json("value")).otherwise(F.from_json("value", "variant", _ANY_LENGTH))
    # Generated columns are computed once; the optimizer would copy plain ones, the parsed document among them, into every later use.
    once = lambda c: F.explode(F.array(c))
    rows = lines.select(once(document).alias("v"))

    def kind(path: str) -> Column:
        of = F.schema_of_variant(F.try_variant_get("v", path, "variant"))
        return F.when(of != "VOID", of).otherwise("NONE")

    wanted = {**{f"$.{f}": t for f, t in TASK_FIELDS.items()}, "$.worldTransform": "ARRAY", "$.clipOptions": "OBJECT", **{f"$.clipOptions.{o}": "BOOLEAN" for o in TASK_OPTIONS}}
    names = [p.removeprefix("$.") for p in wanted]
    kinds = F.struct(*[kind(p).alias(f"k{n}") for n, p in enumerate(wanted)])
    rows = rows.withColumn("kinds", once(F.when(F.schema_of_variant("v").startswith("OBJECT"), kinds)))

    def first(test) -> Column:
        """The first field whose kind fails, by a test of the kind and of the one wanted."""
        return F.coalesce(*[F.when(test(F.col(f"kinds.k{n}"), t), F.lit(name)) for n, (name, t) in enumerate(zip(names, wanted.values()))])

    def unfit(kind: Column, t: str) -> Column:
        return ~kind.rlike(_NUMBERS) if t == "ARRAY" else ~kind.startswith("OBJECT") if t == "OBJECT" else kind != t

    text = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    blank = F.coalesce(*[F.when(F.trim(F.translate(text(f), "\t\r\n\v\f", "     ")) == "", F.lit(f)) for f in NOT_BLANK])
    unknown = F.when(~text("gltfUpAxis").isin(*AXES), "gltfUpAxis").when(~text("contentFormat").isin(*FORMATS), "contentFormat")
    matrix = F.try_variant_get("v", "$.worldTransform", "array<double>")
    checks = [
        ("UNREADABLE", F.when(F.col("kinds").isNull(), "document")), ("MISSING_FIELD", first(lambda k, _: k == "NONE")), ("WRONG_TYPE", first(unfit)),
        ("BLANK", blank), ("UNKNOWN_VALUE", unknown), ("MATRIX_SHAPE", F.when(F.size(matrix) != MATRIX, "worldTransform")),
    ]
    # Rules after the broken one aren't looked at; neither codes nor fields hold a blank.
    rows = rows.withColumn("broken", once(F.coalesce(*[F.concat(F.lit(f"{code} "), field) for code, field in checks]))).drop("kinds")
    typed = [(F.try_variant_get("v", f"$.{f}", "bigint") if t == "BIGINT" else text(f)).alias(f) for f, t in TASK_FIELDS.items()]
    options = F.struct(*[F.try_variant_get("v", f"$.clipOptions.{o}", "boolean").alias(o) for o in TASK_OPTIONS]).alias("clipOptions")
    accepted = rows.where("broken IS NULL").select(text(item).alias("item"), *typed, matrix.alias("worldTransform"), options)
    return accepted, rejects(rows.where("broken IS NOT NULL"), "task", F.try_variant_get("v", f"$.{item}", "string"), F.substring_index("broken", " ", 1), F.substring_index("broken", " ", -1))


# --- Event lines --------------------------------------------------------------------------------------------------

EVENT_FIELDS = ("timestamp", "level", "event", "message", "workerId", "assetId")
EVENT_REQUIRED = ("timestamp", "level", "event")


def event_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Lifecycle events from JSON lines: the base fields, time as a timestamp, all other fields in the map ``open``.

    Rejects: UNREADABLE (no JSON object; cut lines), MISSING_FIELD, BAD_TIMESTAMP. The text of a refused line stays out
    of the reject, since it may hold what must not be logged; its length is the detail.
    """
    lines = spark.read.text(folder).where(F.trim("value") != "")
    corrupt = "_corrupt_record"
    schema = f"{', '.join(f'`{f}` string' for f in EVENT_FIELDS)}, {corrupt} string"
    rows = lines.withColumn("r", F.from_json("value", schema, {"columnNameOfCorruptRecord": corrupt}))
    rows = rows.withColumn("open", F.map_filter(F.from_json("value", "map<string,string>"), lambda k, v: ~k.isin(*EVENT_FIELDS)))
    at = F.try_to_timestamp("r.timestamp")
    unreadable = F.col(f"r.{corrupt}").isNotNull() | F.col("r").isNull()
    missing = F.exists(F.array(*[F.col(f"r.`{f}`") for f in EVENT_REQUIRED]), lambda x: x.isNull())
    code = F.when(unreadable, "UNREADABLE").when(missing, "MISSING_FIELD").when(at.isNull(), "BAD_TIMESTAMP")
    rows = rows.withColumn("code", code)
    good = rows.where("code IS NULL").select(at.alias("timestamp"), *[F.col(f"r.`{f}`").alias(f) for f in EVENT_FIELDS[1:]], "open")
    return good, rejects(rows.where("code IS NOT NULL"), "event", F.col("r.assetId"), F.col("code"), F.length("value"))
