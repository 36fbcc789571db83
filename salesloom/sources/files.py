"""Snapshot CSV folders in, tables out.

Layout: ``<root>/<Entity>/**/part-*.csv`` for live parts and
``part-*.csv@snapshot=<timestamp>`` for their snapshots, at any depth.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.errors import AnalysisException

from salesloom.session import materialize

PART_FILE = r"/part-[^/]*\.csv(@snapshot=[^/]+)?$"
PART_ID = r"/part-([^@/]+)\.csv"
SNAPSHOT_ID = r"@snapshot=([^/]+)"
MALFORMED = "_malformed"


def manifest_columns(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """``entity -> column names`` from a model manifest; one small JSON file."""
    rows = spark.read.option("wholetext", True).text(path).head(1)
    model = json.loads(rows[0][0]) if rows else {}
    return {e["name"]: [a["name"] for a in e.get("attributes", [])] for e in model.get("entities", [])}


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def sanitize_name(name: str) -> str:
    return re.sub(r"[ ,;{}()\n\t=]", "_", name)


def strip_brackets(name: str) -> str:
    """``[Name]`` and ``Table[Name]``-style result headers to ``Name``; other names stay."""
    found = re.fullmatch(r"[^\[\]]*\[(.*)\]", name)
    return found.group(1) if found else name


def rename(df: DataFrame, fix) -> DataFrame:
    return df.toDF(*[fix(c) for c in df.columns])


def with_lineage(df: DataFrame, sequence: bool = True) -> DataFrame:
    """Add ``_path``, ``_part``, ``_snapshot`` and, for batch reads, ``_seq``: the order of
    ingestion, live part first, then its snapshots by time, rows in file order."""
    path = F.col("_metadata.file_path")
    snapshot = F.regexp_extract(path, SNAPSHOT_ID, 1)
    columns = [path.alias("_path"), F.regexp_extract(path, PART_ID, 1).alias("_part"), snapshot.alias("_snapshot")]
    if sequence:
        start = F.col("_metadata.file_block_start")
        row = F.monotonically_increasing_id()
        columns.append(F.struct(snapshot.alias("snapshot"), path.alias("path"), start.alias("block"), row.alias("row")).alias("_seq"))
    return df.select("*", *columns)


def _missing(error: Exception) -> bool:
    return any(code in str(error) for code in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"))


def _empty(spark: SparkSession, columns: Sequence[str], lineage: bool) -> DataFrame:
    df = spark.createDataFrame([], text_schema(columns))
    if not lineage:
        return df
    seq = F.struct(*[F.lit("").alias(n) for n in ("snapshot", "path")], F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row"))
    return df.select("*", *[F.lit("").alias(n) for n in ("_path", "_part", "_snapshot")], seq.alias("_seq"))


def scan_manifest_csv(
    spark: SparkSession, root: str, entity: str, columns: Sequence[str], header: bool = False, lineage: bool = False
) -> DataFrame:
    """Every part and snapshot of an entity as text columns, missing cells ``""``.

    Names come from the manifest, files carry no header. Quoted cells may hold line breaks and
    doubled quotes, so a file is read by one task: keep parts of moderate size. Malformed lines are read as far as
    they go and unreadable files are skipped, so one bad part does not stop the rest. An
    entity without files is an empty frame.
    """
    schema = text_schema(columns)
    try:
        raw = (
            spark.read.schema(schema)
            .option("header", header)
            .option("enforceSchema", True)
            .option("recursiveFileLookup", True)
            .option("ignoreCorruptFiles", True)
            .option("mode", "PERMISSIVE")
            .option("multiLine", True)
            .option("escape", '"')
            .csv(f"{root.rstrip('/')}/{entity}")
        )
    except AnalysisException as error:
        if _missing(error):
            return _empty(spark, columns, lineage)
        raise
    rows = with_lineage(raw).where(F.col("_path").rlike(PART_FILE)).na.fill("", list(columns))
    return rows if lineage else rows.select(*columns)


def _text(spark: SparkSession, path: str, fmt: str, **options) -> DataFrame:
    """All files below a folder; what cannot be read is left out here and shows in the report."""
    reader = spark.read.format(fmt).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True)
    return reader.options(**options).load(path)


def part_headers(spark: SparkSession, root: str, entity: str, missing_ok: bool = True) -> DataFrame:
    """``path, length, part, snapshot, header``: every part with its first line, which a part that cannot be read lacks.

    The listing comes from the file index, which leaves out files without a byte; the lines from one narrow scan that
    keeps a line a file. A header is one line.
    """
    path = f"{root.rstrip('/')}/{entity}"
    name = F.col("_metadata.file_path")
    try:
        listed = _text(spark, path, "binaryFile").select(name.alias("path"), "length").where(F.col("path").rlike(PART_FILE))
        lines = _text(spark, path, "text").where(F.col("_metadata.file_block_start") == 0)
    except AnalysisException as error:
        if missing_ok and _missing(error):
            return spark.createDataFrame([], "path string, length long, part string, snapshot string, header string")
        raise
    numbered = lines.select(name.alias("path"), "value", F.monotonically_increasing_id().alias("_row")).where(F.col("path").rlike(PART_FILE))
    first = numbered.groupBy("path").agg(F.min_by("value", "_row").alias("header"))
    ids = [F.regexp_extract("path", PART_ID, 1).alias("part"), F.regexp_extract("path", SNAPSHOT_ID, 1).alias("snapshot")]
    return listed.join(first, "path", "left").select("path", "length", *ids, "header")


def header_names(line: str) -> list[str]:
    """The cells of a header line; empty and repeated ones are named by their place."""
    names: list[str] = []
    for i, cell in enumerate(next(csv.reader([line.removeprefix("\ufeff")]), [])):
        names.append(cell if cell and cell.lower() not in {n.lower() for n in names} else f"{cell}_{i}")
    return names


def _by_header(spark: SparkSession, root: str, entity: str, parts: list) -> list[tuple[DataFrame, list[str]]]:
    """The rows of the parts, a frame per distinct header, with ``_path`` and ``_malformed``; parts of one header are read together."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for part in sorted(parts, key=lambda p: p.path):
        groups.setdefault(tuple(header_names(part.header)), []).append(part.path)
    frames = []
    for names, paths in groups.items():
        schema = text_schema([*names, MALFORMED])
        options = {"header": True, "enforceSchema": True, "multiLine": True, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
        raw = spark.read.schema(schema).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).options(**options).csv(f"{root.rstrip('/')}/{entity}")
        raw = with_lineage(raw).where(F.col("_metadata.file_path").isin(paths))
        frames.append((raw.withColumn(MALFORMED, F.col(f"`{MALFORMED}`").isNotNull()), list(names)))
    return frames


def _aligned(frames: list[tuple[DataFrame, list[str]]]) -> tuple[DataFrame, list[str]]:
    """One frame with the columns of all headers by name, missing cells ``""``; and the names, in the order in which they are met."""
    names: dict[str, str] = {}
    whole = None
    for frame, own in frames:
        for n in own:
            names.setdefault(n.lower(), n)
        whole = frame if whole is None else whole.unionByName(frame, allowMissingColumns=True)
    return whole.na.fill("", list(names.values())), list(names.values())


def scan_header_csv(spark: SparkSession, root: str, entity: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parts with a header row, each by its own header; ``columns`` selects and orders, else all names in the order in which they are met.

    Rows with too few or too many cells are read as far as they go; ``scan_report`` counts them.
    """
    parts = [p for p in part_headers(spark, root, entity).collect() if p.header]  # a short row a file
    if not parts:
        return _empty(spark, columns or [], False)
    rows, names = _aligned(_by_header(spark, root, entity, parts))
    return missing_columns(rows, columns) if columns else rows.select(*[F.col(f"`{n}`") for n in names])


def scan_report(spark: SparkSession, root: str, entity: str) -> DataFrame:
    """``path, part, snapshot, rows, malformed, outcome`` of every part with a header row.

    ``OK``; ``MALFORMED`` where rows have more or fewer cells than the header, as in a part that was cut
    off; ``ZERO_ROWS``; ``EMPTY`` where even the header line is empty; ``READ_FAIL`` where no line can be read.
    """
    headers = materialize(part_headers(spark, root, entity), "headers")
    parts = headers.where("header <> ''").collect()
    counted = spark.createDataFrame([], "path string, rows long, malformed long")
    if parts:
        rows, names = _aligned(_by_header(spark, root, entity, parts))
        # a cell is looked at, as Spark refuses to read a file for its malformed rows alone
        counted = rows.groupBy(F.col("_path").alias("path")).agg(F.count_if(F.length(F.col(f"`{names[0]}`")) >= 0).alias("rows"), F.count_if(MALFORMED).alias("malformed"))
    outcome = (
        F.when(F.col("header").isNull(), "READ_FAIL").when(F.col("header") == "", "EMPTY")
        .when(F.col("rows").isNull(), "ZERO_ROWS").when(F.col("malformed") > 0, "MALFORMED").otherwise("OK")
    )
    zero = F.lit(0).cast("long")
    return headers.join(counted, "path", "left").select(
        "path", "part", "snapshot", F.coalesce("rows", zero).alias("rows"), F.coalesce("malformed", zero).alias("malformed"), outcome.alias("outcome")
    )


#: The types that text may be read as, the first that fits all cells (dates before times, as a date is
#: a time as well), and what a cell must look like before a cast is tried, as failing casts are dear.
INFERRED = {
    "int": r"^[+-]?\d{1,10}$",
    "bigint": r"^[+-]?\d{1,19}$",
    "double": r"(?i)^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$|^nan$|^[+-]?inf(inity)?$",
    "boolean": r"(?i)^(true|false)$",
    "date": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "timestamp": r"^\d{4}-\d{1,2}-\d{1,2}[ T].+$",
}


def infer_types(rows: DataFrame) -> tuple[dict[str, str], int]:
    """The type of each text column by all its non-empty cells, and the number of rows: one pass."""
    checks, names = [F.count(F.lit(1)).alias("_rows")], rows.columns
    for i, name in enumerate(names):
        cell = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
        checks.append(F.count(cell).alias(f"{i}"))
        for kind, looks in INFERRED.items():
            fits = cell.rlike(INFERRED["date"]) | cell.rlike(looks) if kind == "timestamp" else cell.rlike(looks)
            checks.append(F.count(F.when(fits, cell.try_cast(kind))).alias(f"{i}:{kind}"))
    found = rows.agg(*checks).first()
    types = {n: next((k for k in INFERRED if found[f"{i}"] and found[f"{i}:{k}"] == found[f"{i}"]), "string") for i, n in enumerate(names)}
    return types, found["_rows"]


def scan_infer_csv(spark: SparkSession, root: str, entity: str) -> tuple[DataFrame | None, str]:
    """Header CSV with inferred types, newest snapshot of each part; the frame and its outcome.

    The rows are read once, as text, and written; types and number come from the written table. The
    outcome is ``READ_FAIL`` with a reason, ``EMPTY``, ``ZERO_ROWS`` or the row count as text.
    """
    try:
        parts = part_headers(spark, root, entity, missing_ok=False).collect()
    except AnalysisException as error:
        if _missing(error):
            return None, f"READ_FAIL: no parts below {entity}"
        raise
    newest: dict[str, str] = {}
    for p in parts:
        newest[p.part] = max(newest.get(p.part, ""), p.snapshot)
    kept = [p for p in parts if p.snapshot == newest[p.part]]
    unread = [p.path for p in kept if p.header is None]
    kept = [p for p in kept if p.header]
    if not kept:
        return None, f"READ_FAIL: {', '.join(unread)}" if unread else "EMPTY"
    rows, names = _aligned(_by_header(spark, root, entity, kept))
    text = materialize(rows.select(*[F.col(f"`{n}`").alias(sanitize_name(n)) for n in names]), "text")
    types, count = infer_types(text)
    if not count:
        return None, "ZERO_ROWS"
    cells = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in text.columns]
    return text.select(*[c.cast(types[n]).alias(n) for c, n in zip(cells, text.columns)]), str(count)


def write_table_overwrite(df: DataFrame, name: str, fmt: str = "parquet", path: str | None = None) -> str:
    """Replace a table and its schema; the table name is lower case, ``path`` makes it external."""
    writer = df.write.mode("overwrite").format(fmt).option("overwriteSchema", True)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name.lower())
    return name.lower()


def ingest_entities(spark: SparkSession, root: str, entities: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Load each entity into its table; ``entity, outcome`` of every one. An entity that fails is reported."""
    report = []
    for entity in entities:
        rows, outcome = scan_infer_csv(spark, root, entity)
        if rows is not None:
            write_table_overwrite(rows, entity, fmt)
        report.append((entity, outcome))
    return spark.createDataFrame(report, "entity string, outcome string")


def discover_entities(spark: SparkSession, root: str, prefix: str = "Dim_") -> DataFrame:
    """Sorted names of the sub-folders that hold files and start with ``prefix``; only paths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = F.regexp_extract("path", rf"/({re.escape(prefix)}[^/]*)/", 1)
    return files.select(name.alias("entity")).where(F.col("entity") != "").distinct().orderBy("entity")


def load_entities(
    spark: SparkSession,
    root: str,
    manifest: Mapping[str, Sequence[str]],
    only: Sequence[str] | None = None,
    header: bool = False,
    lineage: bool = False,
) -> dict[str, DataFrame]:
    """Lazy frames of all or some entities; what is not used is not read."""
    wanted = [e for e in manifest if only is None or e in only]
    return {e: scan_manifest_csv(spark, root, e, manifest[e], header, lineage) for e in wanted}


def missing_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns in this order; absent ones are ``""``."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])


def typed_rows_to_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Result rows with bracketed names and typed cells as plain text columns."""
    from salesloom.functions.values import typed_to_text

    plain = rename(df, strip_brackets)
    cells: list[Column] = [typed_to_text(F.col(f"`{n}`"), t).alias(n) for n, t in plain.dtypes]
    return missing_columns(plain.select(*cells), columns)
