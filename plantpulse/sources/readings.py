"""CSV and multi-file reads."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import FAILURE_TYPE, READING_SCHEMA, RUN, STATUS, TIMESTAMP, WARNING_TYPE, require_columns
from ..functions.labels import file_stem, layered_labels
from ..functions.status import clean_status
from ..functions.timebase import parse_timestamp
from ..operators.filters import configured_filter, nan_to_null
from ..operators.resample import resample
from ..storage import BROADCAST_ROWS

_ROW = "_row"
# Distinct headers looked up at the same time.
_LOOKUPS = 16
_KNOWN_TYPES = {f.name: f.dataType for f in READING_SCHEMA}


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Give the schema where it is known; inferring it costs a pass."""
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is None:
        reader = reader.option("inferSchema", True)
    else:
        reader = reader.schema(schema).option("enforceSchema", False)
    return nan_to_null(reader.csv(paths if isinstance(paths, str) else list(paths)))


def read_validated(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV that must have a timestamp; rows with any missing value are dropped."""
    df = read_csv(spark, path, schema)
    require_columns(df, TIMESTAMP)
    return df.withColumn(TIMESTAMP, F.col(TIMESTAMP).cast("timestamp")).na.drop("any")


def _plain_path(path: str) -> str:
    """Path or file URI without scheme, host and percent codes."""
    is_uri = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path)
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/", unquote(path) if is_uri else path).rstrip("/")


def _run_table(spark: SparkSession, files: Sequence[str], paths: Sequence[str], start: int) -> DataFrame:
    """(file, run id, labels) for every file that is read; a run is a file or the folder it lies in.

    The listing is the one the readers already hold, so rows need no work on their path but an
    equality join.
    """
    runs = {_plain_path(p): (start + i, p) for i, p in enumerate(paths)}
    if len(runs) != len(paths):
        raise ValueError("a run file is listed twice")

    def found(file: str):
        plain = _plain_path(file)
        return runs.get(plain) or runs[plain.rpartition("/")[0]]

    rows = [(file, *found(file)) for file in files]
    table = spark.createDataFrame(rows, f"_uri string, {RUN} bigint, _given string")
    table = table.withColumn("_stem", file_stem(F.col("_given")))
    warning, failure = layered_labels(F.col("_given"), F.col("_stem"))
    labelled = table.select("_uri", RUN, warning.alias("_warning"), failure.alias("_failure"))
    return F.broadcast(labelled) if len(rows) <= BROADCAST_ROWS else labelled


def _first_lines(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """First line by plain path, found in one job: a task per block, which ends at its first line. Empty files have none."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    # A block that costs as much to open as a partition may hold is alone in its partition.
    spark.conf.set("spark.sql.files.openCostInBytes", size)
    try:
        meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start")]
        lines = spark.read.text(list(paths)).select(*meta, "value")

        def first(batches):
            for batch in batches:
                if batch.num_rows:
                    if batch.column(1)[0].as_py() == 0:
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), batch.column(2).slice(0, 1)], names=["path", "line"])
                    return

        found = lines.mapInArrow(first, "path string, line string").collect()  # as many rows as the listing has files
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    return {_plain_path(r["path"]): r["line"] for r in found}


def _headers(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, ...]]:
    """Column names of each file: first lines are found in one job, and Spark reads the names of one file for each distinct line."""
    lines = _first_lines(spark, paths)
    own = [lines.get(_plain_path(p)) for p in paths]
    examples = dict(zip(own, paths))
    names = lambda path: tuple(spark.read.option("header", True).option("escape", '"').csv(path).columns)
    with ThreadPoolExecutor(_LOOKUPS) as pool:
        columns = dict(zip(examples, pool.map(names, examples.values())))
    return [columns[line] for line in own]


def _read_group(spark: SparkSession, paths: list[str], header: tuple[str, ...]) -> DataFrame:
    """Files that share a header. Times are read as text because their layout varies."""
    reader = spark.read.option("header", True).option("escape", '"')
    if all(name in _KNOWN_TYPES for name in header):
        fields = [T.StructField(n, T.StringType() if n == TIMESTAMP else _KNOWN_TYPES[n]) for n in header]
        # A header that differs from the schema raises: values never land in another column.
        df = reader.schema(T.StructType(fields)).option("enforceSchema", False).csv(paths)
    else:
        df = reader.option("inferSchema", True).option("timestampFormat", "'never'").csv(paths)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return df.select("*", F.input_file_name().alias("_uri"), place.alias(_ROW))


def load_runs(
    spark: SparkSession,
    paths: Sequence[str],
    start_run_id: int = 1,
    labels: bool = False,
    frequency: str | None = None,
    method: str = "mean",
    header: Sequence[str] | None = None,
) -> DataFrame:
    """Read many run files, number the runs in list order, clean, resample and label them.

    A run is a CSV file or a folder of CSV parts. Files are read together per distinct header and
    united by column name. Give the ``header`` where all files share a known one (a file with another one
    raises); otherwise each part file's first line is looked up. With ``labels`` the warning or failure type is read off the path.
    """
    if not paths:
        return spark.createDataFrame([], T.StructType([*READING_SCHEMA, T.StructField(RUN, T.LongType())]))
    by_header: dict[tuple[str, ...], list[str]] = {}
    # Parts of a run may differ in their columns, so every part file's own header is looked up.
    parts = paths if header is not None else [unquote(f) for f in spark.read.text(list(paths)).inputFiles()]
    for path, columns in zip(parts, _headers(spark, parts) if header is None else [tuple(header)] * len(paths)):
        by_header.setdefault(columns, []).append(path)
    read = [_read_group(spark, group, header) for header, group in by_header.items()]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)

    runs = _run_table(spark, [f for table in read for f in table.inputFiles()], paths, start_run_id)
    unlisted = F.raise_error(F.concat(F.lit("no run for file "), "_uri")).cast("bigint")
    df = df.join(runs, "_uri", "left").withColumn(RUN, F.coalesce(RUN, unlisted))
    df = nan_to_null(df.drop("_uri"))
    if TIMESTAMP in df.columns:
        df = df.withColumn(TIMESTAMP, parse_timestamp(F.col(TIMESTAMP).cast("string")))
        if STATUS in df.columns:
            df = df.withColumn(STATUS, clean_status(F.col(STATUS)))
        if frequency:
            df = resample(df, frequency, method, key=_ROW, groups=[RUN, "_warning", "_failure"])
    if labels:
        df = df.withColumns({WARNING_TYPE: F.col("_warning"), FAILURE_TYPE: F.col("_failure")})
    return df.drop("_warning", "_failure", _ROW)


def run_files(folder: str, names: Sequence[str] | None) -> list[str]:
    """Full paths of listed files; no list means no files. Windows separators are understood."""
    base = folder.replace("\\", "/").rstrip("/")
    return [f"{base}/{name}" for name in names or []]


def load_split(
    spark: SparkSession, train_path: str, test_path: str, condition=None, reader: Callable[[str], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Processed train and test tables, both under the same optional (column, operator, value) filter."""

    def read(path: str) -> DataFrame:
        if reader:
            return reader(path)
        return read_csv(spark, path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)

    tables = nan_to_null(read(train_path)), nan_to_null(read(test_path))
    if condition is None:
        return tables
    return tuple(configured_filter(t, *condition) for t in tables)


def union_by_name(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables; columns are matched by name and absent ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
