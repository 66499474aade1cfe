"""Sources and sinks: raw and processed CSV, tables by kind, and what a folder holds.

Tables are kept as Parquet in one folder for each kind, the selection as a partition of it.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailflow.storage import drop_folder, freed

from . import charset, records, schema

KINDS = tuple(schema.COLUMNS)
#: Bytes of text in a batch of an export's files, about, and of text in a byte of a compressed file.
BATCH_BYTES, COMPRESSED = 4 << 30, 10


class MissingColumns(ValueError):
    """A table lacks columns that its contract asks for; they are listed."""


def require_columns(df: DataFrame, names, what: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"{what} lacks the columns {', '.join(missing)}")
    return df


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The charset of a file, or of a folder's files if it is one, by all of their bytes."""
    found = set(charset.detect(spark, path).values())
    if len(found) > 1:
        raise ValueError(f"files of several charsets in {path}: {', '.join(sorted(found))}")
    return found.pop() if found else "UTF-8"


def read_csv(spark: SparkSession, path: str, sep: str = "|", encoding: str = "utf-8", multiline: bool = True, position: str | None = None) -> DataFrame:
    """All columns as strings; quoted separators, doubled quotes and line feeds are read.

    With multiline=False no cell may hold a line feed, and a large file is read by many
    tasks. `position` names a column to be added that orders rows as they stand in the files.
    Charsets other than UTF-8 need spark.sql.legacy.javaCharsets. A byte order mark goes.
    """
    df = spark.read.options(sep=sep, encoding=encoding, header=True, quote='"', escape='"', multiLine=multiline, inferSchema=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    if position:
        place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        return df.select("*", place.alias(position)).toDF(*names, position)
    return df.toDF(*names)


def read_raw(spark: SparkSession, path: str, kind: str, encoding: str | None = None, multiline: bool = True) -> DataFrame:
    """A raw export by kind, pruned to its contract and renamed; pos orders rows as in the files.

    Without an encoding each file's is detected by all of its bytes; bytes that a charset
    hasn't raise when the rows are read. Large files are read by many tasks, and cells may
    hold line feeds; with multiline=False no cell may, which spares a pass over the files.
    """
    if kind not in schema.RAW:
        raise ValueError(f"unknown kind of dataset: {kind}")
    sep, names = schema.RAW[kind]
    if encoding:
        groups = [(path, next((c for c in charset.PYTHON_NAMES if c.lower() == encoding.lower()), encoding))]
    else:
        found = charset.detect(spark, path)
        kinds = sorted(set(found.values())) or ["UTF-8"]
        groups = [(path if len(kinds) == 1 else [unquote(f) for f in sorted(found) if found[f] == k], k) for k in kinds]
    out = None
    for at, one in groups:
        if one in charset.PYTHON_NAMES:
            columns = records.header(spark, at, sep, one)
            df = records.read(spark, at, sep, one, columns, multiline) if set(names) <= set(columns) else spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        else:  # another charset, by Spark's own reader
            df = read_csv(spark, at, sep, one, multiline, "pos")
        require_columns(df, names, f"raw {kind}")
        df = df.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()], "pos")
        out = df if out is None else out.unionByName(df)
    return out


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """A processed CSV file with names as used here, all strings."""
    df = read_csv(spark, path)
    return df.select(*[F.col(f"`{c}`").alias(schema.HEADERS.get(c, c)) for c in df.columns])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Processed rows under their file headers."""
    names = {v: k for k, v in schema.HEADERS.items()}
    df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns if c != "pos"]).write.mode(mode).options(sep="|", header=True, quote='"', escape='"', encoding="UTF-8").csv(path)


def table_path(folder: str, kind: str) -> str:
    return f"{folder.rstrip('/')}/{kind}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files in a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength())


def batches(spark: SparkSession, path: str, size: int | None = None) -> list:
    """The files of a path in lists of about `size` bytes of text, larger files alone; the path
    itself where one list would have all."""
    out, total, size = [], 0, size or BATCH_BYTES
    for file in sorted(spark.read.text(path).inputFiles()):
        file = unquote(file)
        n = bytes_of(spark, file) * (COMPRESSED if file.endswith((".gz", ".bz2", ".deflate", ".zst", ".xz")) else 1)
        if not out or total + n > size:
            out.append([])
            total = 0
        out[-1].append(file)
        total += n
    return out if len(out) > 1 else [path]


# ---------------------------------------------------------------- tables in versions
#
# A table is a folder of versions, "version=<id>", each written by one job and never changed,
# and of numbered manifests in "_manifests". The last manifest names the versions that are
# the table. A writer first writes a version and then, in one step, a manifest; until then
# readers have the former table, however the writer ends. Whether a row is in the selection
# is a partition of the same table, so that both always belong together.


def _files(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _read_text(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of a table's manifests, the last of which holds."""
    return [int(n.removesuffix(".json")) for n in _files(spark, f"{path}/_manifests") if n.endswith(".json")]


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """A table's manifest, or None if there is no table."""
    numbers = manifests(spark, path) if number is None else [number]
    return json.loads(_read_text(spark, f"{path}/_manifests/{numbers[-1]:09d}.json")) | {"number": numbers[-1]} if numbers else None


def publish(spark: SparkSession, path: str, content: dict, after: int) -> None:
    """Make a manifest the last one. If another writer has done so since, this raises and changes nothing."""
    target = f"{path}/_manifests/{after + 1:09d}.json"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/.{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(at, False)
    try:
        stream.write(json.dumps(content).encode("utf-8"))
    finally:
        stream.close()
    if exists(spark, target) or not fs.rename(at, jvm.org.apache.hadoop.fs.Path(target)):
        fs.delete(at, False)
        raise RuntimeError(f"another writer has changed {path}")


def _plain(spark: SparkSession, path: str) -> bool:
    """Whether a folder is a table without versions: Parquet files as Spark writes them."""
    return not manifests(spark, path) and any(n.endswith(".parquet") for n in _files(spark, path))


def present(spark: SparkSession, path: str) -> bool:
    return bool(manifests(spark, path)) or _plain(spark, path)


def _merged(old: T.StructType, new: T.StructType) -> T.StructType:
    known = {f.name: f.dataType for f in old}
    if clash := [f.name for f in new if known.get(f.name, f.dataType) != f.dataType]:
        raise ValueError(f"appended columns have other types: {', '.join(clash)}")
    return T.StructType([*old, *(f for f in new if f.name not in known)])


def write_table(df: DataFrame, folder: str, kind: str, mode: str = "replace", key: list[str] | None = None, selected: Column | None = None, order: tuple = (), more: Iterable[DataFrame] = ()) -> None:
    """Replace a table, or append to it as it is: no dedup, no sorting.

    With a key, rows whose key is there already aren't appended again. `selected` says which
    rows are in the selection; rows of a customer are found by a Bloom filter of each row
    group. A failed writer leaves the table as it was. Versions that neither the last
    manifest nor the one before names are removed. A table without versions that is appended
    to becomes one with them. Frames in `more` have further rows: each is written when the
    one before is, as a version of its own, and all become part of the table in one step.
    They go without a key.
    """
    if mode not in ("replace", "append"):
        raise ValueError(f"unknown mode: {mode}")
    spark, path = df.sparkSession, table_path(folder, kind)
    now = manifest(spark, path)
    if mode == "append" and now and key:
        old = read_table(spark, folder, kind, False).select(*[F.col(k).alias(f"_{k}") for k in key])
        df = df.join(old, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left_anti").dropDuplicates(key)
    if mode == "append" and _plain(spark, path):
        df = append_all(spark.read.parquet(path), df)
    schema_, made = df.schema, []
    try:
        for part in itertools.chain([df], more):
            made.append(uuid.uuid4().hex[:16])
            _write_version(part, f"{path}/version={made[-1]}", selected, order)
    except Exception:
        for version in made:
            drop_folder(spark, f"{path}/version={version}")
        raise
    old = now if mode == "append" and now else {"versions": [], "schema": T.StructType([]).jsonValue()}
    if old["versions"] and old["selection"] != (selected is not None):
        raise ValueError(f"{path} {'has' if old['selection'] else 'has no'} selection")
    content = {"versions": [*old["versions"], *made], "schema": _merged(T.StructType.fromJson(old["schema"]), schema_).jsonValue(), "selection": selected is not None}
    publish(spark, path, content, now["number"] if now else 0)
    if now:
        _drop_old(spark, path, {*content["versions"], *now["versions"]}, now["number"])


def _write_version(df: DataFrame, path: str, selected: Column | None, order: tuple) -> None:
    if selected is not None:
        df = df.withColumn("selected", F.coalesce(selected, F.lit(False)))
        df = df.sortWithinPartitions("selected", *order) if order else df
    writer = df.write if selected is None else df.write.partitionBy("selected")
    for c in {"customer_id"} & set(df.columns):
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    with freed(df.sparkSession):
        writer.option("compression", "zstd").parquet(path)


def _drop_old(spark: SparkSession, path: str, keep: set[str], since: int) -> None:
    named = set()
    for n in manifests(spark, path):
        if n < since:
            named |= set(manifest(spark, path, n)["versions"])
            drop_folder(spark, f"{path}/_manifests/{n:09d}.json")
    for v in named - keep:
        drop_folder(spark, f"{path}/version={v}")


def read_table(spark: SparkSession, folder: str, kind: str, selection: bool | None = None) -> DataFrame:
    """A table of a folder; with selection=None the selection where there is one.

    The selection is read by partition; no footer is read for the schema.
    """
    path = table_path(folder, kind)
    now = manifest(spark, path)
    if now is None and _plain(spark, path):
        other = f"{path}_selection"
        return spark.read.parquet(other if selection in (None, True) and _plain(spark, other) else path)
    if now is None:
        raise FileNotFoundError(f"no table {kind} in {folder}; load it first")
    shape = T.StructType([*T.StructType.fromJson(now["schema"]), T.StructField("version", T.StringType()), *([T.StructField("selected", T.BooleanType())] if now["selection"] else [])])
    df = spark.read.schema(shape).option("basePath", path).parquet(*[f"{path}/version={v}" for v in now["versions"]])
    if now["selection"] and selection in (None, True):
        df = df.where("selected")
    return df.drop("version", "selected")


def status(spark: SparkSession, folder: str) -> DataFrame:
    """(table, present) for each kind."""
    rows = [(k, present(spark, table_path(folder, k))) for k in KINDS]
    return spark.createDataFrame(rows, T.StructType([T.StructField("table", T.StringType()), T.StructField("present", T.BooleanType())]))


def require_tables(spark: SparkSession, folder: str, kinds) -> None:
    missing = [k for k in kinds if not present(spark, table_path(folder, k))]
    if missing:
        raise AnalysisException(f"load these tables first: {', '.join(missing)}")


def append_all(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, columns aligned by name, missing ones as nulls."""
    return old.unionByName(new, allowMissingColumns=True)


def item_names(items: DataFrame) -> DataFrame:
    """(item_code, site_name): of several rows of a code the last one with a name wins, by
    pos where the table has it."""
    if not {"item_code", "site_name"} <= set(items.columns):
        return items.sparkSession.createDataFrame([], "item_code string, site_name string")
    named = items.where("item_code IS NOT NULL AND site_name IS NOT NULL").withColumn("_at", F.col("pos") if "pos" in items.columns else F.monotonically_increasing_id())
    return named.groupBy("item_code").agg(F.max_by("site_name", "_at").alias("site_name"))
