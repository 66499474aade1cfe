"""Delimited files with quoted cells, read by many tasks although cells may hold line feeds.

Spark reads the lines of a file in ranges. Whether a range begins within an open cell isn't
known there, but what it does to either state is: that is found for all ranges at once, and
composed along each file. Then every task knows the state that its range begins with and
puts lines together to records. The few records that go on across ranges are joined from
their parts. Cells are parsed from records by Spark's own CSV expression.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailflow.session import ship_package
from retailflow.sources.charset import PYTHON_NAMES, lines_of
from retailflow.storage import small, written

_RECORDS = "file string, block long, row long, text string"


class Quotes:
    """Whether a line leaves a cell open. A quote opens a cell only at its beginning."""

    def __init__(self, sep: str):
        other = f"[^{re.escape(sep)}]*+"
        closing = rf'(?:[^"]++|"")*+"{other}'
        cell = f'(?:"{closing}|(?!"){other})'
        self.whole = re.compile(f"{cell}(?:{re.escape(sep)}{cell})*+", re.S)
        self.end = re.compile(f"{closing}(?:{re.escape(sep)}{cell})*+", re.S)

    def leaves_open(self, line: str, opened: bool) -> bool:
        if '"' not in line:
            return opened
        return not (self.end if opened else self.whole).fullmatch(line)


def _lines(batches, codec: str):
    """(file, block, opened, line) of each line; bytes that the charset hasn't raise."""
    at = None
    for batch in batches:
        opened = batch.column("opened").to_pylist() if "opened" in batch.schema.names else [False] * batch.num_rows
        for file, block, state, raw in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), opened, batch.column("value").to_pylist(), strict=True):
            line = raw.decode(codec)
            if at != (file, block):
                at = (file, block)
                if block == 0:
                    line = line.removeprefix("\ufeff")
            yield file, block, state, line


def _effects(sep: str, codec: str):
    """For each range what it does to a closed and to an open cell at its beginning.

    Only lines with a quote are looked at, but all of a file's first range, whose first line
    may have a byte order mark.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        quotes, found = Quotes(sep), {}

        def quoted():
            for batch in batches:
                for one in pa.table([batch.column("file"), batch.column("block")], ["file", "block"]).group_by(["file", "block"]).aggregate([]).to_pylist():
                    found.setdefault((one["file"], one["block"]), (False, True))
                yield batch.filter(pc.or_(pc.equal(batch.column("block"), 0), pc.match_substring(batch.column("value"), '"')))

        for file, block, _, line in _lines(quoted(), codec):
            closed, opened = found.get((file, block), (False, True))
            found[file, block] = (quotes.leaves_open(line, closed), quotes.leaves_open(line, opened)) if '"' in line else (closed, opened)
        rows = [(*k, *v) for k, v in found.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "block", "closed", "opened"])

    return run


def _assembled(sep: str, codec: str, parts: bool, size: int = 4096):
    """The records that begin and end in a range; or else the parts of those that don't, of
    which one that goes on with a record of an earlier range has row -1."""
    import pyarrow as pa

    def block_of(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "block", "row", "text"])

    def run(batches):
        quotes, at, opened, n, begun, held, out = Quotes(sep), None, False, 0, 0, [], []
        for file, block, state, line in _lines(batches, codec):
            if at != (file, block):
                if held and parts:  # open at the end of a range
                    out.append((*at, begun, "\n".join(held)))
                at, opened, n, held, begun = (file, block), state, 0, [], -1
            if not held and not opened:
                begun = n
            held.append(line)
            opened = quotes.leaves_open(line, opened)
            if not opened:
                if (begun < 0) == parts:
                    out.append((*at, begun, "\n".join(held)))
                held = []
            n += 1
            if len(out) >= size:
                yield block_of(out)
                out = []
        if held and parts:
            out.append((*at, begun, "\n".join(held)))
        if out:
            yield block_of(out)

    return run


def ranges(spark: SparkSession, path, sep: str, charset: str) -> DataFrame:
    """file, block, opened and leaves of each range: whether a cell is open where it begins and ends.

    One row for each range; those of a file are composed in its order.
    """
    ship_package(spark)
    lines = lines_of(spark, path, charset).withColumn("value", F.col("value").cast("binary"))
    effects = lines.mapInArrow(_effects(sep, PYTHON_NAMES[charset]), "file string, block long, closed boolean, opened boolean")
    # a range either sets the state, whatever it was, or leaves it, or turns it over
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    turned = F.sum((F.col("closed") & ~F.col("opened")).cast("long")).over(so_far)
    effects = effects.withColumn("turned", turned)
    last = F.last(F.when(F.col("closed") == F.col("opened"), F.struct(F.col("closed").cast("long").alias("state"), "turned")), True).over(so_far)
    after = F.pmod(F.coalesce(last["state"], F.lit(0)) + F.col("turned") - F.coalesce(last["turned"], F.lit(0)), F.lit(2)) == 1
    done = effects.withColumn("leaves", after).withColumn("opened", F.lag("leaves", 1, False).over(Window.partitionBy("file").orderBy("block")))
    return written(done.select("file", "block", "opened", "leaves"), "ranges")


def records(spark: SparkSession, path, sep: str, charset: str = "UTF-8") -> DataFrame:
    """file, block, row and text of each record; block and row say where it begins."""
    states = ranges(spark, path, sep, charset)
    few = F.broadcast if small(states) else (lambda df: df)
    codec = PYTHON_NAMES[charset]
    lines = lines_of(spark, path, charset).withColumn("value", F.col("value").cast("binary"))
    known = lines.join(few(states.drop("leaves")), ["file", "block"])
    whole = known.mapInArrow(_assembled(sep, codec, False), _RECORDS)
    across = states.where("opened OR leaves").select("file", "block", "opened")
    if across.isEmpty():
        return whole
    parts = lines.join(few(across), ["file", "block"]).mapInArrow(_assembled(sep, codec, True), _RECORDS)
    # a part with a row begins a record; those behind it without one go on with it
    parts = parts.withColumn("of", F.count(F.when(F.col("row") >= 0, 1)).over(Window.partitionBy("file").orderBy("block", "row")))
    each = parts.groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("block", "row", "text"))).alias("each"))
    joined = each.select("file", F.col("each")[0]["block"].alias("block"), F.col("each")[0]["row"].alias("row"), F.array_join(F.col("each.text"), "\n").alias("text"))
    return whole.unionByName(joined)


def header(spark: SparkSession, path, sep: str, charset: str, most: int = 64) -> list[str]:
    """Names of the columns, by the first record of a file of the path; it may have so many lines."""
    first = lines_of(spark, path, charset).where("block = 0").select("file", F.col("value").cast("binary").alias("value")).limit(most).collect()
    quotes, text = Quotes(sep), ""
    for r in first:
        if r.file != first[0].file:
            break
        text += r.value.decode(PYTHON_NAMES[charset])
        if not quotes.leaves_open(text, False):
            break
        text += "\n"
    names, out = next(csv.reader([text.removeprefix("\ufeff").removesuffix("\r")], delimiter=sep), []), []
    for n in (n.strip() for n in names):  # of equal names the first one counts
        out.append(n if n not in out else f"{n}.{len(out)}")
    return out


def _each_line(codec: str):
    """Every line as a record, numbered within its range."""
    import pyarrow as pa

    def run(batches):
        at, n = None, 0
        for batch in batches:
            rows, texts = [], []
            for file, block, _, line in _lines([batch], codec):
                at, n = (file, block), (n + 1 if at == (file, block) else 0)
                rows.append(n)
                texts.append(line)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(rows, pa.int64()), pa.array(texts, pa.string())], names=["file", "block", "row", "text"])

    return run


def read(spark: SparkSession, path, sep: str, charset: str, names: list[str], multiline: bool = True) -> DataFrame:
    """The cells of all records but each file's first, as strings, and `pos`, which orders them as in the files.

    With multiline=False no cell may hold a line feed: then every line is a record, and the
    files are read once instead of twice.
    """
    shape = ", ".join(f"c{i} string" for i in range(len(names)))
    if multiline:
        found = records(spark, path, sep, charset)
    else:
        ship_package(spark)
        lines = lines_of(spark, path, charset).withColumn("value", F.col("value").cast("binary"))
        found = lines.mapInArrow(_each_line(PYTHON_NAMES[charset]), _RECORDS)
    # the header is the first record of a file: it begins at its first byte
    found = found.where("NOT (block = 0 AND row = 0)").withColumn("text", F.regexp_replace("text", "\r$", "")).where("text <> ''")
    cells = F.from_csv("text", shape, {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": "true"})
    place = F.struct(F.element_at(F.split("file", "/"), -1).alias("file"), "block", "row")
    return found.select(cells.alias("c"), place.alias("pos")).select(*[F.col(f"c.c{i}").alias(n) for i, n in enumerate(names)], "pos")
