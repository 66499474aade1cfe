"""Operator 10: token ids in a content-addressed store.

A rolling hash over the ids cuts each document's id stream into chunks, so that equal
passages give equal chunks wherever they stand. The store has three tables of Parquet:

chunks     digest, n, width, payload: every distinct chunk once; little-endian ids of
           2 bytes where all are below 65536, else of 4
recipes    one row a document in ascending doc_id order: its chunks' digests and where each
           ends, its own root (a hash of the digests) and the place of its first id
manifest   a Merkle tree's upper levels: a hash for each range of documents, of the hashes of
           its blocks of FAN documents' roots; and of the ranges' hashes the root of all

Reading back checks every chunk against its digest and every root against the manifest.
The ids' crc32 is combined from those of the chunks as read, so no payload moves again.

While a store is written, a table of the encoded documents stands beside it: texts are
encoded once, and no chunk's ids are shuffled to find out which chunks repeat.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_ids, drop_folder, new_folder, prepare, raw_pieces, task_count, written
from .units import Units, id_cache, unit_places

#: A chunk ends where the rolling hash of its last WINDOW ids has no bit of CUT: 512 ids
#: on average. MOST ids end it in any case. WINDOW is a power of two.
WINDOW, CUT, MOST = 16, 511, 4096
#: Hashes that are hashed together at most, up to FAN ** 3 documents a range.
FAN = 4096
_Q = 0xD6E8FEB86659FD93


def cut_points(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of all chunks in ids, where documents end at ends (ascending, none empty)."""
    n = len(ids)
    cuts = np.zeros(n + 1, bool)
    if n >= WINDOW:
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        rolled, width = x, 1
        while width < WINDOW:  # two windows side by side are one of twice the width
            rolled = rolled[:-width] * np.uint64(pow(_Q, width, 1 << 64)) + rolled[width:]
            width *= 2
        rolled ^= rolled >> np.uint64(32)
        begin = np.concatenate([[0], ends[:-1]])
        inside = np.arange(n) - np.repeat(begin, ends - begin) >= WINDOW - 1
        cuts[WINDOW:] = (rolled & np.uint64(CUT) == 0) & inside[WINDOW - 1 :]
    cuts[ends] = True
    at = np.flatnonzero(cuts)
    begin = np.concatenate([[0], at[:-1]])
    if (at - begin > MOST).any():
        at = np.concatenate([np.append(np.arange(b + MOST, e, MOST), e) for b, e in zip(begin, at, strict=True)])
    return at


def digest(raw: bytes) -> bytes:
    """Of a chunk's ids in 4 bytes each, or of digests."""
    return hashlib.blake2b(raw, digest_size=16).digest()


def _encoded(batch, json_text: str, end_id: int):
    """For each piece of the batch: all ids with end ids, and where each document ends."""
    cache = id_cache(json_text)
    for _, own in itertools.groupby(raw_pieces(batch.column("_text"), unit_places), lambda p: p[2]):
        parts, ends = [], np.zeros(1, np.int64)
        for data, offsets, _ in own:  # several, if they are of one long text
            units = Units(data[offsets[0] : offsets[-1]], offsets - offsets[0])
            ids, lengths = cache.ids_of(units)
            total = np.zeros(len(lengths) + 1, np.int64)
            np.cumsum(lengths, out=total[1:])
            ends = ends[-1] + total[np.cumsum(units.counts)]
            parts.append(ids)
        ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
        yield np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def _documents_of(shared, end_id: int):
    """One row a document: its ids' number, root, and all its chunks."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            row = 0
            for ids, ends in _encoded(batch, shared.value, end_id) if batch.num_rows else ():
                at = cut_points(ids, ends)
                begin = np.append(0, at[:-1])
                own = np.searchsorted(at, ends, "right")  # chunks up to each document's end
                raw, small = ids.astype("<u4").tobytes(), ids.astype("<u2").tobytes()
                wide = np.maximum.reduceat(ids, begin) > 0xFFFF
                digests = [digest(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), at.tolist(), strict=True)]
                payload = [raw[4 * b : 4 * e] if w else small[2 * b : 2 * e] for b, e, w in zip(begin.tolist(), at.tolist(), wide.tolist(), strict=True)]
                starts, first = np.append(0, own[:-1]), np.append(0, ends[:-1])
                roots = [digest(b"".join(digests[i:j])) for i, j in zip(starts.tolist(), own.tolist(), strict=True)]
                offsets = pa.array(np.append(0, own), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(digests, pa.binary()), pa.array(at - begin, pa.int32()), pa.array(at - np.repeat(first, own - starts), pa.int64()), pa.array(np.where(wide, 4, 2), pa.int32()), pa.array(payload, pa.binary()))]
                n = pa.array(np.diff(np.append(0, ends)), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(ends)), n, *lists, pa.array(roots, pa.binary())], names=["doc_id", "n_tokens", "digests", "lengths", "ends", "widths", "payloads", "root"])
                row += len(ends)

    return run


def write_store(docs: DataFrame, tokenizer_file: str, folder: str | None = None, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> str:
    """Write every whole text's ids to a store and return its folder.

    A null text is empty: its ids are the end id alone. Null ids come first. Rows that
    share a doc_id are documents of their own, ordered by their content. Other columns
    aren't stored. An empty table gives a store of no documents.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or new_folder(spark, "token-store")
    shared = spark.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    n = task_count(spark)

    kinds = {"doc_id": T.LongType(), "n_tokens": T.LongType(), "digests": T.ArrayType(T.BinaryType()), "lengths": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.LongType()), "widths": T.ArrayType(T.IntegerType()), "payloads": T.ArrayType(T.BinaryType()), "root": T.BinaryType()}
    schema = T.StructType([T.StructField(k, t) for k, t in kinds.items()])
    made = rows.mapInArrow(_documents_of(shared, end_id), schema).withColumn("row", F.monotonically_increasing_id())
    made.write.option("compression", "lz4_raw").parquet(f"{folder}/encoded")  # read once or twice and dropped
    made = spark.read.schema(schema.add("row", T.LongType())).parquet(f"{folder}/encoded")

    # of equal chunks the first is stored; only the others are looked up
    spots = made.select("row", F.posexplode("digests").alias("k", "digest"))
    repeated = written(spots.groupBy("digest").agg(F.min(F.struct("row", "k")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "repeated")
    again = spots.join(repeated.hint("shuffle_merge"), "digest").where(F.struct("row", "k") != F.col("first")).select("row", "k")
    chunks = made.select("row", F.posexplode(F.arrays_zip("digests", "lengths", "widths", "payloads")).alias("k", "c"))
    chunks = by_ids(chunks, written(again, "again"), ["row", "k"], "left_anti")
    chunks = chunks.select(F.col("c.digests").alias("digest"), F.col("c.lengths").alias("n"), F.col("c.widths").alias("width"), F.col("c.payloads").alias("payload"))
    chunks.write.option("compression", "zstd").parquet(f"{folder}/chunks")

    # ranges of documents, then sums over the ranges, then sums within each
    # by root and row too, so that rows without an id, or of the same one, aren't one range
    ranged = made.select("doc_id", "n_tokens", "digests", "ends", "root", "row")
    ranged = ranged.repartitionByRange(n, F.asc_nulls_first("doc_id"), "root", "row").withColumn("range", F.spark_partition_id())
    ranged.write.option("compression", "zstd").parquet(f"{folder}/ranged")
    ranged = spark.read.parquet(f"{folder}/ranged")
    sums = ranged.groupBy("range").agg(F.sum("n_tokens").alias("own"))
    before = sums.select("range", (F.sum("own").over(Window.orderBy("range")) - F.col("own")).alias("before"))
    order = Window.partitionBy("range").orderBy(F.asc_nulls_first("doc_id"), "root", "row")
    placed = ranged.join(F.broadcast(before), "range")  # a row for each of n ranges
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # equal documents have places of their own
    placed = placed.withColumn("start", F.col("before") + F.sum("n_tokens").over(so_far) - F.col("n_tokens")).withColumn("place", F.row_number().over(order))
    placed = placed.select("doc_id", "start", "n_tokens", "digests", "ends", "root", "range", "place")
    placed = placed.repartitionByRange(n, "range").sortWithinPartitions("range", "place")
    placed.write.option("compression", "zstd").parquet(f"{folder}/recipes")

    roots = _range_roots(spark.read.parquet(f"{folder}/recipes"))
    roots.coalesce(1).write.parquet(f"{folder}/manifest")  # a row for each of n ranges
    for part in ("encoded", "ranged"):
        drop_folder(spark, f"{folder}/{part}")
    return folder


def _hashed(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A hash of the roots of each group in order, of FAN at most."""
    roots = F.transform(F.array_sort(F.collect_list(F.struct(order, "root"))), lambda x: x["root"])
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(roots, ""), 256).alias("root"))


def _range_roots(recipes: DataFrame) -> DataFrame:
    """A hash for each range, over hashes of blocks of blocks of its documents' roots; and of
    those the root of all (range -1)."""
    level = recipes.select("range", (F.col("place") - 1).alias("block"), F.hex("root").alias("root"))
    for _ in range(2):
        level = _hashed(level.withColumn("next", F.floor(F.col("block") / FAN).cast("long")), ["range", "next"], "block").withColumnRenamed("next", "block")
    each = _hashed(level, ["range"], "block")
    top = _hashed(each.withColumn("all", F.lit(-1)), ["all"], "range")  # a row for each of n ranges
    return each.select(F.col("range").cast("int"), "root").unionByName(top.select(F.col("all").alias("range"), "root"))


def _shifts(bits: int = 45) -> np.ndarray:
    """Matrices over GF(2) that append 2^k zero bytes to what a crc32 has seen."""

    def times(m, v):
        out = np.zeros_like(v)
        for i in range(32):
            out ^= np.where((v >> np.uint32(i)) & np.uint32(1), m[i], np.uint32(0))
        return out

    one = np.zeros(32, np.uint32)
    one[0] = 0xEDB88320
    one[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)
    for _ in range(3):  # from one bit to one byte
        one = times(one, one)
    all_bits = [one]
    for _ in range(bits - 1):
        all_bits.append(times(all_bits[-1], all_bits[-1]))
    return np.array(all_bits)


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """crc32 values as they count when so many bytes follow: the crc32 of a whole is the
    xor over its parts."""
    crc, zeros = crc.astype(np.uint32).copy(), zeros.astype(np.int64)
    for k, m in enumerate(_shifts()):
        on = np.flatnonzero((zeros >> k) & 1)
        if len(on):
            v, out = crc[on], np.zeros(len(on), np.uint32)
            for i in range(32):
                out ^= np.where((v >> np.uint32(i)) & np.uint32(1), m[i], np.uint32(0))
            crc[on] = out
        if not (zeros >> k).any():
            break
    return crc


def _read_chunks(batches):
    """digest, n and crc32 of each chunk as its file has it; a changed chunk raises."""
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        crcs = []
        for d, n, width, payload in zip(*(batch.column(c).to_pylist() for c in ("digest", "n", "width", "payload")), strict=True):
            raw = payload if width == 4 else np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes()
            if len(raw) != 4 * n or digest(raw) != d:
                raise ValueError(f"chunk {d.hex()} isn't what was written")
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n"), pa.array(crcs, pa.int64())], names=["digest", "n", "crc"])


def _shifted(batches):
    import pyarrow as pa

    for batch in batches:
        crc = crc_shift(batch.column("crc").to_numpy(zero_copy_only=False), batch.column("follow").to_numpy(zero_copy_only=False))
        keep = [c for c in batch.schema.names if c not in ("crc", "follow")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crc.astype(np.int64), pa.int64())], names=[*keep, "crc"])


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the store's files.

    Raises if a chunk differs from its digest, a document's chunks or lengths from its
    recipe (when the rows are computed), or a root from the manifest (at once).
    """
    prepare(spark)
    recipes = spark.read.parquet(f"{folder}/recipes")
    kept = {r["range"]: r["root"] for r in spark.read.parquet(f"{folder}/manifest").collect()}  # a row for each range
    if kept != {r["range"]: r["root"] for r in _range_roots(recipes).collect()}:
        raise ValueError("the recipes don't fit the manifest")
    chunks = spark.read.parquet(f"{folder}/chunks").mapInArrow(_read_chunks, "digest binary, n int, crc long")
    parts = recipes.select("range", "place", "doc_id", "start", "n_tokens", F.posexplode(F.arrays_zip("digests", "ends", F.concat(F.array(F.lit(0).cast("long")), F.slice("ends", 1, F.size("ends") - 1)).alias("begins"))).alias("k", "c"))
    parts = parts.select("range", "place", "doc_id", "start", "n_tokens", F.col("c.digests").alias("digest"), (F.col("c.ends") - F.col("c.begins")).cast("int").alias("length"), ((F.col("n_tokens") - F.col("c.ends")) * 4).alias("follow"))
    parts = parts.join(chunks.hint("shuffle_merge"), "digest", "left")
    parts = parts.select("range", "place", "doc_id", "start", "n_tokens", "length", "n", F.coalesce("crc", F.lit(-1)).alias("crc"), "follow")
    parts = parts.mapInArrow(_shifted, "range int, place int, doc_id long, start long, n_tokens long, length int, n int, crc long")
    whole = parts.groupBy("range", "place", "doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("n").alias("read"), F.bool_and(F.coalesce(F.col("n") == F.col("length"), F.lit(False))).alias("same"))
    sound = F.when(F.col("same") & (F.col("read") == F.col("n_tokens")), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document's chunks don't fit its recipe")).cast("long"))
    return whole.select("doc_id", "start", "n_tokens", sound.alias("ids_crc32"))
