"""What the corpus operators share: size-checked broadcasts, pieces of text, vectorised word
hashes and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.session import ship_package
from retailflow.storage import drop_folder, drop_written, new_folder, small, written, written_so_far  # noqa: F401

#: ASCII white space: the word separators of every operator here.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
#: Text is worked on in pieces of about so many bytes, which bounds a worker's memory.
PIECE_BYTES = 1 << 18


def prepare(spark: SparkSession) -> None:
    """What every operator with Python workers needs first."""
    ship_package(spark)


# ---------------------------------------------------------------- joins and words


def by_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """df, semi- or anti-joined with a written table of ids.

    The ids are broadcast only if they are measured to be small; else both sides are shuffled.
    """
    if small(ids):
        return df.join(F.broadcast(ids), key, how)
    return df.hint("shuffle_merge").join(ids, key, how)


def numbered(rows: DataFrame, place: int) -> tuple[DataFrame, bool, int | None]:
    """The rows with a number in `doc` (a long) where it is null, whether each is alone with
    its number, which leaves room for `place` below it in a long, and the number for null.

    A null's number is the one before the least id, so no row has it; if that doesn't exist,
    ValueError.
    """
    doc = F.col("doc")
    facts = rows.agg(F.count("*").alias("n"), F.count(doc).alias("known"), F.countDistinct(doc).alias("ids"), F.min(doc).alias("low"), F.max(doc).alias("high")).first()
    nulls = facts.n - facts.known
    none = ((facts.low or 0) - 1) if nulls else None
    if nulls and none < -(1 << 63):
        raise ValueError("beside a null id the least id of a long can't be told from it")
    room = (1 << 63) // place
    low = facts.low if none is None else none
    plain = facts.ids == facts.known and nulls <= 1 and (low is None or low >= -room) and (facts.high is None or facts.high < room)
    return rows if none is None else rows.withColumn("doc", F.coalesce(doc, F.lit(none))), plain, none


def given_id(doc: str, none: int | None) -> Column:
    """The id as it was given, null where numbered() put a number."""
    return F.col(doc) if none is None else F.when(F.col(doc) != none, F.col(doc))


def task_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once, whatever lambdas in `use` refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), lambda w: w != "")


# ---------------------------------------------------------------- word hashes

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0..P^(n-1) and the same of P's inverse, modulo 2^64; kept for pieces of usual size."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    usual, made = PIECE_BYTES + (1 << 16), []
    for base in (_P, _PI):
        steps = np.full(max(n, usual), base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if n <= usual:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    x = x ^ np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Piece:
    """Words of some texts: h their hashes, begin and end their byte places in data,
    doc the text of each word (counted from first), first_word where each text begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.first, self.n = first, len(offsets) - 1
        data = data[offsets[0] : offsets[-1]]
        at = (offsets - offsets[0]).astype(np.int64)
        self.data, self.at = data, at
        word = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        begins, ends = word.copy(), word.copy()
        if len(data):
            begins[1:] &= ~word[:-1] | edge[1:-1]
            ends[:-1] &= ~word[1:] | edge[1:-1]
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _power(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
        self.h = mix((total[self.end] - total[self.begin]) * inverse[self.begin])
        self.first_word = np.searchsorted(self.begin, at)
        self.counts = np.diff(self.first_word)
        self.doc = np.repeat(np.arange(self.n), self.counts)

    def windows(self, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of every run of size words within one text, and the word each begins at."""
        n = len(self.h) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        power, inverse = _power(len(self.h) + 1)
        total = np.zeros(len(self.h) + 1, np.uint64)
        h = mix(self.h, salt) if salt else self.h
        np.cumsum(h * power[: len(h)], out=total[1:])
        whole = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return mix((total[whole + size] - total[whole]) * inverse[whole], salt), whole


def text_buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of Arrow strings (nulls as empty) and where each begins and the last ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def raw_pieces(texts, cut=None, size: int | None = None):
    """(data, offsets, first): Arrow strings (nulls as empty) in pieces of about `size` bytes,
    first being the number of a piece's first text.

    cut(data) gives the places of data at which a text may be cut in two. With it, a text
    that is longer goes in several pieces of its own, each with the same `first`; without it
    no text is cut.
    """
    size = size or PIECE_BYTES
    data, offsets = text_buffers(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        if cut is None or offsets[j] - offsets[i] <= size:
            yield data, offsets[i : j + 1], i
        else:
            at, end = int(offsets[i]), int(offsets[j])
            while at < end:
                to, width = end, size
                while at + width < end:  # a stretch without such a place is taken whole
                    if len(places := cut(data[at : at + width])):
                        to = at + int(places[-1])
                        break
                    width *= 2
                yield data, np.array([at, to], np.int64), i
                at = to
        i = j


def pieces(texts, cut=None, size: int | None = None):
    """The same with the words of each piece."""
    for data, offsets, first in raw_pieces(texts, cut, size):
        yield Piece(data, offsets, first)


def argmin_windows(h: np.ndarray, size: int) -> np.ndarray:
    """For each i the leftmost place of the least of h[i : i + size]."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, width = np.arange(len(h)), 1
    while width * 2 <= size:
        a, b = best[: len(best) - width], best[width:]
        best = np.where(h[a] <= h[b], a, b)
        width *= 2
    a, b = best[:n], best[size - width : size - width + n]
    return np.where(h[a] <= h[b], a, b)


# ---------------------------------------------------------------- components


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 40) -> DataFrame:
    """(node, component): the least node that each node of the edges reaches.

    Alternating large-star and small-star steps. Every step is an aggregation and a join
    on node ids, written to the shared folder; no node's neighbours meet in one task as a
    list, so a star of any size is split by the skew join. Edges with a null end are dropped.
    """

    spark = edges.sparkSession
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    since = written_so_far(spark)
    e = written(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least.hint("shuffle_merge"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small_ = large.join(least.hint("shuffle_merge"), "u")
        small_ = small_.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = written(small_.where("u <> v").distinct(), "edges")
        drop_written(spark, since, written_so_far(spark) - 1)  # what the round has read is done with
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    own = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own).distinct()
