"""Operator 12: hard negatives by a vector-approximation file.

Vectors are rounded to integers. Each dimension is cut into cells at quantiles of a bounded
sample, and a vector's approximation is the cell numbers of its dimensions, two to a byte.
Rows lie in packed blocks with, for each dimension and cell, the least and greatest number
that the block has there. From these an anchor makes tables of the least and the greatest
that a cell can add to a score; a row's bounds are sums of looked-up entries. Only rows whose
bounds let them into a window are scored exactly.

Blocks of anchors meet blocks of rows in groups of bounded size, each in a task of its own,
and only the first few of a window leave a group. That is done twice: for the positives, of
an anchor's own label, and then for the negatives in the windows that these set.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written

#: Cells of a dimension: 4 bits, so that two make a byte.
CELLS = 16
#: Rows and numbers of the sample that cells are cut by, at most.
SAMPLE_ROWS, SAMPLE_NUMBERS = 4096, 1 << 20
#: Rows and anchors of a block on average, and anchors that are bounded at a time.
ROW_BLOCK, ANCHOR_BLOCK, AT_A_TIME = 4096, 1024, 64
SEED = 11

_PACKED = "dims int, block int, node array<long>, vec_id array<long>, label array<long>, low array<long>, high array<long>, codes binary, numbers binary, width int"
_SHORT = np.iinfo(np.int32)


def _cut(x: np.ndarray) -> np.ndarray:
    """dims x (CELLS - 1): where each dimension of a sample is cut."""
    at = (np.arange(1, CELLS) * len(x)) // CELLS
    return np.sort(x, axis=0)[at].T.copy()


def _codes(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Cells of each row, two dimensions to a byte; without cuts all are in the first."""
    cells = np.zeros((len(x), x.shape[1] + x.shape[1] % 2), np.uint8)
    for d in range(x.shape[1] if len(cuts) else 0):
        cells[:, d] = np.searchsorted(cuts[d], x[:, d], "right")
    return cells[:, 0::2] * CELLS + cells[:, 1::2]


def _numbers(column, scale: int) -> np.ndarray:
    """Vectors of one length as whole numbers, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(scale * flat).reshape(len(column), -1)
    if len(flat) and np.abs(x).max() >= 2.0**62:
        raise ValueError("a component is too large to be scored in a long")
    return x


def _pack(shared, scale: int):
    """A block of rows as one row, in order of label, id and node."""
    import pyarrow as pa

    def run(key, rows):
        rows = rows.sort_by([("label", "ascending"), ("vec_id", "ascending"), ("node", "ascending")]).combine_chunks()
        d = key[0].as_py()
        x = _numbers(rows.column("vector").combine_chunks(), scale)
        codes = _codes(x, shared.value.get(d, np.zeros((0, CELLS - 1))))
        width = next(w for w in (2, 4, 8) if np.abs(x).max() < 2.0 ** (8 * w - 1))
        one = {f: pa.array([rows.column(f).to_pylist()], pa.list_(pa.int64())) for f in ("node", "vec_id", "label")}
        limits = {f: pa.array([[v for row in rows.column(f).to_pylist() for v in row]], pa.list_(pa.int64())) for f in ("low", "high")}
        return pa.table({"dims": pa.array([d], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), **one, **limits, "codes": pa.array([codes.tobytes()], pa.binary()), "numbers": pa.array([x.astype(f"i{width}").tobytes()], pa.binary()), "width": pa.array([width], pa.int32())})

    return run


class Block:
    """A packed block as arrays."""

    def __init__(self, row: dict):
        self.node, self.vec_id, self.label = (np.array(row[k], np.int64) for k in ("node", "vec_id", "label"))
        n = len(self.node)
        self.x = np.frombuffer(row["numbers"], f"i{row['width']}").reshape(n, row["dims"]).astype(np.int64)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(n, -1)
        self.low, self.high = (np.array(row[k], np.int64).reshape(n, -1) for k in ("low", "high"))
        self.most = int(np.abs(self.x).max())

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """dims x CELLS: the least and the greatest number in each cell; 0 in empty ones."""
        dims = self.x.shape[1]
        each = np.stack([self.codes >> 4, self.codes & (CELLS - 1)], 2).reshape(len(self.x), -1)[:, :dims]
        least, greatest = np.full((dims, CELLS), np.iinfo(np.int64).max), np.full((dims, CELLS), np.iinfo(np.int64).min)
        for d in range(dims):
            np.minimum.at(least[d], each[:, d], self.x[:, d])
            np.maximum.at(greatest[d], each[:, d], self.x[:, d])
        none = least > greatest
        least[none] = greatest[none] = 0
        return least, greatest


class Bounds:
    """Bounds of the scores of a block's rows with some anchors."""

    def __init__(self, rows: Block, anchors: Block):
        reach = rows.x.shape[1] * rows.most * anchors.most
        if reach >= 1 << 62:
            raise ValueError("components are too large to be scored in a long")
        self.kind = np.int32 if reach <= _SHORT.max else np.int64
        self.floats = rows.x.astype(np.float64) if reach < 1 << 53 else None
        self.rows, self.limits = rows, rows.cells()

    def of(self, anchors: np.ndarray, rows: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """rows x anchors: the least and the greatest that each score can be."""
        least, greatest = (m[:, :, None] * anchors.T[:, None, :] for m in self.limits)  # dims x cells x anchors
        codes = np.ascontiguousarray(self.rows.codes[rows].T)
        out = []
        for table in (np.minimum(least, greatest), np.maximum(least, greatest)):
            table = table.astype(self.kind)
            if len(table) % 2:
                table = np.concatenate([table, np.zeros_like(table[:1])])
            total = np.zeros((codes.shape[1], len(anchors)), self.kind)
            for p, code in enumerate(codes):  # two dimensions by one look-up
                total += (table[2 * p][:, None] + table[2 * p + 1][None]).reshape(CELLS * CELLS, -1)[code]
            out.append(total)
        return out[0], out[1]

    def exact(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.floats is not None:  # whole numbers below 2^53
            return (self.floats[at] @ anchor.astype(np.float64)).astype(np.int64)
        return self.rows.x[at] @ anchor


def _kth(values: np.ndarray, k: int):
    """The k-th greatest of each column, None if there aren't so many."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else None


def _sides(rows) -> tuple[Block | None, Block | None]:
    """Rows and anchors of a group; a block may be missing where a hash left it empty."""
    got = {r["side"]: Block(r) for r in rows.to_pylist()}
    return got.get(0), got.get(1)


def _same_label(k: int):
    """The first k rows of each anchor's label, by exact scores."""
    import pyarrow as pa

    def run(key, group):
        rows, anchors = _sides(group)
        out = {"anchor": [], "node": [], "vec_id": [], "score": []}
        if rows is not None and anchors is not None:
            bounds = Bounds(rows, anchors)
            for label in np.intersect1d(rows.label, anchors.label):
                own = slice(*np.searchsorted(rows.label, [label, label + 1]).tolist())
                first, end = np.searchsorted(anchors.label, [label, label + 1]).tolist()
                node, ids = rows.node[own], rows.vec_id[own]
                for i in range(first, end, AT_A_TIME):
                    some = slice(i, min(end, i + AT_A_TIME))
                    low, high = bounds.of(anchors.x[some], own)
                    self_ = node[:, None] == anchors.node[some]
                    low[self_] = np.iinfo(low.dtype).min
                    least = _kth(low, k)
                    open_ = ~self_ if least is None else (high >= least) & ~self_
                    for j in range(some.stop - some.start):
                        at = np.flatnonzero(open_[:, j])
                        score = bounds.exact(anchors.x[i + j], at + own.start)
                        best = np.lexsort((node[at], ids[at], -score))[:k]
                        out["anchor"] += [int(anchors.node[i + j])] * len(best)
                        out["node"] += node[at[best]].tolist()
                        out["vec_id"] += ids[at[best]].tolist()
                        out["score"] += score[best].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def _in_windows(k: int):
    """The first k rows of another label in each window of an anchor, by exact scores."""
    import pyarrow as pa

    def run(key, group):
        rows, anchors = _sides(group)
        out = {"anchor": [], "slot": [], "node": [], "vec_id": [], "score": []}
        if rows is not None and anchors is not None:
            bounds = Bounds(rows, anchors)
            for i in range(0, len(anchors.node), AT_A_TIME):
                low, high = bounds.of(anchors.x[i : i + AT_A_TIME])
                low, high = np.ascontiguousarray(low.T), np.ascontiguousarray(high.T)
                for j in range(len(low)):
                    a, lo, hi = i + j, low[j], high[j]
                    same = slice(*np.searchsorted(rows.label, [anchors.label[a], anchors.label[a] + 1]).tolist())
                    other = np.ones(len(lo), bool)
                    other[same] = False
                    windows = [(s, x, y) for s, (x, y) in enumerate(zip(anchors.low[a].tolist(), anchors.high[a].tolist(), strict=True)) if x <= y]
                    open_ = np.zeros(len(lo), bool)
                    for _, x, y in windows:
                        inside = lo[other & (lo >= x) & (hi <= y)]  # in the window whatever their scores
                        least = _kth(inside, k)
                        open_ |= (hi >= (x if least is None else max(x, int(least)))) & (lo <= y)
                    at = np.flatnonzero(open_ & other)
                    if not len(at):
                        continue
                    score = bounds.exact(anchors.x[a], at)
                    order = np.lexsort((rows.node[at], rows.vec_id[at], -score))
                    at, score = at[order], score[order]
                    for s, x, y in windows:
                        best = np.flatnonzero((score >= x) & (score <= y))[:k]
                        out["anchor"] += [int(anchors.node[a])] * len(best)
                        out["slot"] += [s] * len(best)
                        out["node"] += rows.node[at[best]].tolist()
                        out["vec_id"] += rows.vec_id[at[best]].tolist()
                        out["score"] += score[best].tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def _packed(rows: DataFrame, cuts, scale: int, size: int, name: str) -> DataFrame:
    """Rows (node, vec_id, label, dims, vector, low, high) in blocks of about `size`, written."""
    spark = rows.sparkSession
    counts = [(r.dims, -(-r["count"] // size)) for r in rows.groupBy("dims").count().collect()]
    blocks = spark.createDataFrame(counts, "dims int, blocks int")  # a row for each length of vectors
    dealt = rows.join(F.broadcast(blocks), "dims").withColumn("block", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")).cast("int"))
    return written(dealt.drop("blocks").groupBy("dims", "block").applyInArrow(_pack(cuts, scale), _PACKED), name)


def _met(rows: DataFrame, anchors: DataFrame):
    """Every block of anchors with every block of rows of the same dimensions, as groups."""

    def numbers(df, name):
        return F.broadcast(df.groupBy("dims").agg(F.sort_array(F.collect_set("block")).alias(name)))  # numbers of blocks

    left = rows.join(numbers(anchors, "others"), "dims").withColumn("other", F.explode("others")).drop("others")
    left = left.select("dims", F.col("other").alias("a"), F.col("block").alias("b"), F.lit(0).alias("side"), *rows.columns[2:])
    right = anchors.join(numbers(rows, "others"), "dims").withColumn("other", F.explode("others")).drop("others")
    right = right.select("dims", F.col("block").alias("a"), F.col("other").alias("b"), F.lit(1).alias("side"), *rows.columns[2:])
    return left.unionByName(right).repartition("dims", "a", "b").groupBy("dims", "a", "b")


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "node")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, percent: tuple[int, int] = (50, 95), scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label", block: tuple[int, int] = (ROW_BLOCK, ANCHOR_BLOCK)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A component x counts as floor(scale * x); a score is the inner product of these, and ties
    go to the smaller id. The positives of a row that `anchor` holds of are its first others
    of the same label; for each, the first `negatives` rows of other labels are returned whose
    score is between the two percentages of the positive's. Fewer are returned where there
    are fewer.

    Rows without an id or a label, and vectors that are null, empty or hold a null or a
    number that isn't finite, take no part. Vectors of other lengths than the anchor's aren't
    compared with it. Rows that share an id are rows of their own, each an anchor if `anchor`
    holds; further columns change nothing. An empty table gives none. Components so large
    that a score might not fit a long raise ValueError.
    """
    spark = vectors.sparkSession
    prepare(spark)
    own = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), own.cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.coalesce(sound, F.lit(False))).withColumn("dims", F.size("vector")).withColumn("node", F.monotonically_increasing_id())
    nothing = F.array().cast("array<long>")
    rows = written(rows.select("*", nothing.alias("low"), nothing.alias("high")), "vectors")

    counts = {r.dims: r["count"] for r in rows.groupBy("dims").count().collect()}
    share = min([1.0, *(min(SAMPLE_ROWS, SAMPLE_NUMBERS / d) / n for d, n in counts.items())])
    drawn = rows.where(F.pmod(F.xxhash64("node", F.lit(SEED + 1)), F.lit(1 << 30)) < int(share * (1 << 30))).select("dims", "vector").toArrow()
    cuts = {}
    for d in counts:
        some = drawn.filter(np.asarray(drawn.column("dims")) == d).column("vector").combine_chunks()
        if len(some):
            cuts[d] = _cut(_numbers(some, scale))
    shared = spark.sparkContext.broadcast(cuts)
    file = _packed(rows.drop("anchor"), shared, scale, block[0], "approximations")
    anchors = rows.where("anchor").drop("anchor")

    met = _met(file, _packed(anchors, shared, scale, block[1], "anchors"))
    found = met.applyInArrow(_same_label(positives), "anchor long, node long, vec_id long, score long")
    chosen = _first(found, ["anchor"], positives).select(F.col("anchor"), (F.col("rank") - 1).cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    chosen = written(chosen, "positives")

    # windows as whole numbers: both percentages of a score, rounded inwards
    each = F.sort_array(F.collect_list(F.struct("slot", "positive_score")))
    scores = chosen.groupBy("anchor").agg(each.alias("each")).select(
        F.col("anchor").alias("node"), F.transform("each", lambda e: F.ceil(F.lit(percent[0]).cast("decimal(20)") * e["positive_score"] / 100).cast("long")).alias("low"), F.transform("each", lambda e: F.floor(F.lit(percent[1]).cast("decimal(20)") * e["positive_score"] / 100).cast("long")).alias("high")
    )
    filled = {f: F.slice(F.concat(f, F.array_repeat(F.lit(v).cast("long"), positives)), 1, positives).alias(f) for f, v in (("low", 1), ("high", 0))}
    bounded = anchors.drop("low", "high").join(scores.hint("shuffle_merge"), "node").select("node", "vec_id", "label", "vector", "dims", filled["low"], filled["high"])
    met = _met(file, _packed(written(bounded, "windows"), shared, scale, block[1], "bounded"))
    found = met.applyInArrow(_in_windows(negatives), "anchor long, slot long, node long, vec_id long, score long")
    taken = _first(found, ["anchor", "slot"], negatives)
    out = taken.select("anchor", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(chosen, ["anchor", "slot"])
    ids = anchors.select(F.col("node").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return out.join(ids, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def oracle_sql() -> str:
    """The same for the registered query: anchors against all rows, in DuckDB."""
    return """
WITH sound AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM sound a, sound b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3
"""
