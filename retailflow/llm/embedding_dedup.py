"""Operator 2: near-duplicate vectors by sorted projection passes, until a measured recall is met.

A pass orders all vectors lexicographically by concatenated hashes, the signs of projections
on random directions, and compares each with its neighbours in a bounded window; pairs whose
cosine is high enough are links, united across passes. A hash is taken about the middle of
the vectors that are equal in all hashes before it, so that a dense cone is ordered as finely
as the rest. The first hashes, of which a sample gives the middles, deal the vectors out to
tasks; a task makes the others, until equal ones fit a window, and compares within its own.

Rows decide the first number of passes. Then the links' components are checked: for a sample
of vectors, drawn evenly and from the most crowded places, every link is found by comparing
with all vectors. While less than `recall` of a query's links are within its component on
average, a round with twice the passes and a larger window follows; after MOST_ROUNDS of
them without success RuntimeError is raised.

Within each component all pairs are then compared, block by block: so a vector's number of
links is exact within it however large the group is, and none is emitted as a pair.
Equal vectors are one class from the start, with their number.
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, prepare, written

log = logging.getLogger(__name__)

LEAST = 0.9
#: Places of a window to one side (in the first round and at most), vectors of a task on
#: average, hashes beyond a task's own at most, and rounds after which recall has to be met.
WINDOW, MOST_WINDOW, CELL, HASHES, MOST_ROUNDS = 256, 4096, 8192, 64, 6
#: Share of links that a first round may miss if vectors are spread evenly, and the share to be found as measured.
MISS, RECALL = 1e-3, 0.99
#: Vectors that the driver holds to place the first splits, and those of them that recall is
#: measured with: so many drawn evenly, and so many of the most crowded.
SAMPLE, EVEN, CROWDED = (4096, 65536), 1024, 512
#: Numbers of the sample's vectors at most (32 MB).
SAMPLE_NUMBERS = 1 << 22
SEED = 5
#: Vectors of a block when a component's pairs are compared, and of one in components of
#: more than 32 such blocks: each vector is copied once for each block of its component.
BLOCK, LARGE_BLOCK = 128, 1024
#: Beyond what single precision leaves open.
SLACK = 1e-5


def first_passes(rows: int, window: int, least: float) -> int:
    """Passes after which a pair at `least` has met but for a chance of MISS, if hashes are those of evenly spread vectors."""
    met = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** max(1.0, math.log2(max(1, rows) / window))
    return max(2, math.ceil(math.log(MISS) / math.log1p(-met))) if met < 1 else 2


def plant(x: np.ndarray, passes: int, levels: int, seed) -> tuple[np.ndarray, np.ndarray]:
    """Directions (passes x levels x dims) of the first hashes, and the middle of each node by the sample x (passes x nodes)."""
    directions = np.random.default_rng(seed).normal(size=(passes, levels, x.shape[1]))
    cuts = np.zeros((passes, (1 << levels) - 1))
    for p in range(passes):
        node = np.zeros(len(x), np.int64)
        for level in range(levels):
            at = x @ directions[p, level]
            order = np.lexsort((at, node))
            edge = np.searchsorted(node[order], np.arange((1 << level) + 1))
            n, first = np.diff(edge), (1 << level) - 1
            some = np.flatnonzero(n)
            cuts[p, first + some] = (at[order[edge[some] + (n[some] - 1) // 2]] + at[order[edge[some] + n[some] // 2]]) / 2
            node = 2 * node + (at > cuts[p, first + node])
    return directions, cuts


def cells(x: np.ndarray, directions: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """n x passes: the first hashes of each vector in each pass, as one number."""
    out = np.zeros((len(x), len(directions)), np.int64)
    for p in range(len(directions)):
        for level in range(directions.shape[1]):
            out[:, p] = 2 * out[:, p] + (x @ directions[p, level] > cuts[p, (1 << level) - 1 + out[:, p]])
    return out


def ordered(x: np.ndarray, window: int, seed) -> np.ndarray:
    """Places of x in lexicographic order of concatenated hashes. A hash is the sign of a
    random projection about its mean over the vectors that have been equal so far; those
    that are few enough for a window are left as they are."""
    g, code = np.random.default_rng(seed), np.zeros(len(x), np.int64)
    for _ in range(HASHES):
        size = np.bincount(code)
        wide = size[code] > window
        if not wide.any():
            break
        at = x @ g.normal(size=x.shape[1]).astype(x.dtype)
        middle = np.bincount(code, at) / np.maximum(size, 1)
        code = np.unique(2 * code + (wide & (at > middle[code])), return_inverse=True)[1]
    return np.argsort(code, kind="stable")


def forest(x: np.ndarray, least: float, window: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among unit vectors in double precision, of those at most
    `window` places apart."""
    window = len(x) if window is None else window
    short, label = x.astype(np.float32), np.arange(len(x))
    a, b, tile = [], [], max(64, min(512, (1 << 20) // max(1, len(x))))
    for i in range(0, len(x), tile):
        s = short[i : i + tile] @ short[i : i + tile + window].T
        r, c = np.nonzero(s >= least - SLACK)
        near = (c > r) & (c <= r + window)
        r, c = r[near], c[near]
        close = np.flatnonzero(s[r, c] < least + SLACK)
        for k in range(0, len(close), 1 << 16):
            some = close[k : k + (1 << 16)]
            r[some] = np.where(np.einsum("ij,ij->i", x[r[some] + i], x[c[some] + i]) >= least, r[some], c[some])
        r, c = r + i, c + i
        while True:
            u, v = label[r], label[c]
            open_ = u != v
            if not open_.any():
                break
            r, c, u, v = r[open_], c[open_], u[open_], v[open_]
            low, high = np.minimum(u, v), np.maximum(u, v)
            pick = np.full(len(x), -1)
            pick[high] = np.arange(len(high))
            joined = np.flatnonzero(pick >= 0)
            a.append(r[pick[joined]])
            b.append(c[pick[joined]])
            parent = np.arange(len(x))
            parent[joined] = low[pick[joined]]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            label = parent[label]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths, as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _each_dims(batches, size: int = 2000):
    """Slices of batches of vectors of one number of dimensions: (rows, dims, matrix)."""
    import pyarrow as pa

    for batch in batches:
        for i in range(0, batch.num_rows, size):
            part = batch.slice(i, size)
            dims = np.diff(part.column("vector").offsets.to_numpy())
            for d in np.unique(dims):
                some = part.filter(pa.array(dims == d))
                yield some, int(d), _matrix(some.column("vector"))


def _celled(shared, passes: int):
    """Cells of each vector; those of a number of dimensions without splits have one cell."""
    import pyarrow as pa

    def run(batches):
        for some, d, x in _each_dims(batches):
            c = cells(x, *shared.value[d]) if d in shared.value else np.zeros((len(x), passes), np.int64)
            offsets = pa.array(np.arange(len(c) + 1, dtype=np.int32) * passes)
            yield pa.RecordBatch.from_arrays([some.column("node"), some.column("vector"), pa.array(np.full(len(x), d, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(c.ravel()))], names=["node", "vector", "dims", "cells"])

    return run


def _cell_links(least: float, window: int, round_: int):
    import pyarrow as pa

    def run(key, rows):
        x, n = _matrix(rows.column("vector").combine_chunks()), rows.column("node").to_numpy()
        at = ordered(x.astype(np.float32), window, [SEED, round_, *(k.as_py() for k in key)])
        u, v = forest(x[at], least, window)
        return pa.table({"a": n[at[u]], "b": n[at[v]]})

    return run


def _met(shared, least: float):
    """For each query its links to the vectors seen here, and those within its component."""
    import pyarrow as pa

    def run(batches):
        queries = shared.value
        links, met = {d: np.zeros(len(q[0]), np.int64) for d, q in queries.items()}, {d: np.zeros(len(q[0]), np.int64) for d, q in queries.items()}
        for some, d, x in _each_dims(batches):
            if d in queries:
                nodes, components, y = queries[d]
                near = (x @ y.T >= least) & (some.column("node").to_numpy()[:, None] != nodes)
                links[d] += near.sum(0)
                met[d] += (near & (some.column("component").to_numpy()[:, None] == components)).sum(0)
        for d, q in queries.items():
            yield pa.RecordBatch.from_arrays([pa.array(q[0]), pa.array(links[d]), pa.array(met[d])], names=["node", "links", "met"])

    return run


def _crowded(x: np.ndarray) -> np.ndarray:
    """Places of the vectors of a sample, those with most others at a cosine of 0.7 first."""
    short = x.astype(np.float32)
    others = np.concatenate([(short[i : i + 512] @ short.T >= 0.7).sum(1) for i in range(0, len(x), 512)])
    return np.argsort(-others, kind="stable")


def measured(labelled: DataFrame, sample: dict, least: float) -> list[tuple[str, int, int, float]]:
    """(kind, queries with links, their links, mean share of them within the query's component).

    labelled has node, vector and component; sample is {dims: (nodes, unit vectors)}, of
    which EVEN vectors are queries as they come and CROWDED are those with most others near.
    """
    spark = labelled.sparkSession
    kinds, chosen = {}, {}
    for d, (nodes, x) in sample.items():
        even, crowded = np.arange(min(EVEN, len(x))), _crowded(x[: SAMPLE[0]])[:CROWDED]
        for kind, at in (("even", even), ("crowded", crowded)):
            kinds.setdefault(kind, set()).update(nodes[at].tolist())
        both = np.union1d(even, crowded)
        chosen[d] = (nodes[both], x[both])
    ids = spark.createDataFrame([(n,) for nodes, _ in chosen.values() for n in nodes.tolist()], "node long")
    component = {r.node: r.component for r in labelled.select("node", "component").join(F.broadcast(ids), "node").collect()}
    shared = spark.sparkContext.broadcast({d: (nodes, np.array([component[n] for n in nodes.tolist()]), x) for d, (nodes, x) in chosen.items()})
    rows = labelled.select("node", "vector", "component").mapInArrow(_met(shared, least), "node long, links long, met long")
    got = {r.node: r for r in rows.groupBy("node").agg(F.sum("links").alias("links"), F.sum("met").alias("met")).where("links > 0").collect()}
    out = []
    for kind, nodes in kinds.items():
        some = [got[n] for n in sorted(nodes) if n in got]
        out.append((kind, len(some), sum(r.links for r in some), float(np.mean([r.met / r.links for r in some])) if some else 1.0))
    return out


def united(classes: DataFrame, least: float = LEAST, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """node, copies, least_id, vector, dims, component and linked of every class (node, vector, copies, least_id)."""
    spark = classes.sparkSession
    rows = {r.dims: r["count"] for r in classes.groupBy(F.size("vector").alias("dims")).count().collect()}
    most = max(rows.values(), default=0)
    size = min(SAMPLE[1], max(SAMPLE[0], 16 * most // CELL), max(16, SAMPLE_NUMBERS // max(rows, default=1)))
    drawn = F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(1 << 30)) < int(min(1.0, size / max(1, sum(rows.values()))) * (1 << 30))
    got = classes.where(drawn).select("node", "vector", F.size("vector").alias("dims")).toArrow()
    sample: dict = {}
    for d in rows:
        some = got.filter(np.asarray(got.column("dims")) == d).combine_chunks()
        if some.num_rows:
            sample[d] = (some.column("node").to_numpy(), _matrix(some.column("vector").combine_chunks()))
    passes, links = first_passes(most, window, least), None
    for round_ in range(MOST_ROUNDS):
        splits = {}
        for d, (_, x) in sample.items():
            levels = math.ceil(math.log2(max(1.0, rows[d] / CELL)))
            levels = min(levels, max(0, int(math.log2(len(x) / 4)))) if len(x) >= 4 else 0
            splits[d] = plant(x, passes, levels, [SEED, round_, d])
        celled = classes.select("node", "vector").mapInArrow(_celled(spark.sparkContext.broadcast(splits), passes), "node long, vector array<double>, dims int, cells array<long>")
        each = celled.select("dims", F.posexplode("cells").alias("pass", "cell"), "node", "vector")
        more = written(each.groupBy("dims", "pass", "cell").applyInArrow(_cell_links(least, window, round_), "a long, b long"), "links")
        links = more if links is None else links.unionByName(more)
        found = written(connected_components(links, "a", "b"), "components")
        labelled = classes.join(found.hint("shuffle_merge"), "node", "left").select("node", "copies", "least_id", "vector", F.size("vector").alias("dims"), F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("linked"))
        labelled = written(labelled, "labelled")
        shares = measured(labelled, sample, least)
        log.info("%d vectors, round %d: %d passes, windows of %d: %s", sum(rows.values()), round_ + 1, passes, window, ", ".join(f"{kind}: {share:.4f} of the {n} links of {q} queries" for kind, q, n, share in shares))
        if all(share >= recall for *_, share in shares):
            return labelled
        passes, window = 2 * passes, max(window, min(2 * window, MOST_WINDOW))
    raise RuntimeError(f"after {MOST_ROUNDS} rounds the share of links found is {min(share for *_, share in shares):.4f}")


def _block_counts(least: float):
    import pandas as pd

    def run(key, rows):
        x = np.array(rows["vector"].tolist(), np.float64)
        x /= np.sqrt((x * x).sum(1))[:, None]
        n, side = rows["copies"].to_numpy(), rows["side"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = left if key[1] == key[2] else np.flatnonzero(side == 1)
        near = x[left] @ x[right].T >= least
        if key[1] == key[2]:  # a block with itself
            np.fill_diagonal(near, False)
            return pd.DataFrame({"node": rows["node"].to_numpy()[left], "links": near @ n[right]})
        return pd.DataFrame({"node": rows["node"].to_numpy()[np.concatenate([left, right])], "links": np.concatenate([near @ n[right], near.T @ n[left]])})

    return run


def near_vectors(vectors: DataFrame, least: float = LEAST, window: int = WINDOW, recall: float = RECALL, block: int = BLOCK, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    n_links counts the other vectors at a cosine of at least `least`, component_id is the
    least id that links reach, kept whether it is the row's own; both by the links that
    rounds of passes find until `recall` is measured. Vectors that are null, empty or zero, or hold a null or a number that isn't finite, link with nothing; so do rows
    without an id, and vectors of different lengths with each other. Rows that share an id
    are vectors of their own, which count each other if close. An empty table gives none.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    sound = F.col("vec_id").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    sound = F.coalesce(sound, F.lit(False))
    # scaled by the largest part, so that no square over- or underflows
    most = F.array_max(F.transform("vector", F.abs))
    marked = rows.withColumn("sound", sound)
    marked = written(marked.withColumn("vector", F.when(F.col("sound"), F.transform("vector", lambda v: v / most + F.lit(0.0)))), "vectors")
    classes = marked.where("sound").groupBy("vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    labelled = united(classes, least, window, recall)

    inside = labelled.where("linked").select("node", "copies", "vector", "component", "dims")
    # blocks: members in no order, as many blocks as the component's size asks for
    size = written(inside.groupBy("component").agg(F.count("*").alias("n")), "sizes")
    inside = inside.join(size.hint("shuffle_merge"), "component").withColumn("blocks", F.ceil(F.col("n") / F.when(F.col("n") > 32 * block, max(block, LARGE_BLOCK)).otherwise(block)).cast("int"))
    inside = inside.withColumn("own", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")).cast("int"))
    dealt = inside.select("component", "dims", "node", "copies", "vector", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("component", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "node", "copies", "vector", (F.col("own") > F.col("other")).cast("int").alias("side"))
    # else the join's partitioning by component would serve, and put all its blocks in one task
    dealt = dealt.repartition("component", "bi", "bj")
    counted = dealt.groupBy("component", "bi", "bj").applyInPandas(_block_counts(least), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    ids = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    facts = labelled.join(written(ids, "ids").hint("shuffle_merge"), "component").join(counted.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    facts = written(facts.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "facts")
    out = marked.where("sound").join(facts.hint("shuffle_merge"), "vector").select("vec_id", "n_links", "component_id")
    alone = marked.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
