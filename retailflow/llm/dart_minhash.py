"""Operator 3: near-duplicate documents by DartMinHash.

A document is a weighted set: its shingles of five words, weighted by how often they
occur. Every unit of a shingle's weight is a region at which hashed darts arrive as a
Poisson process, the same in every document that has the region. Each dart falls on one of
the signature's coordinates, and a coordinate keeps its earliest. Two documents agree in a
coordinate with the probability of their weighted Jaccard similarity.

Bands of coordinates propose pairs, the texts confirm them, and connected components of
confirmed links are the groups. Documents of equal words are one node from the start. In
each band's bucket all members are compared with one of them, picked by a hash; where that
leaves a bucket in several components, the pairs across them are compared too: in blocks
where the bucket is large. So no proposed link is lost, though no group is ever expanded
into its pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Piece, by_ids, connected_components, mix, pieces, prepare, written

SHINGLE, LEAST = 5, 0.8
#: At a similarity of 0.8 a pair shares none of 24 bands of 5 once in 14,000 times.
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Orders by which buckets pick the member that the others are compared with first.
LEADS = 8
#: Members of a bucket whose pairs are compared one by one; larger ones go in blocks of BLOCK.
FEW, BLOCK = 12, 256


def shingles(piece: Piece, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and their documents; fewer words are one shingle."""
    h, at = piece.windows(size, 0xA5)
    doc = piece.doc[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((piece.counts > 0) & (piece.counts < size))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            on = piece.counts[short] > k
            own[on] = mix(own[on], k + 1) + piece.h[piece.first_word[short[on]] + k]
        h, doc = np.concatenate([h, mix(own, 0x5A)]), np.concatenate([doc, short])
    return h, doc


def regions(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit regions of the shingles' weights: the k-th occurrence of a shingle in a
    document is its k-th region. Ordered by document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    rank = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    return mix(h + rank.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 0x77), doc


def signatures(region: np.ndarray, doc: np.ndarray, n: int, coordinates: int = COORDINATES, part: np.ndarray | None = None) -> np.ndarray:
    """n x coordinates ids of the earliest darts; 0 in documents that have no region.

    part is the share of each region that belongs to the document (1 if not given): darts
    that land beyond it don't count, which makes any real weight possible.
    """
    best = np.full(n * coordinates, np.inf)
    out = np.zeros(n * coordinates, np.uint64)
    weight = np.bincount(doc, part, n) if part is not None else np.bincount(doc, minlength=n).astype(float)
    until = np.zeros(n)
    full = weight > 0
    until[full] = coordinates * (np.log(coordinates) + 2) / weight[full]
    done = np.zeros(len(region))  # time of each region's last dart so far
    thrown = np.zeros(len(region), np.int64)
    while full.any():
        active = np.flatnonzero(full[doc] & (done < until[doc]))
        width = 2
        while len(active):
            width = min(64, max(1, 300_000 // len(active)), width)
            k = thrown[active][:, None] + np.arange(1, width + 1)
            dart = mix(region[active][:, None] + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0x1234)
            wait = -np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            time = done[active][:, None] + np.cumsum(wait, axis=1)
            thrown[active] += width
            done[active] = time[:, -1]
            d = doc[active]
            ok = time < until[d][:, None]
            # a dart beyond the limit is thrown again when the limit is raised
            late = ~ok.all(axis=1)
            first_late = np.argmax(~ok[late], axis=1)
            thrown[active[late]] -= width - first_late
            done[active[late]] = np.where(first_late > 0, time[late, np.maximum(first_late - 1, 0)], done[active[late]] - time[late, -1] + (time[late, 0] - wait[late, 0]))
            dart = mix(dart, 0x4321)
            if part is not None:
                ok &= (mix(dart, 0x99) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < part[active][:, None]
            cell = (d * coordinates)[:, None] + (dart % np.uint64(coordinates)).astype(np.int64)
            cell, when, dart = cell[ok], time[ok], dart[ok]
            np.minimum.at(best, cell, when)
            win = best[cell] == when
            out[cell[win]] = dart[win]
            active = active[~late]
            width *= 2
        full &= np.isinf(best.reshape(n, coordinates)).any(axis=1)
        until[full] *= 2
    return out.reshape(n, coordinates)


def bands(signature: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """n x count hashes, each of one band's coordinates."""
    x = signature.reshape(len(signature), count, rows)
    h = np.arange(count, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(x), 1), np.uint64)
    for r in range(rows):
        h = mix(h ^ x[:, :, r], r + 1)
    return h


def _whole(piece: Piece, salt: int) -> np.ndarray:
    """A hash of each document's words in order."""
    h = mix(piece.h, salt)
    place = (np.arange(len(h)) - np.repeat(piece.first_word[:-1], piece.counts)).astype(np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h + place * np.uint64(0x9E3779B97F4A7C15), salt), out=total[1:])
    return total[piece.first_word[1:]] - total[piece.first_word[:-1]]


def _sketch(batches):
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, keys, empty = [], [], [], []
        for piece in pieces(batch.column("_text")):
            region, doc = regions(*shingles(piece))
            keys.append(bands(signatures(region, doc, piece.n)).astype(np.int64))
            a.append(_whole(piece, 3))
            b.append(_whole(piece, 5))
            empty.append(piece.counts == 0)
        none = np.concatenate(empty)
        keys = np.concatenate(keys)
        offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.concatenate(a).astype(np.int64), mask=none), pa.array(np.concatenate(b).astype(np.int64), mask=none), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))],
            names=["doc_id", "h1", "h2", "bands"],
        )


def similarities(left, right) -> np.ndarray:
    """Weighted Jaccard similarities of the texts of two Arrow columns, row by row; 0 if
    either has no words."""
    sides = []
    for column in (left, right):
        h, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for piece in pieces(column):
            x, doc = shingles(piece)
            h.append(x)
            row.append(doc + piece.first)
        sides.append((np.concatenate(h), np.concatenate(row)))
    h, row = np.concatenate([sides[0][0], sides[1][0]]), np.concatenate([sides[0][1], sides[1][1]])
    if not len(h):
        return np.zeros(len(left))
    side = np.repeat([0, 1], [len(sides[0][0]), len(sides[1][0])])
    order = np.lexsort((h, row))
    h, row, side = h[order], row[order], side[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    b = np.add.reduceat(side, begin)
    a = np.diff(np.append(begin, len(h))) - b
    low, high = np.bincount(row[begin], np.minimum(a, b), len(left)), np.bincount(row[begin], np.maximum(a, b), len(left))
    return low / np.maximum(high, 1)


def _compare(least: float):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                s = similarities(part.column("_ta"), part.column("_tb"))
                keep = pa.array(s >= least)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep), pa.array(s).filter(keep)], names=["a", "b", "similarity"])

    return run


def _confirmed(docs: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are as similar as that."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    held = written(by_ids(docs.where(F.col("_text").isNotNull()), ids, "doc_id"), "held")
    both = pairs.join(held.select(F.col("doc_id").alias("b"), F.col("_text").alias("_tb")).hint("shuffle_merge"), "b")
    both = both.join(held.select(F.col("doc_id").alias("a"), F.col("_text").alias("_ta")).hint("shuffle_merge"), "a")
    return written(both.select("a", "b", "_ta", "_tb").mapInArrow(_compare(least), "a long, b long, similarity double"), "links")


def _block_links(least: float):
    """Links of a group of at most two blocks of documents; of all that it has, those that
    unite components not united yet."""
    import pandas as pd
    import pyarrow as pa

    def run(key, rows):
        rows = rows.reset_index(drop=True)
        region, doc = [], []
        for piece in pieces(pa.array(rows["_text"], pa.string())):
            h, d = regions(*shingles(piece))
            region.append(h)
            doc.append(d + piece.first)
        region, doc = np.concatenate(region), np.concatenate(doc)
        size = np.bincount(doc, minlength=len(rows)).astype(np.float64)
        _, at, n = np.unique(region, return_inverse=True, return_counts=True)
        both = n[at] > 1
        number = np.cumsum(n > 1) - 1
        at, doc = number[at[both]], doc[both]
        order = np.argsort(at, kind="stable")
        at, doc = at[order], doc[order]
        common = np.zeros((len(rows), len(rows)))
        for i in range(0, int(at[-1]) + 1 if len(at) else 0, 8192):
            x, y = np.searchsorted(at, [i, i + 8192])
            held = np.zeros((len(rows), 8192), np.float32)
            held[doc[x:y], at[x:y] - i] = 1
            common += held @ held.T
        near = common >= least * (size[:, None] + size[None, :] - common)
        comp = rows["component"].to_numpy()
        a, b = np.nonzero(np.triu(near & (comp[:, None] != comp[None, :]), 1))
        root: dict = {}

        def top(u):
            while root.get(u, u) != u:
                u = root[u]
            return u

        node, out = rows["node"].to_numpy(), []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            r, s = top(comp[i]), top(comp[j])
            if r != s:
                root[s] = r
                out.append((node[i], node[j], common[i, j] / (size[i] + size[j] - common[i, j])))
        return pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

    return run


def _confirmed_in_blocks(docs: DataFrame, open_: DataFrame, least: float) -> DataFrame:
    """Links between the components of large buckets, (key, node, n, component): all pairs
    across components are compared, in blocks, and none is emitted that isn't needed.

    Members of a bucket's largest component are one already, so their blocks only meet
    those of the others.
    """
    held = written(by_ids(docs.where(F.col("_text").isNotNull()), written(open_.select(F.col("node").alias("doc_id")).distinct(), "ids"), "doc_id"), "held")
    sizes = open_.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = written(sizes.groupBy("key").agg(F.max(F.struct("c", "component")).alias("m")).select("key", F.col("m.c").alias("mains"), F.col("m.component").alias("main")), "main")
    dealt = open_.join(main.hint("shuffle_merge"), "key")
    dealt = dealt.withColumn("rests", F.ceil((F.col("n") - F.col("mains")) / BLOCK).cast("int")).withColumn("mains", F.ceil(F.col("mains") / BLOCK).cast("int"))
    here = F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("component") == F.col("main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    own = F.when(F.col("component") == F.col("main"), F.col("rests") + here).otherwise(here)
    last = F.when(F.col("component") == F.col("main"), F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1
    dealt = dealt.select("key", "node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select("key", "node", "component", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    dealt = dealt.join(held.select(F.col("doc_id").alias("node"), "_text").hint("shuffle_merge"), "node")
    return written(dealt.groupBy("key", "bi", "bj").applyInPandas(_block_links(least), "a long, b long, similarity double"), "links")


def near_duplicates(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, component_id and kept of every row.

    class_id is the least id with the same words, component_id the least id that confirmed
    links reach, kept whether it is the row's own. Shingles are five words, unchanged; a
    text of one to four words is one shingle, so it links with its copies only. Texts
    without words, null texts and rows without an id link with nothing; they are kept,
    with their own id. Rows that share an id are one document here. An empty table gives
    none.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    sketch = written(docs.mapInArrow(_sketch, "doc_id long, h1 long, h2 long, bands array<long>"), "sketches")
    named = sketch.where("doc_id IS NOT NULL AND h1 IS NOT NULL")
    classes = written(named.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    keys = classes.select("node", F.posexplode("bands").alias("band", "key"))
    order = F.struct(F.xxhash64("node", F.col("band") % LEADS).alias("o"), F.col("node").alias("node"))
    lead = keys.groupBy("key").agg(F.min(order)["node"].alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(written(lead, "lead").hint("shuffle_merge"), "key").select("key", "node", "lead", "n"), "members")
    tried = written(members.where("node <> lead").select(F.greatest("node", "lead").alias("a"), F.least("node", "lead").alias("b")).distinct(), "tried")
    links = _confirmed(docs, tried, least)
    found = written(connected_components(links, "a", "b"), "components")
    placed = members.join(found.withColumnRenamed("node", "_n").hint("shuffle_merge"), F.col("node") == F.col("_n"), "left")
    placed = placed.select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_ = written(placed.join(written(split, "split").hint("shuffle_merge"), "key"), "open")
    small = open_.where(F.col("n") <= FEW)
    other = small.select("key", F.col("node").alias("b"), F.col("component").alias("_cb"))
    across = small.join(other.hint("shuffle_merge"), "key").where("component < _cb").select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
    across = written(across.join(tried.hint("shuffle_merge"), ["a", "b"], "left_anti"), "across")
    more = _confirmed(docs, across, least) if across.head(1) else links.limit(0)
    large = open_.where(F.col("n") > FEW)
    if large.head(1):
        more = more.unionByName(_confirmed_in_blocks(docs, large, least))
    if more.head(1):
        found = written(connected_components(links.unionByName(more), "a", "b"), "components")
    classes = classes.join(found.withColumnRenamed("node", "_n").hint("shuffle_merge"), F.col("node") == F.col("_n"), "left")
    classes = written(classes.select("h1", "h2", F.col("node").alias("class_id"), F.coalesce("component", "node").alias("component_id")), "placed")
    out = named.select("doc_id", "h1", "h2").join(classes.hint("shuffle_merge"), ["h1", "h2"]).select("doc_id", "class_id", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    alone = sketch.where("doc_id IS NULL OR h1 IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with all columns, less all but one document of each group.

    Where rows share an id, one of them stays.
    """
    marks = written(near_duplicates(docs, least, doc_id, text), "marks")
    gone = written(marks.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(doc_id)).distinct(), "gone")
    out = by_ids(docs, gone, doc_id, "left_anti")
    if marks.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").head(1):
        out = out.where(F.col(doc_id).isNull()).unionByName(out.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id]))
    return out
