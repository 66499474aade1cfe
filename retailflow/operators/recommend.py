"""Recommenders: a closed-form item model, a pairwise factor model, and scoring.

Everything runs on DataFrames in blocks of bounded size: the item matrix is inverted block by
block, factors are trained by blocks of users, and users are scored in blocks against blocks
of items, of which only the best leave a task.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.operators import interactions as I
from retailflow.operators import relational as R
from retailflow.session import ship_package
from retailflow.storage import drop_folder, new_folder, written

#: Rows and columns of a block of the item matrix; users of a block to be scored by factors,
#: items of one, and pairs of a block of users to be scored by the item matrix.
BLOCK, USER_BLOCK, ITEM_BLOCK, TOP_PAIRS = 512, 512, 512, 1_000_000
#: Pairs of a block of users on average when factors are trained, and items whose factors are
#: broadcast at most (768 bytes each with 64 dimensions); more items go in blocks as well.
BLOCK_PAIRS, BPR_ITEMS = 200_000, 50_000


class TooLarge(ValueError):
    """The model has a limit, and the data are beyond it."""


# ---------------------------------------------------------------- closed-form item model


def _matrix(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(size, size)


def _block_table(key, m: np.ndarray):
    import pyarrow as pa

    return pa.table({"bi": pa.array([key[0].as_py()], pa.int32()), "bj": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([np.ascontiguousarray(m).tobytes()], pa.binary())})


def _filled(n: int, size: int, l2: float):
    """A dense block of G + l2 I; beyond n rows the identity, so that it can be inverted."""

    def run(key, rows):
        m = np.zeros((size, size))
        known = rows.filter(rows["g"].is_valid())
        m[known["i"].to_numpy() % size, known["j"].to_numpy() % size] = known["g"].to_numpy()
        if key[0] == key[1]:
            at = np.arange(size)
            m[at, at] += np.where(key[0].as_py() * size + at < n, l2, 1.0)
        return _block_table(key, m)

    return run


def _pivot_column(k: int, size: int):
    """A block C of the pivot's column, as `c`, and C times the pivot's inverse, as `cells`; of
    the pivot itself its inverse with the sign turned."""

    def run(key, rows):
        import pyarrow as pa

        cells = dict(zip(rows["role"].to_pylist(), rows["cells"].to_pylist(), strict=True))
        p, i = np.linalg.inv(_matrix(cells["p"], size)), key[0].as_py()
        c = None if i == k else _matrix(cells["a"], size)
        d = -p if i == k else c @ p
        return pa.table({"i": pa.array([i], pa.int32()), "c": pa.array([b"" if c is None else np.ascontiguousarray(c).tobytes()], pa.binary()), "cells": pa.array([np.ascontiguousarray(d).tobytes()], pa.binary())})

    return run


def _swept(size: int):
    def run(key, rows):
        cells = {r: _matrix(c, size) for r, c in zip(rows["role"].to_pylist(), rows["cells"].to_pylist(), strict=True)}
        return _block_table(key, cells["a"] - cells["d"] @ cells["c"].T)

    return run


def _turned(size: int):
    """Blocks with their rows as columns, where `turn` says so."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            cells = [np.ascontiguousarray(_matrix(c, size).T).tobytes() if t else c for c, t in zip(batch.column("cells").to_pylist(), batch.column("turn").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("bi"), batch.column("bj"), pa.array(cells, pa.binary())], names=["bi", "bj", "cells"])

    return run


def inverted(blocks: DataFrame, count: int, size: int) -> DataFrame:
    """The inverse of a symmetric positive matrix in blocks (bi, bj, cells), with its sign
    turned; only blocks with bi <= bj are read, and given.

    The matrix is swept by one diagonal block after the other and stays symmetric, so half of
    the blocks are enough. A step updates each block in a task of its own, with the two of
    the pivot's column that belong to its row and its column beside it.
    """
    schema = "bi int, bj int, cells binary"
    spark = blocks.sparkSession
    blocks = blocks.where("bi <= bj")
    turned = lambda df: df.mapInArrow(_turned(size), schema)
    for k in range(count):
        pivot = F.col("bi") == F.col("bj")
        mine = blocks.where((F.col("bi") == k) | (F.col("bj") == k))
        column = turned(mine.select("bi", "bj", "cells", ((F.col("bi") == k) & ~pivot).alias("turn")))
        column = column.select((F.col("bi") + F.col("bj") - k).cast("int").alias("i"), F.lit("a").alias("role"), "cells")
        own = mine.where(pivot).select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"), F.lit("p").alias("role"), "cells")
        column = written(column.unionByName(own).groupBy("i").applyInArrow(_pivot_column(k, size), "i int, c binary, cells binary"), "pivot-column")
        others = column.where(F.col("i") != k)
        to = lambda low, high: F.explode(F.filter(F.sequence(low, high), lambda j: j != k))  # noqa: B023, E731
        d = others.where(F.lit(count > 1)).select(F.col("i").alias("bi"), to(F.col("i"), F.lit(count - 1)).alias("bj"), F.lit("d").alias("role"), "cells")
        c = others.select(to(F.lit(0), F.col("i")).alias("bi"), F.col("i").alias("bj"), F.lit("c").alias("role"), F.col("c").alias("cells"))
        rest = blocks.where((F.col("bi") != k) & (F.col("bj") != k)).select("bi", "bj", F.lit("a").alias("role"), "cells")
        swept = rest.unionByName(d.select("bi", F.col("bj").cast("int").alias("bj"), "role", "cells")).unionByName(c.select(F.col("bi").cast("int").alias("bi"), "bj", "role", "cells")).groupBy("bi", "bj").applyInArrow(_swept(size), schema)
        new = turned(column.select(F.least("i", F.lit(k)).alias("bi"), F.greatest("i", F.lit(k)).alias("bj"), "cells", (F.col("i") > k).alias("turn")))
        path = new_folder(spark, "inverse")
        swept.unionByName(new).write.parquet(path)
        for done in {f.rsplit("/", 1)[0] for f in (*column.inputFiles(), *(blocks.inputFiles() if k else ()))}:
            drop_folder(spark, done)
        blocks = spark.read.schema(schema).parquet(path)
    return blocks


def _diagonals(size: int):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            cells = batch.column("cells").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("bj"), pa.array([np.diag(_matrix(c, size)).tolist() for c in cells], pa.list_(pa.float64()))], names=["bj", "diagonal"])

    return run


def _triples(size: int, n: int):
    """-P / diag(P) by columns, without the diagonal, as rows; both are given with their sign turned."""
    import pyarrow as pa

    def run(key, rows):
        i0, j0 = key[0].as_py() * size, key[1].as_py() * size
        b = -_matrix(rows["cells"][0].as_py(), size) / np.asarray(rows["diagonal"][0].as_py())[None, :]
        if i0 == j0:
            np.fill_diagonal(b, 0.0)
        b = b[: max(0, n - i0), : max(0, n - j0)].astype(np.float32)
        y, x = np.nonzero(b)
        return pa.table({"i": pa.array((y + i0).astype(np.int32)), "j": pa.array((x + j0).astype(np.int32)), "b": pa.array(b[y, x])})

    return run


def ease(train: DataFrame, items: DataFrame, cfg: I.Config = I.Config(), size: int = BLOCK) -> DataFrame:
    """(item, other, b): what having `item` says for `other`. items is (item, idx).

    B = -P / diag(P) by columns with P = (G + l2 I)^-1, and a zero diagonal. Raises TooLarge
    beyond cfg.ease_items items, the model's own limit.
    """
    n = items.count()
    if n > cfg.ease_items:
        raise TooLarge(f"{n} items; the closed-form model takes {cfg.ease_items} at most")
    spark = train.sparkSession
    ship_package(spark)
    few = F.broadcast(items)  # cfg.ease_items rows at most
    g = I.gram(train.join(few, "item").select("user", F.col("idx").alias("item"), "w"))
    count = max(1, -(-n // size))
    cells = g.select(F.floor(F.col("i") / size).cast("int").alias("bi"), F.floor(F.col("j") / size).cast("int").alias("bj"), "i", "j", F.col("g").cast("double").alias("g"))
    grid = spark.range(count * count).select(F.floor(F.col("id") / count).cast("int").alias("bi"), (F.col("id") % count).cast("int").alias("bj"))
    cells = cells.unionByName(grid, allowMissingColumns=True)
    blocks = written(cells.groupBy("bi", "bj").applyInArrow(_filled(n, size, cfg.ease_l2), "bi int, bj int, cells binary"), "gram")
    half = inverted(blocks, count, size)
    diagonals = half.where("bi = bj").select("bj", "cells").mapInArrow(_diagonals(size), "bj int, diagonal array<double>")
    other = half.where("bi < bj").select(F.col("bj").alias("bi"), F.col("bi").alias("bj"), "cells", F.lit(True).alias("turn"))
    p = half.unionByName(other.mapInArrow(_turned(size), "bi int, bj int, cells binary"))
    b = p.join(diagonals, "bj").groupBy("bi", "bj").applyInArrow(_triples(size, n), "i int, j int, b float")
    left, right = items.select("item", F.col("idx").alias("i")), items.select(F.col("item").alias("other"), F.col("idx").alias("j"))
    return b.join(F.broadcast(left), "i").join(F.broadcast(right), "j").select("item", "other", "b")


def ease_scores(train: DataFrame, b: DataFrame) -> DataFrame:
    """(user, item, score) of items that a user hasn't yet and that any of his says something for."""
    scored = train.join(b, "item").groupBy("user", F.col("other").alias("item")).agg(F.sum(F.col("w") * F.col("b")).alias("score"))
    return scored.join(train.select("user", "item"), ["user", "item"], "left_anti")


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest finite scores of each row, of equal ones the first."""
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(scores)), order.shape[1])
    good = np.isfinite(scores[row, order.ravel()])
    return row[good], order.ravel()[good]


def _packed_pairs(key, rows):
    """Users' rows within a block of items, in order of user, as one row."""
    import pyarrow as pa

    users, u = np.unique(rows["user"].to_numpy(), return_inverse=True)
    names, i = np.unique(rows["item"].to_numpy(), return_inverse=True)
    order = np.argsort(u, kind="stable")
    return _packed(key, ("ub", "ib"), rows.schema, {"user": users, "item": names}, (u[order], i[order], rows["v"].to_numpy()[order]), pa.float64())


def _packed_cells(key, rows):
    """A block of the item matrix in order of item, as one row: dense where a quarter of it is filled."""
    names, i = np.unique(rows["item"].to_numpy(), return_inverse=True)
    others, j = np.unique(rows["other"].to_numpy(), return_inverse=True)
    v, kind = rows["v"].to_numpy(), rows.schema.field("v").type
    if 4 * len(v) >= len(names) * len(others):
        m = np.zeros((len(names), len(others)), v.dtype)
        m[i, j] = v
        i, j, v = i[:0], j[:0], m.ravel()
    else:
        order = np.argsort(i, kind="stable")
        i, j, v = i[order], j[order], v[order]
    return _packed(key, ("ib", "jb"), rows.schema, {"item": names, "other": others}, (i, j, v), kind)


def _packed(key, blocks, schema, lists: dict, arrays, kind):
    import pyarrow as pa

    out = {b: pa.array([k.as_py()], pa.int32()) for b, k in zip(blocks, key, strict=True)}
    out |= {f"{c}s": pa.array([x.tolist()], pa.list_(schema.field(c).type)) for c, x in lists.items()}
    a, b, v = arrays
    return pa.table(out | {"a": pa.array([a.astype(np.int32).tobytes()], pa.binary()), "b": pa.array([b.astype(np.int32).tobytes()], pa.binary()), "v": pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())})


class _Cells:
    """A block of the item matrix: names in rows, columns placed among all of a column block."""

    def __init__(self, names, others, a, b, v, columns):
        self.names, self.place, self.width = names, np.searchsorted(columns, others), len(columns)
        self.dense = not len(a)
        if self.dense:
            m = np.zeros((len(names), len(columns)), v.dtype)
            m[:, self.place] = v.reshape(len(names), len(others))
            self.m, said = m, m != 0
            both, i, j = np.intersect1d(names, columns, return_indices=True)
            said[i, j] = True  # an item says nothing for itself, and needs not: who has it isn't shown it
            self.said = None if said.all() else said
        else:
            self.edge, self.b, self.v = np.searchsorted(a, np.arange(len(names) + 1)), self.place[b], v

    def add(self, scores, known, user, row, w) -> None:
        """Adds w times a row to each user's scores; users are in order."""
        for k in range(0, len(user), 2048):
            u, r, x = user[k : k + 2048], row[k : k + 2048], w[k : k + 2048]
            if self.dense:
                first = np.flatnonzero(np.diff(u, prepend=-1))
                scores[u[first]] += np.add.reduceat(self.m[r] * x[:, None], first, axis=0)
                known[u[first]] |= True if self.said is None else np.logical_or.reduceat(self.said[r], first, axis=0)
                continue
            n = self.edge[r + 1] - self.edge[r]
            at = np.arange(int(n.sum())) + np.repeat(self.edge[r] - (np.cumsum(n) - n), n)
            flat = np.repeat(u * self.width, n) + self.b[at]
            np.add.at(scores.reshape(-1), flat, self.v[at] * np.repeat(x, n))
            known.reshape(-1)[flat] = True


def _linear_top(k: int, single: bool, chunk: int = 1024):
    """A block of users' rows (side 0) against a block of columns (side 1), each in parts by
    blocks of items: the k best others of each user that the user hasn't."""
    import pyarrow as pa

    def run(key, rows):
        parts: dict = {0: {}, 1: {}}
        value = lambda c, n: rows.column(c)[n]
        listed = lambda c, n: value(c, n).values.to_numpy(zero_copy_only=False)
        for n, (side, ib) in enumerate(zip(rows.column("side").to_pylist(), rows.column("ib").to_pylist(), strict=True)):
            a, b = (np.frombuffer(value(c, n).as_py(), np.int32) for c in ("a", "b"))
            v = np.frombuffer(value("v", n).as_py(), np.float32 if side and single else np.float64)
            parts[side][ib] = (listed("items", n), listed("others" if side else "users", n), a, b, v)
        out: dict = {"user": [], "item": [], "score": []}
        if parts[0] and parts[1]:
            columns = np.unique(np.concatenate([p[1] for p in parts[1].values()]))
            users = np.unique(np.concatenate([p[1] for p in parts[0].values()]))
            cells = {ib: _Cells(*p, columns) for ib, p in parts[1].items()}
            mine = []
            for ib, (names, some, a, b, v) in parts[0].items():
                at = np.searchsorted(columns, names)
                column = np.where(columns[np.minimum(at, len(columns) - 1)] == names, at, -1)[b]
                row = np.full(len(b), -1)
                if ib in cells:
                    own = np.searchsorted(cells[ib].names, names)
                    row = np.where(cells[ib].names[np.minimum(own, len(cells[ib].names) - 1)] == names, own, -1)[b]
                mine.append((ib, np.searchsorted(users, some)[a], row, column, v))
            for u0 in range(0, len(users), chunk):
                n = min(chunk, len(users) - u0)
                scores, known = np.zeros((n, len(columns))), np.zeros((n, len(columns)), bool)
                for ib, u, row, _, w in mine:
                    i, j = np.searchsorted(u, [u0, u0 + n])
                    hit = np.flatnonzero(row[i:j] >= 0) + i
                    if len(hit):
                        cells[ib].add(scores, known, u[hit] - u0, row[hit], w[hit])
                scores[~known] = -np.inf
                for _, u, _, column, _ in mine:
                    i, j = np.searchsorted(u, [u0, u0 + n])
                    seen = np.flatnonzero(column[i:j] >= 0) + i
                    scores[u[seen] - u0, column[seen]] = -np.inf
                row, col = _best(scores, k)
                out["user"] += users[u0 + row].tolist()
                out["item"] += columns[col].tolist()
                out["score"] += scores[row, col].tolist()
        kinds = {"user": rows.schema.field("users").type.value_type, "item": rows.schema.field("others").type.value_type, "score": pa.float64()}
        return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})

    return run


def ease_top(train: DataFrame, b: DataFrame, k: int = 20, pairs: int = TOP_PAIRS, items: int = ITEM_BLOCK) -> DataFrame:
    """(user, item, score, rank): the k best of ease_scores() for each user, ties by item.

    Users are dealt into blocks of about `pairs` pairs, items into blocks of about `items`.
    The matrix and the users' rows are packed by blocks of items. A block of users meets a
    block of columns in one group, part by part, and only k scores of each user leave it. A
    column block is shuffled once for each block of users, so for thousands of users.
    """
    ship_package(train.sparkSession)
    n_users = max(1, -(-train.count() // pairs))
    n_items = max(1, -(-b.select(F.approx_count_distinct("other")).first()[0] // items))
    kinds = {f.name: f.dataType.simpleString() for f in [*train.schema, *b.schema]}
    single = kinds["b"] == "float"
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    mine = train.select(block("user", n_users).alias("ub"), block(F.col("item").cast(kinds["other"]), n_items).alias("ib"), "user", F.col("item").cast(kinds["other"]).alias("item"), F.col("w").cast("double").alias("v"))
    mine = mine.groupBy("ub", "ib").applyInArrow(_packed_pairs, f"ub int, ib int, users array<{kinds['user']}>, items array<{kinds['other']}>, a binary, b binary, v binary")
    cells = b.select(block(F.col("item").cast(kinds["other"]), n_items).alias("ib"), block("other", n_items).alias("jb"), F.col("item").cast(kinds["other"]).alias("item"), "other", F.col("b").cast("float" if single else "double").alias("v"))
    cells = cells.groupBy("ib", "jb").applyInArrow(_packed_cells, f"ib int, jb int, items array<{kinds['other']}>, others array<{kinds['other']}>, a binary, b binary, v binary")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = mine.select("ub", every(n_items).alias("jb"), F.lit(0).alias("side"), "ib", "users", "items", F.lit(None).cast(f"array<{kinds['other']}>").alias("others"), "a", "b", "v")
    right = cells.select(every(n_users).alias("ub"), "jb", F.lit(1).alias("side"), "ib", F.lit(None).cast(f"array<{kinds['user']}>").alias("users"), "items", "others", "a", "b", "v")
    best = left.unionByName(right).groupBy("ub", "jb").applyInArrow(_linear_top(k, single), f"user {kinds['user']}, item {kinds['other']}, score double")
    return top_unseen(best, k)


def top_unseen(scores: DataFrame, k: int = 20) -> DataFrame:
    return R.top_per(scores, "user", "score", "item", k)


def ease_evaluate(train: DataFrame, holdout: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    """recall and ndcg; held-out items that the user has in train as well count as misses."""
    return I.metrics(ease_top(train, b, k), holdout, k)


# ---------------------------------------------------------------- pairwise factor model


def _epoch(u: np.ndarray, v: np.ndarray, state: list, user: np.ndarray, item: np.ndarray, share: np.ndarray, seen: np.ndarray, cfg: I.Config, g, step: int) -> tuple[float, int, np.ndarray]:
    """One epoch of Adam on -log sigmoid(s+ - s-) with an L2 penalty, in place: its mean loss,
    the steps so far, and how often each item was drawn.

    Batches are drawn by weight without replacement; negatives evenly, anew for up to 25
    rounds where they hit a positive.
    """
    total, rounds, drawn = 0.0, -(-len(user) // cfg.batch), np.zeros(len(v))
    for _ in range(rounds):
        pick = np.arange(len(user)) if len(user) <= cfg.batch else g.choice(len(user), cfg.batch, replace=False, p=share)
        a, p = user[pick], item[pick]
        n = g.integers(0, len(v), len(pick))
        for _ in range(25):
            key = a.astype(np.int64) * len(v) + n
            at = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
            bad = seen[at] == key
            if not bad.any():
                break
            n[bad] = g.integers(0, len(v), int(bad.sum()))
        x, y, z = u[a], v[p], v[n]
        d = ((y - z) * x).sum(1)
        total += float(np.logaddexp(0, -d).mean() + cfg.penalty * ((x * x).sum(1) + (y * y).sum(1) + (z * z).sum(1)).mean())
        s = (-1 / (1 + np.exp(d)) / len(pick))[:, None]
        r = 2 * cfg.penalty / len(pick)
        gu, gv = cfg.decay * u, cfg.decay * v
        np.add.at(gu, a, s * (y - z) + r * x)
        np.add.at(gv, p, s * x + r * y)
        np.add.at(gv, n, -s * x + r * z)
        drawn += np.bincount(p, minlength=len(v)) + np.bincount(n, minlength=len(v))
        step += 1
        for w, grad, (m, q) in ((u, gu, state[0]), (v, gv, state[1])):
            m += 0.1 * (grad - m)
            q += 0.001 * (grad * grad - q)
            w -= (cfg.rate * (m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return total / max(1, rounds), step, drawn


def _ranks(u: np.ndarray, v: np.ndarray, users: np.ndarray, target: np.ndarray, seen: list[np.ndarray], chunk: int = 512) -> np.ndarray:
    """The place of each held-out target among the items that its user hasn't; a target that
    the user has is last."""
    out = np.zeros(len(users), np.int64)
    for i in range(0, len(users), chunk):
        scores = u[users[i : i + chunk]] @ v.T
        for row in range(len(scores)):
            scores[row, seen[i + row]] = -np.inf
        own = scores[np.arange(len(scores)), target[i : i + chunk]]
        out[i : i + chunk] = np.where(np.isfinite(own), (scores > own[:, None]).sum(1), len(v))
    return out


def _user_block(shared, cfg: I.Config, epoch: int, last: bool):
    """One block of users: what the factors so far find of its held-out items, then (but for
    the last call) an epoch over its pairs, from the items' factors as broadcast."""
    import pyarrow as pa

    def run(key, pairs, users):
        v, m, q, step = (x.copy() if isinstance(x, np.ndarray) else x for x in shared.value)
        dims, block = v.shape[1], key[0].as_py()
        ids = users["u"].to_numpy()
        rows = np.asarray(users["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(ids), 3 * dims)
        order = np.argsort(ids)
        ids, rows = ids[order], rows[order]
        u, state = rows[:, :dims].copy(), [(rows[:, dims : 2 * dims].copy(), rows[:, 2 * dims :].copy()), (m, q)]
        at, item, held = np.searchsorted(ids, pairs["u"].to_numpy()), pairs["i"].to_numpy(), pairs["held"].to_numpy() == 1
        order = np.lexsort((item, at, held))
        at, item, weight, held = at[order], item[order], pairs["w"].to_numpy()[order], held[order]
        a, p, w, ha, hi = at[~held], item[~held], weight[~held], at[held], item[held]
        begin = np.searchsorted(a, np.arange(len(ids) + 1))
        rank = _ranks(u, v, ha, hi, [p[begin[x] : begin[x + 1]] for x in ha]) if epoch else np.zeros(0, np.int64)
        hit = rank[rank < cfg.top_k]
        out = [("eval", 0, float(len(rank)), [float(len(hit)), float((1 / np.log2(hit + 2.0)).sum())])]
        if not last and len(a):
            seen = np.unique(a.astype(np.int64) * len(v) + p)
            loss, step, drawn = _epoch(u, v, state, a, p, w / w.sum(), seen, cfg, np.random.default_rng([cfg.seed, epoch, block]), step)
            out.append(("loss", step, float(len(a)), [loss]))
            some = np.flatnonzero(drawn)
            out += [("item", int(i), float(drawn[i]), np.concatenate([v[i], m[i], q[i]])) for i in some]
        if not last:
            out += [("user", int(i), 1.0, x) for i, x in zip(ids, np.concatenate([u, *state[0]], 1), strict=True)]
        kinds = {"block": pa.int32(), "side": pa.string(), "idx": pa.int32(), "n": pa.float64(), "vec": pa.list_(pa.float32())}
        return pa.table([pa.array([block] * len(out), pa.int32()), *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), list(kinds.values())[1:], strict=True))], names=list(kinds))

    return run


def _weighted_means(key, rows):
    """Means of the vectors of each item, weighted by how often blocks drew it."""
    import pyarrow as pa

    idx, at = np.unique(rows["idx"].to_numpy(), return_inverse=True)
    n = rows["n"].to_numpy()
    x = rows["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)
    total = np.zeros((len(idx), x.shape[1]))
    np.add.at(total, at, x * n[:, None])
    return pa.table({"idx": pa.array(idx.astype(np.int32)), "vec": _lists(total / np.bincount(at, n)[:, None])})


def bpr(train: DataFrame, holdout: DataFrame, users: DataFrame, items: DataFrame, cfg: I.Config = I.Config(), block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(side, idx, factors) for users and items, which are (user, idx) and (item, idx)."""
    return bpr_trained(train, holdout, users, items, cfg, block_pairs)[0]


def bpr_trained(train: DataFrame, holdout: DataFrame, users: DataFrame, items: DataFrame, cfg: I.Config = I.Config(), block_pairs: int = BLOCK_PAIRS) -> tuple[DataFrame, list[tuple]]:
    """The factors of the epoch of the best recall (of the last without held-out pairs), and
    (epoch, loss, recall, ndcg) of each epoch.

    Users are dealt into blocks. In an epoch every block trains its own users with a copy of
    the items' factors; then the copies' means, weighted by draws, are the next epoch's. One
    block is the plain sequential loop. A user's pairs are distinct items, so a block is
    bounded. Beyond BPR_ITEMS items see bpr_strata().
    """
    spark = train.sparkSession
    n_items, n = items.count(), train.count()
    if n_items > BPR_ITEMS:
        return bpr_strata(train, holdout, users, items, cfg)
    ship_package(spark)
    u, i = users.select("user", F.col("idx").alias("u")), items.select("item", F.col("idx").alias("i"))
    block = F.pmod(F.xxhash64("u"), F.lit(max(1, -(-n // block_pairs)))).cast("int").alias("block")
    pairs = train.select("user", "item", "w", F.lit(0).alias("held")).unionByName(holdout.select("user", "item", F.lit(1.0).alias("w"), F.lit(1).alias("held")))
    pairs = written(pairs.join(u, "user").join(F.broadcast(i), "item").select(block, "u", "i", F.col("w").cast("double").alias("w"), "held"), "pairs")
    drawn = users.select(F.lit("user").alias("side"), "idx").mapInArrow(_drawn_factors(cfg), "side string, idx int, factors array<float>, m array<float>, q array<float>")
    state = written(drawn.select(F.col("idx").alias("u"), F.concat("factors", "m", "q").alias("vec")).select(block, "u", "vec"), "users")
    g = np.random.default_rng([cfg.seed, 1])
    v = g.normal(0, 0.1, (n_items, cfg.dims)).astype(np.float32)
    m, q, step, best, history = np.zeros_like(v), np.zeros_like(v), 0, None, []
    schema = "block int, side string, idx int, n double, vec array<float>"
    shards = max(1, n_items // 512)
    for epoch in range(cfg.epochs + 1):
        shared = spark.sparkContext.broadcast((v, m, q, step))
        out = pairs.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(_user_block(shared, cfg, epoch, epoch == cfg.epochs), schema)
        out = written(out, "epoch")
        found = out.where("side = 'eval'").agg(F.sum("n").alias("n"), F.sum(F.col("vec")[0]).alias("hits"), F.sum(F.col("vec")[1]).alias("gain")).first()
        if epoch:
            recall, ndcg = ((found.hits or 0) / found.n, (found.gain or 0) / found.n) if found.n else (0.0, 0.0)
            history[-1] = (*history[-1], recall, ndcg)
            if best is None or recall > best[0] or not found.n:
                best = (recall, state, v)
        if epoch == cfg.epochs:
            break
        lost = out.where("side = 'loss'").agg((F.sum(F.col("n") * F.col("vec")[0]) / F.sum("n")).alias("loss"), F.max("idx").alias("step")).first()
        history.append((epoch + 1, float(lost.loss or 0.0)))
        step = int(lost.step or step)
        means = out.where("side = 'item'").groupBy(F.pmod("idx", F.lit(shards)).alias("s")).applyInArrow(_weighted_means, "idx int, vec array<float>")
        got = means.toArrow()  # a row for each item that was drawn, BPR_ITEMS at most
        v, m, q = v.copy(), m.copy(), q.copy()
        if got.num_rows:
            at, x = got["idx"].to_numpy(), got["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(got.num_rows, 3, cfg.dims)
            v[at], m[at], q[at] = x[:, 0], x[:, 1], x[:, 2]
        state = out.where("side = 'user'").select("block", F.col("idx").alias("u"), "vec")
        shared.unpersist()
    _, state, v = best or (0.0, state, v)
    import pyarrow as pa

    of_items = spark.createDataFrame(pa.table({"side": pa.array(["item"] * n_items), "idx": pa.array(np.arange(n_items, dtype=np.int32)), "factors": _lists(v)}))
    return state.select(F.lit("user").alias("side"), F.col("u").alias("idx"), F.slice("vec", 1, cfg.dims).alias("factors")).unionByName(of_items), history


def _rows(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(x: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))


def _drawn_factors(cfg: I.Config):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            side, idx = batch.column("side").to_pylist(), batch.column("idx").to_pylist()
            if not idx:
                continue
            f = np.stack([np.random.default_rng([cfg.seed, s == "item", k]).normal(0, 0.1, cfg.dims) for s, k in zip(side, idx, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("side"), batch.column("idx"), _lists(f), _lists(0 * f), _lists(0 * f)], names=["side", "idx", "factors", "m", "q"])

    return run


def _stratum(cfg: I.Config, epoch: int, round_: int, step: int):
    """One epoch's steps for the pairs of a block of users and a block of items."""
    import pyarrow as pa

    def run(key, pairs, states):
        dims, block = cfg.dims, key[0].as_py()
        out = []
        found = {}
        for side in ("user", "item"):
            rows = states.filter(pa.array(np.asarray(states["side"].to_pylist(), object) == side)).sort_by("idx")
            x = _rows(rows["vec"].combine_chunks()).astype(np.float32) if len(rows) else np.zeros((0, 3 * dims), np.float32)
            found[side] = rows["idx"].to_numpy(), x[:, :dims].copy(), (x[:, dims : 2 * dims].copy(), x[:, 2 * dims :].copy())
        (users, u, su), (items, v, sv) = found["user"], found["item"]
        if len(pairs):
            order = np.lexsort((pairs["i"].to_numpy(), pairs["u"].to_numpy()))
            a, p, w = (pairs[c].to_numpy()[order] for c in ("u", "i", "w"))
            a, p = np.searchsorted(users, a), np.searchsorted(items, p)
            seen = np.unique(a.astype(np.int64) * len(v) + p)
            loss, steps, _ = _epoch(u, v, [su, sv], a, p, w / w.sum(), seen, cfg, np.random.default_rng([cfg.seed, epoch, round_, block]), step)
            out.append(("loss", steps, float(len(a)), [loss]))
        for side, ids, x, state in (("user", users, u, su), ("item", items, v, sv)):
            out += [(side, int(i), 1.0, r) for i, r in zip(ids, np.concatenate([x, *state], 1), strict=True)]
        kinds = {"side": pa.string(), "idx": pa.int32(), "n": pa.float64(), "vec": pa.list_(pa.float32())}
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    return run


def bpr_strata(train: DataFrame, holdout: DataFrame, users: DataFrame, items: DataFrame, cfg: I.Config = I.Config(), blocks: int | None = None) -> tuple[DataFrame, list[tuple]]:
    """bpr_trained() for any number of items, without a copy of all factors anywhere.

    In each epoch users and items are dealt into as many blocks by hashes of their own. A
    round trains every block of users with one block of items, no two with the same, so that
    the rounds' steps are those of some sequential loop; after as many rounds as blocks all
    pairs have been. A pair's negatives come from its item's block, which other items join
    in every epoch. Batches are of cfg.batch pairs, so an epoch has about pairs / cfg.batch
    steps, whatever its blocks. Factors and their moments are written once a round.
    """
    spark = train.sparkSession
    ship_package(spark)
    u, i = users.select("user", F.col("idx").alias("u")), items.select("item", F.col("idx").alias("i"))
    pairs = written(train.join(u, "user").join(i, "item").select("u", "i", F.col("w").cast("double").alias("w")), "pairs")
    n = pairs.count()
    blocks = blocks or max(1, -(-items.count() // BPR_ITEMS), int(np.ceil(np.sqrt(n / BLOCK_PAIRS))))
    schema = "side string, idx int, factors array<float>, m array<float>, q array<float>"
    state = users.select(F.lit("user").alias("side"), "idx").unionByName(items.select(F.lit("item").alias("side"), "idx"))
    state = written(state.mapInArrow(_drawn_factors(cfg), schema).select("side", "idx", F.concat("factors", "m", "q").alias("vec")), "state")
    factors = lambda df: df.select("side", "idx", F.slice("vec", 1, cfg.dims).alias("factors"))
    best, history, step, total = None, [], 0, F.lit(blocks)
    for epoch in range(1, cfg.epochs + 1):
        of = lambda side, idx: F.pmod(F.xxhash64(F.lit(side), F.lit(cfg.seed + epoch), F.col(idx).cast("int")), total).cast("int")  # noqa: B023, E731
        lost, size = 0.0, 0.0
        for r in range(blocks):
            # the block of users b meets the block of items b + r
            ub, ib = of("user", "u"), F.pmod(of("item", "i") - r, total)
            mine = pairs.withColumn("block", ub).where(ub == ib)
            states = state.withColumn("block", F.when(F.col("side") == "user", of("user", "idx")).otherwise(F.pmod(of("item", "idx") - r, total)))
            out = mine.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(_stratum(cfg, epoch, r, step), "side string, idx int, n double, vec array<float>")
            out = written(out, "round")
            found = out.where("side = 'loss'").agg(F.sum(F.col("n") * F.col("vec")[0]).alias("lost"), F.sum("n").alias("n"), F.max("idx").alias("step")).first()
            lost, size, step = lost + (found.lost or 0.0), size + (found.n or 0.0), int(found.step or step)
            state = out.where("side <> 'loss'").select("side", "idx", "vec")
        one = I.metrics(factor_top(factors(state), train, users, items, cfg.top_k), holdout, cfg.top_k).first()
        history.append((epoch, lost / max(1.0, size), one.recall, one.ndcg))
        if best is None or one.recall > best[0] or not one.users:
            best = (one.recall, state)
    return factors(best[1] if best else state), history


def als(train: DataFrame, users: DataFrame, items: DataFrame, cfg: I.Config = I.Config()) -> DataFrame:
    """Factors by implicit alternating least squares: another loss, but no limit in size."""
    from pyspark.ml.recommendation import ALS

    numbered = train.join(users.select("user", F.col("idx").alias("u")), "user").join(items.select("item", F.col("idx").alias("i")), "item")
    model = ALS(rank=cfg.dims, userCol="u", itemCol="i", ratingCol="w", implicitPrefs=True, seed=cfg.seed, maxIter=10).fit(numbered.select("u", "i", F.col("w").cast("float")))
    side = lambda df, s: df.select(F.lit(s).alias("side"), F.col("id").alias("idx"), F.col("features").alias("factors"))
    return side(model.userFactors, "user").unionByName(side(model.itemFactors, "item"))


def _factor_block_top(k: int):
    """A block of users' factors (side 0, with the items of the block that each has) against
    a block of items' (side 1): the k best items of each user that the user hasn't."""
    import pyarrow as pa

    def run(key, rows):
        side = rows["side"].to_numpy()
        mine, items = rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1))
        if not len(mine) or not len(items):
            return pa.table({"u": pa.array([], pa.int32()), "i": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})
        items = items.sort_by("idx")
        x, y = (_rows(t["factors"].combine_chunks()).astype(np.float32) for t in (mine, items))
        scores, at = (x @ y.T).astype(np.float64), items["idx"].to_numpy()
        for r, seen in enumerate(mine["seen"].to_pylist()):
            if seen:
                scores[r, np.searchsorted(at, seen)] = -np.inf
        row, col = _best(scores, k)
        return pa.table({"u": pa.array(mine["idx"].to_numpy()[row]), "i": pa.array(at[col]), "score": pa.array(scores[row, col])})

    return run


def factor_top(factors: DataFrame, train: DataFrame, users: DataFrame, items: DataFrame, k: int = 20, user_block: int = USER_BLOCK, item_block: int = 8 * ITEM_BLOCK) -> DataFrame:
    """(user, item, score, rank) of the k best unseen items of each user, ties by the item's idx.

    Users and items are scored block against block, and only k scores of each user leave a
    block. Blocks are of consecutive idx.
    """
    spark = factors.sparkSession
    ship_package(spark)
    block = lambda c, size: F.floor(F.col(c) / size).cast("int")
    n_users, n_items = (df.agg(F.max("idx")).first()[0] or 0 for df in (users, items))
    parts = lambda n, size: F.explode(F.sequence(F.lit(0), F.lit(n // size)))
    i = items.select("item", F.col("idx").alias("i"))
    of = users.select("user", F.col("idx").alias("u"))
    seen = train.select("user", "item").join(of, "user").join(i, "item").groupBy("u", block("i", item_block).alias("ib")).agg(F.collect_set("i").alias("seen"))
    mine = factors.where("side = 'user'").join(users.select("idx"), "idx", "left_semi").select(block("idx", user_block).alias("ub"), parts(n_items, item_block).alias("ib"), "idx", "factors")
    mine = mine.join(seen, (F.col("idx") == F.col("u")) & (mine["ib"] == seen["ib"]), "left").select("ub", mine["ib"], F.lit(0).alias("side"), "idx", "factors", "seen")
    theirs = factors.where("side = 'item'").join(items.select("idx"), "idx", "left_semi")
    theirs = theirs.select(parts(n_users, user_block).alias("ub"), block("idx", item_block).alias("ib"), F.lit(1).alias("side"), "idx", "factors", F.lit(None).cast("array<int>").alias("seen"))
    best = mine.unionByName(theirs).groupBy("ub", "ib").applyInArrow(_factor_block_top(k), "u int, i int, score double")
    top = R.top_per(best, "u", "score", "i", k)
    return top.join(of, "u").join(i, "i").select("user", "item", "score", "rank")


# ---------------------------------------------------------------- recommendation and artifacts


def recommend(profile: DataFrame, b: DataFrame, names: DataFrame, k: int = 20) -> DataFrame:
    """rank, item, site_name, score for one profile (item, w): known items only, none seen."""
    scored = profile.join(b, "item").groupBy(F.col("other").alias("item")).agg(F.sum(F.col("w") * F.col("b")).alias("score"))
    best = scored.join(profile.select("item"), "item", "left_anti").withColumn("user", F.lit(0))
    best = R.top_per(best, "user", "score", "item", k).join(names.select(F.col("item_code").alias("item"), "site_name"), "item", "left")
    return best.select("rank", "item", F.coalesce("site_name", F.lit("")).alias("site_name"), "score").orderBy("rank")


def save(folder: str, cfg: I.Config, **frames: DataFrame) -> None:
    """Parquet for each frame, and the configuration as JSON text."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(cfg.__dict__),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")


def load(spark, folder: str, *names: str) -> tuple[I.Config, dict[str, DataFrame]]:
    cfg = I.Config(**json.loads(spark.read.text(f"{folder}/config").first()[0]))
    return cfg, {n: spark.read.parquet(f"{folder}/{n}") for n in names}
