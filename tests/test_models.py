"""Interactions, split, metrics and both models, against hand-made and dense results."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailflow.operators import interactions as I
from retailflow.operators import kpi as K
from retailflow.operators import recommend as M


@pytest.fixture(scope="module")
def events(spark):
    day = dt.date(2024, 1, 1)
    orders = spark.createDataFrame([("u", "a", day, "25", 1), ("v", "a", day, None, 2), ("w", "c", day, "0", 3), (None, "a", day, "1", 4)], "customer_id string, item_code string, event_date date, qty string, pos long")
    favs = spark.createDataFrame([("u", "b", day, 1), ("v", "c", day, 2)], "customer_id string, item_code string, event_date date, pos long")
    views = spark.createDataFrame(
        [("u", "c", day, "Номенклатура", 1), ("u", "z", day, "Категория", 2), ("v", "a", None, "Номенклатура", 3)], "customer_id string, item_code string, event_date date, item_type string, pos long"
    )
    return I.events(orders, favs, views)


def test_events_and_split(events):
    rows = {(r.user, r.item, r.src): r.w for r in events.collect()}
    assert rows == {("u", "a", 0): 50.0, ("v", "a", 0): 5.0, ("w", "c", 0): 5.0, ("u", "b", 1): 3.0, ("v", "c", 1): 3.0, ("u", "c", 2): 1.0, ("v", "a", 2): 1.0}
    train, held = I.split(events)
    # of the same day the view comes last; the undated view is of 1970
    assert {tuple(r) for r in held.collect()} == {("u", "c"), ("v", "c")}
    assert {tuple(r) for r in train.collect()} == {("u", "a", 50.0), ("u", "b", 3.0), ("v", "a", 6.0), ("w", "c", 5.0)}
    assert [tuple(r) for r in I.ids(events, "user").orderBy("idx").collect()] == [("u", 0), ("v", 1), ("w", 2)]
    assert {r.item: r.w for r in I.profile(events, "u").collect()} == {"a": 50.0, "b": 3.0, "c": 1.0}


def test_split_of_one_user_with_most_events(spark):
    """Against brute force, with equal times, repeated rows and users of few events."""
    g = np.random.default_rng(4)
    rows = [(0 if g.random() < 0.9 else int(g.integers(1, 40)), int(g.integers(0, 30)), int(g.integers(0, 5)), float(g.integers(1, 9)), int(g.integers(0, 3)), int(g.integers(0, 50))) for _ in range(4000)]
    rows += rows[:50] + [(99, 1, 1, 2.0, 0, 0), (98, 1, 1, 2.0, 0, 0), (98, 1, 1, 2.0, 0, 0)]
    df = spark.createDataFrame(rows, "user int, item int, ts int, w double, src int, pos int")
    held, train = {}, {}
    for u in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[4], r[5], r[1], r[3]))
        if len(own) >= 2:
            held[u] = own.pop()[1]
        for r in own:
            train[u, r[1]] = train.get((u, r[1]), 0.0) + r[3]
    a, b = I.split(df)
    assert {(r.user, r.item): r.w for r in a.collect()} == train
    assert {r.user: r.item for r in b.collect()} == held
    assert "Window" not in a._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 2.0], [5.0] * 9, [-2.0, -1.0, 0.0, 1e9], "random", "ties"])
def test_mean_and_median(spark, values):
    g = np.random.default_rng(6)
    if isinstance(values, str):
        values = (g.normal(size=3001) * 10.0 ** g.integers(-3, 6, 3001)).tolist() if values == "random" else g.integers(-3, 4, 2000).astype(float).tolist()
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    r = K.mean_and_median(df, df["x"]).first()
    if not values:
        assert (r.mean, r.median) == (None, None)
    else:
        assert r.median == np.median(values) and math.isclose(r.mean, np.mean(values), rel_tol=1e-9, abs_tol=1e-9)


def test_metrics(spark):
    ranked = spark.createDataFrame([("u", "a", 1), ("u", "b", 3), ("v", "c", 2)], "user string, item string, rank int")
    held = spark.createDataFrame([("u", "b"), ("v", "x"), ("w", "c")], "user string, item string")
    r = I.metrics(ranked, held, 20).first()
    assert r.users == 3 and math.isclose(r.recall, 1 / 3) and math.isclose(r.ndcg, 1 / math.log2(4) / 3)
    r = I.metrics(ranked, held.limit(0), 20).first()
    assert (r.recall, r.ndcg, r.users) == (0.0, 0.0, 0)


@pytest.fixture(scope="module")
def pairs(spark):
    g = np.random.default_rng(1)
    rows = sorted({(int(u), int(i if g.random() < 0.9 else 7 - i)) for u in range(40) for i in g.integers(0, 4, 3) + 4 * (u % 2)})
    return spark.createDataFrame([(u, i, float(1 + (u + i) % 3)) for u, i in rows], "user int, item int, w double")


def test_item_model_equals_dense(spark, pairs):
    items = I.ids(pairs, "item")
    b = M.ease(pairs, items, I.Config(ease_l2=5.0))
    rows = pairs.collect()
    n = items.count()
    x = np.zeros((40, n))
    for r in rows:
        x[r.user, r.item] = r.w
    p = np.linalg.inv(x.T @ x + 5.0 * np.eye(n))
    want = -p / np.diag(p)[None, :]
    np.fill_diagonal(want, 0)
    got = np.zeros((n, n))
    for r in b.collect():
        got[r.item, r.other] = r.b
    assert np.abs(got - want).max() < 1e-4 and not np.diag(got).any()
    scores = M.ease_scores(pairs, b)
    seen = {(r.user, r.item) for r in rows}
    for r in scores.collect():
        assert (r.user, r.item) not in seen and abs(r.score - (x @ want)[r.user, r.item]) < 1e-3
    with pytest.raises(M.TooLarge):
        M.ease(pairs, items, I.Config(ease_items=3))


def test_recommendations_exclude_seen(spark, pairs):
    b = M.ease(pairs, I.ids(pairs, "item"), I.Config(ease_l2=5.0))
    names = spark.createDataFrame([(0, "zero")], "item_code int, site_name string")
    every = spark.createDataFrame([(i, 1.0) for i in range(8)], "item int, w double")
    assert M.recommend(every, b, names).count() == 0
    some = spark.createDataFrame([(1, 1.0), (99, 5.0)], "item int, w double")
    rows = M.recommend(some, b, names, 3).collect()
    assert [r.rank for r in rows] == [1, 2, 3] and 1 not in {r.item for r in rows}
    assert all(r.site_name == ("zero" if r.item == 0 else "") for r in rows)


@pytest.mark.parametrize("size", [3, 8])
def test_inverse_in_blocks(spark, size):
    """Any number of blocks gives the dense inverse's model."""
    g = np.random.default_rng(5)
    x = g.integers(0, 3, (30, 11)).astype(float)
    train = spark.createDataFrame([(u, i, float(x[u, i])) for u in range(30) for i in range(11) if x[u, i]], "user int, item int, w double")
    b = M.ease(train, I.ids(train, "item"), I.Config(ease_l2=3.0), size)
    p = np.linalg.inv(x.T @ x + 3.0 * np.eye(11))
    want = -p / np.diag(p)[None, :]
    np.fill_diagonal(want, 0)
    got = np.zeros((11, 11))
    for r in b.collect():
        got[r.item, r.other] = r.b
    assert np.abs(got - want).max() < 1e-5


def test_scoring_in_blocks(spark, pairs):
    """Blocks of any size rank as the join of all pairs does."""
    b = M.ease(pairs, I.ids(pairs, "item"), I.Config(ease_l2=5.0))
    exact = pairs.withColumn("w", pairs["w"] * 8), b.selectExpr("item", "other", "round(b * 64) AS b")
    want = {(r.user, r.item, r.score, r.rank) for r in M.top_unseen(M.ease_scores(*exact), 3).collect()}
    for size, items in ((10**6, 512), (17, 3), (1, 1)):
        assert {tuple(r) for r in M.ease_top(*exact, 3, size, items).select("user", "item", "score", "rank").collect()} == want


@pytest.mark.parametrize("kind", ["string", "int"])
def test_scoring_a_sparse_matrix(spark, kind):
    """Few cells are filled, some sums are 0, and some items are known to one side only."""
    g = np.random.default_rng(9)
    pairs = [(f"u{u}", str(i), float(g.integers(1, 4))) for u in range(30) for i in g.choice(60, 5, replace=False)]
    cells = []
    for i, j in {(int(g.integers(0, 50)), int(g.integers(10, 70))) for _ in range(400)}:
        if i != j:
            cells.append((str(i), str(j), float(g.integers(-2, 3) or 1)))
    train = spark.createDataFrame(pairs, "user string, item string, w double").withColumn("item", F.col("item").cast(kind))
    b = spark.createDataFrame(cells, "item string, other string, b double").select(F.col("item").cast(kind).alias("item"), F.col("other").cast(kind).alias("other"), "b")
    want = {tuple(r) for r in M.top_unseen(M.ease_scores(train, b), 4).select("user", "item", "score", "rank").collect()}
    for size, items in ((10**6, 512), (20, 9)):
        assert {tuple(r) for r in M.ease_top(train, b, 4, size, items).select("user", "item", "score", "rank").collect()} == want


def test_gram_of_heavy_users(spark, pairs):
    want = {(r.i, r.j): r.g for r in I.gram(pairs).collect()}
    assert {(r.i, r.j): r.g for r in I.gram(pairs, heavy=2).collect()} == want
    rows = pairs.collect()
    by_force = {}
    for a in rows:
        for c in rows:
            if a.user == c.user:
                by_force[a.item, c.item] = by_force.get((a.item, c.item), 0.0) + a.w * c.w
    assert want == by_force


@pytest.mark.parametrize("block_pairs", [10**6, 30])
def test_factor_model_learns_clusters(spark, pairs, block_pairs):
    """One block or several learn the two groups; each epoch is measured and the best returned."""
    users, items = I.ids(pairs, "user").cache(), I.ids(pairs, "item").cache()
    held = spark.createDataFrame([(u, 4 * (u % 2) + k) for u in range(40) for k in range(4)], "user int, item int").join(pairs, ["user", "item"], "left_anti").dropDuplicates(["user"])
    cfg = I.Config(dims=4, epochs=4, batch=16, rate=0.2, top_k=2)
    factors, history = M.bpr_trained(pairs, held, users, items, cfg, block_pairs)
    assert [h[0] for h in history] == [1, 2, 3, 4] and history[-1][1] < history[0][1]
    f = {(r.side, r.idx): r.factors for r in factors.collect()}
    assert len(f) == users.count() + items.count()
    s = np.array([f["user", u] for u in range(40)]) @ np.array([f["item", i] for i in range(8)]).T
    own = (np.arange(40)[:, None] % 2) == (np.arange(8)[None, :] // 4)
    assert s[own].mean() > s[~own].mean()
    found = I.metrics(M.factor_top(factors, pairs, users, items, 2), held, 2).first()
    assert math.isclose(found.recall, max(h[2] for h in history), abs_tol=1e-6)
    again = M.bpr_trained(pairs, held, users, items, cfg, block_pairs)[1]
    assert np.allclose(again, history)


def test_factor_top_and_artifacts(spark, pairs, tmp_path):
    users, items = I.ids(pairs, "user"), I.ids(pairs, "item")
    held = pairs.limit(0).select("user", "item")
    cfg = I.Config(dims=4, epochs=2)
    f = M.bpr(pairs, held, users, items, cfg)
    top = M.factor_top(f, pairs, users, items, 3).collect()
    seen = {(r.user, r.item) for r in pairs.collect()}
    assert top and not any((r.user, r.item) in seen for r in top) and max(r.rank for r in top) <= 3
    M.save(str(tmp_path), cfg, users=users, items=items)
    back, frames = M.load(spark, str(tmp_path), "users", "items")
    assert back == cfg and frames["users"].count() == users.count()


def test_factor_model_beyond_broadcast_items(spark, pairs, monkeypatch):
    """More items than are broadcast are trained by joins, and learn the two groups."""
    monkeypatch.setattr(M, "BPR_ITEMS", 3)
    users, items = I.ids(pairs, "user").cache(), I.ids(pairs, "item").cache()
    held = pairs.limit(0).select("user", "item")
    cfg = I.Config(dims=4, epochs=2, batch=60, rate=0.3)
    f = {(r.side, r.idx): r.factors for r in M.bpr(pairs, held, users, items, cfg).collect()}
    assert len(f) == users.count() + items.count()
    s = np.array([f["user", u] for u in range(40)]) @ np.array([f["item", i] for i in range(8)]).T
    own = (np.arange(40)[:, None] % 2) == (np.arange(8)[None, :] // 4)
    assert s[own].mean() > s[~own].mean() + 0.1


@pytest.mark.parametrize("blocks", [1, 3])
def test_factor_model_by_strata(spark, pairs, blocks):
    """One stratum is the plain loop; each epoch has its loss, recall and ndcg and all pairs' steps."""
    users, items = I.ids(pairs, "user").cache(), I.ids(pairs, "item").cache()
    held = spark.createDataFrame([(u, 4 * (u % 2) + k) for u in range(40) for k in range(4)], "user int, item int").join(pairs, ["user", "item"], "left_anti").dropDuplicates(["user"])
    cfg = I.Config(dims=4, epochs=3, batch=16, rate=0.2, top_k=2)
    factors, history = M.bpr_strata(pairs, held, users, items, cfg, blocks)
    assert [h[0] for h in history] == [1, 2, 3] and history[-1][1] < history[0][1]
    f = {(r.side, r.idx): r.factors for r in factors.collect()}
    assert len(f) == users.count() + items.count() and all(np.isfinite(x).all() for x in f.values())
    found = I.metrics(M.factor_top(factors, pairs, users, items, 2), held, 2).first()
    assert math.isclose(found.recall, max(h[2] for h in history), abs_tol=1e-6)
    if blocks == 1:
        # by hand: the same draws, steps and batches
        a = {r.user: r.idx for r in users.collect()}
        b = {r.item: r.idx for r in items.collect()}
        rows = sorted((a[r.user], b[r.item], r.w) for r in pairs.collect())
        u, i, w = (np.array([r[k] for r in rows]) for k in range(3))
        x = {s: np.stack([np.random.default_rng([cfg.seed, s == "item", k]).normal(0, 0.1, 4) for k in range(n)]).astype(np.float32) for s, n in (("user", len(a)), ("item", len(b)))}
        state = [(0 * x[s], 0 * x[s]) for s in ("user", "item")]
        loss, step, _ = M._epoch(x["user"], x["item"], state, u, i, w / w.sum(), np.unique(u * len(b) + i), cfg, np.random.default_rng([cfg.seed, 1, 0, 0]), 0)
        assert step == -(-len(rows) // cfg.batch) and math.isclose(loss, history[0][1], rel_tol=1e-5)


def test_samples(spark, pairs):
    assert I.weighted_sample(pairs, 10**6).count() == pairs.count()
    assert I.weighted_sample(pairs, 10).count() == 10
    neg = I.uniform_negatives(pairs, I.ids(pairs, "item"), 2)
    assert neg.join(pairs, ["user", "item"], "left_semi").count() == 0
    assert neg.count() == 2 * pairs.count()  # none is lost to a collision
    again = I.uniform_negatives(pairs.repartition(5), I.ids(pairs, "item"), 2)
    assert sorted(map(tuple, neg.collect())) == sorted(map(tuple, again.collect()))
    some = {tuple(r) for r in I.weighted_sample(pairs, 10).collect()}
    assert some == {tuple(r) for r in I.weighted_sample(pairs.repartition(3), 10).collect()}


def test_blocks_of_factors(spark, pairs):
    """Small blocks rank as one large block does."""
    users, items = I.ids(pairs, "user"), I.ids(pairs, "item")
    g = np.random.default_rng(2)
    rows = [("user", u, g.normal(size=3).tolist()) for u in range(40)] + [("item", i, g.normal(size=3).tolist()) for i in range(8)]
    f = spark.createDataFrame(rows, "side string, idx int, factors array<float>")
    one, many = (sorted(map(tuple, M.factor_top(f, pairs, users, items, 4, *size).select("user", "item", "rank").collect())) for size in ((512, 4096), (7, 3)))
    assert one == many


def test_kpi_edges(spark):
    cols = "customer_id string, order_id string, item_code string, sex string, age int, age_group string, qty long, site_name string, event_date date"
    rows = [("a", "1", "i", None, 17, "14-25", 3, None, dt.date(2024, 2, 1)), ("a", "1", "j", "Мужской", 81, "65+", 1, "J", dt.date(2024, 1, 1)), (None, "2", "i", None, None, None, 2, None, None), ("b", "3", "j", "Женский", 30, "26-35", 2, "J", dt.date(2024, 1, 5))]
    df = spark.createDataFrame(rows, cols)
    from pyspark.sql import functions as F

    assert tuple(K.per_client(df, F.sum("qty")).first()) == (3.0, 3.0)
    assert {r.sex: r.pct for r in K.sex_share(df, F.sum("qty")).collect()} == {"Не указан": 62.5, "Мужской": 12.5, "Женский": 25.0}
    assert tuple(K.age_stats(df).first()) == (30.0, 30.0)
    assert K.age_group_mode(df).first()[0] == "26-35"
    assert tuple(K.age_stats(df.limit(0)).first()) == (0.0, 0.0)
    assert K.age_group_mode(df.limit(0)).first()[0] == "Не указано"
    r = K.top_month(df, F.sum("qty")).first()
    assert (r.year, r.month, r.v) == (2024, 1, 3)
    assert K.sparsity(df.limit(0)).first()[0] is None
    named = spark.createDataFrame([("k", 1, "Zeta", 1), ("k", 1, "Alpha", 2)], "item_code string, qty long, site_name string, pos long")
    assert K.top_items(named).first().site_name == "Zeta"  # the first in the table, not of the alphabet
    top = K.top_items(df).collect()
    assert [(r.item_code, r.site_name, r.qty) for r in top] == [("i", "name not found (i)", 5), ("j", "J", 3)]


def test_queries_use_the_operators_own_model():
    from retailflow.plans import catalog

    assert catalog.CFG == I.Config() and (catalog.CFG.dims, catalog.CFG.epochs) == (64, 20)


def test_training_driver_and_command_line(spark, tmp_path, monkeypatch, capsys):
    from retailflow import cli
    from retailflow.operators import train as T

    folder, artifacts = str(tmp_path / "tables"), str(tmp_path / "models")
    day = dt.date(2024, 1, 1)
    g = np.random.default_rng(6)
    rows = [(f"u{u}", f"i{i + 5 * (u % 2)}", day + dt.timedelta(days=int(k)), "2") for u in range(20) for k, i in enumerate(g.permutation(5)[:4])]
    orders = spark.createDataFrame(rows, "customer_id string, item_code string, event_date date, qty string")
    orders.write.parquet(f"{folder}/orders")
    orders.limit(0).select("customer_id", "item_code", "event_date").write.parquet(f"{folder}/favorites")
    orders.limit(0).selectExpr("customer_id", "item_code", "event_date", "'' AS item_type").write.parquet(f"{folder}/views")
    spark.createDataFrame([("i0", "zero")], "item_code string, site_name string").write.parquet(f"{folder}/items")
    cfg = I.Config(dims=4, epochs=2, top_k=3, ease_l2=1.0)
    found = T.train(spark, folder, artifacts, cfg).collect()
    assert [(r.model, r.epoch) for r in found] == [("bprmf", 1), ("bprmf", 2), ("ease", None)] and found[2].recall > 0.5
    assert spark.read.parquet(f"{artifacts}/metrics").count() == 3
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    for model in ("ease", "bprmf"):
        best = T.recommend(spark, folder, artifacts, "u0", 3, model).collect()
        assert [r.rank for r in best] == list(range(1, len(best) + 1)) and best
        assert cli.main(["--tables", folder, "--artifacts", artifacts, "--recommend", "u0", "--k", "3", "--model", model]) == 0
    assert "1. " in capsys.readouterr().out
    assert cli.main(["--tables", folder, "--artifacts", artifacts, "--recommend", "nobody", "--status"]) == 0
    assert "no history" in capsys.readouterr().out
