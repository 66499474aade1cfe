"""The corpus operators against brute force on small tables with nulls, empty texts, ties,
repeated rows and clashing column names; and over empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retailflow.llm import dart_minhash, decontaminate, embedding_dedup, line_dedup, mixing, quality_conv, queries, secret_scan, substring_dedup, token_counts, token_store

SPACE = " \t\n\x0b\x0c\r"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def texts(seed=3):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(30, 90))) for _ in range(12)]
    out = [*base, base[0], base[1] + " tail", " ".join(words(base[2])[:-2]), "x y " + base[3], base[4].replace("alpha", "omega", 1), None, "", " \n\t", "one two", "one two", "a " * 60, "same line of eight words in here now\nsame line of eight words in here then\nsame line of eight words here now"]
    out.append(base[5][:200] + "\n" + base[6] + "\n" + base[6] + "é中\U0001f600 <|endoftext|> " + base[7])
    out.append("password = 'hunter22x' AKIA" + "A1B2" * 5 + " é 0123456789abcdef0123456789abcdef token: ab")
    out.append(" ".join(rng.choices(WORDS, k=3000)))
    return out


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i * 3, t, "en", [None, "a", "b", "c"][i % 4], 0, 1.0, "clash") for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, line string")


def empty(spark):
    return table(spark, []).limit(0)


def component_labels(n, links):
    root = list(range(n))

    def top(u):
        while root[u] != u:
            u = root[u]
        return u

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(u) for u in range(n)]


def test_quality(spark):
    rng = random.Random(1)
    rows = [("word " * rng.randint(20, 60) if i % 2 else " ".join(rng.choices(WORDS, k=60))) for i in range(200)] + [None, ""]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(i * 3, 1 - i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    net = quality_conv.fit(docs, labels, queries.is_held_out)
    got = {r.doc_id: r for r in quality_conv.score(docs, net).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert got[600].score == got[603].score
    held = [i for i in range(200) if zlib.crc32(str(i * 3).encode()) % 5 == 0]
    assert sum(got[i * 3].predicted == 1 - i % 2 for i in held) > 0.9 * len(held)
    assert quality_conv.score(empty(spark), net).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(6, 16))
    x = [list(map(float, centre[i % 6] + rng.normal(size=16) * 0.22)) for i in range(160)]
    x += [x[0], [2 * v for v in x[1]], None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, []]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    m = np.array(x[:162])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = (m @ m.T >= 0.9) & ~np.eye(162, dtype=bool)
    comp = component_labels(len(x), zip(*np.nonzero(near), strict=True))
    for i in range(len(x)):
        links = int(near[i].sum()) if i < 162 else 0
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (links, comp[i], comp[i] == i)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_embeddings_in_a_dense_cone(spark):
    """Thousands of vectors at a mutual cosine of 0.8, some of which have a twin at 0.91."""
    rng = np.random.default_rng(7)
    n, twins, dims = 6000, 200, 64
    centre = np.eye(dims)[0]

    def across(like=None, cosine=0.0):  # a direction across the centre's, at a cosine to another one
        r = rng.normal(size=dims)
        r[0] = 0
        if like is not None:
            r -= (r @ like) * like
        r /= np.linalg.norm(r)
        return r if like is None else cosine * like + np.sqrt(1 - cosine**2) * r

    sides = [across() for _ in range(n)]
    sides += [across(sides[i], 0.55) for i in range(twins)]
    x = np.sqrt(0.8) * centre + np.sqrt(0.2) * np.array(sides)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    a, b = np.nonzero(near)
    assert all(near[i, n + i] for i in range(twins))
    found = [got[i].component_id == got[j].component_id for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert np.mean(found) >= 0.98
    assert np.mean([got[i].n_links == k for i, k in enumerate(near.sum(1).tolist())]) >= 0.98


def test_forest_of_links():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(900, 8)), np.ones((700, 8)) + 0.05 * rng.normal(size=(700, 8))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    a, b = embedding_dedup.forest(x, 0.9)
    assert near[a, b].all() and component_labels(len(x), zip(a.tolist(), b.tolist(), strict=True)) == component_labels(len(x), zip(*(k.tolist() for k in np.nonzero(np.triu(near, 1))), strict=True))
    assert len(a) == len(x) - len(set(component_labels(len(x), zip(a.tolist(), b.tolist(), strict=True))))


def weighted_jaccard(a, b):
    from collections import Counter

    x, y = (Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter() for w in (words(a), words(b)))
    low, high = sum((x & y).values()), sum((x | y).values())
    return low / high if x and y else 0


@pytest.mark.parametrize("few", [12, 2])
def test_near_duplicates(spark, monkeypatch, few):
    monkeypatch.setattr(dart_minhash, "FEW", few)
    rows = texts()
    core = words(rows[7]) * 3
    rng = random.Random(5)
    for _ in range(25):  # a chain-like group whose members aren't all alike
        w = list(core)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        rows.append(" ".join(w))
    docs = table(spark, rows)
    got = {r.doc_id: r for r in dart_minhash.near_duplicates(docs).collect()}
    links = [(i, j) for i in range(len(rows)) for j in range(i) if weighted_jaccard(rows[i], rows[j]) >= 0.8]
    comp = component_labels(len(rows), links)
    assert [got[i * 3].component_id for i in range(len(rows))] == [3 * c for c in comp]
    kept = dart_minhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3 * i for i in range(len(rows)) if comp[i] == i]
    assert dart_minhash.near_duplicates(empty(spark)).count() == 0


def test_token_counts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    got = {r.doc_id: r for r in token_counts.count_tokens(table(spark), path, entries=20, sample=3).collect()}
    for i, x in enumerate(texts()):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i * 3].n_bytes, got[i * 3].n_tokens, got[i * 3].over_limit) == (len((x or "").encode()), n, n > 2048)
    assert token_counts.count_tokens(empty(spark), path).count() == 0


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_line_dedup(spark):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark)).collect()}
    before = []
    for i, x in enumerate(texts()):
        kept = []
        for line in (x or "").split("\n"):
            w = words(line)
            gone = bool(w) and any(w == v or (len(w) >= 8 and len(v) >= 8 and one_edit(w, v)) for v in before)
            if w:
                before.append(w)
            if not gone:
                kept.append(line)
        r = got[i * 3]
        assert (r.n_lines, r.n_dropped, r.kept) == (len((x or "").split("\n")), len((x or "").split("\n")) - len(kept), "\n".join(kept)), i
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_secrets(spark):
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.scan_secrets(table(spark))).collect()}
    kinds = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]
    for i, x in enumerate(texts()):
        found = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(kinds) for m in p.finditer(x or "") if len(m[g]) >= least)
        base = [f"{kinds[k][0]}:{a}:{b}" for a, k, b in found]
        r = got[i * 3]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in found) for j in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""}
    table_ = secret_scan.train_ratios(secret_scan.labelled_samples())
    odd = table(spark, ["key kQ9zX2vB7mT4wR8pL1sD6fG3 end", "see customer_account_history_table_2024 there"])
    spans = [r.spans for r in secret_scan.digest(secret_scan.scan_secrets(odd, table=table_)).orderBy("doc_id").collect()]
    assert spans == ["random:4:28", ""]
    assert secret_scan.scan_secrets(empty(spark)).count() == 0


def repeats_by_force(rows):
    first, out = {}, []
    for i, x in enumerate(rows):
        w = words(x)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if first.setdefault(key, (i, k)) != (i, k):
                gone[k : k + 20] = [True] * 20
        out.append((len(w), sum(gone), " ".join(v for v, g in zip(w, gone, strict=True) if not g)))
    return out


def test_repeats(spark):
    rng = random.Random(8)
    rows = texts()
    for _ in range(15):
        a, b = rng.choice(rows[:12]), rng.choice(rows[:12])
        w = words(a)[rng.randint(0, 10) :] + words(b)
        w[rng.randrange(len(w))] = "changed"
        rows.append(" ".join(w))
    rows.append(rows[0] + " " + rows[0])
    for sizes in ((2_000_000, 1_000_000, 256), (150, 60, 7)):
        got = {r.doc_id: r for r in substring_dedup.remove_repeats(table(spark, rows), "doc_id", "text", *sizes).collect()}
        assert [(got[i * 3].n_words, got[i * 3].n_removed, got[i * 3].kept) for i in range(len(rows))] == repeats_by_force(rows)
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_passages_go_where_their_windows_recur(spark, monkeypatch):
    """Not to every shard that shares a phrase of them: that grew with the square of the table."""
    seen, put = {}, substring_dedup.written
    monkeypatch.setattr(substring_dedup, "written", lambda df, name: seen.setdefault(name, put(df, name)))
    rng = random.Random(12)
    some = lambda n: [f"{w}{rng.randint(0, 999)}" for w in rng.choices(WORDS, k=n)]
    common = [some(15) for _ in range(6)]  # each shorter than a window
    twice = some(20) + common[0] + some(20)
    rows = [" ".join(sum((some(20) + c for c in common), [])) for _ in range(60)] + [" ".join(some(30) + twice), " ".join(twice + some(30))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(table(spark, rows), "doc_id", "text", 200, 200, 256).collect()}
    assert got == {i * 3: 55 if i == 61 else 0 for i in range(62)}
    assert seen["some"].count() > 50 and seen["parts"].count() == seen["passages"].count() == 1


def test_decontaminate(spark):
    rng = random.Random(4)
    item = [f"{w}{rng.randint(0, 99)}" for w in rng.choices(WORDS, k=40)]
    other = list(item)
    other[5] = other[20] = other[33] = "changed"
    rows = [*texts(), " ".join(["before"] * 9 + other + ["after"] * 9), " ".join(w.upper() + "," for w in item)]
    bench = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "x"), (3, "", "x"), (1, " ".join(item), "x")], "item_id long, text string, score string")
    docs = table(spark, rows)
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontaminate.flag(docs, bench).collect()}
    n = len(texts()) * 3
    assert {k: v for k, v in got.items() if v[0]} == {n: (True, [1]), n + 3: (True, [1])} and len(got) == len(rows)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == list(range(0, n, 3))
    assert decontaminate.flag(empty(spark), bench).count() == 0 and decontaminate.clean(docs, bench.limit(0)).count() == len(rows)


def test_mixing(spark):
    docs = table(spark)
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(texts()) and all(0 <= r.taken <= 2 * r.size for r in rows)
    for s in (None, "a", "b", "c"):
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].source_size == sum(r.size for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs.repartition(7)).collect()))
    assert mixing.repeat(docs).columns == docs.columns
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_token_store(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    folder = token_store.write_store(table(spark), path)
    start = 0
    for r, x in zip(token_store.read_store(spark, folder).orderBy("doc_id").collect(), texts(), strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    changed = spark.read.parquet(f"{folder}/chunks").selectExpr("digest", "n", "width", "overlay(payload PLACING X'00' FROM 1) AS payload").collect()
    spark.createDataFrame(changed, "digest binary, n int, width int, payload binary").write.mode("overwrite").parquet(f"{folder}/chunks")
    with pytest.raises(Exception, match="isn't what was written"):
        token_store.read_store(spark, folder).collect()
    assert token_store.read_store(spark, token_store.write_store(empty(spark), path)).count() == 0
