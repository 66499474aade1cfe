"""Null and repeated ids, equal rows, very long texts and clashing column names, for every
corpus operator; and properties that need tables of their own."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retailflow.llm import dart_minhash, decontaminate, embedding_dedup, line_dedup, mixing, quality_conv, queries, secret_scan, substring_dedup, token_counts, token_store, units
from retailflow.llm.common import PIECE_BYTES

from test_operators import WORDS, one_edit, words


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def odd_rows():
    """(doc_id, text): ids missing and repeated, equal rows, and a text over PIECE_BYTES."""
    rng = random.Random(12)
    a, b, c = prose(rng, 60), prose(rng, 45), "one line of some eight words or more\n" + prose(rng, 30)
    long = "\n".join(prose(rng, 400) for _ in range(160)) + "é password = hunter22x"
    assert len(long.encode()) > 1.2 * PIECE_BYTES
    rows = [(3, a), (3, a), (3, b), (None, c), (None, c), (None, None), (None, ""), (5, None), (6, ""), (7, long), (8, long[:-400]), (9, a), (10, c), (11, " "), (12, "tail \n\n"), (13, "next")]
    return rows


def odd_table(spark, rows=None):
    """The rows with columns whose names operators might use themselves."""
    names = "_text doc th key node n lines kept score runs _line o _key size target".split()
    kinds = ", ".join(f"{n} string" for n in names)
    rows = odd_rows() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None if k % 3 else "s", *["x"] * len(names)) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, lang string, source string, {kinds}")


def rows_of(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_quality_edges(spark):
    docs = odd_table(spark)
    labels = spark.createDataFrame([(i, k % 2, 0) for k, (i, _) in enumerate(odd_rows())] + [(9, None, 0)], "doc_id long, quality int, toxic int")
    net = quality_conv.fit(docs, labels, lambda c: queries.is_held_out(c) & (c < 0), rows=20)
    got = quality_conv.score(docs.select("doc_id", "text", "n"), net, keep=("doc_id", "text", "n")).collect()
    assert len(got) == len(odd_rows())
    by_text = {}
    for r in got:
        by_text.setdefault(r.text or "", set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    again = quality_conv.score(docs.repartition(7), net, keep=("text",)).collect()
    assert {(r.text or "", r.score) for r in again} == {(r.text or "", r.score) for r in got}
    with pytest.raises(ValueError, match="clash"):
        quality_conv.score(docs, net, keep=("doc_id", "score"))
    assert quality_conv.fit(docs.limit(0), labels, queries.is_held_out).p["out"].shape == (quality_conv.UNITS,)


def plain_scores(net, text):
    """The network by definition, place by place."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    W, S, T, C = quality_conv.WIDTH, quality_conv.STRIDE, quality_conv.STEP, quality_conv.CHUNK
    steps = max(C, -(-len(text) // (S * T)))
    padded, G, L = text + bytes(steps * S * T + W + 8), quality_conv.GRAM, quality_conv.LOOK
    held = bytes(L) + padded
    symbol = [padded[i] + 256 * any(held[i + L - lag : i + L - lag + G] == padded[i : i + G] for lag in range(2, L + 1)) for i in range(steps * S * T + W)]
    first = np.array([[max(0.0, f) for f in sum(p["table"][k][symbol[i + k]] for k in range(W)) + p["bias"]] for i in range(0, steps * S * T, S)])
    summed = first.reshape(steps, T, -1).sum(1)
    second = np.array([np.tanh(sum(summed[i + k] @ p["chunks"][k] for k in range(C)) + p["shift"]) for i in range(steps - C + 1)])
    return 1 / (1 + np.exp(-(second.max(0) @ p["out"] + p["last"][0])))


def test_network_by_definition():
    rng = random.Random(3)
    net = quality_conv.Network()
    texts = [b"", b"x", b"short", *(bytes(rng.choices(range(256), k=rng.randint(1, 900))) for _ in range(20))]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for piece in (1 << 18, 700, 40):  # however texts are cut and batched
        assert np.allclose(net.scores(data, at, piece), [plain_scores(net, t) for t in texts], atol=1e-5)
    for shift in range(6):
        moved = np.frombuffer(b"z" * shift + texts[9], np.uint8)
        assert net.scores(moved, np.array([shift, len(moved)]))[0] == net.scores(data, at)[9]


def test_quality_on_held_out_rows(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    net = quality_conv.fit(docs, labels, queries.is_held_out)
    held = docs.join(labels, "doc_id").where(queries.is_held_out(docs["doc_id"]))
    got = quality_conv.score(held, net, keep=("doc_id", "quality")).collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.99
    assert np.mean([g >= 0.3 for g in good]) > 0.99 and np.mean([b < 0.3 for b in bad]) > 0.9


def test_embedding_edges(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(3, 8)).tolist()
    data = [(1, base[0]), (1, base[0]), (1, base[1]), (None, base[0]), (2, base[1]), (3, base[2]), (4, None), (5, [1.0]), (6, [2.0]), (7, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in data], "vec_id long, embedding array<double>, node string, vector string")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect())
    assert got == Counter({(1, 1, 1, True): 3, (2, 1, 1, False): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 1, (5, 1, 5, True): 1, (6, 1, 5, False): 1, (7, 0, 7, True): 1, (None, 0, None, True): 1})


def test_embedding_blocks_of_a_large_group(spark):
    """One component of most rows, counted in many blocks."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.ones((300, 12)) + 0.15 * rng.normal(size=(300, 12)), rng.normal(size=(100, 12))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = ((u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)).sum(1).tolist()
    for block in (16, 128):
        got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, block=block).collect()}
        assert [got[i] for i in range(len(x))] == near


def test_minhash_edges(spark):
    docs = odd_table(spark)
    got = dart_minhash.near_duplicates(docs).collect()
    assert len(got) == len(odd_rows())
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of[9] == 3 and of[8] == of[7] == 7 and of[10] == 10 and of[5] == 5 and of[6] == 6 and of[11] == 11
    kept = dart_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({None: 4, 3: 1, 5: 1, 6: 1, 7: 1, 10: 1, 11: 1, 12: 1, 13: 1})


def test_token_count_edges(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    got = rows_of(token_counts.count_tokens(odd_table(spark), path, keep=("doc_id", "n")), "doc_id", "n", "n_bytes", "n_tokens")
    assert got == Counter((i, "x", len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in odd_rows())
    with pytest.raises(ValueError, match="clash"):
        token_counts.count_tokens(odd_table(spark).withColumnRenamed("n", "n_tokens"), path, keep=("doc_id", "n_tokens"))
    gap = [(1, "x" * (PIECE_BYTES * 2)), (2, ("y" * 70_000 + " ") * 9)]  # words longer than a piece, or than the table takes
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(odd_table(spark, gap), path).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in gap}


def in_order(rows):
    """Distinct (id, text) as the line and repeat operators order them: a null id first. Texts
    of one id share no lines or windows here, so their order doesn't matter."""
    return sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_line_edges(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(8, 14))) for _ in range(12)]
    texts = []
    for _ in range(40):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            kind, k = rng.randrange(3), rng.randrange(len(w))
            w[k : k + (kind < 2)] = [] if kind == 1 else [rng.choice(WORDS)]
        texts.append(" ".join(w) + rng.choice(["", "\n", "\nshort line\n\n"]) + rng.choice(base))
    huge = rng.choices(WORDS, k=3000)
    texts += [" ".join(huge), " ".join(huge[:1500] + huge[1501:]), " ".join([*huge[:2999], "other"]), " ".join(["x", *huge[1:2999], "other"])]
    rows = odd_rows() + [(20 + i, x) for i, x in enumerate(texts)]
    before, expect = [], {}
    for i, x in in_order(rows):
        kept = []
        for line in (x or "").split("\n"):
            w = words(line)
            gone = bool(w) and any(w == v or (len(w) >= 8 and len(v) >= 8 and abs(len(w) - len(v)) < 2 and one_edit(w, v)) for v in before)
            before += [w] if w else []
            kept += [] if gone else [line]
        n = len((x or "").split("\n"))
        expect[i, x or ""] = (i, n, n - len(kept), "\n".join(kept))
    got = rows_of(line_dedup.dedup_lines(odd_table(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept")
    assert got == Counter(expect[i, x or ""] for i, x in rows)


def test_one_edit_and_keys(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        a = rng.choices("abc", k=rng.randint(1, 6))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            k, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            b[k : k + (kind < 2)] = [] if kind == 1 and len(b) > 1 else [rng.choice("abc")]
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    from pyspark.sql import functions as F

    for r in df.select("a", "b", line_dedup.one_edit(F.col("a"), F.col("b")).alias("near")).collect():
        assert r.near == one_edit(r.a.split(), r.b.split()), r
    line = spark.createDataFrame([(" ".join(WORDS * 50),)], "line string")
    w = (WORDS * 50).copy()
    keys = line.select(F.explode(line_dedup.variant_keys(F.col("line"), F.lit(len(w)))).alias("v")).select("v.*").collect()
    for i in (1, 600, len(w)):
        left = spark.createDataFrame([(" ".join(w[: i - 1] + w[i:]),)], "line string").select(line_dedup.whole_key(F.col("line"))).first()[0]
        assert keys[i - 1].child == left


def test_repeat_edges(spark):
    rng = random.Random(10)
    common = prose(rng, 25)  # a passage in every shard
    rows = odd_rows() + [(30 + k, prose(rng, rng.randint(0, 40)) + " " + common + " " + prose(rng, 20)) for k in range(30)] + [(31, prose(rng, 30)), (31, "x")]
    first, expect = {}, {}
    for i, x in in_order(rows):
        w = words(x)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first.setdefault(tuple(w[k : k + 20]), (i, x, k)) != (i, x, k):
                gone[k : k + 20] = [True] * 20
        expect[i, x or ""] = (i, len(w), sum(gone), " ".join(v for v, g in zip(w, gone, strict=True) if not g))
    got = rows_of(substring_dedup.remove_repeats(odd_table(spark, rows), "doc_id", "text", 400, 200, 9), "doc_id", "n_words", "n_removed", "kept")
    assert got == Counter(expect[i, x or ""] for i, x in rows)


def agreed_by_force(item, doc, stretch=15, agree=0.8):
    width = min(stretch, len(item))
    for shift in range(-len(item) + 1, len(doc)):
        same = [0 <= k + shift < len(doc) and doc[k + shift] == w for k, w in enumerate(item)]
        if any(sum(same[k : k + width]) >= math.ceil(width * agree) for k in range(len(item) - width + 1)):
            return True
    return False


def test_decontaminate_by_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [rng.choices(vocabulary, k=n) for n in (*range(1, 22), 40, 80)] + [["tiny", "item", "of"]]
    docs = []
    for item in items:
        for _ in range(6):
            k = rng.randint(0, max(0, len(item) - 15))
            part = item[k : k + max(15, rng.randint(0, len(item)))]
            part = [w if rng.random() > 0.13 else "changed" for w in part]
            docs.append(rng.choices(vocabulary, k=rng.randint(0, 12)) + part + rng.choices(vocabulary, k=rng.randint(0, 12)))
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in enumerate(items)] + [(None, None, "x")], "item_id long, text string, doc_id string")
    expect = [[k for k, item in enumerate(items) if agreed_by_force(item, d)] for d in docs]
    got = {r.doc_id: r.item_ids for r in decontaminate.flag(odd_table(spark, [(i, " ".join(d)) for i, d in enumerate(docs)]), bench).collect()}
    assert [got[i] for i in range(len(docs))] == expect and 20 < sum(map(len, expect))
    got = {r.doc_id: r.item_ids for r in decontaminate.flag(odd_table(spark, [(i, " ".join(d)) for i, d in enumerate(docs)]), bench, least_words=4).collect()}
    assert [got[i] for i in range(len(docs))] == [[k for k in e if len(items[k]) >= 4] for e in expect]
    rows = [*odd_rows(), (None, " ".join(items[5])), (3, " ".join(items[5]))]
    table = odd_table(spark, rows)
    found = rows_of(decontaminate.flag(table, bench), "doc_id", "contaminated")
    assert found == Counter((i, x == " ".join(items[5])) for i, x in rows)
    clean = decontaminate.clean(table, bench)
    assert clean.columns == table.columns and rows_of(clean, "doc_id", "text") == Counter(odd_rows())


def test_mixing_edges(spark):
    got = mixing.mix_sources(odd_table(spark)).collect()
    assert len(got) == len(odd_rows())
    for s in (None, "s"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    again = mixing.mix_sources(odd_table(spark).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.repeat(odd_table(spark))
    assert out.columns == odd_table(spark).columns and out.count() > 0


def store_by_force(t, rows):
    """(doc_id, n_tokens, crc32) of each row."""
    out = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


def test_token_store_edges(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    monkeypatch.setattr(token_store, "FAN", 3)
    got = token_store.read_store(spark, token_store.write_store(odd_table(spark), path)).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(store_by_force(t, odd_rows()))
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_token_store_on_random_texts(spark):
    """White space, punctuation and marks in all positions, in batches of several orders."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(13)
    bits = ["a", "word", "Ünï", "é", "\n", "\n\n", " ", "  ", "\t", ".", "...", "'s", "'", "12", "<|endoftext|>", "<", "|", " ", "　", "中文", "\U0001f600", "_", "-", "\r\n", "\x0b"]
    rows = [(k, "".join(rng.choices(bits, k=rng.randint(0, 9))) + rng.choice(["", "\n\n", " ", "  "])) for k in range(6000)]
    expect = store_by_force(t, rows)
    for seed in (1, 2):
        mixed = random.Random(seed).sample(rows, len(rows))
        df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(seed)
        got = token_store.read_store(spark, token_store.write_store(df, path)).orderBy("start").collect()
        assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == expect
        assert [r.start for r in got] == np.cumsum([0, *(n for _, n, _ in expect)]).tolist()[:-1]


def test_words_go_past_the_pattern(monkeypatch):
    """Blanks with letters behind them have the library's ids without its pattern; so has all else."""
    given = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    lettered = json.loads(given)
    lettered["added_tokens"].append({"id": 50257, "content": " wor", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False})
    rng = random.Random(29)
    bits = ["a", "Zo", "word", "Ünï", "é", "Ã", "×", "÷", "ß", " ", " ", " ", "  ", "\n", "\t", ".", "'s", "12", "<|endoftext|>", "ā", "中", "\u00a0", "Ġ", "\U0001f600"]
    texts = ["", " ", " é", "é", " ×", "a", *("".join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(3000))]
    lines = units.encode_lines
    for spec, past in ((given, True), (json.dumps(lettered), False)):
        slow = []
        monkeypatch.setattr(units, "encode_lines", lambda j, data, begin, end, slow=slow: slow.extend(data[b:e].tobytes().decode() for b, e in zip(begin, end, strict=True)) or lines(j, data, begin, end))
        cache, t = units.IdCache(spec), Tokenizer.from_str(spec)
        for k in range(0, len(texts), 500):
            some = texts[k : k + 500]
            at = np.cumsum([0, *(len(x.encode()) for x in some)])
            own = units.Units(np.frombuffer("".join(some).encode(), np.uint8), at)
            ids, lengths = cache.ids_of(own)
            ends = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(own.counts))]
            if past:  # a unit may end within an added token of letters
                assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in some]
        words = [u for u in slow if re.fullmatch(" [A-Za-zÀ-ÖØ-öø-ÿ]+", u)]
        assert bool(words) != past and slow


def test_word_ids_that_are_more_than_the_cache_holds(monkeypatch):
    monkeypatch.setattr(units, "CACHE_UNITS", 40)
    given = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    t, rng = Tokenizer.from_str(given), random.Random(3)
    monkeypatch.setattr(units, "_caches", {})
    cache = units.id_cache(given)
    for _ in range(60):
        text = "".join(" " + "".join(rng.choices("abcdeé", k=rng.randint(1, 3))) for _ in range(30))
        raw = np.frombuffer(text.encode(), np.uint8)
        assert cache.ids_of(units.Units(raw, np.array([0, len(raw)])))[0].tolist() == t.encode(text, add_special_tokens=False).ids


def test_cut_points_of_every_window():
    ids = np.random.default_rng(4).integers(0, 60000, 30000).astype(np.uint32)
    x = [((int(i) + 1) * 0x9E3779B97F4A7C15) % 2**64 for i in ids]
    x = [v ^ v >> 29 for v in x]
    cuts = {4000, 4010, 30000}
    for begin, end in ((0, 4000), (4000, 4010), (4010, 30000)):
        for e in range(begin + token_store.WINDOW, end + 1):
            h = 0
            for v in x[e - token_store.WINDOW : e]:
                h = (h * token_store._Q + v) % 2**64
            cuts |= {e} if (h ^ h >> 32) & token_store.CUT == 0 else set()
    assert token_store.cut_points(ids, np.array([4000, 4010, 30000])).tolist() == sorted(cuts)


def ratio_by_force(token, table):
    at = [secret_scan.ALPHABET.index(c) for c in token]
    return sum(table[a * len(secret_scan.ALPHABET) + b] for a, b in zip(at, at[1:], strict=False))


def test_secret_edges(spark):
    rows = [*odd_rows(), (40, "AKIA" + "Z9" * 9 + " " + "q" * 30 + " token=abcdefg"), (41, " ".join(f"secret: {k:06d}abc" for k in range(1500)))]
    got = secret_scan.digest(secret_scan.scan_secrets(odd_table(spark, rows))).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[40].n_assign, by_id[40].n_access, by_id[41].n_assign) == (1, 1, 1500) and by_id[7].n_assign == 1
    place = [m.span() for m in re.finditer("secret: [0-9a-z]+", rows[-1][1])]
    assert by_id[41].base_sha256 == hashlib.sha256(",".join(f"assign:{a}:{b}" for a, b in place).encode()).hexdigest()


def test_random_spans_by_force(spark):
    """Added spans are those of a plain scorer; measured on samples that trained nothing."""
    table = secret_scan.train_ratios(secret_scan.labelled_samples())
    samples = secret_scan.labelled_samples(600, seed=99)
    rng = random.Random(14)
    rows = [(k, rng.choice(["see ", "é中 ", "", "some/long_path/of_words/with/", "account_setting="]) + s + rng.choice([" end", "", "\n"])) for k, (s, _) in enumerate(samples)]
    found = secret_scan.scan_secrets(odd_table(spark, rows)).collect()
    got, base = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3] for r in found}, {r.doc_id: len(r.base) for r in found}
    for k, x in rows:
        if not base[k]:
            assert got[k] == secret_scan_by_force(x, table), x
    caught = [bool(got[k] or base[k]) for k, (_, y) in enumerate(samples) if y]
    wrong = [bool(got[k]) for k, (_, y) in enumerate(samples) if not y]
    assert np.mean(caught) > 0.9 and np.mean(wrong) < 0.02


def secret_scan_by_force(text, table):
    def judged(pattern):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= secret_scan.RANDOM_LEAST and ratio_by_force(m[0], table) >= max(secret_scan.RATIO_WHOLE, secret_scan.RATIO_EACH * len(m[0])):
                yield m.span()

    whole = list(judged(r"[A-Za-z0-9+/_=-]+"))
    return sorted(whole + [(a, b) for a, b in judged(r"[A-Za-z0-9+_-]+") if not any(a < y and x < b for x, y in whole)])


def test_long_token(spark):
    """A megabyte without a blank takes one pass."""
    rng = random.Random(15)
    token = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1 << 20))
    got = secret_scan.digest(secret_scan.scan_secrets(odd_table(spark, [(1, token)]))).first()
    assert got.spans == f"random:0:{1 << 20}"


def test_ids_at_the_ends_of_a_long(spark):
    """A null id is smaller than any, and no id stands for it; the least long leaves it no place."""
    from retailflow.llm import line_dedup, substring_dedup

    passage = " ".join(f"w{i}" for i in range(40))
    ids = [None, -(1 << 34), -(1 << 62), (1 << 63) - 1, 5]
    for some in (ids, ids[:2], [None, -(1 << 34), 5]):
        docs = spark.createDataFrame([(i, passage) for i in some], "doc_id long, text string")
        lines = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs).collect()}
        words = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()}
        assert lines == {i: int(i is not None) for i in some}
        assert words == {i: 40 * int(i is not None) for i in some}
    docs = spark.createDataFrame([(None, "a"), (-(1 << 63), "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="null id"):
        line_dedup.dedup_lines(docs)


def test_one_document_of_very_many_lines_and_secrets(spark):
    """200,000 lines, half of which go, and 50,000 tokens: no work that grows with their square."""
    import time

    from retailflow.llm import line_dedup, secret_scan

    n = 100_000
    lines = [f"line {i}" for i in range(n)] * 2
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    began = time.time()
    r = line_dedup.dedup_lines(docs).first()
    assert (r.n_lines, r.n_dropped, r.kept) == (2 * n, n, "\n".join(lines[:n]))
    assert time.time() - began < 120
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choices(letters, k=32)) if i % 2 else f"token={''.join(rng.choices('0123456789abcdef', k=32))}" for i in range(50_000)]
    docs = spark.createDataFrame([(1, " ".join(tokens))], "doc_id long, text string")
    began = time.time()
    r = secret_scan.scan_secrets(docs).first()
    assert len(r.base) == 50_000 and len(r.spans) > 70_000
    assert time.time() - began < 180
    taken = sorted((s.start, s.end) for s in r.spans if s.kind == 3)
    base = sorted((s.start, s.end) for s in r.base)
    assert not {b for b in base} & {t for t in taken}


def test_clear_spans_by_force(spark):
    from pyspark.sql import functions as F

    from retailflow.llm import secret_scan

    rng = random.Random(8)
    rows = []
    for i in range(60):
        of = lambda kind, k: [(s, kind, s + rng.randint(1, 9)) for s in (rng.randint(0, 3000 if i == 0 else 90) for _ in range(k))]  # noqa: B023, E731
        rows.append((i, of(3, 1500 if i == 0 else rng.randint(0, 12)), of(0, 900 if i == 0 else rng.randint(0, 6))))
    kind = "array<struct<start:int,kind:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, spans {kind}, of {kind}")
    got = {r.i: sorted(map(tuple, r.out)) for r in df.select("i", secret_scan._clear(F.col("spans"), F.col("of")).alias("out")).collect()}
    for i, spans, of in rows:
        assert got[i] == sorted(s for s in spans if not any(s[0] < b[2] and b[0] < s[2] for b in of))
