"""Operator 13 by brute force: groups from equal ends, links one by one, counts over all texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from retailflow.llm import token_alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(6)
    pool = "aàbcAΣ .,'<|>1é́ \n\t 中文字😀ﬁ-_ the and  "
    out = ["".join(rng.choices(pool, k=rng.randint(1, 50))) + rng.choice(["", " <|endoftext|>", "</s>", "<0x41>", " "]) for _ in range(300)]
    out += [None, "", " ", "  ", "\n", "a ", "same text", "same text", "a ▁ b", "▁", "\x00a", "a" * 3000, " " * 3000, "ab" * 700 + "\n" * 99]
    return [*out, *(" ".join(rng.choices(["alpha", "beta", "gamma,", "delta", "中文"], k=rng.randint(1, 60))) for _ in range(60)), "some more words here, and " * 30_000]


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {i: t for t, i in a.get_vocab().items()}
    from tokenizers.pre_tokenizers import ByteLevel

    values = {c: i for i, c in enumerate(_letters())}
    assert set(values) == set(ByteLevel.alphabet())
    groups = []
    for t in rows:
        if not t:
            groups.append([])
            continue
        whole = (" " + t).encode()
        x = a.encode(" " + t, add_special_tokens=False).ids
        y = b.encode(t)
        xs = [bytes(values[c] for c in letters[i]) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(xs) != whole or b"".join(ys) != whole:
            groups.append([])
            continue
        ends = [], []
        for side, pieces in ((0, xs), (1, ys)):
            at = 0
            for p in pieces:
                at += len(p)
                ends[side].append(at)
        common, out, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for e in common:
            u, v = [], []
            while i < len(x) and ends[0][i] <= e:
                u.append(x[i])
                i += 1
            while j < len(y) and ends[1][j] <= e:
                v.append(y[j])
                j += 1
            out.append((u, v))
        groups.append(out)
    links = []
    for g in groups:
        own = Counter()
        for u, v in g:
            for (p, n), (q, m) in ((s, t) for s in Counter(u).items() for t in Counter(v).items()):
                own[p, q] += n * m
        links.append(own)
    count = Counter(k for own in links for k in own)
    most = defaultdict(int)
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    out = []
    for g, own in zip(groups, links, strict=True):
        text = ";".join("|".join(",".join(map(str, s)) for s in pair) for pair in g)
        best = sum(n for k, n in own.items() if count[k] == most[k[0]])
        out.append((sum(len(u) for u, _ in g), sum(len(v) for _, v in g), len(g), sum(own.values()), best, sum(n * count[k] for k, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def _letters():
    from retailflow.llm.bpe_codec import byte_letters

    return byte_letters()


@pytest.mark.parametrize("entries", [token_alignment.TABLE_PAIRS, 40, 0])
def test_alignment(spark, entries):
    rows = texts()
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1, "x") for i, t in enumerate(rows)], "doc_id long, text string, row int, pairs string").repartition(3)
    want = brute(rows)
    got = token_alignment.digest(docs, A, B, entries=entries).collect()
    by_id = {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None}
    wrong = [(rows[i][:40] if rows[i] else rows[i], by_id[i], w) for i, w in enumerate(want) if i % 9 and by_id[i] != w]
    assert not wrong, wrong[:3]
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, groups string")
    assert token_alignment.digest(docs.limit(0), A, B).count() == 0
    assert token_alignment.align(docs, A, B).first().n_groups == 1
    with pytest.raises(ValueError):
        token_alignment.align(docs, A, B, keep=("doc_id", "groups"))


def test_large_groups_by_their_ids(spark, monkeypatch):
    """A text is the same whether its groups' links are made one by one or by different ids."""
    docs = spark.createDataFrame([(1, "the 中文字😀 cat" * 50)], "doc_id long, text string")
    want = token_alignment.align(docs, A, B).first()
    found = token_alignment.groups(*(token_alignment.np.array(x) for x in ([2, 3, 7, 9], [1, 3, 5, 9])))
    assert [x.tolist() for x in found] == [[2, 4], [2, 4]]
    ids = token_alignment.np.array([5, 6, 5, 5]), token_alignment.np.array([8, 9, 8, 7])
    one = token_alignment.Aligner._pairs(*ids, *found, token_alignment.np.array([2, 2]), token_alignment.np.array([2, 2]), token_alignment.np.array([0, 0]))
    monkeypatch.setattr(token_alignment, "GROUP_LINKS", 0)
    two = token_alignment.Aligner._pairs(*ids, *found, token_alignment.np.array([2, 2]), token_alignment.np.array([2, 2]), token_alignment.np.array([0, 0]))
    assert [x.tolist() for x in one] == [x.tolist() for x in two]
    assert sum(want.times) == want.n_links
