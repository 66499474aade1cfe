"""Operator 11 against the tokenizers library: ids, decoded texts and edges."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retailflow.llm import bpe_codec

LETTERS = "aàbcAΣσςİ .,'<|>1é́̈ \n\t 中文字😀ﬁ-_\x1c\x85՘\U00016ea0"
SHAPE = "doc_id long, text string, ids int, decoded double, _text string, _ids string"


def texts():
    rng = random.Random(4)
    out = ["".join(rng.choices(LETTERS, k=rng.randint(0, 50))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>X", "'S ", " \n"]) for _ in range(400)]
    out += [None, "", " ", " \n\t ", "same text", "same text", "a" * 70, "ab" * 4000, "".join(rng.choices("abcdefgh", k=20_000)), "word and more " * 40_000]
    return [*out, "".join(rng.choices("中文字国人大", k=900)), "x" * bpe_codec.WIDE, "x" * (bpe_codec.WIDE + 1)]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_and_texts_are_the_librarys(spark, file):
    path = public_tokenizers.path(file)
    rows = texts()
    docs = spark.createDataFrame([(i if i % 9 else None, t, 1, 1.0, "x", "y") for i, t in enumerate(rows)], SHAPE).repartition(3)
    t = Tokenizer.from_file(path)
    t.no_truncation()
    want = []
    for x in t.encode_batch([r or "" for r in rows], add_special_tokens=False):
        joined, decoded = " ".join(map(str, x.ids)), t.decode(x.ids, skip_special_tokens=False)
        want.append((len(x.ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    got = bpe_codec.digest(docs, path).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(want)
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id} == {i: w for i, w in enumerate(want) if i % 9}
    assert bpe_codec.digest(docs.limit(0), path).count() == 0


def test_unknown_ids_clashes_and_other_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.createDataFrame([([320, None, -1, 10**6, 320],), (None,), ([],)], "ids array<int>")
    one = Tokenizer.from_file(path).id_to_token(320)
    assert [r.decoded for r in bpe_codec.decode(rows, path).collect()] == [f"{one} {one}", "", ""]
    docs = spark.createDataFrame([(1, "a", [1])], "doc_id long, text string, ids array<int>")
    with pytest.raises(ValueError):
        bpe_codec.encode(docs, path, keep=("doc_id", "ids"))
    with pytest.raises(ValueError):
        bpe_codec.decode(rows, path, out="ids")
    other = tmp_path / "other.json"
    other.write_text('{"model": {"type": "WordPiece"}}')
    with pytest.raises(ValueError):
        bpe_codec.encode(docs, str(other))


def test_rows_and_heap_agree():
    from pathlib import Path

    codec, rng = bpe_codec.Codec(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")), random.Random(5)
    for _ in range(200):
        word = bytes(rng.choices(b"abet hinors", k=rng.randint(1, bpe_codec.WIDE)))
        assert codec.encode_words([word])[0].tolist() == codec._heap([*codec.plain[list(word[:-1])].tolist(), int(codec.last[word[-1]])])


def test_a_worker_that_forgets(monkeypatch):
    from pathlib import Path

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(bpe_codec, "CACHE_WORDS", 5)
    codec, t = bpe_codec.Codec(Path(path).read_text(encoding="utf-8")), Tokenizer.from_file(path)
    for text in ("one two three four", "five six <|endoftext|> seven one", "one two three four five six seven eight nine"):
        assert codec.encode([text])[0].tolist() == t.encode(text, add_special_tokens=False).ids
