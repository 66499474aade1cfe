"""The corpus pipeline against a brute-force version of each stage, on small tables."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from test_edges import agreed_by_force, odd_rows
from test_operators import component_labels, weighted_jaccard
from tokenizers import Tokenizer

import corpus_pipeline
from retailflow.llm import mixing, quality_conv, queries

SMALL = "/root/testdata/sf0.001"


def tokens(text):
    out, word = [], ""
    for c in (text or "").lower():
        if c.isalpha() or c.isnumeric():
            word += c
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def test_pipeline_by_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 6000")
    extra = spark.createDataFrame([(900_000 + k, t, "en", None, 1) for k, (_, t) in enumerate(odd_rows()[:9])] + [(None, "no id here at all", "en", "src1", 1)], docs.schema)
    docs = docs.unionByName(extra).selectExpr("*", "lang AS _score", "lang AS size")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")

    # quality: every row by its own score
    net = quality_conv.fit(docs, labels, queries.is_held_out)
    rows = docs.collect()
    text = [(r.text or "").encode() for r in rows]
    score = net.scores(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]))
    rows = [r for r, s in zip(rows, score.tolist(), strict=True) if s >= 0.3]
    first = corpus_pipeline.quality(spark, docs, folder)
    assert first.columns == docs.columns and Counter(first.collect()) == Counter(rows)

    # near copies: components over all pairs
    named = [r for r in rows if r.doc_id is not None]
    named.sort(key=lambda r: r.doc_id)
    links = [(i, j) for i in range(len(named)) for j in range(i) if weighted_jaccard(named[i].text, named[j].text) >= 0.8]
    component = component_labels(len(named), links)
    rows = [r for i, r in enumerate(named) if component[i] == i] + [r for r in rows if r.doc_id is None]
    assert len(rows) < len(named)

    # benchmark: every alignment of every item
    items = [w for w in (tokens(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()) if len(w) >= 4]

    def leaks(text):
        d = tokens(text)
        held = set(d)
        return any(agreed_by_force(item, d) for item in items if sum(w in held for w in item) >= math.ceil(0.8 * min(15, len(item))))

    rows = [r for r in rows if not leaks(r.text)]

    # mixture: the same by DuckDB, copies rounded
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in rows])
    taken = {i: (math.floor(n / size + 0.5) if size else 0) for i, size, n in db.execute(f"SELECT doc_id, size, taken FROM ({mixing.oracle_sql()})").fetchall()}
    rows = [r for r in rows for _ in range(taken[r.doc_id])]

    # token files
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expect = []
    for r in rows:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        expect.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(expect)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
