"""A corpus pipeline in five stages, from raw documents to a token store.

Each stage calls one corpus operator on all that its predecessor kept, and each but the
last returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.llm import dart_minhash, decontaminate, mixing, quality_conv, token_store
from retailflow.llm.common import written
from retailflow.llm.queries import is_held_out, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects: score under 0.3.

    Trained as operator 1 is, on labelled rows of the input that aren't held out.
    """
    net = quality_conv.fit(docs, table(spark, sf_dir, "labels"), is_held_out)
    names = tuple("_" * (1 + max(map(len, docs.columns))) + n for n in ("score", "predicted"))  # clash with none
    scored = quality_conv.score(docs, net, keep=tuple(docs.columns), out=names)
    # the kept columns hold the text itself, so nothing is joined
    return scored.where(F.col(names[1]) == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of each group of near copies."""
    return dart_minhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their targets.

    Texts stay whole: of the one document of a source that the budget cuts, the number of
    copies is rounded. Copies are rows of their own with the same doc_id.
    """
    return mixing.repeat(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns what its files say of each document."""
    folder = token_store.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_store(spark, folder)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_files),
]

#: SQL can express neither the network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written as Parquet and read again; drop_written() removes these tables."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = written(out, f"stage-{k}")
    return docs
