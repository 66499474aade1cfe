"""Operator 9: mixing sources to target weights, with DataFrame operations only.

Every document has a hash-random key. Within its source the keys are cut into ranges, and
prefix sums of words are made over the ranges first and within each range then, so that
no source, however large, is summed in one task. A source takes all its documents as many
whole times as its target allows, and of one further round those up to the exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, SPACES, small, written

WEIGHTS = (3, 1, 2)
SHARE, MOST_TIMES, SEED = 1.5, 2, 17
#: Hexadecimal digits of the key that number its range: 4096 ranges a source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_PATTERN))).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size) with target: a share of all sizes dealt out by weight.

    A target stops at `most` times its source's size and the excess goes to the others
    by weight: the sources in order of size for their weight fill up first, and the rest
    share what is left. One row a source; the windows see sources, not documents.
    """
    first = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(first) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("left", F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("rest", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.col("rest"))
    open_level = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    t = t.withColumn("final", F.min(F.when(open_level.isNotNull(), F.struct((-F.col("rest")).alias("o"), open_level.alias("level")))).over(every)["level"])
    capped = F.col("final").isNull() | (F.col("final") * F.col("w") > F.col("cap"))
    return t.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_TIMES, seed: int = SEED, text: str = "text", source: str = "source", doc_id: str = "doc_id"
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and _text_hash of every row.

    taken counts the words that the mix takes of a document, repeats included: at most
    `most` times its size, and over a source its target to the word. The same rows give the
    same result whatever the partitions; rows with the same id differ by their text, and
    equal rows are interchangeable. Null sources are one source, the last; null texts and
    ids are allowed; an empty table gives none. Other columns are left out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("_text_hash"), F.col(text).alias("_text"))
    # rows without an id have keys by their texts
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("_text"), F.lit("")))))
    rows = rows.withColumn("_key", F.md5(F.concat(name, F.lit(f":{seed}")))).drop("_text")
    rows = written(rows.withColumn("_range", F.substring("_key", 1, RANGE_DIGITS)), "sized")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("_rounds", whole).withColumn("_budget", F.floor(F.col("target") - F.col("_rounds") * F.col("source_size") + 0.5).cast("long"))
    targets = written(targets, "targets")
    few = small(targets)
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_own"))
    so_far = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(F.col("source").alias("_s"), F.col("_range").alias("_r"), (F.sum("_own").over(so_far) - F.col("_own")).alias("_offset"))
    within = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "_text_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_before", F.sum("size").over(within) - F.col("size"))
    placed = placed.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    t = targets.withColumnRenamed("source", "_t")
    placed = placed.join(F.broadcast(t) if few else t, F.col("source").eqNullSafe(F.col("_t")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_budget") - F.col("_before") - F.col("_offset")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("_rounds") * F.col("size") + part).cast("long").alias("taken"), "_text_hash")


def copies(mixed: DataFrame) -> Column:
    """Whole copies of a document that come nearest to the words taken of it."""
    return F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")


def repeat(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of docs with all columns, each as many times as the mix takes it whole."""
    mixed = mix_sources(docs, text=text, source=source, doc_id=doc_id, **options)
    n = written(mixed.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_text_hash").alias("_h"), copies(mixed).alias("_copies")), "copies")
    # of equal rows one gets the copies of all
    many = n.groupBy("_d", "_s", "_h").count().where("count > 1").head(1)
    same = lambda: docs[doc_id].eqNullSafe(F.col("_d")) & docs[source].eqNullSafe(F.col("_s")) & (F.xxhash64(docs[text]) == F.col("_h"))
    if not many:
        other = n.where("_copies <> 1")
        if small(other):
            out = docs.join(F.broadcast(other), same(), "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
        else:
            out = docs.join(n, same())
    else:
        total = n.groupBy("_d", "_s", "_h").agg(F.sum("_copies").alias("_copies"))
        out = docs.dropDuplicates([doc_id, source, text]).join(total, same())
    out = out.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select(*docs.columns)


def oracle_sql(weights=WEIGHTS, share: float = SHARE, most: int = MOST_TIMES, seed: int = SEED) -> str:
    """The same in DuckDB's SQL, with one window a source in place of ranges."""
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) || ':{seed}') AS k, coalesce(text, '') AS t
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([{", ".join(map(str, weights))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1 AS INT)] AS DOUBLE) AS w,
             source_size * {float(most)}::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * {share}::DOUBLE - coalesce(sum(cap) OVER o, 0)) AS lft,
             (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS rest
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_max(lft / rest, rest) AS final FROM l WHERE lft / rest * w <= cap),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR final * w > cap THEN cap ELSE final * w END AS target FROM l, f),
b AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS rounds FROM t),
c AS (SELECT *, CAST(floor(target - rounds * source_size + 0.5) AS BIGINT) AS budget FROM b),
p AS (SELECT d.doc_id, d.source, d.size, CAST(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size, t ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d)
SELECT p.doc_id, p.size, c.source_size, c.target,
       CAST(c.rounds * p.size + greatest(0, least(p.size, c.budget - p.before)) AS BIGINT) AS taken
FROM p JOIN c ON p.source IS NOT DISTINCT FROM c.source
"""
