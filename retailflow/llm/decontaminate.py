"""Operator 8: benchmark decontamination by spaced seeds, with DataFrame operations only.

A fixed mask keeps some of a few consecutive words and ignores the others. The kept words
of every place of every document are hashed and joined with those of the benchmark's
items. Each hit fixes how document and item line up; along that line the words are
compared, and the document is contaminated if nearly all of a stretch agrees. The first two
masks together hit every stretch of 7 to 15 words with as many substitutions as are
tolerated. Where the benchmark has items of 4 to 6 words, three more masks are used, which
together hit those with every substitution that is tolerated in them. Items of 1 to 3 words, in which
none is tolerated, have masks of all their words, where the benchmark has such items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, small, written

# Places that a mask keeps; those for short items.
MASKS = ((0, 1, 2, 4), (0, 1, 4, 5))
SHORT_MASKS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 2, 3, 4))
#: Words from which on the first masks are enough, and up to which an item has its own mask.
SHORT, TINY = 7, 3
#: Words of a compared stretch, and the share of them that must agree.
STRETCH, AGREE = 15, 0.8


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(words: Column, masks) -> Column:
    """For each mask, hashes of the kept words at every place of words (short at the end)."""
    places = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)))

    def of(k: int, mask: tuple[int, ...]) -> Column:
        return F.transform(places, lambda i: F.xxhash64(F.lit(k), *[F.get(words, i + m) for m in mask]))

    return F.flatten(F.array(*[of(k, mask) for k, mask in enumerate(masks)]))


def _aligned(doc: Column, item: Column, shift: Column) -> Column:
    """1 or 0 for each word of the item: whether the document has it at the same place."""
    return F.transform(item, lambda w, i: F.when((i + shift >= 0) & (F.get(doc, F.greatest(i + shift, F.lit(0))) == w), F.lit(1)).otherwise(F.lit(0)))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, agree: float = AGREE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = 1
) -> DataFrame:
    """One row for each document and item that it contains: doc_id, text_hash, item_id, agreed.

    agreed is the largest number of agreeing words in a stretch of `stretch` words, or of
    the whole item where that is shorter; it is enough at the share `agree`, rounded up, so
    an item of up to 4 words has to stand whole. Items of fewer than `least_words` words are
    left out; an item without words is never found.
    Words are compared in lower case without punctuation. Null texts hold nothing. Rows that share an id are
    told apart by text_hash. Either table may be empty.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), tokens(F.col(item_text)).alias("_item")).where(F.size("_item") >= max(1, least_words))
    items = written(items.distinct(), "items")
    sizes = {r.n for r in items.select(F.least(F.size("_item"), F.lit(SHORT)).alias("n")).distinct().collect()}
    tiny = tuple(tuple(range(k)) for k in range(1, TINY + 1) if k in sizes)
    masks = MASKS + (SHORT_MASKS if sizes & set(range(TINY + 1, SHORT)) else ()) + tiny
    n = F.size("_item")
    seeds = items.select("item_id", "_item", n.alias("n"), F.posexplode(_seeds(F.col("_item"), masks)).alias("p", "seed"))
    # the last places of each mask hold fewer words than it keeps
    span = F.get(F.array(*[F.lit(m[-1]) for m in masks]), (F.col("p") / F.col("n")).cast("int"))
    whole = F.get(F.array(*[F.lit(m in tiny) for m in masks]), (F.col("p") / F.col("n")).cast("int"))
    seeds = seeds.where((F.col("p") % F.col("n") + span < F.col("n")) & (~whole | (F.col("n") == span + 1))).select("seed", "item_id", F.xxhash64("_item").alias("_v"), (F.col("p") % F.col("n")).alias("at"))
    seeds = written(seeds.distinct(), "seeds")
    key = [F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash")]
    made = docs.where(F.col(text).isNotNull()).select(*key, tokens(F.col(text)).alias("_words"))
    places = made.select("doc_id", "text_hash", F.size("_words").alias("n"), F.posexplode(_seeds(F.col("_words"), masks)).alias("p", "seed"))
    hits = places.join(F.broadcast(seeds) if small(seeds) else seeds, "seed")
    hits = hits.select("doc_id", "text_hash", "item_id", "_v", (F.col("p") % F.col("n") - F.col("at")).cast("int").alias("shift")).distinct()
    hits = written(hits, "hits")
    hit_docs = written(hits.select("text_hash").distinct(), "hit-docs")
    held = by_ids(docs.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("_text")), hit_docs, "text_hash").distinct()
    held = held.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"), tokens(F.col("_text")).alias("_words"))
    i = items.select(F.col("item_id").alias("_i"), F.xxhash64("_item").alias("_w"), "_item")
    same_item = F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("_v") == F.col("_w"))
    few = small(items)
    # a document's words go into one shuffle only: few items are broadcast behind it, many
    # come to their hits before it
    pairs = (hits if few else hits.join(i, same_item)).join(held, (F.col("text_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    pairs = pairs.join(F.broadcast(i), same_item) if few else pairs
    pairs = pairs.select("doc_id", "text_hash", "item_id", _aligned(F.col("_words"), F.col("_item"), F.col("shift")).alias("_same"))
    width = F.least(F.size("_same"), F.lit(stretch))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("_same") - width + 1), lambda k: F.aggregate(F.slice("_same", k, width), F.lit(0), lambda a, x: a + x)))
    pairs = pairs.where(F.aggregate("_same", F.lit(0), lambda a, x: a + x) >= F.ceil(width * agree))
    pairs = pairs.select("doc_id", "text_hash", "item_id", best.alias("agreed"), F.ceil(width * agree).alias("_least")).where("agreed >= _least")
    return pairs.groupBy("doc_id", "text_hash", "item_id").agg(F.max("agreed").alias("agreed"))


def flag(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids (ascending) of every row of docs."""
    found = contaminated(docs, benchmark, doc_id=doc_id, text=text, **options)
    # as many items as the benchmark has can stand in one document at most
    each = found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    each = written(each.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_hash", "_h"), "flags")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_t"))
    joined = rows.join(F.broadcast(each) if small(each) else each, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_h")), "left")
    ids = F.coalesce("item_ids", F.array().cast(each.schema["item_ids"].dataType))
    return joined.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    found = contaminated(docs, benchmark, doc_id=doc_id, text=text, **options)
    found = written(found.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct(), "found")
    return docs.join(F.broadcast(found) if small(found) else found, docs[doc_id].eqNullSafe(found["_d"]) & (F.xxhash64(docs[text]) == found["_h"]), "left_anti")
