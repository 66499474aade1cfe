"""Operator 5: line dedup by a deletion-neighbourhood join, with DataFrame operations only.

Lines are compared by their words. Two lines are within one edit if a word of one is
replaced, or missing, in the other. A line's variants are what is left when one word is
deleted: if a word is replaced, both lines have the same variant at the same place; if one
is missing, a variant of the longer line is the shorter line itself. So variants are
hashed with their place for the first case and without it for the second, and equal keys
are joined. A variant's hash is made of running hashes of the line's words, so that all
variants of a line take one pass over it. Each key only gives its earliest line, which is all that a later one needs; so
a key that a third of all lines share is a sum, not a list of pairs.

Lines within one edit also share one half, whichever half has the edit. Halves are joined
first, and only lines that share one emit variants, for the words of the other half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, SPACES, by_ids, given_id, let, numbered, written

#: Lines of fewer words go only if they are equal to an earlier one.
LEAST_WORDS = 8
#: Words whose hashes are run together at a time.
GROUP = 512
_PLACE = 1 << 28


def normal(line: Column) -> Column:
    """Words joined by one space; only lines with other gaps need the pattern."""
    bare = F.btrim(line, F.lit(SPACES))
    other = F.contains(line, F.lit("  "))
    for space in SPACES.replace(" ", ""):
        other = other | F.contains(line, F.lit(space))
    return F.when(other, F.regexp_replace(bare, SPACE_PATTERN, " ")).otherwise(bare)


def _size(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _head(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), n)


def _halves(line: Column, n: Column) -> list[Column]:
    """Keys of the first and second halves, as a line of n words and as one of n - 1: the
    shorter line of a pair has its own number of words in the key, the longer one less."""
    out = []
    for r in (n, n - 1):
        half = F.floor(r / 2).cast("int")
        out += [F.xxhash64(F.lit("first"), r, _head(line, half)), F.xxhash64(F.lit("second"), r, _head(line, half - r))]
    return out


def one_edit(a: Column, b: Column) -> Column:
    """Whether the words of two lines are at an edit distance of 1 or less, in one pass."""
    x, y = F.split(a, " "), F.split(b, " ")
    swap = F.size(x) <= F.size(y)
    both = F.struct(F.when(swap, x).otherwise(y).alias("s"), F.when(swap, y).otherwise(x).alias("l"))

    def judged(p):
        n, more = F.size(p["s"]), F.size(p["l"]) - F.size(p["s"])
        # the first place at which the lines differ, n + 1 if the longer one goes on there
        same = F.zip_with(p["s"], F.slice(p["l"], 1, n), lambda u, v: u == v)
        first = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)), (n + 1).cast("long")).cast("int")
        rest = lambda c, k: F.slice(c, k, F.greatest(F.size(c) - k + 1, F.lit(0)))
        return F.when(more == 0, let(first, lambda k: (k > n) | (rest(p["s"], F.least(k, n) + 1) == rest(p["l"], F.least(k, n) + 1)))).when(more == 1, let(first, lambda k: rest(p["s"], k) == rest(p["l"], k + 1))).otherwise(False)

    return let(both, judged)


def _running(values: Column) -> Column:
    """Exclusive-or of the first 0, 1, ... all values of an array: GROUP at a time, so that
    no long list grows by one."""
    zero = F.lit(0).cast("long")
    none = lambda x: F.struct(x.alias("x"), F.array().cast("array<bigint>").alias("out"))
    step = lambda acc, v: F.struct(acc["x"].bitwiseXOR(v).alias("x"), F.concat(acc["out"], F.array(acc["x"].bitwiseXOR(v))).alias("out"))

    def grow(all_):
        def one(acc, g):
            return let(F.aggregate(F.slice(all_, g * GROUP + 1, F.lit(GROUP)), none(acc["x"]), step), lambda o: F.struct(o["x"].alias("x"), F.concat(acc["out"], o["out"]).alias("out")))

        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / GROUP).cast("int")), none(zero), one)["out"]

    return F.concat(F.array(zero), let(values, grow))


def whole_key(line: Column) -> Column:
    """A hash of a line's words: the exclusive-or of hashes of each with its place."""
    zero = F.lit(0).cast("long")
    return let(F.transform(F.split(line, " "), lambda w, j: F.xxhash64(w, j)), lambda h: F.aggregate(h, zero, lambda a, x: a.bitwiseXOR(x)))


def variant_keys(line: Column, n: Column) -> Column:
    """(i, swap, child) for each word i of a line, from 1: keys of the line with a gap there,
    and of the line without the word, which is whole_key() of what is left."""

    def of(h):
        own, moved = h["own"], h["moved"]  # running hashes of words at their places, and at one place less
        at = lambda c, k: F.get(c, k)
        gap = lambda i: at(own, i - 1).bitwiseXOR(at(own, n)).bitwiseXOR(at(own, i))
        left = lambda i: at(own, i - 1).bitwiseXOR(at(moved, n)).bitwiseXOR(at(moved, i))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.xxhash64(i, gap(i)).alias("swap"), left(i).alias("child")))

    hashes = lambda d: _running(F.transform(F.split(line, " "), lambda w, j: F.xxhash64(w, j - d)))
    return let(F.struct(hashes(F.lit(0)).alias("own"), hashes(F.lit(1)).alias("moved")), of)


def dropped_lines(docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, int | None, DataFrame]:
    """The documents as (doc, th, _text), the number that stands for a null id, and (doc, th, lines) with the places of lines that
    go, counted from 0, for documents that lose any; doc as numbered() has it."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows, plain, none = numbered(rows, _PLACE)
    rows = rows.withColumn("th", F.lit(0).cast("long") if plain else F.xxhash64("_text"))
    order = (F.col("doc") * _PLACE + F.col("at")) if plain else F.struct("doc", "th", "at")

    def lines_of(some: DataFrame) -> DataFrame:
        each = some.select("doc", "th", F.posexplode(F.split("_text", "\n")).alias("at", "_line"))
        each = each.where(F.btrim(F.col("_line"), F.lit(SPACES)) != "").withColumn("line", normal(F.col("_line")))
        return each.select(order.alias("o"), "doc", "th", "at", "line")

    lines = lines_of(rows).withColumn("n", _size(F.col("line")))
    keys = _halves(F.col("line"), F.col("n"))
    long_enough = F.col("n") >= least_words
    lines = lines.select("o", "doc", "th", "at", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), "n", *[F.when(long_enough, k).alias(f"k{i}") for i, k in enumerate(keys)])
    lines = written(lines, "lines")
    distinct = lines.groupBy("h1", "h2").agg(F.min("o").alias("o"), *[F.min(c).alias(c) for c in ("n", "k0", "k1", "k2", "k3")])
    distinct = written(distinct, "distinct")

    # lines that share a half with another: as equals (for a replaced word), or one of them
    # a word longer (for a missing one)
    role = lambda key, longer, half: F.struct(F.col(key).alias("key"), F.lit(longer).alias("longer"), F.lit(half).alias("half"))
    halves = distinct.where("k0 IS NOT NULL").select("o", F.inline(F.array(role("k0", 0, 0), role("k1", 0, 1), role("k2", 1, 0), role("k3", 1, 1))))
    shared = halves.groupBy("key").agg(F.sum(1 - F.col("longer")).alias("shorts"), F.sum("longer").alias("longs")).where("shorts > 1 OR (shorts > 0 AND longs > 0)")
    shared = written(shared, "halves")
    mine = halves.join(shared.hint("shuffle_merge"), "key")
    short = F.col("longer") == 0
    mine = mine.select("o", "half", (short & (F.col("shorts") > 1)).alias("swap"), (short & (F.col("longs") > 0)).alias("parent"), (~short & (F.col("shorts") > 0)).alias("child"))
    flags = mine.groupBy("o").agg(*[F.max(F.when(F.col("half") == h, F.col(c)).otherwise(False)).alias(f"{c}{h}") for c in ("swap", "child") for h in (0, 1)], F.max("parent").alias("parent"))
    flags = written(flags.where("swap0 OR swap1 OR child0 OR child1 OR parent"), "flags")
    home = flags.select((F.shiftright("o", 28) if plain else F.col("o.doc")).alias("doc")).distinct()
    texts = lines_of(by_ids(rows, written(home, "homes"), "doc")).select("o", "line").join(flags.hint("shuffle_merge"), "o").dropDuplicates(["o"])
    texts = written(texts.withColumn("n", _size(F.col("line"))), "texts")

    # variants: for a shared first half words of the second go, and the other way round
    n = F.col("n")
    first = F.floor((n - 1) / 2)
    spots = texts.where("swap0 OR swap1 OR child0 OR child1").select("o", "n", "swap0", "swap1", "child0", "child1", F.inline(variant_keys(F.col("line"), n)))
    late, early = F.col("i") > first, F.col("i") <= F.lit(1) + n - (n - 1 - first)
    on_swap, on_child = (F.col("swap0") & late) | (F.col("swap1") & early), (F.col("child0") & late) | (F.col("child1") & early)
    kind = lambda on, key, role: F.when(on, F.struct(F.col(key).alias("key"), F.lit(role).alias("role")))
    variants = spots.select("o", F.inline(F.filter(F.array(kind(on_swap, "swap", 2), kind(on_child, "child", 1)), lambda v: v.isNotNull())))
    variants = variants.unionByName(texts.where("parent").select("o", whole_key(F.col("line")).alias("key"), F.lit(0).alias("role")))
    least = variants.groupBy("key").agg(*[F.min(F.when(F.col("role") == r, F.col("o"))).alias(f"m{r}") for r in (0, 1, 2)], F.count("*").alias("n")).where("n > 1")
    near = variants.join(written(least, "variants").hint("shuffle_merge"), "key")
    near = near.select("o", F.when(F.col("role") == 2, F.col("m2")).when(F.col("role") == 1, F.col("m0")).otherwise(F.col("m1")).alias("earlier")).where("earlier < o")
    near = written(near.groupBy("o").agg(F.min("earlier").alias("earlier")), "near")
    both = near.join(texts.select("o", "line").hint("shuffle_merge"), "o").join(texts.select(F.col("o").alias("earlier"), F.col("line").alias("_first")).hint("shuffle_merge"), "earlier")
    near = both.where(one_edit(F.col("line"), F.col("_first"))).select("o", F.lit(True).alias("near"))
    known = written(distinct.select("h1", "h2", "o").join(written(near, "confirmed").hint("shuffle_merge"), "o", "left").select("h1", "h2", F.col("o").alias("first"), F.coalesce("near", F.lit(False)).alias("near")), "known")
    gone = lines.select("h1", "h2", "o", "doc", "th", "at").join(known.hint("shuffle_merge"), ["h1", "h2"]).where(F.col("near") | (F.col("o") != F.col("first")))
    # as many as the document has lines at most
    return rows, none, gone.groupBy("doc", "th").agg(F.array_sort(F.collect_set("at")).alias("lines"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped and kept, the text of the lines that stay.

    A line goes if an earlier one, in a document of a smaller id or before it in the same,
    has the same words, or is within one edit where both have `least_words` or more. All
    is judged on the documents as given. Lines without words stay. Ids are whole numbers
    of 64 bits, of which a null is the smallest; a null text is one empty line. Rows of the same id and text are one document;
    rows of one id with different texts are ordered by a hash of these. An empty table gives
    none.
    """
    rows, none, gone = dropped_lines(docs, least_words, doc_id, text)
    gone = written(gone, "gone")
    ids = written(gone.select("doc").distinct(), "ids")
    lines = F.split("_text", "\n")
    out = lambda kept, dropped: ["doc", F.size(lines).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept")]
    some = by_ids(rows, ids, "doc").join(gone.hint("shuffle_merge"), ["doc", "th"], "left")
    lost = F.coalesce("lines", F.array().cast("array<int>"))
    # what stands between the lost lines, slice by slice
    edges = F.concat(F.array(F.lit(-1)), lost, F.array(F.size(lines)))
    between = lambda l, e: F.flatten(F.transform(F.sequence(F.lit(1), F.size(e) - 1), lambda j: F.slice(l, F.get(e, j - 1) + 2, F.get(e, j) - F.get(e, j - 1) - 1)))  # noqa: E731, E741
    kept = F.array_join(let(lines, lambda l: let(edges, lambda e: between(l, e))), "\n")  # noqa: E741
    some = some.select(*out(kept, F.size(lost)))
    rest = by_ids(rows, ids, "doc", "left_anti").select(*out(F.col("_text"), F.lit(0)))
    return some.unionByName(rest).select(given_id("doc", none).alias("doc_id"), "n_lines", "n_dropped", "kept")
