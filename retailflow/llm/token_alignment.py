"""Operator 13: the tokens of two tokenizers on the same texts, aligned by byte ranges.

The B tokens of a text are a static index of intervals: their starts and ends in order. Each
A token stabs it by two bisections, which give the first and last B token that it overlaps.
A gap between A tokens that no B token spans, and that lies in no A token, is where both end:
there a group ends. Within a group every A token is linked with every B token.

Texts are encoded and aligned where they are read. Of each document only its different id
pairs go on, with how often they are linked. How many documents hold a pair is counted in
the tasks and then over all. The counts of the most frequent pairs are looked up in a table
of bounded size; the others, each held by few documents, by a join.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BYTE, _IS_SPACE, _power, mix, prepare, raw_pieces, written
from .units import _UNSURE, IdCache, Units

#: Pairs of the broadcast table at most, of 16 bytes each.
TABLE_PAIRS = 1 << 19
#: Links of a group that are made one by one at most; of more, by its different ids.
GROUP_LINKS = 1024
#: Different pairs that a counting task holds before it sends them on.
HELD_PAIRS = 1 << 20
#: Parts of an octave of counts, by which the table's least count is found.
STEPS = 8


class BlankUnits(Units):
    """Units of texts that begin with a blank: each from a blank behind something else on."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = data
        power, inverse = _power(len(data) + 1)
        starts = np.zeros(len(data) + 1, bool)
        starts[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        starts[at] = True
        starts[len(data)] = False
        self.begin = np.flatnonzero(starts)
        self.end = np.append(self.begin[1:], len(data)) if len(self.begin) else self.begin
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
        self.h = mix((total[self.end] - total[self.begin]) * inverse[self.begin], 0x2545F491)
        self.counts = np.diff(np.searchsorted(self.begin, at))


class PieceCache(IdCache):
    """Ids of the sentencepiece library: it puts a blank before what it encodes, so a unit goes without its first."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.blank = self.library.piece_to_id("▁")
        super().__init__("")

    def _encode(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units = [data[b + 1 : e].tobytes().decode("utf-8", "replace") for b, e in zip(begin.tolist(), end.tolist(), strict=True)]
        # a unit of one blank stands behind other text; an empty text would have no piece
        got = [ids if u else [self.blank] for u, ids in zip(units, self.library.encode(units, num_threads=1), strict=True)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)


class TokenBytes:
    """The bytes of each id of a vocabulary, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        ends = np.cumsum(n)
        return self.data[np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(self.first[ids] - (ends - n), n)]


def byte_level_tokens(json_text: str) -> list[bytes]:
    from .bpe_codec import byte_letters

    value = {c: b for b, c in enumerate(byte_letters())}
    vocab = json.loads(json_text)["model"]["vocab"]
    out = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        out[i] = bytes(value[c] for c in t)
    return out


def piece_tokens(library) -> list[bytes]:
    """A piece in UTF-8, with blanks for their marks; <0xHH> is a byte."""
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]


def plain_tokenizer(json_text: str) -> str:
    """The file without its special tokens: their strings in a text are then plain text."""
    file = json.loads(json_text)
    file["added_tokens"] = []
    return json.dumps(file, ensure_ascii=False)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Where a long text may be cut: at a blank between letters, where tokens of both kinds begin."""
    return np.flatnonzero((data[1:-1] == 32) & ~_IS_SPACE[data[:-2]] & ~_UNSURE[data[2:]]) + 1


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of each group among the A tokens and among the B tokens.

    Tokens of either kind lie end to end over the same bytes. The B tokens are the index;
    each A token lists those from `low` to `high`.
    """
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    low = np.searchsorted(b_ends, a_starts, "right")
    high = np.searchsorted(b_starts, a_ends, "left") - 1
    spanned = high[:-1] >= low[1:]  # a B token overlaps both sides of the gap
    last = np.append(np.flatnonzero(~spanned), len(a_ends) - 1)
    return last + 1, high[last] + 1


class Aligner:
    """What a worker keeps: both tokenizers, their caches and texts of ids."""

    def __init__(self, a_json: str, b_model: bytes):
        self.a, self.b = IdCache(plain_tokenizer(a_json)), PieceCache(b_model)
        self.a_bytes, self.b_bytes = TokenBytes(byte_level_tokens(a_json)), TokenBytes(piece_tokens(self.b.library))
        # ids with what follows them: within a group, at its A tokens' end, at its own end
        self.a_text, self.b_text = (np.array([[f"{i}{mark}" for i in range(len(t.length))] for mark in ",|;"], object) for t in (self.a_bytes, self.b_bytes))

    def align(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For some texts with a blank before: n_a, n_b, n_groups, n_links and whether they are
        sound, as rows; their groups as strings; and text, pair and times of their id pairs."""
        n = len(at) - 1
        size = np.diff(at)
        a, b, lengths = {}, {}, {}
        for own, cache, units in ((a, self.a, Units), (b, self.b, BlankUnits)):
            u = units(data, at)
            own["ids"], per_unit = cache.ids_of(u)
            edge = np.append(0, np.cumsum(u.counts))
            own["n"] = np.diff(np.append(0, np.cumsum(per_unit))[edge])
        sound = size > 0
        for own, table in ((a, self.a_bytes), (b, self.b_bytes)):
            lengths[id(own)] = table.length[own["ids"]]
            edge = np.append(0, np.cumsum(own["n"]))
            own["size"] = np.diff(np.append(0, np.cumsum(lengths[id(own)]))[edge])
            sound &= own["size"] == size
        for own, table in ((a, self.a_bytes), (b, self.b_bytes)):
            kept = np.repeat(sound, own["n"])
            made, real = table.of(own["ids"][kept]), data[np.repeat(sound, size)]
            differ = np.flatnonzero(made != real)
            if len(differ):
                own["differ"] = np.unique(np.searchsorted(np.cumsum(size[sound]), differ, "right"))
        for own in (a, b):
            if "differ" in own:
                own["differ"] = np.flatnonzero(sound)[own["differ"]]
        for own in (a, b):
            if "differ" in own:
                sound[own["differ"]] = False
        for own in (a, b):
            kept = np.repeat(sound, own["n"])
            own["ids"], own["ends"], own["n"] = own["ids"][kept].astype(np.int64), np.cumsum(lengths[id(own)][kept]), np.where(sound, own["n"], 0)
        a_end, b_end = groups(a["ends"], b["ends"])
        a_n, b_n = np.diff(a_end, prepend=0), np.diff(b_end, prepend=0)
        text = np.searchsorted(np.cumsum(a["n"]), a_end - 1, "right")  # of each group
        links = np.zeros(n, np.int64)
        np.add.at(links, text, a_n * b_n)
        facts = np.stack([a["n"], b["n"], np.bincount(text, minlength=n), links, sound.astype(np.int64)])
        return facts, self._strings(a, b, a_end, b_end, a_n, b_n), *self._pairs(a["ids"], b["ids"], a_end, b_end, a_n, b_n, text)

    def _strings(self, a, b, a_end, b_end, a_n, b_n) -> list[str]:
        mark_a, mark_b = np.zeros(len(a["ids"]), np.int64), np.zeros(len(b["ids"]), np.int64)
        mark_a[a_end - 1], mark_b[b_end - 1] = 1, 2
        out = np.empty(len(mark_a) + len(mark_b), object)
        out[np.arange(len(mark_a)) + np.repeat(b_end - b_n, a_n)] = self.a_text[mark_a, a["ids"]]
        out[np.arange(len(mark_b)) + np.repeat(a_end, b_n)] = self.b_text[mark_b, b["ids"]]
        edge = np.append(0, np.cumsum(a["n"] + b["n"])).tolist()
        return ["".join(out[i:j].tolist())[:-1] for i, j in zip(edge, edge[1:], strict=False)]

    @staticmethod
    def _pairs(a_ids, b_ids, a_end, b_end, a_n, b_n, text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, pair and times, in order of text and pair."""
        few = np.flatnonzero(a_n * b_n <= GROUP_LINKS)
        n = a_n[few] * b_n[few]
        ends = np.cumsum(n)
        k = np.arange(int(ends[-1]) if len(n) else 0) - np.repeat(ends - n, n)
        width = np.repeat(b_n[few], n)
        left = a_ids[np.repeat((a_end - a_n)[few], n) + k // np.maximum(width, 1)]
        right = b_ids[np.repeat((b_end - b_n)[few], n) + k % np.maximum(width, 1)]
        found = [(np.repeat(text[few], n), left << 32 | right, np.ones(len(k), np.int64))]
        for g in np.flatnonzero(a_n * b_n > GROUP_LINKS).tolist():
            u, m = np.unique(a_ids[a_end[g] - a_n[g] : a_end[g]], return_counts=True)
            v, w = np.unique(b_ids[b_end[g] - b_n[g] : b_end[g]], return_counts=True)
            found.append((np.full(len(u) * len(v), text[g]), (u[:, None] << 32 | v).ravel(), (m[:, None] * w).ravel()))
        return merged(*(np.concatenate(x) for x in zip(*found, strict=True)))


def merged(text: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of a text as one, with the sum of their times."""
    if not len(pair):
        return text, pair, times
    order = np.lexsort((pair, text))
    text, pair, times = text[order], pair[order], times[order]
    new = np.append(True, (text[1:] != text[:-1]) | (pair[1:] != pair[:-1]))
    first = np.flatnonzero(new)
    return text[first], pair[first], np.add.reduceat(times, first)


_aligners: dict[int, Aligner] = {}


def _aligner(shared) -> Aligner:
    if shared.id not in _aligners:
        _aligners.clear()
        _aligners[shared.id] = Aligner(*shared.value)
    return _aligners[shared.id]


class _Shared:
    """A broadcast with a name that stays the same in all tasks of a worker."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self):
        return self.broadcast.value


def _blank_before(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a blank before each that isn't empty."""
    data, at = data[at[0] : at[-1]], (at - at[0]).astype(np.int64)
    some = np.diff(at) > 0
    return np.insert(data, at[:-1][some], 32), at + np.append(0, np.cumsum(some))


def align(docs: DataFrame, a_file: str, b_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_a, n_b, n_groups, n_links, groups, pairs and times of every row.

    a_file is a byte-level file of the tokenizers library, which encodes a blank and the
    text; b_file a model of sentencepiece, which puts that blank before itself. Special
    strings in a text are plain text. `groups` lists the ids of each group as
    "a1,a2|b1;a3|b2,b3". `pairs` are the different linked ids, A's in the upper and B's in
    the lower 32 bits of a long, in order; `times` says how often each is linked.

    A null or empty text, and one whose bytes the tokens of either side don't give back, has
    no tokens: zeros, an empty string and empty arrays. Null ids, repeated rows and further
    columns change nothing: each row gives one row. An empty table gives none. A kept name
    that clashes with an output raises ValueError.
    """
    import pyarrow as pa

    outputs = ("n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")
    if clash := set(outputs) & set(keep):
        raise ValueError(f"kept columns clash with outputs: {sorted(clash)}")
    spark = docs.sparkSession
    prepare(spark)
    shared = _Shared(spark, (Path(a_file).read_text(encoding="utf-8"), Path(b_file).read_bytes()))
    rows = docs.select(*keep, F.col(text).alias("_" * (1 + max(map(len, [*keep, ""]))) + "text"))
    own, fields = rows.columns[-1], rows.schema.fields[:-1]
    longs = T.ArrayType(T.LongType())
    kinds = dict(groups=T.StringType(), pairs=longs, times=longs)
    schema = T.StructType([*fields, *(T.StructField(o, kinds.get(o, T.LongType())) for o in outputs)])

    def lists(values, counts):
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values))

    def block(batch, first, facts, strings, which, pair, times):
        n = facts.shape[1]
        counts = np.bincount(which, minlength=n)
        arrays = [*(batch.column(f.name).slice(first, n) for f in fields), *map(pa.array, facts[:4]), pa.array(strings, pa.string()), lists(pair, counts), lists(times, counts)]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def whole(parts):
        """One text from its parts, each as align() gives them."""
        facts = np.sum([p[0] for p in parts], axis=0)
        if not all(p[0][4, 0] for p in parts):
            return np.zeros_like(facts), [""], *(np.zeros(0, np.int64) for _ in range(3))
        return facts, [";".join(p[1][0] for p in parts)], *merged(*(np.concatenate([p[k] for p in parts]) for k in (2, 3, 4)))

    def run(batches):
        aligner = _aligner(shared)
        for batch in batches:
            held, last = [], -1  # parts of one long text
            for data, at, first in raw_pieces(batch.column(own), cut_places):
                if first == last:  # goes on with a blank of its own
                    held.append(aligner.align(data[at[0] : at[-1]], at - at[0]))
                    continue
                if held:
                    yield block(batch, last, *whole(held))
                held, last = [], first
                found = aligner.align(*_blank_before(data, at))
                if len(at) == 2:
                    held = [found]
                else:
                    yield block(batch, first, *found)
            if held:
                yield block(batch, last, *whole(held))

    return rows.mapInArrow(run, schema)


def _counted(batches):
    """How many documents of a task hold each pair."""
    import pyarrow as pa

    def out(pair, n):
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        more = np.sort(batch.column("pairs").flatten().to_numpy(zero_copy_only=False))
        if not len(more):
            continue
        first = np.flatnonzero(np.append(True, more[1:] != more[:-1]))
        both = np.concatenate([pair, more[first]])
        _, pair, n = merged(np.zeros(len(both), np.int8), both, np.concatenate([n, np.diff(np.append(first, len(more)))]))
        if len(pair) > HELD_PAIRS:
            yield out(pair, n)
            pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield out(pair, n)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n and best of each linked pair of ids: how many rows hold it, and whether no
    other pair of its A id has a higher number. One row of maxima for each A id, of which
    there are as many as the vocabulary has at most, is broadcast."""
    counts = aligned.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("a", F.shiftright("pair", 32)), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return written(counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _least_count(counts: DataFrame, most: int) -> int:
    """The least n such that about `most` pairs at most have it or more."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    total, least = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        total += r.k
        if total > most:
            break
        least = r.n
    return least if least is not None else 1 << 62


def link_facts(aligned: DataFrame, counts: DataFrame, row: str, entries: int = TABLE_PAIRS) -> DataFrame:
    """row, n_best and count_sum of every row of `aligned`, whose column `row` tells rows apart:
    the links whose pair is the best of its A id, and the sum over links of their pair's count."""
    import pyarrow as pa

    spark = aligned.sparkSession
    least = _least_count(counts, entries)
    top = counts.where(F.col("n") >= least).select("pair", F.when(F.col("best"), -F.col("n")).otherwise(F.col("n")).alias("n")).toArrow()
    pair, n = (top.column(k).to_numpy() for k in ("pair", "n"))
    order = np.argsort(pair)
    shared = spark.sparkContext.broadcast((pair[order], n[order]))

    def run(batches):
        keys, n = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            pair, times = (batch.column(k).flatten().to_numpy() for k in ("pairs", "times"))
            text = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            value = np.where(hit, n[at] if len(n) else 0, 0)
            best, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(total, text, times * np.abs(value))
            np.add.at(best, text, np.where(value < 0, times, 0))
            rest = np.append(0, np.cumsum(np.bincount(text[~hit], minlength=len(size)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~hit])) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([batch.column(row), pa.array(best), pa.array(total), *lists], names=[row, "n_best", "count_sum", "pairs", "times"])

    schema = f"`{row}` long, n_best long, count_sum long, pairs array<long>, times array<long>"
    looked = written(aligned.select(row, "pairs", "times").mapInArrow(run, schema), "links")
    rare = looked.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(row, "x.pairs", "x.times")
    rare = rare.withColumnRenamed("pairs", "pair").join(counts.where(F.col("n") < least).hint("shuffle_merge"), "pair")
    rare = rare.select(row, F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    both = looked.select(row, "n_best", "count_sum").unionByName(rare)
    return both.groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digest(docs: DataFrame, a_file: str, b_file: str, text: str = "text", doc_id: str = "doc_id", entries: int = TABLE_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = align(rows, a_file, b_file, keep=("row", "doc_id"))
    hashed = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    found = written(found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", hashed, "pairs", "times"), "aligned")
    facts = link_facts(found, pair_counts(found), "row", entries)
    out = found.drop("pairs", "times").join(facts.hint("shuffle_merge"), "row")
    return out.select(F.col("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
