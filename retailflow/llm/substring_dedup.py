"""Operator 7: removing passages that occur earlier, by repeated-phrase automata.

A window is 20 consecutive words of one document. The work is done in three steps.

1. Every window picks the least hash among its phrases of 8 words. Equal windows pick the
   same phrase, so only documents that hold a picked phrase which is picked elsewhere too
   can hold a recurring window. The others are done: a filter that loses nothing, so that
   all documents need not stream past all automata.
2. The documents are dealt into shards. Their windows whose phrase is picked elsewhere too
   are sorted by hash and place: the first place of a recurring window, and the shards in which it recurs, are
   neighbours. For each shard, recurring windows that begin at consecutive words of one
   document make a passage, with its words and its place, in pieces of bounded length: each
   window is in one piece of a shard. So a shard has no more of them than windows of its own,
   whatever the number of shards.
3. Pieces of a shard are dealt into parts of bounded size; a part compiles an Aho-Corasick
   automaton of its pieces' phrases, every 13th place a pattern, so that each window holds
   one. The shard's documents stream past each of its parts' automata; where a phrase is
   found, the words around are compared, and every run of 20 or more equal words that starts
   later than the passage is removed. A document's runs are united at the end.

A task holds one automaton and one batch of documents, whatever a shard's size. All
decisions are by the documents as given. Windows are told apart by 64-bit hashes in the
steps before, and by each of their words in step 3, where words are 64-bit hashes too.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Piece, argmin_windows, by_ids, given_id, numbered, pieces, prepare, small, written

WINDOW, PHRASE = 20, 8
STEP = WINDOW - PHRASE + 1
#: Words beside a phrase that a window which holds it can reach.
REACH = WINDOW - PHRASE
#: Words of a shard's documents on average, and of the pieces in one part of a shard's.
SHARD_WORDS, PART_WORDS = 2_000_000, 1_000_000
#: Windows of a piece of a passage at most.
PIECE_WINDOWS = 256
#: Words to a letter, when words are written as two letters each.
LETTERS = 512
#: Places of found phrases that are compared at once.
HITS = 100_000
#: Windows whose places are counted at once.
COUNTED = 1 << 20
_SALT, _PLACE = 0x7E57, 1 << 28


def _picked(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all phrases by place; the words at which windows begin, and the place of
    the phrase that each window picks."""
    n = len(piece.h)
    if n < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own, at = piece.windows(PHRASE, _SALT)
    phrases = np.full(n - PHRASE + 1, np.iinfo(np.uint64).max, np.uint64)
    phrases[at] = own
    begin = np.flatnonzero(piece.doc[: n - WINDOW + 1] == piece.doc[WINDOW - 1 :])
    return phrases, begin, argmin_windows(phrases, STEP)[begin]


def _changes(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def _phrase_counts(batches):
    import pyarrow as pa

    for batch in batches:
        found = [phrases[_changes(place)] for piece in pieces(batch.column("_text")) for phrases, _, place in [_picked(piece)]]
        if found:
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], names=["phrase", "n"])


def _phrases_by_doc(batches):
    import pyarrow as pa

    for batch in batches:
        for piece in pieces(batch.column("_text")):
            phrases, _, place = _picked(piece)
            place = _changes(place)
            h, doc = phrases[place], piece.doc[place]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            rows = pa.array(doc[new] + piece.first)
            yield pa.RecordBatch.from_arrays([pa.array(h[new].astype(np.int64)), batch.column("doc").take(rows), batch.column("th").take(rows)], names=["phrase", "doc", "th"])


def _counted(found, doc: np.ndarray, th: np.ndarray, shard: np.ndarray):
    """Windows by hash, for each shard with their first place in these documents and the number
    of places. So a window that every document has gives few rows."""
    import pyarrow as pa

    h, row, place = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(h, kind="stable")
    h, row, place = h[order], row[order], place[order]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    many, keep, n = np.flatnonzero(same[1:] | same[:-1]), np.ones(len(h), bool), np.ones(len(h), np.int64)
    if len(many):
        r = row[many]
        many = many[np.lexsort((place[many], th[r], doc[r], shard[r], h[many]))]
        x, y = h[many], shard[row[many]]
        new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        keep[many[~new]] = False
        n[many[new]] = np.diff(np.append(np.flatnonzero(new), len(many)))
    h, row, place, n = h[keep], row[keep], place[keep], n[keep]
    return pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(doc[row]), pa.array(th[row]), pa.array(place.astype(np.int32)), pa.array(shard[row]), pa.array(n)], names=["window", "doc", "th", "place", "shard", "n"])


def _windows(batches):
    for batch in batches:
        own, repeated = [batch.column(c).to_numpy() for c in ("doc", "th", "shard")], batch.column("repeated")
        found, size = [], 0
        for piece in pieces(batch.column("_text")):
            h, at = piece.windows(WINDOW, _SALT)
            if not len(h):
                continue
            phrases, _, place = _picked(piece)
            known = np.unique(repeated[piece.first : piece.first + piece.n].flatten().to_numpy().view(np.uint64))
            again = np.isin(phrases[place], known)
            h, at = h[again], at[again]
            found.append((h, piece.doc[at] + piece.first, at - piece.first_word[piece.doc[at]]))
            size += len(h)
            if size >= COUNTED:
                yield _counted(found, *own)
                found, size = [], 0
        if size:
            yield _counted(found, *own)


def _recurring(batches):
    """Of rows ordered by window and place: the first place of each window that has others, with
    the shards that have these. A start is the shard and, below it, the place."""
    import pyarrow as pa

    first = None  # the row of the window at hand
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("window", "doc", "th", "place", "shard", "n")]
        if first is not None:
            cols = [np.append(x, c) for x, c in zip(first, cols, strict=True)]
        window, doc, th, place, shard, n = cols
        new = np.append(True, window[1:] != window[:-1])
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        others = np.flatnonzero(~new | (n > 1))
        found = np.unique(begin[others] << 32 | shard[others])
        if len(found):
            i, k = found >> 32, found & 0xFFFFFFFF
            at = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(i)).astype(np.int32)), pa.array(k << 32 | place[i]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[i[at]]), pa.array(th[i[at]]), lists], names=["doc", "th", "starts"])
        at = begin[-1]
        first = [window[at], doc[at], th[at], place[at], shard[at], 1]  # its other places in the shard are told


def _passages(windows: int):
    """Pieces of the passages that begin at `starts`, for each shard."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            shard, doc, th, place, words, n = [], [], [], [], [], []
            docs, ths, starts = (batch.column(c) for c in ("doc", "th", "starts"))
            for piece in pieces(batch.column("_text")):
                for d in range(piece.n):
                    first, row = int(piece.first_word[d]), piece.first + d
                    p = np.unique(starts[row].values.to_numpy())
                    # a piece ends where windows aren't consecutive, or are too many
                    run_start = np.flatnonzero(np.append(True, np.diff(p) > 1))
                    k = np.arange(len(p)) - run_start[np.searchsorted(run_start, np.arange(len(p)), "right") - 1]
                    edges = np.append(np.flatnonzero(k % windows == 0), len(p))
                    which, p = p >> 32, p & 0xFFFFFFFF
                    for s, x, y in zip(which[edges[:-1]].tolist(), p[edges[:-1]].tolist(), p[edges[1:] - 1].tolist(), strict=True):
                        raw = piece.data[piece.begin[first + x] : piece.end[first + y + WINDOW - 1]].tobytes()
                        shard.append(s)
                        doc.append(docs[row].as_py())
                        th.append(ths[row].as_py())
                        place.append(x)
                        words.append(b" ".join(raw.split()))
                        n.append(y - x + WINDOW)
                    if len(words) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((shard, doc, th, place, words, n), kinds.values(), strict=True)], names=list(kinds))
                        shard, doc, th, place, words, n = [], [], [], [], [], []
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((shard, doc, th, place, words, n), kinds.values(), strict=True)], names=list(kinds))

    kinds = {"shard": pa.int32(), "doc": pa.int64(), "th": pa.int64(), "place": pa.int32(), "words": pa.binary(), "n": pa.int32()}
    return run


def letters(ids: np.ndarray) -> str:
    """Word numbers as two letters each, of different halves of an alphabet. The automaton
    searches a node's children one by one: so no node has more than a few hundred."""
    out = np.empty((len(ids), 2), "<u4")
    out[:, 0], out[:, 1] = ids // LETTERS + LETTERS, ids % LETTERS
    out[out >= 0xD800] += 0x800  # past the surrogates
    return out.tobytes().decode("utf-32-le")


def compile_phrases(flat: np.ndarray, begin: np.ndarray, length: np.ndarray):
    """An automaton over word numbers that finds a phrase at every 13th place of the passages,
    which stand in flat; and for each phrase's number its places: (first, count, place, passage)."""
    import ahocorasick

    number = np.maximum(0, (length - PHRASE) // STEP + 1)
    passage = np.repeat(np.arange(len(begin)), number)
    k = np.arange(len(passage)) - np.repeat(np.cumsum(number) - number, number)
    place = begin[passage] + k * STEP
    machine, found, size = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}, 2 * PHRASE
    every = letters(flat[place[:, None] + np.arange(PHRASE)].ravel())
    which = np.fromiter((found.setdefault(every[i : i + size], len(found)) for i in range(0, len(every), size)), np.int64, len(place))
    for phrase, i in found.items():
        machine.add_word(phrase, i)
    machine.make_automaton()
    order = np.argsort(which, kind="stable")
    count = np.bincount(which, minlength=len(found))
    return machine, np.cumsum(count) - count, count, place[order], passage[order]


def _agree(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
    """How many words of x from i on equal those of y from j on, REACH at most."""
    n, on = np.zeros(len(i), np.int64), np.arange(len(i))
    for k in range(REACH):
        on = on[x[i[on] + k * step] == y[j[on] + k * step]]
        if not len(on):
            break
        n[on] += 1
    return n


class Automaton:
    """Some pieces of passages, ready to be found: their words as numbers from 1, and the
    compiled phrases. doc, th and place say where each piece was first."""

    def __init__(self, words, doc: np.ndarray, th: np.ndarray, place: np.ndarray):
        own = list(pieces(words))
        self.known, numbers = np.unique(np.concatenate([p.h for p in own]), return_inverse=True)
        length = np.concatenate([p.counts for p in own])
        self.begin = REACH + np.cumsum(length + REACH) - length - REACH
        self.flat = np.zeros(int(self.begin[-1] + length[-1]) + REACH, np.int64)
        self.flat[np.arange(len(numbers)) + np.repeat(self.begin - (np.cumsum(length) - length), length)] = numbers + 1
        self.doc, self.th, self.place = doc, th, place
        self.machine, self.first, self.count, self.at, self.passage = compile_phrases(self.flat, self.begin, length)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The numbers of words by hash, 0 for those that no piece has."""
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.where(self.known[at] == h, at + 1, 0)

    def gone(self, piece: Piece, doc: np.ndarray, th: np.ndarray) -> np.ndarray:
        """Whether each word of a piece of text goes; doc and th name its documents.

        A window has a compiled phrase, so these are the windows around the phrases found,
        at most REACH words to either side of one. Documents stand apart by REACH places.
        """
        ids = self.numbers(piece.h)
        at = np.arange(len(ids)) + REACH * (piece.doc + 1)
        spaced = np.zeros(len(ids) + REACH * (piece.n + 1), np.int64)
        spaced[at] = ids
        own, edge = np.where(spaced > 0, spaced, -1), np.zeros(len(spaced) + 1, np.int64)
        home = np.zeros(len(spaced), np.int64)
        home[at] = piece.doc
        first = piece.first_word[:-1] + REACH * (np.arange(piece.n) + 1)
        found = np.array(list(self.machine.iter(letters(spaced))), np.int64).reshape(-1, 2)
        found[:, 0] //= 2
        hits = np.cumsum(self.count[found[:, 1]])
        cuts = np.append(0, np.searchsorted(hits, np.arange(HITS, (hits[-1] if len(hits) else 0) + HITS, HITS), "right"))
        cuts[-1] = len(found)
        for i, j in zip(cuts, cuts[1:], strict=False):
            n = self.count[found[i:j, 1]]
            k = np.arange(n.sum()) + np.repeat(self.first[found[i:j, 1]] - (np.cumsum(n) - n), n)
            x, y, p = np.repeat(found[i:j, 0] - PHRASE + 1, n), self.at[k], self.passage[k]
            d = home[x]
            # not the passage itself
            new = (self.doc[p] != doc[d]) | (self.th[p] != th[d]) | (x - first[d] - (y - self.begin[p]) != self.place[p])
            x, y = x[new], y[new]
            left = _agree(own, x - 1, self.flat, y - 1, -1)
            right = _agree(own, x + PHRASE, self.flat, y + PHRASE, 1)
            go = left + PHRASE + right >= WINDOW
            edge += np.bincount((x - left)[go], minlength=len(edge)) - np.bincount((x + PHRASE + right)[go], minlength=len(edge))
        return (np.cumsum(edge[:-1]) > 0)[at]


def _runs(gone: np.ndarray, piece: Piece):
    """(texts, list array): begins and ends, one after the other, of each text's runs of words
    that go, for the texts that have any."""
    import pyarrow as pa

    first = np.zeros(len(gone) + 1, bool)
    first[piece.first_word] = True
    begin = np.flatnonzero(gone & np.append(True, ~gone[:-1] | first[1:-1]))
    end = np.flatnonzero(gone & np.append(~gone[1:] | first[1:-1], True)) + 1
    text, number = np.unique(piece.doc[begin], return_counts=True)
    both = np.stack([begin, end], 1) - np.repeat(piece.first_word[text], number)[:, None]
    return text, pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(2 * number)).astype(np.int32)), pa.array(both.ravel().astype(np.int32)))


def _streamed(batches):
    """Rows ordered by shard and part, in each the pieces (kind 0) before the documents: for
    each document that has any the runs of words that go."""
    import pyarrow as pa

    key, waiting, machine = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        what = np.stack([batch.column(c).to_numpy() for c in ("shard", "part", "kind")], 1)
        edges = np.append(np.flatnonzero(np.append(True, (what[1:] != what[:-1]).any(1))), len(what))
        for i, j in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            if (now := tuple(what[i, :2].tolist())) != key:
                key, waiting, machine = now, [], None
            rows = batch.slice(i, j - i)
            if what[i, 2] == 0:
                waiting.append(pa.RecordBatch.from_arrays([pa.concat_arrays([rows.column(c)]) for c in ("words", "doc", "th", "place")], names=["words", "doc", "th", "place"]))
                continue
            if machine is None:
                if not waiting:
                    continue
                all_ = pa.Table.from_batches(waiting)
                machine, waiting = Automaton(all_["words"], *(all_[c].to_numpy() for c in ("doc", "th", "place"))), []
            for piece in pieces(rows.column("words")):
                own = slice(piece.first, piece.first + piece.n)
                doc, th = (rows.column(c).to_numpy()[own] for c in ("doc", "th"))
                gone = machine.gone(piece, doc, th)
                if gone.any():
                    text, runs = _runs(gone, piece)
                    yield pa.RecordBatch.from_arrays([pa.array(doc[text]), pa.array(th[text]), runs], names=["doc", "th", "runs"])


def _left(batches):
    """What stays of each text less its runs, which may overlap."""
    import pyarrow as pa

    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            size, lost, kept = [], [], []
            for text, runs in zip(part.column("_text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                words = (text or "").encode().split()
                size.append(len(words))
                if runs:
                    r, edge = np.asarray(runs, np.int64).reshape(-1, 2), np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, r[:, 0], 1)
                    np.add.at(edge, r[:, 1], -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                lost.append(size[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=["doc", "n_words", "n_removed", "kept"])


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS, part_words: int = PART_WORDS, piece_windows: int = PIECE_WINDOWS
) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay joined by one space.

    Words are runs of anything but ASCII white space. Earlier means a smaller id, or an
    earlier start in the same document. Ids are whole numbers of 64 bits, of which a null is
    the smallest. Rows of the same id and
    text are one document and get the same result; rows of one id with different texts are
    different documents, ordered by a hash of their texts. Texts under 20 words, empty and
    null ones lose nothing. An empty table gives none.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("_text"))
    # with one row for each id, and ids that leave room for a place, one long orders windows
    rows, plain, none = numbered(rows, _PLACE)
    rows = rows.withColumn("th", F.lit(0).cast("long") if plain else F.xxhash64("_text"))

    counts = rows.mapInArrow(_phrase_counts, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n"))
    repeated = written(counts.where("n > 1").select("phrase"), "phrases")
    spots = rows.mapInArrow(_phrases_by_doc, "phrase long, doc long, th long").join(repeated.hint("shuffle_merge"), "phrase", "left_semi")
    lists = written(spots.groupBy("doc", "th").agg(F.collect_list("phrase").alias("repeated")), "lists")
    some = written(lists.select("doc").distinct(), "some")
    # where few ids spare it, not all texts are dealt out
    held = (rows.join(F.broadcast(some), "doc", "left_semi") if small(some) else rows).hint("shuffle_merge").join(lists, ["doc", "th"])
    held = written(held if plain else held.dropDuplicates(["doc", "th"]), "held")

    size = held.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    shards = max(1, round(size / 6 / shard_words))
    shard = F.pmod(F.xxhash64("doc", "th"), F.lit(shards)).cast("int")
    windows = held.withColumn("shard", shard).mapInArrow(_windows, "window long, doc long, th long, place int, shard int, n long")
    windows = windows.repartition("window").sortWithinPartitions("window", "doc", "th", "place")
    starts = windows.mapInArrow(_recurring, "doc long, th long, starts array<long>").groupBy("doc", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    passages = held.select("doc", "th", "_text").join(starts.hint("shuffle_merge"), ["doc", "th"]).mapInArrow(_passages(piece_windows), "shard int, doc long, th long, place int, words binary, n int")
    passages = written(passages, "passages")
    # a row for each shard: Spark broadcasts it if it is small as written
    parts = written(passages.groupBy("shard").agg(F.ceil(F.sum("n") / part_words).cast("int").alias("parts")), "parts")
    some_pieces = passages.join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc", "th", "place"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "doc", "th", "place", "words")
    streams = held.withColumn("shard", shard).join(parts, "shard")
    streams = streams.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "doc", "th", F.lit(0).alias("place"), F.col("_text").cast("binary").alias("words"))
    ordered = some_pieces.unionByName(streams).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind")
    runs = ordered.mapInArrow(_streamed, "doc long, th long, runs array<int>").groupBy("doc", "th").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    done = (held if plain else by_ids(rows, some, "doc")).join(written(runs, "runs").hint("shuffle_merge"), ["doc", "th"], "left").select("doc", "_text", "runs")
    rest = by_ids(rows, some, "doc", "left_anti").select("doc", "_text", F.array().cast("array<int>").alias("runs"))
    done = done.unionByName(rest).mapInArrow(_left, "doc long, n_words long, n_removed long, kept string")
    return done.select(given_id("doc", none).alias("doc_id"), "n_words", "n_removed", "kept")
