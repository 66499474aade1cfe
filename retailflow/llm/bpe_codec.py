"""Operator 11: byte-pair encoding and decoding by contiguous rank arrays.

A short word is a row of part ids and, beside it, of the ranks of its adjacent pairs. The
least rank is found by a scan, the boundary in its pair is deleted by moving what follows
one place to the left, and only the two neighbouring ranks are looked up anew; until no
pair of the word can merge. Rows of many words go through these steps together, so a step
is a few array operations. Words of more than WIDE parts, of which a scan for each merge
would take quadratic time, keep their pairs in a heap instead.

A worker meets a word once: it remembers the ids of those it has met. Texts are worked on
where they are read; nothing is shuffled and nothing but the tokenizer's file is broadcast.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, raw_pieces
from .units import unit_places

#: Parts of a word that is a row of an array at most, and the widths that words are sorted in.
WIDE = 64
WIDTHS = (4, 8, 12, 16, 24, 32, 48, WIDE)
#: Places of one array at most, and words that a worker remembers; then it starts afresh.
PLACES, CACHE_WORDS = 1 << 18, 150_000
#: Ids of an Arrow batch that is sent back, about.
BATCH_IDS = 1 << 18

#: Fixed value: how the byte-level files split a text if they name no pattern of their own.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Below this letter, the first that Unicode leaves open, a text needs no look at newer ones.
_WIDE_LETTERS = re.compile("[\u0378-\U0010ffff]")
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that byte-level files write for each byte: itself where it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@functools.cache
def unassigned() -> re.Pattern:
    """The code points that Python's Unicode tables leave open, as a pattern."""
    open_ = np.array([unicodedata.category(chr(i)) == "Cn" for i in range(sys.maxunicode + 1)])
    edge = np.flatnonzero(np.diff(open_, prepend=False, append=False)).tolist()
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2], edge[1::2], strict=True)) + "]")


class Decoder:
    """What each id of a file stands for. Texts of bytes are joined as they are, others by blanks."""

    def __init__(self, file: dict):
        kind = (file.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"unknown decoder: {kind}")
        self.bytes_out = kind == "ByteLevel"
        value = {c: b for b, c in enumerate(byte_letters())}
        tokens = {i: t for t, i in file["model"]["vocab"].items()}
        if self.bytes_out:
            tokens = {i: bytes(value[c] for c in t) for i, t in tokens.items()}
        for t in file["added_tokens"]:
            tokens[t["id"]] = t["content"].encode() if self.bytes_out else t["content"]
        self.known = np.zeros(max(tokens) + 1, bool)
        self.known[list(tokens)] = True
        self.pieces = [tokens.get(i) for i in range(len(self.known))]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; ids that the file has not are left out."""
        ids = ids[(ids >= 0) & (ids < len(self.known))]
        pieces = map(self.pieces.__getitem__, ids[self.known[ids]].tolist())
        return b"".join(pieces).decode("utf-8", "replace") if self.bytes_out else " ".join(pieces)


class Codec:
    """A tokenizer file of the kinds that this operator knows: byte-level pairs, with a
    pattern that splits texts, and with or without normalisation and a mark of word ends."""

    def __init__(self, json_text: str):
        import regex

        file = json.loads(json_text)
        model = file["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        unknown = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or unknown:
            raise ValueError(f"not a plain byte-pair model: {unknown or model.get('type')}")
        self.nfc, self.lower = self._normalizer(file.get("normalizer"))
        self.pattern = regex.compile(self._pattern(file["pre_tokenizer"]))
        vocab, self.letters = model["vocab"], byte_letters()
        self.json_text, self.library = json_text, None
        self.specials = {}
        for t in file["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError(f"unknown kind of added token: {t['content']}")
            self.specials[t["content"]] = t["id"]
        names = sorted(self.specials, key=lambda s: (-len(s), s))
        self.special = regex.compile("|".join(regex.escape(s) for s in names)) if names else None
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        left, right, made = (np.array([p[k] for p in pairs], np.int64) for k in range(3))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made.astype(np.int32)
        self.plain = np.array([vocab[c] for c in self.letters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in self.letters], np.int32)
        self.forget()

    def __getstate__(self):
        """Without what a worker remembers."""
        return {k: v for k, v in self.__dict__.items() if k not in ("slot", "pool", "used", "first", "length", "library")}

    def __setstate__(self, state):
        self.__dict__.update(state, library=None)
        self.forget()

    @staticmethod
    def _normalizer(said) -> tuple[bool, bool]:
        steps = [] if said is None else said["normalizers"] if said["type"] == "Sequence" else [said]
        for s in steps:
            # runs of white space made one blank: white space is dropped before the pairs
            if s["type"] not in ("NFC", "Lowercase") and not (s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " "):
                raise ValueError(f"unknown normalizer: {s}")
        kinds = [s["type"] for s in steps]
        return "NFC" in kinds, "Lowercase" in kinds

    @staticmethod
    def _pattern(said) -> str:
        steps = said["pretokenizers"] if said["type"] == "Sequence" else [said]
        byte = steps[-1]
        if byte["type"] != "ByteLevel" or byte["add_prefix_space"]:
            raise ValueError(f"unknown pre-tokenizer: {byte}")
        if len(steps) == 1 and byte["use_regex"]:
            return BYTE_PATTERN
        split = steps[0]
        if len(steps) == 2 and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"] and not byte["use_regex"]:
            return split["pattern"]["Regex"]
        raise ValueError(f"unknown pre-tokenizer: {said}")

    # ------------------------------------------------------------ pairs

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, _NONE where it never merges or an end is missing (-1)."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(_NONE)) if len(self.keys) else np.full(len(key), _NONE, np.int32)

    def _rows(self, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rows of part ids (-1 behind the last) to their ends."""
        n, width = parts.shape
        place = np.arange(width)
        ranks = np.full((n, width), _NONE, np.int32)  # of each part and the one behind it
        if width > 1:
            ranks[:, :-1] = self.rank_of(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(n, -1)
        out, ends = np.full_like(parts, -1), sizes.copy()
        row = np.arange(n)
        while len(row):
            at = ranks.argmin(axis=1)
            own = np.arange(len(row))
            least = ranks[own, at]
            done = least == _NONE
            if done.any():
                out[row[done]] = parts[done]
                go = ~done
                row, parts, ranks, at, least = row[go], parts[go], ranks[go], at[go], least[go]
                own = np.arange(len(row))
                if not len(row):
                    break
            parts[own, at] = self.made[least]
            # the boundary goes: what stands behind it moves to the left
            source = np.minimum(place + (place > at[:, None]), width - 1)
            parts, ranks = np.take_along_axis(parts, source, 1), np.take_along_axis(ranks, np.minimum(place + (place >= at[:, None]), width - 1), 1)
            parts[:, -1], ranks[:, -1] = -1, _NONE
            ends[row] -= 1
            behind = parts[own, np.minimum(at + 1, width - 1)]
            ranks[own, at] = self.rank_of(parts[own, at], np.where(at + 1 < width, behind, -1))
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.rank_of(parts[some, at[some] - 1], parts[some, at[some]])
        return out, ends

    def _heap(self, parts: list[int]) -> list[int]:
        """The same for one long word, in time about proportional to its length."""
        n = len(parts)
        x = np.array(parts, np.int64)
        first = self.rank_of(x[:-1], x[1:]).tolist()
        heap = [(r, i) for i, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), [*first, _NONE]
        known = {}

        def look(a, b):
            if (a, b) not in known:
                known[a, b] = int(self.rank_of(np.array([a]), np.array([b]))[0])
            return known[a, b]

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            parts[i] = int(self.made[r])
            gone = after[i]
            rank[gone] = -1
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (i, before[i]):
                if j < 0:
                    continue
                rank[j] = look(parts[j], parts[after[j]]) if after[j] < n else _NONE
                if rank[j] < _NONE:
                    heapq.heappush(heap, (rank[j], j))
        out, i = [], 0
        while i < n:
            out.append(parts[i])
            i = after[i]
        return out

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word (not empty), each by itself."""
        out: list = [None] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        low = 0
        for width in WIDTHS:
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for k in range(0, len(some), PLACES // width):
                part = some[k : k + PLACES // width]
                n = sizes[part]
                inner = np.arange(width) < n[:, None]
                data = np.zeros((len(part), width), np.uint8)
                data[inner] = np.frombuffer(b"".join([words[i] for i in part.tolist()]), np.uint8)
                parts = np.where(inner, self.plain[data], np.int32(-1))
                parts[np.arange(len(part)), n - 1] = self.last[data[np.arange(len(part)), n - 1]]
                ids, ends = self._rows(parts, n)
                flat, stop = ids[ids >= 0], np.cumsum(ends)
                for i, e, m in zip(part.tolist(), stop.tolist(), ends.tolist(), strict=True):
                    out[i] = flat[e - m : e]
        for i in np.flatnonzero(sizes > WIDE).tolist():
            data = np.frombuffer(words[i], np.uint8)
            out[i] = np.array(self._heap([*self.plain[data[:-1]].tolist(), int(self.last[data[-1]])]), np.int32)
        return out

    # ------------------------------------------------------------ texts

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0
        self.first, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        for s, i in self.specials.items():  # a special string is no word, so its key is marked
            self._remember(["\0" + s], [np.array([i], np.int32)])

    def _remember(self, words: list[str], ids: list[np.ndarray]) -> None:
        n = len(self.slot)
        while n + len(words) > len(self.first):
            self.first, self.length = np.concatenate([self.first, self.first]), np.concatenate([self.length, self.length])
        lengths = np.array([len(x) for x in ids], np.int64)
        total = int(lengths.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.concatenate(ids) if ids else []
        self.first[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(words)] = lengths
        self.used += total
        self.slot.update(zip(words, range(n, n + len(words)), strict=True))

    def _newer_words(self, text: str) -> list[str]:
        """Words of a text with letters that Python's tables don't know yet: split by the library's."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.json_text)
        t, value = self.library, {c: b for b, c in enumerate(self.letters)}
        words = t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text) if t.normalizer else text)
        return [bytes(value[c] for c in w).decode() for w, _ in words]

    def _plain_words(self, text: str) -> list[str]:
        if not text.isascii():
            if _WIDE_LETTERS.search(text) and unassigned().search(text):
                return self._newer_words(text)
            if self.nfc:
                text = unicodedata.normalize("NFC", text)
        if self.lower:  # letter by letter: a sigma at a word's end is as any other
            text = text.replace("Σ", "σ").lower()
        return self.pattern.findall(text)

    def words(self, text: str) -> list[str]:
        """The words of a text, special strings among them with a mark before."""
        if self.special is None or not self.special.search(text):
            return self._plain_words(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._plain_words(text[at : m.start()])
            out.append("\0" + m[0])
            at = m.end()
        return out + self._plain_words(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts one after the other, and their number for each."""
        words, counts = [], []
        for text in texts:
            own = self.words(text)
            words += own
            counts.append(len(own))
        new = list(set(words).difference(self.slot))
        if new:
            if len(self.slot) + len(new) > CACHE_WORDS:
                self.forget()
                new = list(set(words).difference(self.slot))
            self._remember(new, self.encode_words([w.encode("utf-8", "surrogatepass") for w in new]))
        slot = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        length = self.length[slot]
        ends = np.zeros(len(slot) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        ids = self.pool[np.arange(ends[-1]) + np.repeat(self.first[slot] - ends[:-1], length)]
        edge = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=edge[1:])
        return ids, np.diff(ends[edge])


def _int_lists(values: np.ndarray, counts: np.ndarray):
    import pyarrow as pa

    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32, copy=False)))


def _slices(counts: np.ndarray, most: int = BATCH_IDS):
    """Ranges of rows that hold about so many ids."""
    ends, i = np.cumsum(counts), 0
    while i < len(counts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def encode(docs: DataFrame, tokenizer_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The kept columns and `ids`, an array of the token ids, of every row.

    The ids are those of the tokenizers library for the whole text, without special tokens
    added; special strings inside a text are tokens, as the library has them by default. A
    null text counts as empty: no ids. Null ids of documents, repeated rows and further
    columns change nothing: each row gives one row. An empty table gives none. A kept name
    that clashes with the output, and a file of another kind, raise ValueError.
    """
    import pyarrow as pa

    if ids in keep:
        raise ValueError(f"a kept column clashes with the output: {ids}")
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Codec(Path(tokenizer_file).read_text(encoding="utf-8")))
    rows = docs.select(*keep, F.col(text).alias("_" * (1 + max(map(len, [*keep, ""]))) + "text"))
    own, fields = rows.columns[-1], rows.schema.fields[:-1]
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        codec = shared.value  # one for all tasks of a worker
        for batch in batches:
            found, counts, done, held = [], np.zeros(batch.num_rows, np.int64), 0, 0

            def block(to):
                arrays = [batch.column(f.name).slice(done, to - done) for f in fields]  # noqa: B023
                return pa.RecordBatch.from_arrays([*arrays, _int_lists(np.concatenate(found), counts[done:to])], names=schema.names)  # noqa: B023

            for data, at, first in raw_pieces(batch.column(own), unit_places):  # a long text in several
                if held > BATCH_IDS and first > done:  # all texts before this piece's are whole, or it goes on with the last
                    goes_on = counts[first] > 0
                    if not goes_on:
                        yield block(first)
                        found, done, held = [], first, 0
                raw = data[at[0] : at[-1]].tobytes()
                edge = (at - at[0]).tolist()
                got, n = codec.encode([raw[i:j].decode("utf-8", "replace") for i, j in zip(edge, edge[1:], strict=False)])
                found.append(got)
                held += len(got)
                counts[first : first + len(n)] += n
            if done < batch.num_rows:
                yield block(batch.num_rows)

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_file: str, ids: str = "ids", keep: tuple[str, ...] | None = None, out: str = "decoded") -> DataFrame:
    """The kept columns (all, if none are named) and `out`, the text of the ids, of every row.

    Special tokens are kept as their strings; ids that are null or not in the file are left
    out. A null or empty array gives an empty text.
    """
    import pyarrow as pa

    keep = tuple(encoded.columns) if keep is None else keep
    if out in keep:
        raise ValueError(f"a kept column clashes with the output: {out}")
    spark = encoded.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Decoder(json.loads(Path(tokenizer_file).read_text(encoding="utf-8"))))
    rows = encoded.select(*keep, F.filter(F.coalesce(ids, F.array()).cast("array<int>"), F.isnotnull).alias("_" * (1 + max(map(len, [*keep, ""]))) + "ids"))
    own, fields = rows.columns[-1], rows.schema.fields[:-1]
    schema = T.StructType([*fields, T.StructField(out, T.StringType())])

    def run(batches):
        decoder = shared.value
        for batch in batches:
            lists = batch.column(own)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False)
            for i, j in _slices(np.diff(offsets)):
                part = pa.array([decoder.decode(values[a:b]) for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(i, j - i) for f in fields), part], names=schema.names)

    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: hashes of the decimal ids
    joined by a blank, and of the text that they decode to."""
    both = decode(encode(docs, tokenizer_file, text, (doc_id,)), tokenizer_file)
    hashed = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return both.select(doc_id, F.size("ids").cast("long").alias("n_tokens"), hashed.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
