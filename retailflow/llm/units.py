"""Cutting texts into units that a tokenizer treats independently, and worker caches
of what the tokenizer makes of each unit."""

from __future__ import annotations

import json
import os

import numpy as np

from .common import _BYTE, _IS_SPACE, _power, mix

#: Bytes after a white-space byte that may belong to further white space or to a special
#: token, so that no unit may begin there: ASCII white space, the first bytes of Unicode's
#: other spaces, and "<".
_UNSURE = _IS_SPACE.copy()
_UNSURE[[0x3C, 0xC2, 0xE1, 0xE2, 0xE3]] = True

#: ASCII punctuation that ends a run of letters, but for "|", which special tokens hold.
_POINT = np.zeros(256, bool)
_POINT[[c for c in range(33, 127) if not chr(c).isalnum() and c != 0x7C]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(65, 123) if chr(c).isalpha()]] = True
#: Second bytes of Latin letters whose first byte is C3: all but those of two signs.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False

#: These of a byte as bits: white space, not unsure, a letter, a point, a Latin letter's second byte.
_KINDS = (_IS_SPACE + ~_UNSURE * np.uint8(2) + _LETTER * np.uint8(4) + _POINT * np.uint8(8) + _LATIN * np.uint8(16)).astype(np.uint8).tobytes()

#: First of three bytes of Unicode's wider spaces.
_SPACE_LEAD = np.zeros(256, bool)
_SPACE_LEAD[[0xE1, 0xE2, 0xE3]] = True

#: Units that a worker remembers at most (about 150 bytes each); then those met but once go.
CACHE_UNITS = 300_000

#: The characters that stand for bytes in byte-level tokenizers' vocabularies.
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_POINTS = np.zeros(256, "<u4")
_POINTS[_SEEN] = _SEEN
_POINTS[[b for b in range(256) if b not in _SEEN]] = 256 + np.arange(256 - len(_SEEN))
_BLANK = chr(_POINTS[0x20])

_tokenizers: dict[str, object] = {}
_word_tokenizers: dict[str, tuple[object, np.ndarray] | None] = {}


def tokenizer(json_text: str):
    """The library's tokenizer, once for each worker; parallelism is Spark's."""
    if json_text not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(json_text)
        t.no_truncation()
        t.no_padding()
        _tokenizers[json_text] = t
    return _tokenizers[json_text]


def encode_units(json_text: str, units: list[str]) -> list[list[int]]:
    """The ids of each unit by itself."""
    return [e.ids for e in tokenizer(json_text).encode_batch_fast(units, add_special_tokens=False)]


def word_tokenizer(json_text: str) -> tuple[object, np.ndarray] | None:
    """The library's tokenizer for words that begin with a blank and are letters else, written
    in the vocabulary's characters, and the ids that begin with a blank.

    A byte-level tokenizer takes such a word whole, so only blanks have to be found; it shares
    the model. None where the tokenizer may treat such words otherwise.
    """
    if json_text not in _word_tokenizers:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Metaspace

        made, spec = None, json.loads(json_text)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True) and not spec.get("normalizer")
        plain = plain and model.get("type") == "BPE" and _BLANK in model["vocab"]
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        # a token beside the vocabulary must hold what no such word holds
        if plain and all(any(c != " " and not c.isalpha() for c in a["content"]) for a in spec.get("added_tokens") or []):
            t = tokenizer(json_text)
            t.model._resize_cache(0)  # IdCache asks for no word twice
            words = Tokenizer(t.model)
            words.pre_tokenizer = Metaspace(replacement=_BLANK, prepend_scheme="never", split=True)
            blank = np.zeros(max(model["vocab"].values()) + 1, bool)
            blank[[i for token, i in model["vocab"].items() if token.startswith(_BLANK)]] = True
            made = words, blank
        _word_tokenizers[json_text] = made
    return _word_tokenizers[json_text]


def kinds_of(data: np.ndarray) -> np.ndarray:
    """_KINDS of each byte; bytes.translate is several times faster than an index."""
    return np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)


def words_among(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the units data[begin:end] are a blank and letters behind it."""
    letter = np.zeros(len(data) + 1, np.int64)
    kinds = kinds_of(data)
    own = kinds & 4 != 0
    latin = (data[:-1] == 0xC3) & (kinds[1:] & 16 != 0)
    own[:-1] |= latin
    own[1:] |= latin
    np.cumsum(own, out=letter[1:])
    size = end - begin
    # of two bytes for a letter none may be in another unit
    return (size > 1) & (data[np.minimum(begin, len(data) - 1)] == 0x20) & (letter[end] - letter[begin] == size - 1) & (data[end - 1] != 0xC3)


def encode_words(json_text: str, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """All ids of units that are such words, and their number for each, from one text; None
    if the ids don't show where the words begin."""
    words, blank = word_tokenizer(json_text)
    size = end - begin
    total = np.cumsum(size)
    where = np.arange(int(total[-1])) + np.repeat(begin - (total - size), size)
    text = _POINTS[data[where]].tobytes().decode("utf-32-le")
    ids = np.asarray(words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
    first = np.flatnonzero(blank[ids])
    if len(first) != len(begin) or first[0] != 0:
        return None
    return ids, np.diff(np.append(first, len(ids)))


def encode_apart(json_text: str, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the units data[begin:end], and their number for each: words of letters go by
    themselves, past the tokenizer's own pattern, which takes longer than its merges."""
    word = words_among(data, begin, end) if word_tokenizer(json_text) and len(data) else np.zeros(len(begin), bool)
    got = encode_words(json_text, data, begin[word], end[word]) if word.any() else None
    if got is None:
        return encode_lines(json_text, data, begin, end)
    ids, own = encode_lines(json_text, data, begin[~word], end[~word])
    lengths = np.zeros(len(begin), np.int64)
    lengths[word], lengths[~word] = got[1], own
    of_word = np.repeat(word, lengths)
    out = np.zeros(len(of_word), np.uint32)
    out[of_word], out[~of_word] = got[0], ids
    return out, lengths


def encode_lines(json_text: str, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the units data[begin:end], and their number for each, from one text with a
    unit a line.

    A line feed between units is an id of its own there, which is much faster than a call
    a unit; units that hold line feeds themselves, or may end in white space, go by themselves.
    """
    t = tokenizer(json_text)
    feed = t.encode("\n", add_special_tokens=False).ids
    feeds = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=feeds[1:])
    last, size = data[end - 1], end - begin
    wide = ((size > 1) & (data[np.maximum(end - 2, 0)] == 0xC2)) | ((size > 2) & _SPACE_LEAD[data[np.maximum(end - 3, 0)]])
    plain = (feeds[end] == feeds[begin]) & (last > 32) & ~((last >= 0x80) & wide)
    n = size[plain] + 1
    total = np.cumsum(n)
    text = np.full(int(total[-1]) if len(n) else 0, 10, np.uint8)
    k = np.arange(len(text)) - np.repeat(total - n, n)
    inner = k < np.repeat(n - 1, n)
    text[inner] = data[(k + np.repeat(begin[plain], n))[inner]]
    ids = np.asarray(t.encode_batch_fast([text[:-1].tobytes().decode("utf-8", "replace")], add_special_tokens=False)[0].ids if len(n) else [], np.uint32)
    ends = np.append(np.flatnonzero(ids == feed[0]), len(ids)) if len(n) else np.zeros(0, np.int64)
    if len(feed) != 1 or len(ends) != len(n):
        plain[:], ids, ends = False, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    lengths = np.zeros(len(begin), np.int64)
    lengths[plain] = np.diff(np.append(-1, ends)) - 1 if plain.any() else 0
    rest = encode_units(json_text, [data[b:e].tobytes().decode("utf-8", "replace") for b, e in zip(begin[~plain].tolist(), end[~plain].tolist(), strict=True)])
    lengths[~plain] = [len(x) for x in rest]
    out = np.zeros(int(lengths.sum()), np.uint32)
    own = np.repeat(plain, lengths)
    out[own] = np.delete(ids, ends[:-1]) if plain.any() else ids
    out[~own] = [i for x in rest for i in x]
    return out, lengths


class Units:
    """Units of some texts: begin and end in data, hash h, and the number in each text.

    Every unit begins at a text's start, at a white-space byte with something else behind
    it in the same text, or where punctuation follows a letter. Byte-level tokenizers that split texts into
    words, punctuation and white space before their merges always have a boundary there,
    so the ids of a text are those of its units in order.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data = data
        power, inverse = _power(len(data) + 1)
        starts = np.zeros(len(data) + 1, bool)
        if len(data) > 1:
            kinds = kinds_of(data)
            starts[: len(data) - 1] = kinds[:-1] & (kinds[1:] >> 1) & 1
            # behind the last byte of a text stands nothing, whatever text is next in data
            starts[np.maximum(at[1:-1], 1) - 1] = False
            letter = kinds[:-1] & 4 != 0
            letter[1:] |= (kinds[1:-1] & 16 != 0) & (data[:-2] == 0xC3)
            starts[1 : len(data)] |= letter & (kinds[1:] & 8 != 0)
        starts[at] = True
        starts[len(data)] = False
        self.begin = np.flatnonzero(starts)
        self.end = np.append(self.begin[1:], len(data)) if len(self.begin) else self.begin
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
        h = (total[self.end] - total[self.begin]) * inverse[self.begin]
        self.h = mix(h, 0x5851F42D)
        self.counts = np.diff(np.searchsorted(self.begin, at))


def unit_places(data: np.ndarray) -> np.ndarray:
    """Places at which a long text may be cut: some of those at which units begin."""
    return np.flatnonzero(_IS_SPACE[data[1:-1]] & ~_UNSURE[data[2:]]) + 1


class IdCache:
    """A worker's ids of the units that it has met, by hash: keys in order, each with a slot,
    and the slots' ids in one growing array."""

    def __init__(self, json_text: str, most: int | None = None):
        self.json_text, self.most = json_text, most or CACHE_UNITS
        self.reset()

    def reset(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.met = np.zeros(1 << 16, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.uint16), 0

    def _ids(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some slots one after the other, and their number for each."""
        length = self.length[slots].astype(np.int64)
        ends = np.cumsum(length)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.first[slots] - (ends - length), length)
        return self.pool[where], length

    def _encode(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units data[begin:end], and their number for each."""
        return encode_apart(self.json_text, data, begin, end)

    def _shrink(self) -> None:
        """Keep the units that were met in more than one piece, if these are few enough."""
        keep = self.met[self.slots] > 1
        if keep.sum() > self.most // 2:
            self.reset()
            return
        keys, slots = self.keys[keep], self.slots[keep]
        ids, length = self._ids(slots)
        self.reset()
        self._add(keys, ids, length)

    def _add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Units by hash, in ascending order of it."""
        n = len(self.keys)
        while n + len(keys) > len(self.first):
            self.first, self.length, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length, self.met))
        if len(ids) and int(ids.max()) > np.iinfo(self.pool.dtype).max:
            self.pool = self.pool.astype(np.uint32)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.length[n : n + len(keys)] = lengths
        self.first[n : n + len(keys)] = self.used + np.cumsum(lengths) - lengths
        self.met[n : n + len(keys)] = 0
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, np.arange(n, n + len(keys)))

    def ids_of(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their number for each unit."""
        order = np.argsort(units.h)
        h = units.h[order]
        new = np.append(True, h[1:] != h[:-1])[: len(h)]
        distinct, example = h[new], order[new]
        inverse = np.empty(len(h), np.int64)
        inverse[order] = np.cumsum(new) - 1
        if len(self.keys) + len(distinct) > self.most:
            self._shrink()
        got = np.full(len(distinct), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            got = np.where(self.keys[at] == distinct, self.slots[at], -1)
        missing = np.flatnonzero(got < 0)
        if len(missing):
            got[missing] = np.arange(len(self.keys), len(self.keys) + len(missing))
            which = example[missing]
            ids, lengths = self._encode(units.data, units.begin[which], units.end[which])
            self._add(distinct[missing], ids, lengths)
        self.met[got] += 1
        ids, length = self._ids(got[inverse])
        return ids.astype(np.uint32), length


_caches: dict[str, IdCache] = {}


def id_cache(json_text: str) -> IdCache:
    """A worker's only cache, so that it may hold twice as many units as one beside another."""
    if json_text not in _caches:
        _caches.clear()
        _caches[json_text] = IdCache(json_text, 2 * CACHE_UNITS)
    return _caches[json_text]
