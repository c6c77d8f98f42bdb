"""Encoding of whole texts through a table of their units.

A BPE tokenizer treats each piece of a text by itself. Texts are cut into units
at places that are always ends of pieces; a unit's ids are looked up in a table
that a Python worker keeps from task to task, and only units that the table lacks
are encoded. A unit is looked up by all of its bytes, so no two units can be taken
for one another. Cutting, lookup and the gathering of ids are vectorised over the
bytes of many texts.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from souk.llm.common import text_buffer

_L, _D, _P, _U, _S, _W = range(6)  # letters, digits, other ASCII, not ASCII, blank, other white space
_CLASS = np.array([_S if c == 32 else _W if 9 <= c <= 13 else _D if 48 <= c <= 57 else _L if 65 <= c <= 90 or 97 <= c <= 122 else _U if c >= 128 else _P for c in range(256)], np.uint8)
#: Whether two neighbours that aren't white space are of different pieces; with what isn't ASCII one can't tell.
_APART = np.zeros((6, 6), bool)
for _a, _b in ((_L, _P), (_L, _D), (_D, _L), (_D, _P), (_P, _D), (_P, _L)):
    _APART[_a, _b] = True
#: White space and controls that are not in the classes above.
_UNUSUAL = regex.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　]")


_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Units that are encoded at a time: the library's results are large objects.
AT_ONCE = 4096


def short_keys(data: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of units of up to ``UnitTable.SHORT`` bytes as two numbers each; the
    second's highest byte is the length, so it is never 0. ``data`` ends with 16 spare bytes."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    low = words[begins] & _LOW[np.minimum(lengths, 8)]
    high = words[begins + 8] & _LOW[np.clip(lengths - 8, 0, 7)]
    return low, high | (lengths.astype(np.uint64) << np.uint64(56))


class UnitTable:
    """unit -> ids, in numpy arrays with open addressing; longer units are keys of a
    dictionary. Emptied when it holds ``LIMIT`` units or ``BYTES`` of ids and long units."""

    LIMIT, BYTES, SHORT = 1 << 19, 32 << 20, 15

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.size, self.count, self.used, self.long_bytes = 1 << 16, 0, 0, 0
        self.low, self.high = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64)
        self.entry = np.zeros(self.size, np.int32)
        self.long: dict[bytes, int] = {}
        self.starts, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint32)

    @property
    def full(self) -> bool:
        return self.count >= self.LIMIT or 4 * self.used + self.long_bytes >= self.BYTES

    def _first(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * _ONE + high * _TWO
        return ((h ^ (h >> np.uint64(29))) * _ONE) >> np.uint64(65 - self.size.bit_length())

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each key; -1 where it is missing."""
        at = self._first(low, high)
        seen = self.high[at]
        same = (seen == high) & (self.low[at] == low)
        out = np.where(same, self.entry[at], np.int32(-1))
        left = np.flatnonzero(~same & (seen != 0))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & np.uint64(self.size - 1)
            seen = self.high[at[left]]
            same = (seen == high[left]) & (self.low[at[left]] == low[left])
            out[left[same]] = self.entry[at[left[same]]]
            left = left[~same & (seen != 0)]
        return out

    def _place(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        """Distinct keys that the table lacks."""
        at, left = self._first(low, high), np.arange(len(low))
        while len(left):  # of those that want a free slot the last takes it, the others go on
            free = left[self.high[at[left]] == 0]
            self.entry[at[free]] = entry[free]
            won = free[self.entry[at[free]] == entry[free]]
            self.low[at[won]], self.high[at[won]] = low[won], high[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + np.uint64(1)) & np.uint64(self.size - 1)

    def add(self, low: np.ndarray, high: np.ndarray, long: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """New units, the short ones before the long ones, and their ids."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        total = self.count + len(lengths)
        while total + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts), np.int64)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[self.count + 1 : total + 1] = self.used + np.cumsum(lengths)
        entry = np.arange(self.count, self.count + len(low), dtype=np.int32)
        if self.size < 2 * total:
            old = self.high != 0
            kept = self.low[old], self.high[old], self.entry[old]
            while self.size < 2 * total:
                self.size *= 2
            self.low, self.high = np.zeros(self.size, np.uint64), np.zeros(self.size, np.uint64)
            self.entry = np.zeros(self.size, np.int32)
            self._place(*kept)
        self._place(low, high, entry)
        self.long.update(zip(long, range(self.count + len(low), total), strict=True))
        self.count, self.used, self.long_bytes = total, self.used + len(ids), self.long_bytes + sum(map(len, long))

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all entries one after another, number of ids of each)."""
        first = self.starts[entries]
        lengths = self.starts[entries + 1] - first
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(first - ends + lengths, lengths) + np.arange(total)], lengths


class Encoder:
    """``encode_units``: the ids of each unit (all in one array) and how many each
    has. ``whole``: the ids of a text, for texts with one of the strings of
    ``special`` or unusual white space, or for all if texts mayn't be ``cut`` (the
    cuts here are those of one pattern). ``words``: white space ends units and
    belongs to none, case doesn't count, and each digit is a unit; else a blank
    belongs to the unit after it."""

    def __init__(self, encode_units: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], whole: Callable[[str], np.ndarray], special: tuple[str, ...] = (), words: bool = False, cut: bool = True):
        self.encode_units, self.whole, self.special, self.words, self.cut = encode_units, whole, [s.encode() for s in special], words, cut
        self.table = UnitTable()
        folded = np.arange(256, dtype=np.uint8)
        if words:
            folded[65:91] += 32
        self.folded = folded

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where units begin."""
        c = _CLASS[raw]
        before = np.concatenate([[_W], c[:-1]]).astype(np.uint8)
        white, white_before = c >= _S, before >= _S
        cut = _APART[before, c]
        quote = np.flatnonzero(raw[:-1] == 39) + 1
        cut[quote] &= c[quote] != _L  # a quote and the letters after it may be one piece
        if self.words:
            cut |= white_before | (c == _D)
            cut &= ~white
            begins = offsets[:-1][offsets[:-1] < len(raw)]
            cut[begins] = ~white[begins]
        else:
            after_white = np.concatenate([white[1:], [True]])
            cut |= white & ~white_before
            cut |= white & white_before & ~after_white  # the last of several goes apart, a blank to what follows
            cut |= ~white & (before == _W)
            last = offsets[1:][offsets[1:] > 0] - 1  # what follows is of another text
            two = last[(last > 0) & white[last] & white_before[last]]
            cut[two] = False
            cut[offsets[:-1][offsets[:-1] < len(raw)]] = True
        return cut

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin and the end)."""
        raw, offsets = text_buffer(texts)
        n = len(offsets) - 1
        apart = [i for i in range(n) if self._apart(raw, texts, offsets, i)] if self._any_apart(raw) else []
        folded = self.folded[raw]
        cut = self.cuts(folded, offsets)
        begins = np.flatnonzero(cut)
        if self.words:  # a unit ends where another begins, or white space does
            inside = _CLASS[raw] < _S
            ends = np.flatnonzero(inside & np.append(cut[1:] | ~inside[1:], True)) + 1
        else:
            ends = np.append(begins[1:], len(raw))
        owner_first = np.searchsorted(begins, offsets)
        if apart:
            skip = np.zeros(len(begins), bool)
            for i in apart:
                skip[owner_first[i] : owner_first[i + 1]] = True
            kept = np.flatnonzero(~skip)
            ids, some = self.table.gather(self._entries(folded, begins[kept], ends[kept]))
            lengths = np.zeros(len(begins), np.int64)
            lengths[kept] = some
        else:
            ids, lengths = self.table.gather(self._entries(folded, begins, ends))
        starts = np.concatenate([[0], np.cumsum(lengths)])[owner_first]
        if not apart:
            return ids, starts
        parts = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for i in apart:
            parts[i] = self.whole(texts[i].as_py() or "")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _any_apart(self, raw: np.ndarray) -> bool:
        if not self.cut:
            return True
        data = raw.tobytes()
        if any(s in data for s in self.special):
            return True
        return not self.words and _UNUSUAL.search(data.decode("utf-8", "replace")) is not None

    def _apart(self, raw: np.ndarray, texts: pa.Array, offsets: np.ndarray, i: int) -> bool:
        data = raw[offsets[i] : offsets[i + 1]].tobytes()
        return not self.cut or any(s in data for s in self.special) or (not self.words and _UNUSUAL.search(data.decode("utf-8", "replace")) is not None)

    def _entries(self, folded: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The table's entry of each unit; units that it lacks are encoded first."""
        lengths = ends - begins
        short, long = np.flatnonzero(lengths <= UnitTable.SHORT), np.flatnonzero(lengths > UnitTable.SHORT)
        data = np.concatenate([folded, np.zeros(16, np.uint8)])
        low, high = short_keys(data, begins[short], lengths[short])
        units = [data[a:b].tobytes() for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True)]
        out = np.empty(len(begins), np.int32)
        if self.table.full:
            self.table.clear()
        out[short], out[long] = self.table.find(low, high), [self.table.long.get(u, -1) for u in units]
        if len(out) and out.min() < 0:
            lack = np.flatnonzero(out[short] < 0)
            order = lack[np.lexsort((low[lack], high[lack]))]
            new = order[np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))] if len(order) else order
            at = short[new]
            more = list(dict.fromkeys(u for u, e in zip(units, out[long].tolist(), strict=True) if e < 0))
            texts = [data[a:b].tobytes().decode() for a, b in zip(begins[at].tolist(), ends[at].tolist(), strict=True)] + [u.decode() for u in more]
            parts = [self.encode_units(texts[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE)]
            self.table.add(low[new], high[new], more, *(np.concatenate(x) for x in zip(*parts, strict=True)))
            out[short], out[long] = self.table.find(low, high), [self.table.long[u] for u in units]
        return out


def library_units(path: str, plain: bool = False) -> tuple[Callable, Callable]:
    """(encode_units, whole) of a vocabulary file of the tokenizers library. ``plain``:
    strings of special tokens in a text are ordinary text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain

    def encode_units(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lists = [e.ids for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.array([len(x) for x in lists], np.int64)

    def whole(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode_units, whole


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a vocabulary file."""
    from tokenizers import Tokenizer

    return 1 + max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


_workers: dict[tuple, Encoder] = {}


def library_encoder(path: str, special: tuple[str, ...], words: bool) -> Encoder:
    """One for each Python worker, which Spark reuses from task to task."""
    key = (path, special, words)
    if key not in _workers:
        _workers[key] = Encoder(*library_units(path), special=special, words=words)
    return _workers[key]


def shared_encoder(key: tuple, make: Callable[[], Encoder]) -> Encoder:
    if key not in _workers:
        _workers[key] = make()
    return _workers[key]
