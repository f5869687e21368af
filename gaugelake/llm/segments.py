"""Texts to token ids by segments, in NumPy: a batch of texts is cut, looked up and put together at once.

A text is cut before white space and between a letter and a mark like a comma. No match of the
usual byte-level patterns crosses such a place. Segments of up to 23 bytes are their own keys,
three integers with the length in the last byte, in an open-addressing table; longer ones are
kept in a dict. Only segments that a worker doesn't know go through the tokenizer. Texts stay
UTF-8 bytes all the way, so memory is a few times that of the texts given at once.
"""

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Letters that are letters in every version of Unicode, and marks that never follow them in a match.
LETTER, MARK = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff", b".,;:|!?&$%*#"
#: A segment that is a single match of the pattern.
WORD = re.compile(f" ?[{LETTER}]+")
#: Segments that a worker remembers, ids of them, and the bytes up to which a long one is remembered.
MEMORY, IDS, LONGEST = 400_000, 4_000_000, 256
#: Segments that are looked up at once, and bytes of text that a caller should give at once.
AT_ONCE, BYTES = 1 << 16, 1 << 21

_CODES = np.arange(256)
_SPACE = (_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13))
_ASCII = ((_CODES | 32) >= 97) & ((_CODES | 32) <= 122) & (_CODES < 128)
_MARK = np.isin(_CODES, np.frombuffer(MARK, np.uint8))
#: Bits of a word's first n bytes.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def byte_table() -> list[str]:
    """The character that stands for each byte: itself if it is printed, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(hidden.get(b, b)) for b in range(256)]


_SHOWN = str.maketrans({chr(b): c for b, c in enumerate(byte_table())})


def as_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow column of texts as UTF-8 bytes and the n + 1 places where texts begin and end."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def portions(column, size: int = BYTES):
    """Ranges of rows whose texts hold about ``size`` bytes, one row at least."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(lengths, dtype=np.int64), 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        after = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield at, after - at
        at = after


def spread(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places first[i], first[i] + 1, ... of all runs, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + lengths, lengths)


def _cuts(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where segments begin."""
    size = len(data)
    if not size:
        return np.empty(0, np.int64)
    space, letter = _SPACE[data], _ASCII[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    letter[latin + 1] = True
    cut = np.zeros(size + 1, bool)
    cut[1:size] = (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & letter[:-1])
    # White space beyond ASCII before a space is one run with it.
    wide = np.flatnonzero(cut[1:size] & (data[:-1] >= 0x80) & space[1:]) + 1
    if wide.size:
        last = data[wide - 1].astype(np.int64)
        last += data[wide - 2].astype(np.int64) << 8
        third = last + (data[np.maximum(wide - 3, 0)].astype(np.int64) << 16)
        white = np.isin(last, (0xC285, 0xC2A0)) | np.isin(
            third, (0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080, *range(0xE28080, 0xE2808B))
        )
        cut[wide[white]] = False
    cut[places[:-1]] = True
    return np.flatnonzero(cut[:size])


class Encoder:
    """Texts to ids of a tokenizer.

    ``cut`` says that the tokenizer's pattern allows cuts (see above); else a text is a single
    segment. ``lower`` says that the tokenizer lower-cases and drops white space.
    """

    def __init__(self, tokenizer: Tokenizer, cut=True, lower=False, memory=MEMORY):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.cut, self.lower, self.memory = cut, lower, memory
        # A slice of texts comes on top of what is remembered; half the places stay free.
        self.bits = int(2 * (memory + AT_ONCE)).bit_length()
        self._forget()

    def _forget(self):
        size = 1 << self.bits
        self.keys, self.codes = np.zeros((size, 3), np.uint64), np.full(size, -1, np.int32)
        self.long = {}
        self.first, self.length, self.known = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.hits = np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _shrink(self):
        """Forget what was seen least since the last time, the larger half at least, and all long ones."""
        at = np.flatnonzero(self.codes >= 0)
        codes, least = self.codes[at], 2
        while np.count_nonzero(self.hits[codes] >= least) > self.memory // 2:
            least *= 2
        at = at[self.hits[codes] >= least]
        key, codes = self.keys[at], self.codes[at]
        lengths = self.length[codes]
        ids = self.ids[spread(self.first[codes], lengths)]
        self._forget()
        self._keep(ids, lengths)
        self._put(key, self._slots(key), np.arange(len(codes)))

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, as little-endian unsigned 32-bit integers."""
        data = np.frombuffer((text or "").encode(), np.uint8)
        return self.encode_bytes(data, np.array([0, len(data)]))[0].astype("<u4").tobytes()

    def encode_column(self, column) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_bytes(*as_bytes(column))

    def encode_bytes(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts (UTF-8 one after another), and the n + 1 places where each text's ids begin."""
        if self.cut:
            starts = _cuts(data, places)
        else:
            starts = np.unique(places[:-1][places[:-1] < places[1:]])
        ends = np.append(starts[1:], len(data))
        ids, counts = [], [np.zeros(1, np.int64)]
        for at in range(0, len(starts), AT_ONCE):
            codes = self._codes(data, starts[at : at + AT_ONCE], ends[at : at + AT_ONCE])
            lengths = self.length[codes]
            ids.append(self.ids[spread(self.first[codes], lengths)])
            counts.append(lengths)
            self.hits += np.bincount(codes, minlength=len(self.hits))
            if self.known > self.memory or self.used > IDS:
                self._shrink()
        before = np.cumsum(np.concatenate(counts))
        ids = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        return ids, before[np.searchsorted(starts, places)]

    def _codes(self, data, starts, ends):
        """The code of each segment; unknown ones are learnt."""
        sizes = ends - starts
        codes = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(sizes < 24)
        missing, unnamed = [], []
        if short.size:
            base, stop = int(starts[0]), int(ends[-1])
            near = np.zeros(stop - base + 24, np.uint8)
            near[: stop - base] = data[base:stop]
            words = np.ndarray((stop - base + 16,), "<u8", near, strides=(1,))
            own, size = starts[short] - base, sizes[short]
            key = np.empty((len(own), 3), np.uint64)
            for n in range(3):
                key[:, n] = words[np.minimum(own + 8 * n, stop - base)] & _KEEP[np.clip(size - 8 * n, 0, 8)]
            key[:, 2] |= size.astype(np.uint64) << np.uint64(56)
            slot = self._slots(key)
            found = self._found(key, slot)
            codes[short] = found
            new = np.flatnonzero(found < 0)
            if new.size:
                # Equal keys follow one another; the same key may get two codes, both right.
                new = new[np.argsort(slot[new], kind="stable")]
                other = (key[new][1:] != key[new][:-1]).any(axis=1)
                group = np.cumsum(np.append(0, other))
                one = new[np.flatnonzero(np.append(True, other))]
                named = self.known + np.arange(len(one))
                missing = [bytes(data[a:b]) for a, b in zip(starts[short[one]], ends[short[one]], strict=True)]
                codes[short[new]] = named[group]
        at = self.known + len(missing)
        for n in np.flatnonzero(sizes >= 24).tolist():
            segment = data[starts[n] : ends[n]].tobytes()
            code = self.long.get(segment)
            if code is None:
                code = at + len(unnamed)
                unnamed.append(segment)
                if len(segment) <= LONGEST:
                    self.long[segment] = code
            codes[n] = code
        if missing or unnamed:
            self._learn(missing + unnamed)
            if missing:
                self._put(key[one], slot[one], named)
        return codes

    def _slots(self, key):
        mixed = key[:, 0] * _ODD[0] ^ key[:, 1] * _ODD[1] ^ key[:, 2] * _ODD[2]
        mixed ^= mixed >> np.uint64(32)
        return (mixed * _ODD[3] >> np.uint64(64 - self.bits)).astype(np.int64)

    def _found(self, key, slot):
        out, left, at = np.full(len(key), -1, np.int64), np.arange(len(key)), slot
        while left.size:
            code = self.codes[at]
            taken = code >= 0
            hit = taken & (self.keys[at] == key[left]).all(axis=1)
            out[left[hit]] = code[hit]
            on = taken & ~hit
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _put(self, key, slot, codes):
        left, at = np.arange(len(key)), slot
        while left.size:
            free = self.codes[at] < 0
            self.codes[at[free]] = codes[left[free]]
            won = free & (self.codes[at] == codes[left])
            self.keys[at[won]] = key[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _learn(self, segments):
        """Encode segments and keep their ids, in order, under the next codes."""
        texts, tokenize = [s.decode() for s in segments], self.model.tokenize
        made, rest = [None] * len(texts), []
        for n, text in enumerate(texts):
            if self.cut and WORD.fullmatch(text):
                word = text.lstrip(" ").lower() if self.lower else text
                shown = word.encode().decode("latin-1").translate(_SHOWN)
                made[n] = [t.id for t in tokenize(shown)]
            else:
                rest.append(n)
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([texts[n] for n in some], add_special_tokens=False)
            for n, e in zip(some, found, strict=True):
                made[n] = e.ids
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        self._keep(np.fromiter(chain.from_iterable(made), np.uint32, int(lengths.sum())), lengths)

    def _keep(self, ids, lengths):
        known, used = self.known + len(lengths), self.used + len(ids)
        self.first, self.length = _room(self.first, known), _room(self.length, known)
        self.hits, self.ids = _room(self.hits, known), _room(self.ids, used)
        self.first[self.known : known] = self.used + np.cumsum(lengths) - lengths
        self.length[self.known : known] = lengths
        self.ids[self.used : used] = ids
        self.known, self.used = known, used


def _room(values, size):
    if size <= len(values):
        return values
    more = np.zeros(max(size, 2 * len(values)), values.dtype)
    more[: len(values)] = values
    return more
