"""External induced sorting of the suffixes of a byte string, with common prefixes.

Suffixes are sorted by induction: the LMS suffixes are put in order (recursively: those that tie
over eight bytes by the next eight), from them the L suffixes follow in one scan, and from these
the S suffixes in a scan back. The scans work through one queue for each leading byte, a queue
holding tuples of a suffix and its common prefix with the one before. A tuple's common prefix is
one more than the smallest among the scanned tuples between its two causes, so it is carried
along and never measured, but for the seams between L and S suffixes of a byte.

Queues move to a file once they hold more than ``memory`` tuples, and are read back in order.
Common prefixes are capped; suffixes that agree over the cap come in any order.
"""

import tempfile

import numpy as np

CAP = 64
#: Zeros that a text ends with.
END = CAP + 8


class Queues:
    """Queues of (position, common prefix), one for each byte, on disk beyond a limit."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.parts = [[] for _ in range(256)]
        self.file = None

    def put(self, byte: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        if self.held + len(places) <= self.memory:
            self.parts[byte].append((places, prefixes))
            self.held += len(places)
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        self.file.write(places.tobytes() + prefixes.tobytes())
        self.parts[byte].append((at, len(places)))

    def take(self, byte: int):
        """All tuples waiting in a queue, in order; they are taken away."""
        parts, self.parts[byte] = self.parts[byte], []
        out = []
        for first, second in parts:
            if isinstance(first, np.ndarray):
                self.held -= len(first)
                out.append((first, second))
            else:
                self.file.seek(first)
                data = self.file.read(second * 10)
                out.append(
                    (np.frombuffer(data, np.int64, second), np.frombuffer(data, np.int16, second, 8 * second))
                )
        if not out:
            return None
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def close(self):
        if self.file is not None:
            self.file.close()


def _word(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes from ``at + depth`` as one number."""
    rows = np.lib.stride_tricks.sliding_window_view(text, 8)[at + depth]
    return rows.view(">u8").ravel()


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of pairs of suffixes, up to the cap."""
    out = np.full(len(a), CAP, np.int16)
    left = np.arange(len(a))
    for depth in range(0, CAP, 8):
        apart = _word(text, a[left], depth) ^ _word(text, b[left], depth)
        ended = apart != 0
        differ = apart[ended].astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        out[left[ended]] = depth + differ.argmax(axis=1)
        left = left[~ended]
        if not len(left):
            break
    return out


def _sorted_starts(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Suffixes at ``starts`` in order of their first ``CAP`` bytes."""
    order = starts[np.argsort(_word(text, starts, 0), kind="stable")]
    lo = np.zeros(len(order), np.int64)
    depth = 0
    while depth < CAP and len(order):
        word = _word(text, order, depth)
        new = np.empty(len(order), bool)
        new[0] = True
        new[1:] = (word[1:] != word[:-1]) | (lo[1:] != lo[:-1])
        lo = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        depth += 8
        tied = ~new
        tied[:-1] |= tied[1:]
        tied = np.flatnonzero(tied)
        if not len(tied) or depth >= CAP:
            break
        within = np.lexsort((_word(text, order[tied], depth), lo[tied]))
        order[tied] = order[tied][within]
    return order


def _push(queues, text, causes, prefixes, wanted, carry):
    """Put the suffixes before ``causes`` that are of the wanted type into their queues.

    ``carry`` holds, for each byte, the smallest common prefix scanned since its last tuple.
    """
    before = causes - 1
    fits = (before >= 0) & wanted[before]
    bytes_ = np.where(fits, text[before], 0)
    present = np.flatnonzero(np.bincount(bytes_[fits], minlength=256))
    low = int(prefixes.min())
    kept = carry.copy()
    np.minimum(carry, low, out=carry)
    for byte in present:
        own = np.flatnonzero(fits & (bytes_ == byte))
        cuts = np.concatenate([[0], own + 1])
        tail = cuts[-1] == len(prefixes)
        least = np.minimum.reduceat(prefixes, cuts[:-1] if tail else cuts)
        found = least[: len(own)].copy()
        found[0] = min(found[0], kept[byte])
        carry[byte] = CAP if tail else least[-1]
        queues.put(int(byte), before[own], np.minimum(found + 1, CAP).astype(np.int16))


def suffixes(text: np.ndarray, memory: int = 1 << 24):
    """Blocks (positions, common prefixes with the one before) in order of the suffixes.

    ``text`` holds bytes and then ``END`` zeros, of which the first is the end; it may be mapped
    from a file. Positions whose first ``CAP`` bytes agree come in any order.
    """
    size = len(text) - END + 1
    # S suffixes are smaller than the one after; equal bytes take the type of the next.
    step = np.sign(text[1:size].astype(np.int16) - text[: size - 1])
    turns = np.flatnonzero(step)
    following = np.searchsorted(turns, np.arange(size - 1))
    small = np.ones(size, bool)
    inside = following < len(turns)
    small[:-1][inside] = step[turns[following[inside]]] > 0
    small[:-1][~inside] = False
    starts = np.flatnonzero(small[1:-1] & ~small[:-2]) + 1
    starts = _sorted_starts(text, starts)
    prefixes = np.zeros(len(starts), np.int16)
    if len(starts) > 1:
        prefixes[1:] = common(text, starts[:-1], starts[1:])
    leading = np.searchsorted(text[starts], np.arange(257)) if len(starts) else np.zeros(257, int)
    large = ~small
    queues, done = Queues(memory), Queues(memory)
    carry = np.full(256, -1, np.int16)
    # The end is the smallest suffix, and comes first.
    _push(queues, text, np.array([size - 1]), np.zeros(1, np.int16), large, carry)
    for byte in range(256):
        last = None
        while (batch := queues.take(byte)) is not None:
            done.put(byte, *batch)
            last = batch[0][-1]
            _push(queues, text, *batch, large, carry)
        own = starts[leading[byte] : leading[byte + 1]]
        if len(own):
            shared = prefixes[leading[byte] : leading[byte + 1]].copy()
            shared[0] = 0 if last is None else common(text, np.array([last]), own[:1])[0]
            _push(queues, text, own, shared, large, carry)
    carry = np.full(256, -1, np.int16)
    blocks = []
    for byte in range(255, -1, -1):
        places, shared = [], []
        while (batch := queues.take(byte)) is not None:
            places.append(batch[0])
            shared.append(batch[1])
            _push(queues, text, *batch, small, carry)
        ahead = np.concatenate(places)[::-1] if places else np.empty(0, np.int64)
        right = np.concatenate(shared)[::-1] if shared else np.empty(0, np.int16)
        behind = done.take(byte)
        seam = 0
        if behind is not None:
            if len(ahead):
                seam = common(text, behind[0][-1:], ahead[:1])[0]
            back = np.append(behind[1][1:], seam).astype(np.int16)[::-1]
            _push(queues, text, behind[0][::-1], back, small, carry)
        order = ahead if behind is None else np.concatenate([behind[0], ahead])
        left = np.concatenate(([] if behind is None else [behind[1]]) + [[seam][: len(ahead)], right[:-1]])
        if len(order):
            blocks.append((order, left.astype(np.int16)))
    queues.close()
    done.close()
    return blocks[::-1]
