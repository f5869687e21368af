"""Groups of similar texts by comparing all pairs of plainly computed fingerprints."""

import xxhash

MASK = (1 << 64) - 1


def mixed(h, n):
    """Word n of a shingle's hash: the hash itself, then outputs of splitmix64."""
    if not n:
        return h
    z = h + n * 0x9E3779B97F4A7C15 & MASK
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & MASK
    z = (z ^ z >> 27) * 0x94D049BB133111EB & MASK
    return z ^ z >> 31


def shingles(text):
    words = (text or "").encode().lower().split()
    return [b" ".join(words[n : n + 5]) for n in range(max(1, len(words) - 4))] if words else []


def plain_words(text):
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text)]
    words = []
    for n in range(4):
        own = [mixed(h, n) for h in hashes]
        words.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)))
    return words


def linked(x, y):
    first = x[0] ^ y[0]
    block = min((first >> at & 0xFFFF).bit_count() for at in (0, 16, 32, 48))
    total = sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True))
    return block <= 2 and first.bit_count() <= 17 and total <= 44


def similar_components(words):
    low = list(range(len(words)))
    for i in range(len(words)):
        for j in range(i):
            if low[i] != low[j] and linked(words[i], words[j]):
                old, new = max(low[i], low[j]), min(low[i], low[j])
                low = [new if x == old else x for x in low]
    return low


def similar_groups(ids, texts):
    """The smallest id of each text's group, in the order of the texts."""
    low = similar_components([plain_words(t) for t in texts])
    least = {}
    for root, i in zip(low, ids, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return [least.get(root) for root in low]
