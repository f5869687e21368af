"""Groups of similar texts: against all pairs, and against the share of common shingles."""

import random

import numpy as np
import pytest
from conftest import sentence, table
from plain_texts import linked, plain_words, shingles, similar_components, similar_groups

from gaugelake.llm import near_texts, simhash


def flipped(rng, words, most):
    words = list(words)
    for _ in range(rng.randrange(most + 1)):
        words[rng.randrange(4)] ^= 1 << rng.randrange(64)
    return words


def test_fingerprint_equals_plain(texts):
    for text in texts:
        assert near_texts.fingerprint(text).tolist() == plain_words(text)


@pytest.mark.parametrize("tile", [1, 3, 256])
def test_small_nodes_cover_all_pairs_once(tile):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = sorted(flipped(rng, [rng.choice(base)] * 4, 40)[0] for _ in range(120))
    values = np.array(values + [values[-1]] * 9, np.uint64)
    for node in ((0, 129, 0, 129), (0, 70, 70, 129)):
        seen = []
        for a, b, c, d in near_texts.small_nodes(values, [node], most=6, tile=tile):
            assert b - a <= tile and d - c <= tile
            seen += [(i, j) for i in range(a, b) for j in range(c, d) if i < j]
        assert len(seen) == len(set(seen))
        want = {
            (i, j)
            for i in range(node[0], node[1])
            for j in range(node[2], node[3])
            if i < j and int(values[i] ^ values[j]).bit_count() <= 6
        }
        assert want <= set(seen)


def test_connected_beyond_one_tile():
    """More rows than a tile, many of them with equal first words, against all pairs."""
    rng = random.Random(2)
    base = [[rng.getrandbits(64) for _ in range(4)] for _ in range(30)]
    rows = [flipped(rng, rng.choice(base), 60) for _ in range(500)]
    rows += [[7, *flipped(rng, [0, 1, 2, 3], 60)[1:]] for _ in range(400)]
    rows.sort()
    got = near_texts.connected(np.array(rows, np.uint64), (0, 900, 0, 900)).tolist()
    low = list(range(900))
    for i in range(900):
        for j in range(i):
            first = (rows[i][0] ^ rows[j][0]).bit_count()
            total = sum((a ^ b).bit_count() for a, b in zip(rows[i], rows[j], strict=True))
            if first <= 17 and total <= 44 and low[i] != low[j]:
                old, new = max(low[i], low[j]), min(low[i], low[j])
                low = [new if x == old else x for x in low]
    assert got == low and 30 < len(set(low)) < 800


@pytest.mark.parametrize("large", [near_texts.LARGE, 3])
def test_links_connect_all_linked(spark, large):
    """Cells as a whole and dealt out as pairs of shares."""
    rng = random.Random(3)
    base = [[rng.getrandbits(64) for _ in range(4)] for _ in range(12)]
    rows = [flipped(rng, rng.choice(base), 50) for _ in range(150)]
    signed = [[w - (1 << 64) if w >> 63 else w for w in r] for r in rows]
    nodes = spark.createDataFrame(
        [(n, *r) for n, r in enumerate(signed)], "node long, f0 long, f1 long, f2 long, f3 long"
    )
    found = near_texts.links(nodes, large).collect()
    want = similar_components(rows)
    low = list(range(len(rows)))
    for a, b in found:
        old, new = max(low[a], low[b]), min(low[a], low[b])
        low = [new if x == old else x for x in low]
    assert low == want and 12 <= len(set(want)) < 150


def test_groups_equal_all_pairs(repeated, nothing):
    rows = near_texts.near_texts(repeated)
    assert rows.count() == repeated.count()
    texts = [tuple(r) for r in repeated.select("doc_id", "text").collect()]
    want = similar_groups([i for i, _ in texts], [t for _, t in texts])
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(
        repr((i, g)) for (i, _), g in zip(texts, want, strict=True)
    )
    assert near_texts.near_texts(nothing).count() == 0


def test_similar_texts_are_found_and_others_left(spark):
    """Against the share of common shingles: 0.85 or more is one group, 0.5 or less is not."""
    rng = random.Random(4)
    texts = []
    for _ in range(90):
        words = sentence(rng, 300).split()
        other = list(words)
        for _ in range(rng.choice([1, 3, 5, 30, 60])):
            other[rng.randrange(len(other))] = "edited"
        texts += [" ".join(words), " ".join(other)]
    docs = table(spark, texts)
    group = dict(near_texts.near_texts(docs).collect())
    high = missed = 0
    for i in range(0, len(texts), 2):
        x, y = set(shingles(texts[i])), set(shingles(texts[i + 1]))
        share = len(x & y) / len(x | y)
        if share >= 0.85:
            high += 1
            missed += group[i] != group[i + 1]
        elif share <= 0.5:
            assert group[i] != group[i + 1]
    assert high > 20 and not missed
    assert all(g in (i, i - i % 2) for i, g in group.items())
    kept = {r["doc_id"] for r in simhash.keep_one(docs, near_texts.near_texts).collect()}
    assert kept == {i for i, g in group.items() if i == g}
    assert linked(plain_words(texts[0]), plain_words(texts[0]))
