"""Groups of similar texts: wide SimHash fingerprints and a trie self-join with a large budget.

``simhash`` links fingerprints of 64 bits that differ in two. Texts that share 0.8 of their
shingles of five words differ in about 0.15 of all bits, so here a fingerprint has four words
of 64 bits, and two texts are linked if at most ``BITS`` of the 256 differ.

Fingerprints meet in the cells of the first word: of its four blocks of 16 bits each is dealt
out under its own value and under the 16 values one bit away. Two blocks that differ in at most two
bits thus share a cell, which by pigeonhole finds every pair whose first words differ in at most
eleven bits, and most pairs beyond. Within a cell a binary trie of the first words is joined with
itself: pairs of nodes descend together, differing bits are added up, and a pair is dropped when it
exceeds ``FIRST``. Small nodes are finished by one product. What is connected already isn't
compared again, so a group of near copies costs little more than its spanning links.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm.components import components, forest
from gaugelake.settle import settle

#: Words of a shingle.
WIDTH = 5
SEED = 42
#: Words of 64 bits of a fingerprint.
WORDS = 4
STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bits of 256 in which linked texts may differ. Texts that share 0.8 of their shingles differ in
#: 39 on average, with a deviation of 6; those that share 0.6 in 59.
BITS = 44
#: Bits of the first word beyond which a pair of trie nodes is dropped.
FIRST = 17
BLOCK_BITS = 16
#: A cell with more fingerprints than this is dealt out as pairs of shares.
LARGE = 20_000
#: Nodes of at most this size are compared by one product.
TILE = 256
NAMES = ("f0", "f1", "f2", "f3")
CELL = ("key", "p", "q")


def fingerprint(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Four words of SimHash over the word shingles of a whole text; no words give zeros.

    A-Z are lower-cased, words end at white space of ASCII. A bit is set if it is set in more than
    half of the hashes, repeats counted. Fewer words than ``width`` make one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(WORDS, np.uint64)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(shingles), 16_384):
        part = shingles[at : at + 16_384]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), "<u8", len(part))
        # The further words come from the first by the mixing steps of splitmix64.
        mixed = hashes[:, None] + STEP * np.arange(WORDS, dtype="<u8")
        mixed[:, 1:] = (mixed[:, 1:] ^ mixed[:, 1:] >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed[:, 1:] = (mixed[:, 1:] ^ mixed[:, 1:] >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        mixed[:, 1:] ^= mixed[:, 1:] >> np.uint64(31)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")


def with_words(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, f0, f1, f2, f3); null and empty texts give zeros."""

    def add(batches):
        for batch in batches:
            rows = [fingerprint(t.as_py()) for t in batch.column(1)]
            words = np.array(rows, np.uint64).reshape(-1, WORDS).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(words[:, n])) for n in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in NAMES)
    return docs.select("doc_id", "text").mapInArrow(add, schema)


def small_nodes(values: np.ndarray, pairs: list, most: int = FIRST, tile: int = TILE):
    """Pairs of trie nodes (from, to, from, to) of at most ``tile`` values that the budget allows.

    ``values`` (unsigned) ascend within each node of ``pairs``. Nodes of more equal values than
    that are halved by position.
    """
    state = np.array(pairs, np.int64).reshape(-1, 4)
    state = np.hstack([state, np.zeros((len(state), 1), np.int64)])
    bit = 63
    while True:
        done = (state[:, 1] - state[:, 0] <= tile) & (state[:, 3] - state[:, 2] <= tile)
        yield from state[done, :4].tolist()
        state = state[~done]
        if not len(state):
            return
        a, b, c, d, off = state.T
        if bit >= 0:
            ones = np.concatenate(
                [[0], np.cumsum(values >> np.uint64(bit) & np.uint64(1), dtype=np.int64)]
            )
            ab, cd = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        else:
            ab, cd = (a + b) // 2, (c + d) // 2
        same, differs = a == c, int(bit >= 0)
        state = np.concatenate(
            [
                np.stack([a, ab, c, cd, off], 1),
                np.stack([ab, b, cd, d, off], 1),
                np.stack([a, ab, cd, d, off + differs], 1),
                np.stack([ab, b, c, cd, off + differs], 1)[~same],
            ]
        )
        full = (state[:, 1] > state[:, 0]) & (state[:, 3] > state[:, 2])
        state = state[full & (state[:, 4] <= most)]
        bit -= 1


def connected(words: np.ndarray, node: tuple) -> np.ndarray:
    """Smallest position reachable from each row of ``words`` over links within a pair of nodes."""
    first = np.ascontiguousarray(words[:, 0])
    low = np.arange(len(words))
    for a, b, c, d in small_nodes(first, [node]):
        if (low[a:b] == low[a]).all() and (low[c:d] == low[a]).all():
            continue
        near = np.bitwise_count(first[a:b, None] ^ first[None, c:d]) <= FIRST
        if a == c:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = i + a, j + c
        apart = low[i] != low[j]
        i, j = i[apart], j[apart]
        close = np.bitwise_count(words[i] ^ words[j]).sum(1, dtype=np.int64) <= BITS
        i, j = low[i[close]], low[j[close]]
        if len(i):
            labels, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            to = np.arange(len(words))
            to[labels] = labels[forest(at[: len(i)], at[len(i) :], len(labels))]
            low = to[low]
    return low


def _cell_links(batches):
    """Spanning links of each cell; rows arrive sorted by cell, share and first word."""

    def links(table):
        keys = np.stack([table.column(k).to_numpy() for k in CELL])
        share, names = table.column("share").to_numpy(), table.column("node").to_numpy()
        words = np.stack([table.column(n).to_numpy() for n in NAMES], 1).view(np.uint64)
        edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = np.concatenate([[0], edge, [len(names)]]).tolist()
        ends = [np.empty((2, 0), np.int64)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            n = hi - lo
            if n < 2:
                continue
            if keys[1, lo] == keys[2, lo]:
                node = (0, n, 0, n)
            else:
                mid = int(np.searchsorted(share[lo:hi], keys[2, lo]))
                if mid in (0, n):
                    continue
                node = (0, mid, mid, n)
            low = connected(words[lo:hi], node)
            own = np.flatnonzero(low != np.arange(n))
            ends.append(np.stack([names[lo + own], names[lo + low[own]]]))
        a, b = np.concatenate(ends, 1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < LARGE:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([table.column(k).to_numpy() for k in CELL])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(cuts):
            yield links(table.slice(0, int(cuts[-1])))
            held = table.slice(int(cuts[-1])).to_batches()
            rows = sum(x.num_rows for x in held)
    if rows:
        yield links(pa.Table.from_batches(held).combine_chunks())


def links(nodes: DataFrame, large: int = LARGE) -> DataFrame:
    """Distinct fingerprints (node, f0 .. f3) to links (a, b) of nodes that connect all linked ones.

    Each cell returns spanning links only, at most one for a fingerprint.
    """
    cells = []
    for at in range(0, 64, BLOCK_BITS):
        block = F.shiftrightunsigned("f0", at).bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
        block += (at // BLOCK_BITS) << BLOCK_BITS
        cells += [block, *(block.bitwiseXOR(F.lit(1 << n)) for n in range(BLOCK_BITS))]
    keys = F.array(*cells)
    # There are 4 x 65,536 keys at most, whatever the input.
    hot = nodes.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    hot = settle(hot.where(F.col("n") > large), "hot")
    dealt = nodes.select("node", *NAMES, F.explode(keys).alias("key")).join(hot, "key", "left")
    shares = F.ceil(F.coalesce("n", F.lit(1)) / large).cast("int")
    share = F.pmod(F.xxhash64("node"), shares).cast("int")
    dealt = dealt.withColumn("share", share).withColumn(
        "o", F.explode(F.sequence(F.lit(0), shares - 1))
    )
    dealt = dealt.select(
        "key", F.least("share", "o").alias("p"), F.greatest("share", "o").alias("q"), "share", "node", *NAMES
    )
    place = F.col("f0").bitwiseXOR(F.lit(-(1 << 63)))
    dealt = dealt.repartition(*CELL).sortWithinPartitions(*CELL, "share", place)
    return dealt.mapInArrow(_cell_links, "a long, b long").distinct()


def near_texts(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """Documents (doc_id, text) to rows (doc_id, component_id), one for each row.

    ``component_id`` is the smallest doc_id among the documents reachable over links, the document
    itself included. Equal fingerprints are one node, so groups of copies of any size cost one.
    Null and empty texts are equal. A row without doc_id links like any other, but names no
    component; a component of such rows alone has a null id.
    """
    rows = settle(with_words(docs), "words")
    nodes = rows.groupBy(*NAMES).agg(F.min("doc_id").alias("least"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "texts")
    roots = components(links(nodes.select("node", *NAMES), large))
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(named, "root").select(*NAMES, "component_id")
    return rows.join(named, list(NAMES)).select("doc_id", "component_id")
