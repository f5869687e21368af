"""SimHash fingerprints, and near-duplicates by a self-join of a binary trie.

The distinct fingerprints are dealt out by pigeonhole: of three blocks of bits, two
fingerprints that differ in at most two bits share one. Within a block value a binary trie is
joined with itself: pairs of trie nodes descend together, one bit a level, the differing bits
are added up, and a pair is dropped as soon as it exceeds the budget. Block values with very
many fingerprints are split once more into pairs of sub-tries, so no task holds such a block.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.llm.components import components, forest
from gaugelake.settle import settle

SEED = 42
#: Bits two linked fingerprints may differ in; the three blocks are made for two.
BUDGET = 2
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: A block value with more fingerprints than this is dealt out as pairs of sub-tries.
LARGE = 20_000
#: Bits of the sub-tries.
SUB = 8
#: Rows that one traversal takes, unless a single bucket has more.
CHUNK = 20_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the word shingles of a whole text; texts without words give zero.

    A-Z are lower-cased; words end at white space of ASCII. A bit is set if it is set in more
    than half of the shingles' XXH64, repeats counted. Fewer words than ``width`` make one
    shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
    else:
        words = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(words), 65_536):
        part = words[at : at + 65_536]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), "<u8", len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(words), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint as a signed long; a column of that name is replaced.

    Null and empty texts have fingerprint zero.
    """
    docs = docs.drop(name)
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema

    def add(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            values = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values.view(np.int64))], [*batch.schema.names, name]
            )

    return docs.mapInArrow(add, schema)


def trie_pairs(values: np.ndarray, pairs: list, budget: int = BUDGET):
    """Positions (i, j) of values that differ in at most ``budget`` bits.

    ``values`` (unsigned) ascend and are distinct within each node of ``pairs``. A pair is
    (from, to, from, to): two nodes as ranges of positions, equal or disjoint.
    """
    state = np.array(pairs, dtype=np.int64).reshape(-1, 4)
    state = np.hstack([state, np.zeros((len(state), 1), np.int64)])
    found = [np.empty((0, 2), np.int64)]
    for bit in range(63, -1, -1):
        if not len(state):
            break
        ones = np.concatenate(
            [[0], np.cumsum(values >> np.uint64(bit) & np.uint64(1), dtype=np.int64)]
        )
        a, b, c, d, off = state.T
        ab, cd = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = a == c
        step = [
            np.stack([a, ab, c, cd, off], 1),
            np.stack([ab, b, cd, d, off], 1),
            np.stack([a, ab, cd, d, off + 1], 1),
            np.stack([ab, b, c, cd, off + 1], 1)[~same],
        ]
        state = np.concatenate(step)
        size, other = state[:, 1] - state[:, 0], state[:, 3] - state[:, 2]
        alone = (state[:, 0] == state[:, 2]) & (size < 2)
        state = state[(size > 0) & (other > 0) & ~alone & (state[:, 4] <= budget)]
        leaf = (state[:, 1] - state[:, 0] == 1) & (state[:, 3] - state[:, 2] == 1)
        ends = state[leaf][:, [0, 2]]
        found.append(ends[np.bitwise_count(values[ends[:, 0]] ^ values[ends[:, 1]]) <= budget])
        state = state[~leaf]
    return np.concatenate(found)


def _bucket_links(batches):
    """Links within each bucket; rows arrive sorted by bucket, sub-trie and fingerprint."""

    def links(table):
        keys = np.stack([table.column(k).to_numpy() for k in ("block", "value", "p", "q")])
        sub, fps = table.column("sub").to_numpy(), table.column("fp").to_numpy()
        edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        bounds = np.concatenate([[0], edge, [len(fps)]])
        nodes = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            p, q = keys[2, lo], keys[3, lo]
            if p == q:
                nodes.append((lo, hi, lo, hi))
            else:
                mid = lo + int(np.searchsorted(sub[lo:hi], q))
                nodes.append((lo, mid, mid, hi))
        found = trie_pairs(fps.view(np.uint64), nodes)
        low = forest(found[:, 0], found[:, 1], len(fps))
        own = np.flatnonzero(low != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[own]), pa.array(fps[low[own]])], ["a", "b"])

    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([table.column(k).to_numpy() for k in ("block", "value", "p", "q")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if len(cuts):
            yield links(table.slice(0, int(cuts[-1])))
            held = table.slice(int(cuts[-1])).to_batches()
            rows = sum(x.num_rows for x in held)
    if rows:
        yield links(pa.Table.from_batches(held).combine_chunks())


def links(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect all pairs within the budget.

    Returned are spanning links of what each task has found, at most one for a fingerprint
    and bucket, with the same components as all pairs have.
    """
    dealt = fps.select(
        "fp",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(n).alias("block"),
                        F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1).alias("value"),
                        F.shiftrightunsigned("fp", (at + bits) % 64)
                        .bitwiseAND((1 << SUB) - 1)
                        .cast("int")
                        .alias("sub"),
                    )
                    for n, (at, bits) in enumerate(BLOCKS)
                )
            )
        ).alias("x"),
    ).select("fp", "x.*")
    counts = dealt.groupBy("block", "value").agg(F.count("*").alias("n")).where("n > 1")
    dealt = dealt.join(counts, ["block", "value"])
    near = F.filter(
        F.sequence(F.lit(0), F.lit((1 << SUB) - 1)),
        lambda y: F.bit_count(F.col("sub").bitwiseXOR(y)) <= BUDGET,
    )
    other = F.explode(F.when(F.col("n") > large, near).otherwise(F.array(F.col("sub"))))
    dealt = dealt.withColumn("o", other)
    whole = F.col("n") <= large
    dealt = dealt.select(
        "block",
        "value",
        F.when(whole, 0).otherwise(F.least("sub", "o")).alias("p"),
        F.when(whole, 0).otherwise(F.greatest("sub", "o")).alias("q"),
        F.when(whole, 0).otherwise(F.col("sub")).alias("sub"),
        F.col("fp"),
        F.col("fp").bitwiseXOR(F.lit(-(1 << 63))).alias("place"),
    )
    keys = ["block", "value", "p", "q"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "sub", "place")
    return dealt.mapInArrow(_bucket_links, "a long, b long")


def near_duplicates(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """Documents (doc_id, text) to rows (doc_id, fingerprint, component_id), one for each row.

    ``component_id`` is the smallest doc_id among the documents reachable over fingerprints
    that differ in at most two bits, the document itself included. Equal fingerprints are one
    node, so groups of copies of any size cost one. A row without doc_id is returned and links
    like any other, but names no component; a component of such rows alone has a null id.
    """
    rows = settle(
        with_fingerprint(docs.select("doc_id", "text"), name="fp").select("doc_id", "fp"), "fps"
    )
    nodes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), large))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(named, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    ``groups`` gives each row's ``component_id``; ``near_texts.near_texts`` is the one for similar
    texts. All columns are kept. Of repeated rows of one doc_id, one stays. Rows without doc_id can't
    be told apart and stay.
    """
    found = groups(docs.where("doc_id is not null"))
    kept = settle(found.where("doc_id = component_id").select("doc_id").distinct(), "kept")
    # The rows travel as one column, so that theirs can have any names.
    rows = docs.where("doc_id is not null").select(
        "doc_id", F.struct("*").alias("row"), F.col("text").alias("tie")
    )
    named = rows.join(kept, "doc_id", "left_semi")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("tie"))
    named = named.withColumn("place", order).where("place = 1")
    named = named.select(*(F.col("row").getField(n).alias(n) for n in docs.columns))
    return named.unionByName(docs.where("doc_id is null"))
