"""Packing documents into sequences of a fixed number of tokens, by minimum bin slack.

Texts are encoded where they are read; only documents longer than a sequence are cut. What the
packing needs is how many pieces there are of each length, a table of at most ``capacity`` rows
whatever the corpus. Bin by bin, the longest length left is completed by the combination of
available lengths that leaves the least slack, found by subset sums over bitsets; it is then
removed. A combination stays the fullest while all of its lengths last, so it is removed as often
as they allow at once: the number of combinations depends on the capacity, not on the corpus.
Pieces then find their sequence by their number within their length.
"""

import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.llm import bpe
from gaugelake.llm.segments import portions
from gaugelake.settle import settle

CAPACITY = 2048


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths and how often each is taken so that their sum is the largest up to ``room``.

    ``lengths`` descend. A bitset holds the sums that can be reached; after each length the sums
    before are kept, so that the way back is read off.
    """
    mask, sums = (1 << room + 1) - 1, [1]
    for length in lengths:
        reach = sums[-1]
        left = min(counts[length], room // length)
        step = 1
        # Each power of two once, and the rest: any number up to ``left``.
        while left:
            step = min(step, left)
            reach |= reach << step * length & mask
            left -= step
            step *= 2
        sums.append(reach)
        if reach >> room:
            break
    at, taken = sums[-1].bit_length() - 1, []
    for length, (before, _) in zip(reversed(lengths[: len(sums) - 1]), reversed(list(pairwise(sums))), strict=True):
        n = 0
        while not before >> at & 1:
            at -= length
            n += 1
        if n:
            taken.append((length, n))
    return taken


def combinations(histogram: dict[int, int], capacity: int = CAPACITY):
    """Bins of one kind after another: how many, and the lengths in each with their numbers."""
    counts = {length: n for length, n in histogram.items() if n}
    while counts:
        lengths = sorted(counts, reverse=True)
        first = lengths[0]
        counts[first] -= 1
        room = capacity - first
        near = [x for x in lengths if x <= room and counts[x]]
        taken = dict(fullest(near, counts, room))
        counts[first] += 1
        taken[first] = taken.get(first, 0) + 1
        times = min(counts[length] // n for length, n in taken.items())
        for length, n in taken.items():
            counts[length] -= times * n
            if not counts[length]:
                del counts[length]
        yield times, sorted(taken.items(), reverse=True)


def places(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length, rows (first number, in a bin, first sequence, offset) by ascending number.

    Pieces of a length are numbered; those from a row's first number on go to its sequences, so
    many to each, one after another from the offset on.
    """
    used, sequence, found = dict.fromkeys(histogram, 0), 0, {length: [] for length in histogram}
    for times, taken in combinations(histogram, capacity):
        offset = 0
        for length, n in taken:
            found[length].append((used[length], n, sequence, offset))
            used[length] += times * n
            offset += n * length
        sequence += times
    return {length: np.array(rows, np.int64) for length, rows in found.items() if rows}


def pieces(docs: DataFrame, tokenizer: str, lower: bool, end: int, capacity: int, with_ids: bool) -> DataFrame:
    """A written table of documents' pieces, numbered within their length and part of the table.

    Columns: doc_id, piece, start, length, ids_crc32, part, nth (and ids, 32-bit little-endian).
    """
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"
    if with_ids:
        schema += ", ids binary"

    def run(batches):
        encoder = bpe.file_encoder(tokenizer, lower)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at, count in portions(batch.column(1)):
                some = batch.slice(at, count)
                ids, marks = encoder.encode_column(some.column(1))
                ids = np.insert(ids, marks[1:], np.uint32(end)).astype("<u4")
                sizes = np.diff(marks) + 1
                cuts = -(-sizes // capacity)
                owner = np.repeat(np.arange(count), cuts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(sizes[owner] - start, capacity)
                first = np.cumsum(length) - length
                # The number of each piece among those of its length so far.
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                new = np.append(True, ordered[1:] != ordered[:-1])
                begins = np.flatnonzero(new)[np.cumsum(new) - 1]
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - begins + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                spans = [ids[a : a + n].tobytes() for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                arrays = [
                    some.column(0).take(pa.array(owner)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()),
                    pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                    pa.array(np.full(len(owner), part), pa.int32()),
                    pa.array(nth),
                ]
                if with_ids:
                    arrays.append(pa.array(spans, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in schema.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return settle(rows.mapInArrow(run, schema), "pieces")


def packed(
    docs: DataFrame,
    tokenizer: str,
    lower: bool = True,
    end: int = 0,
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Documents (doc_id, text) to pieces with their place in sequences of at most ``capacity`` ids.

    Columns: doc_id, piece, start (ids of the document before it), length, ids_crc32, sequence_id,
    offset (and ids). Each document is its ids and ``end``; null and empty texts are one end id.
    Only longer documents are cut. Sequences are filled from offset 0 without gaps. Which of the
    pieces of one length goes where follows their order in the table. Repeated rows are packed
    each; a null doc_id stays null. An empty table has no pieces. Other columns are left out.
    ``lower`` is for vocabularies that lower-case texts and drop white space.
    """
    spark = docs.sparkSession
    rows = pieces(docs, tokenizer, lower, end, capacity, with_ids)
    parts = settle(rows.groupBy("part", "length").agg(F.count("*").alias("size")), "pieces-parts")
    # At most ``capacity`` rows: one for each length.
    sizes = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("size").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(sizes, capacity))
    before = F.sum("size").over(Window.partitionBy("length").orderBy("part")) - F.col("size")
    numbered = rows.join(parts.select("part", "length", before.alias("before")), ["part", "length"])
    numbered = numbered.withColumn("nth", F.col("nth") + F.col("before"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    numbered = numbered.select(*kept, "nth")
    schema = numbered.drop("nth").selectExpr("*", "0L as sequence_id", "0L as offset").schema

    def run(batches):
        of = table.value
        for batch in batches:
            length, nth = batch.column(3).to_numpy(), batch.column(len(kept)).to_numpy()
            sequence, offset = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            order = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in pairwise(bounds.tolist()):
                own = order[a:b]
                size = int(length[own[0]])
                first, each, base, begin = of[size][np.searchsorted(of[size][:, 0], nth[own], "right") - 1].T
                past, inside = np.divmod(nth[own] - first, each)
                sequence[own], offset[own] = base + past, begin + inside * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"]
            )

    return numbered.mapInArrow(run, schema)


def sequences(rows: DataFrame) -> DataFrame:
    """Pieces with ids to whole sequences: rows (sequence_id, length, ids)."""
    items = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = rows.groupBy("sequence_id").agg(F.sum("length").alias("length"), items.alias("items"))
    ids = F.expr("aggregate(items, cast('' as binary), (a, i) -> concat(a, i.ids))")
    return whole.select("sequence_id", "length", ids.alias("ids"))
