"""Token ids in files: Simple-8b words, in the order of the documents.

A file row holds whole documents that follow one another: their ids, packed, and their doc_ids
and lengths. The packed form is self-contained (all little-endian):

    4 bytes "S8B1" | uint32 ids, words, escapes
    uint32 x blocks: the id with which each block of ``BLOCK`` words begins
    uint32 x escapes: positions | uint64 x escapes: values
    uint64 x words: selector in the top 4 bits, ids from the low end of the other 60

Values of 2^60 and more are escapes and packed as 0. All words of a selector are unpacked in one
step, and the block offsets let a reader start in the middle.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.llm import bpe
from gaugelake.llm.segments import portions
from gaugelake.settle import fresh_path

#: Ids in a word and bits of each, by selector; fixed values of the Simple-8b code.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BLOCK = 1024
#: A file row is closed once it holds so many ids.
ROW = 1 << 18


def _choose(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and selector of each word; values below 2^60, padded by 240 zeros."""
    size = len(values) - 240
    widths = np.frexp(values.astype(np.float64))[1].astype(np.int8)  # 53 bits of accuracy
    large = values >= 1 << 52
    if large.any():
        widths[large] = [int(v).bit_length() for v in values[large]]
    best = np.full(size, 15, np.int8)
    widest, span = widths, 1
    for selector in range(14, -1, -1):
        while span < COUNTS[selector]:
            step = min(span, int(COUNTS[selector]) - span)
            widest = np.maximum(widest[: len(widest) - step], widest[step:])
            span += step
        best[widest[:size] <= BITS[selector]] = selector
    # Words begin at 0 and wherever the word before ends. Jumps over 2, 4, ... words come by
    # doubling; only every 64th word is walked to.
    jumps = [np.append(np.minimum(np.arange(size) + COUNTS[best], size), size)]
    for _ in range(5):
        jumps.append(jumps[-1][jumps[-1]])
    far, walked, at = jumps[-1][jumps[-1]].tolist(), [], 0
    while at < size:
        walked.append(at)
        at = far[at]
    starts = np.array(walked, dtype=np.int64)
    for over in reversed(jumps):
        starts = np.stack([starts, over[starts]], axis=1).ravel()
    starts = starts[starts < size]
    return starts, best[starts]


def pack(ids: np.ndarray) -> bytes:
    """Unsigned integers (up to 64 bits) to the packed form."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    escaped = np.flatnonzero(ids >> np.uint64(60))
    values = np.concatenate([ids, np.zeros(240, np.uint64)])
    values[escaped] = 0
    starts, selectors = _choose(values)
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors).tolist():
        if not BITS[selector]:
            continue
        own, steps = selectors == selector, np.arange(COUNTS[selector])
        shifted = values[starts[own, None] + steps] << (steps * BITS[selector]).astype(np.uint64)
        words[own] |= np.bitwise_or.reduce(shifted, axis=1)
    head = np.array([len(ids), len(words), len(escaped)], "<u4")
    return b"".join(
        (
            b"S8B1",
            head.tobytes(),
            starts[::BLOCK].astype("<u4").tobytes(),
            escaped.astype("<u4").tobytes(),
            ids[escaped].astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
        )
    )


def unpack(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of a packed form, or those from ``start`` to ``stop``."""
    if data[:4] != b"S8B1":
        raise ValueError("not a packed list of ids")
    count, size, escapes = np.frombuffer(data, "<u4", 3, 4).tolist()
    blocks = -(-size // BLOCK)
    at = 16
    firsts = np.frombuffer(data, "<u4", blocks, at)
    at += 4 * blocks
    places = np.frombuffer(data, "<u4", escapes, at)
    at += 4 * escapes
    escaped = np.frombuffer(data, "<u8", escapes, at)
    at += 8 * escapes
    words = np.frombuffer(data, "<u8", size, at)
    stop = count if stop is None else min(stop, count)
    if start >= stop:
        return np.empty(0, np.uint64)
    first = int(np.searchsorted(firsts, start, "right")) - 1
    last = int(np.searchsorted(firsts, stop))
    words, base = words[first * BLOCK : last * BLOCK], int(firsts[first])
    selectors = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[selectors])
    out = np.zeros(int(ends[-1]), np.uint64)
    for selector in np.unique(selectors).tolist():
        bits = int(BITS[selector])
        if not bits:
            continue
        own, steps = np.flatnonzero(selectors == selector), np.arange(COUNTS[selector])
        values = words[own, None] >> (steps * bits).astype(np.uint64) & np.uint64((1 << bits) - 1)
        out[(ends[own] - COUNTS[selector])[:, None] + steps] = values
    inside = (places >= base) & (places < base + len(out))
    out[places[inside].astype(np.int64) - base] = escaped[inside]
    return out[start - base : stop - base]


SCHEMA = "part int, seq int, n_ids long, doc_ids array<long>, lengths array<long>, data binary"


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 0) -> None:
    """Encode documents (doc_id, text) and write them to ``path`` in ascending doc_id order.

    ``end`` is the id after each document. Null and empty texts are one end id. Documents are
    dealt out by ranges of doc_id, and rows of one doc_id by a hash of the text, so that no id
    is a hot key; rows without doc_id come first. A task writes its range, so what a lost
    executor held is written again alike.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        encoder = bpe.file_encoder(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        names, lengths, held, size = [], [], [], 0

        def row():
            ids = np.concatenate(held)
            columns = ([part], [seq], [len(ids)], [names], [lengths], [pack(ids)])
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                ["part", "seq", "n_ids", "doc_ids", "lengths", "data"],
            )

        longs = pa.list_(pa.int64())
        kinds = [pa.int32(), pa.int32(), pa.int64(), longs, longs, pa.binary()]
        for batch in batches:
            for at, count in portions(batch.column(1), ROW):
                some = batch.slice(at, count)
                ids, places = encoder.encode_column(some.column(1))
                names += some.column(0).to_pylist()
                lengths += (np.diff(places) + 1).tolist()
                # One end id after each document.
                held.append(np.insert(ids, places[1:], np.uint32(end)))
                size += len(held[-1])
                if size >= ROW:
                    yield row()
                    names, lengths, held, size, seq = [], [], [], 0, seq + 1
        if names:
            yield row()

    rows.select("doc_id", "text").mapInArrow(run, SCHEMA).write.parquet(path)


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Documents of written files: doc_id, start, n_tokens and ids_crc32 (and their ids).

    ``start`` counts the ids of all documents before: a sum over the file rows of a range and
    one over the ranges, so only one row for each range meets in a task.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("size")
    sizes = sizes.select("part", before.alias("base"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    bases = files.select("part", "seq", "n_ids").withColumn("inner", inner).join(sizes, "part")
    bases = bases.select("part", "seq", (F.col("base") + F.col("inner")).alias("base"))
    schema = "part int, seq int, doc_id long, first long, n_tokens long, ids_crc32 long"
    if with_ids:
        schema += ", ids array<long>"

    def run(batches):
        for batch in batches:
            for part, seq, names, lengths, data in zip(*batch.columns, strict=True):
                ids = unpack(data.as_py()).astype("<u4")
                lengths = np.array(lengths.as_py(), np.int64)
                firsts = np.cumsum(lengths) - lengths
                spans = [ids[a : a + n] for a, n in zip(firsts.tolist(), lengths.tolist(), strict=True)]
                columns = [
                    pa.array([part.as_py()] * len(spans), pa.int32()),
                    pa.array([seq.as_py()] * len(spans), pa.int32()),
                    pa.array(names.as_py(), pa.int64()),
                    pa.array(firsts),
                    pa.array(lengths),
                    pa.array([zlib.crc32(s.tobytes()) for s in spans], pa.int64()),
                ]
                fields = ["part", "seq", "doc_id", "first", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([s.tolist() for s in spans], pa.list_(pa.int64())))
                    fields.append("ids")
                yield pa.RecordBatch.from_arrays(columns, fields)

    found = files.select("part", "seq", "doc_ids", "lengths", "data").mapInArrow(run, schema)
    found = found.join(bases, ["part", "seq"])
    more = ["ids"] if with_ids else []
    return found.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *more)


def written(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents to the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write(docs, path, tokenizer)
    return read(docs.sparkSession, path)
