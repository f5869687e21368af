"""Exact removal of repeated byte strings by suffix arrays over shards.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller
doc_id. Comparing all suffixes of a corpus in one place is out of the question, so strings that
may be equal are brought together first, without loss:

1. Each 50-byte string is named by its smallest 20-byte gram (by hash, the leftmost of equals).
   Equal strings have equal grams, so a string whose gram is in one document only is unique.
2. Around each gram that several documents hold, the strings it names are cut out as one context
   of at most 80 bytes. Equal contexts are one row with the smallest doc_id; copies cost nothing
   further.
3. A gram with a single context has equal strings only, and nothing is left to compare.
   Contexts of all other grams are dealt to shards by gram, and those that differ from all
   others on both sides of the gram are done with. A shard sorts the suffixes of its other
   contexts by external induced sorting; runs of suffixes whose common prefix is at least 50
   are equal strings, and the smallest doc_id of a run is told to all of its contexts. A gram
   with very many contexts would be too much for one shard: the strings of its contexts are
   dealt out one by one, by gram and a hash of the whole string, and compared by an aggregation.
4. The strings with a smaller doc_id go back to their documents as spans.

Up to step 3, a context is known by two 64-bit hashes, of its gram and of its bytes, and by one
place where it stands; its bytes are read there when a shard needs them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import suffixes
from gaugelake.settle import settle

#: Bytes of a string that counts, and of a gram.
LENGTH, GRAM = 50, 20
#: Grams in a string.
SPAN = LENGTH - GRAM + 1
#: Bytes that a string holds on one side of its gram at least.
HALF = (LENGTH - GRAM) // 2
#: Bytes of documents that are hashed at once, and tuples that a shard's queues hold in memory.
CHUNK, MEMORY = 1 << 16, 1 << 22
#: Bytes of contexts that a task sorts at once (a gram's contexts stay together).
SHARD = 4 << 20
#: A gram with more contexts than this (of 80 bytes each at most) isn't sorted in one shard.
MANY = 1 << 14

_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A place is one number: first string, further strings (below 32), and bits of the text's hash.
SIZE_BITS, TIE_BITS = 5, 24


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial of each 20-byte gram, by doubling."""
    h, power, four = _TABLE[data], _ODD, None
    for size in (1, 2, 4, 8):
        h = h[:-size] * power + h[size:]
        with np.errstate(over="ignore"):
            power = power * power
        if size == 2:
            four, of_four = h, power
    return h[: len(data) - GRAM + 1] * of_four + four[16 : 16 + len(data) - GRAM + 1]


def anchors(texts: list[bytes], with_contexts: bool):
    """Grams that name strings: number of the text, hash, first and last string.

    Strings are numbered by the byte they start with. With contexts, also a hash of the bytes
    from the first string to the end of the last.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    value = gram_hashes(data)
    # Order in the high half and place in the low one: the smallest is the leftmost of equals.
    least = (value * _ODD) >> np.uint64(32) << np.uint64(32)
    least |= np.arange(len(value), dtype=np.uint64)
    width = 1
    while width < SPAN:
        step = min(width, SPAN - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(place[1:] != place[:-1]) + 1
    first = np.concatenate([[0], new])
    last = np.concatenate([new, [len(place)]]) - 1
    place = place[first]
    # A gram may name strings of two texts, or strings across the end of a text.
    owner = np.searchsorted(ends, place, "right")
    begin = (ends - sizes)[owner]
    first = np.maximum(first, begin)
    last = np.minimum(last, ends[owner] - LENGTH)
    kept = np.flatnonzero((first <= last) & (place + GRAM <= ends[owner]))
    owner, first, last, begin = owner[kept], first[kept], last[kept], begin[kept]
    found = [owner, _mixed(value[place[kept]]), first - begin, last - begin]
    if with_contexts:
        powers = np.full(len(data) + 1, _ODD)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        back = np.full(len(data) + 1, _INVERSE)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * powers[:-1], out=sums[1:])
        whole = (sums[last + LENGTH] - sums[first]) * back[first]
        found.append(_mixed(whole + (last - first).astype(np.uint64)))
    return found


def _anchors(docs: DataFrame, with_contexts: bool) -> DataFrame:
    """Documents (k, tie, data) to rows (h, k), or (h, k, place, x) with the context's hash."""

    def rows(keys, ties, texts):
        found = anchors(texts, with_contexts)
        owner, h, first, last = found[:4]
        columns = [pa.array(h.view(np.int64)), pa.array(np.array(keys, np.int64)[owner])]
        names = ["h", "k"]
        if with_contexts:
            place = (first << SIZE_BITS | last - first) << TIE_BITS | np.array(ties)[owner]
            columns += [pa.array(place), pa.array(found[4].view(np.int64))]
            names += ["place", "x"]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        keys, ties, texts, size = [], [], [], 0
        for batch in batches:
            for k, tie, data in zip(*batch.columns, strict=True):
                data = data.as_py()
                if len(data) < LENGTH:
                    continue
                keys.append(k.as_py())
                ties.append(tie.as_py())
                texts.append(data)
                size += len(data)
                if size >= CHUNK:
                    yield rows(keys, ties, texts)
                    keys, ties, texts, size = [], [], [], 0
        if texts:
            yield rows(keys, ties, texts)

    schema = "h long, k long" + (", place long, x long" if with_contexts else "")
    return docs.select("k", "tie", "data").mapInArrow(run, schema)


def _contexts(found: DataFrame) -> DataFrame:
    """Documents (tie, data, wanted) to the contexts wanted of them: (h, x, least, context)."""

    def run(batches):
        for batch in batches:
            h, x, least, contexts = [], [], [], []
            for tie, data, wanted in zip(*batch.columns, strict=True):
                tie, data = tie.as_py(), data.as_py()
                for want in wanted.as_py():
                    place = want["place"]
                    if place & (1 << TIE_BITS) - 1 != tie:
                        continue
                    place >>= TIE_BITS
                    first, size = place >> SIZE_BITS, place & (1 << SIZE_BITS) - 1
                    h.append(want["h"])
                    x.append(want["x"])
                    least.append(want["k"])
                    contexts.append(data[first : first + size + LENGTH])
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip((h, x, least, contexts), kinds, strict=True)],
                ["h", "x", "least", "context"],
            )

    schema = "h long, x long, least long, context binary"
    return found.select("tie", "data", "wanted").mapInArrow(run, schema)


def may_match(h: np.ndarray, contexts: list[bytes]) -> np.ndarray:
    """Which contexts may share a string with another one of their gram.

    A string holds, beside the gram, at least ``HALF`` bytes before or after it. A context that
    shares neither these bytes before nor those after with another one shares no string. All
    contexts of a gram must be given together.
    """
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    value = _mixed(gram_hashes(data)).view(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(value)]
    place = np.flatnonzero(value[: len(owner)] == h[owner])
    place = place[place + GRAM <= ends[owner[place]]]
    of = owner[place]
    # Where the gram stands more than once, the context is kept, and others may match it at
    # any of these places.
    kept = np.bincount(of, minlength=len(sizes)) != 1
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    for at, whole in (
        (place - HALF, place - HALF >= (ends - sizes)[of]),
        (place + GRAM, place + GRAM + HALF <= ends[of]),
    ):
        own, at = of[whole], at[whole]
        first, second = (words[at + n].view("<u8").ravel() for n in (0, HALF - 8))
        key = _mixed(_mixed(first) + second * _ODD) ^ h[own].view(np.uint64)
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        kept[own[count[inverse] > 1]] = True
    return kept


def sources(contexts: list[bytes], least: np.ndarray, memory: int = MEMORY) -> list[np.ndarray]:
    """For each context and each string in it, the smallest of ``least`` over equal strings."""
    if not contexts:
        return []
    sizes = np.array([len(c) for c in contexts]) + 1
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"\0".join(contexts) + bytes(suffixes.END), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    out = [np.zeros(n - LENGTH, np.int64) for n in sizes.tolist()]
    flat = np.zeros(len(owner), np.int64)
    low = suffixes.CAP
    places, groups = [], []
    number = 0
    for order, shared in suffixes.suffixes(text, memory):
        order, shared = order[order < len(owner)], shared[order < len(owner)]
        # Only suffixes that hold a whole string count; a break may be at one that doesn't.
        whole = order - starts[owner[order]] + LENGTH < sizes[owner[order]]
        own = np.flatnonzero(whole)
        if not len(own):
            low = min(low, int(shared.min(initial=suffixes.CAP)))
            continue
        cuts = np.concatenate([[0], own + 1])
        tail = cuts[-1] == len(shared)
        between = np.minimum.reduceat(shared, cuts[:-1] if tail else cuts)
        between[0] = min(between[0], low)
        low = suffixes.CAP if tail else int(between[-1])
        group = number + np.cumsum(between[: len(own)] < LENGTH)
        number = int(group[-1])
        places.append(order[own])
        groups.append(group)
    if places:
        places, groups = np.concatenate(places), np.concatenate(groups)
        heads = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1))
        smallest = np.minimum.reduceat(least[owner[places]], heads)
        flat[places] = np.repeat(smallest, np.diff(np.append(heads, len(groups))))
    return [flat[s : s + len(o)] for s, o in zip(starts.tolist(), out, strict=True)]


def _told(contexts: DataFrame) -> DataFrame:
    """Contexts (h, x, least, context), together by h, to rows (h, x, runs of smaller sources)."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32()), ("source", pa.int64())]))

    def shard(rows):
        h, x, least, context = (list(c) for c in zip(*rows, strict=True))
        kept = np.flatnonzero(may_match(np.array(h), context)).tolist()
        out = ([], [], [])
        compared = sources([context[n] for n in kept], np.array(least)[kept])
        for n, found in zip(kept, compared, strict=True):
            cuts = np.flatnonzero(np.diff(found)) + 1
            bounds = [0, *cuts.tolist(), len(found)]
            runs = [
                {"at": a, "to": b, "source": int(found[a])}
                for a, b in zip(bounds[:-1], bounds[1:], strict=True)
                if found[a] < least[n]
            ]
            if runs:
                for column, value in zip(out, (h[n], x[n], runs), strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), kind]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["h", "x", "runs"]
        )

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD and row[0] != rows[-1][0]:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield shard(rows)

    schema = "h long, x long, runs array<struct<at: int, to: int, source: long>>"
    dealt = contexts.repartition("h").sortWithinPartitions("h", "x")
    return dealt.select("h", "x", "least", "context").mapInArrow(run, schema)


def string_hashes(contexts: list[bytes]):
    """The strings of contexts: number of the context, place in it, and hash of the 50 bytes."""
    sizes = np.array([len(c) for c in contexts])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    value = gram_hashes(data)
    # Three grams cover a string.
    count = len(data) - LENGTH + 1
    whole = np.zeros(count, np.uint64)
    for n in (0, HALF, LENGTH - GRAM):
        whole = _mixed(whole * _ODD + value[n : n + count])
    strings = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(sizes)), strings)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
    return owner, at, whole[(np.cumsum(sizes) - sizes)[owner] + at]


def _told_by_string(contexts: DataFrame) -> DataFrame:
    """As ``_told``, with the strings of a gram in as many tasks as there are.

    Strings that contexts of one document hold only are dropped by an aggregation, so what is
    joined is what repeats.
    """

    def run(batches):
        for batch in batches:
            for n in range(0, batch.num_rows, 4096):
                h, x, least, context = batch.slice(n, 4096).columns
                owner, at, s = string_hashes(context.to_pylist())
                own = [pa.array(c.to_numpy()[owner]) for c in (h, x, least)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(at, pa.int32()), pa.array(s.view(np.int64))],
                    ["h", "x", "least", "at", "s"],
                )

    schema = "h long, x long, least long, at int, s long"
    strings = contexts.select("h", "x", "least", "context").mapInArrow(run, schema)
    strings = settle(strings, "strings")
    several = strings.groupBy("h", "s").agg(F.min("least").alias("source"), F.max("least").alias("b"))
    several = several.where("source < b").drop("b")
    found = strings.join(several, ["h", "s"]).where("source < least")
    one = F.struct("at", (F.col("at") + 1).alias("to"), "source")
    return found.select("h", "x", F.array(one).alias("runs"))


def with_spans(docs: DataFrame, many: int = MANY) -> DataFrame:
    """Documents (doc_id, text) to rows (doc_id, data, spans): bytes, and spans that go.

    ``spans`` (start, end) may overlap and may be null. Null texts are empty. A null doc_id is
    smaller than any other; rows with equal doc_ids take nothing from each other. Every row
    comes back.
    """
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"),
        F.coalesce("text", F.lit("")).cast("binary").alias("data"),
    )
    docs = docs.withColumn("tie", F.xxhash64("data").bitwiseAND(F.lit((1 << TIE_BITS) - 1)))
    several = _anchors(docs, False).groupBy("h").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    several = settle(several.where("a < b").select("h"), "grams")
    shared = settle(_anchors(docs, True).join(several, "h"), "anchors")
    own = F.min(F.struct("k", "place")).alias("own")
    distinct = shared.groupBy("h", "x").agg(own).select("h", "x", "own.*")
    distinct = settle(distinct, "contexts")
    counts = settle(distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "counts")

    def cut(grams):
        wanted = distinct.join(grams.select("h"), "h").groupBy(F.col("k").alias("of")).agg(
            F.collect_list(F.struct("h", "x", "k", "place")).alias("wanted")
        )
        return _contexts(docs.join(wanted, F.col("k") == F.col("of")))

    few = counts.where(F.col("n") <= many)
    compared = settle(_told(cut(few)), "compared")
    if not counts.where(F.col("n") > many).isEmpty():
        hot = settle(_told_by_string(cut(counts.where(F.col("n") > many))), "compared")
        compared = compared.unionByName(hot)
    # Within a context, all copies take from the smallest doc_id that holds it.
    size = F.shiftright("place", TIE_BITS).bitwiseAND(F.lit((1 << SIZE_BITS) - 1)).cast("int")
    run = F.struct(F.lit(0).alias("at"), (size + 1).alias("to"), F.col("k").alias("source"))
    told = distinct.select("h", "x", F.array(run).alias("runs")).unionByName(compared)
    gone = shared.join(told, ["h", "x"]).select("k", "place", F.explode("runs").alias("r"))
    first = F.shiftright("place", TIE_BITS + SIZE_BITS)
    gone = gone.where("r.source < k").groupBy(
        F.col("k").alias("of"), F.col("place").bitwiseAND(F.lit((1 << TIE_BITS) - 1)).alias("of_tie")
    )
    gone = gone.agg(
        F.collect_list(
            F.struct(
                (first + F.col("r.at")).alias("start"),
                (first + F.col("r.to") + (LENGTH - 1)).alias("end"),
            )
        ).alias("spans")
    )
    same = (F.col("k") == F.col("of")) & (F.col("tie") == F.col("of_tie"))
    return docs.join(settle(gone, "spans"), same, "left").select("doc_id", "data", "spans")


def deduplicated(docs: DataFrame, many: int = MANY) -> DataFrame:
    """Documents (doc_id, text) to what is left of each.

    Columns: doc_id, n_bytes, n_removed, n_spans (runs of removed bytes), kept (the remaining
    bytes; a cut may fall within a character). See ``with_spans`` for rows with nulls.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for doc_id, data, spans in zip(*batch.columns, strict=True):
                data = data.as_py()
                merged = []
                for s in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                parts, at = [], 0
                for a, b in merged:
                    parts.append(data[at:a])
                    at = b
                kept = b"".join([*parts, data[at:]])
                row = (doc_id.as_py(), len(data), len(data) - len(kept), len(merged), kept)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return with_spans(docs, many).mapInArrow(run, schema)


#: The removal in DuckDB's SQL: all strings of 50 bytes, as hex digits, by their first document.
SQL = f"""
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
parts as (
  select doc_id, lo, substr(h, 2 * lo + 1, 2 * (256 + {LENGTH - 1})) as part
  from (select doc_id, h, unnest(range(0, length(h) // 2, 256)) as lo from texts) w),
strings as (
  select doc_id, lo + j as i, substr(part, 2 * j + 1, {2 * LENGTH}) as s
  from (select doc_id, lo, part, unnest(range(0, length(part) // 2 - {LENGTH - 1})) as j from parts) w),
firsts as (select s, min(doc_id) as first from strings group by s having min(doc_id) < max(doc_id)),
starts as (
  select doc_id, i, lag(i) over (partition by doc_id order by i) as before
  from strings join firsts using (s) where first < doc_id),
runs as (
  select doc_id, min(i) as a, max(i) + {LENGTH} as b, row_number() over (partition by doc_id order by min(i)) as nth
  from (select *, sum(case when before is null or i > before + {LENGTH} then 1 else 0 end)
      over (partition by doc_id order by i) as run from starts) r
  group by doc_id, run),
removed as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(nth) as last from runs group by doc_id),
kept as (
  select r.doc_id, string_agg(substr(h, 2 * coalesce(p.b, 0) + 1, 2 * (r.a - coalesce(p.b, 0))), '' order by r.nth)
    || substr(any_value(h), 2 * max(r.b) + 1) as h
  from runs r join texts t on t.doc_id = r.doc_id left join runs p on p.doc_id = r.doc_id and p.nth = r.nth - 1
  group by r.doc_id)
select t.doc_id, length(t.h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(k.h, t.h))) as kept_sha256
from texts t left join removed m on m.doc_id = t.doc_id left join kept k on k.doc_id = t.doc_id
"""
