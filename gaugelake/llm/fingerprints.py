"""Document fingerprints: a homomorphic multiset hash, in DataFrame functions.

A text is the multiset of its pieces (sentences, clauses, lines; see ``CUT``). Each piece is
hashed to a wide vector, and the fingerprint is the sum of the vectors, lane by lane, modulo
powers of two. The order of pieces doesn't matter, and adding or taking away a piece's vector
updates a fingerprint. The vector has two parts: ``WIDE`` dense lanes, which tell whether
two multisets are equal, and groups of sparse lanes, of which a piece touches one. How many
sparse lanes differ estimates how many pieces differ; each group holds a quarter of the
pieces of the group before it. The last one holds one of four million pieces, so that one of
them suits a text of any length that a string can have.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces end after these, and after words that end in e, so that no text is one long piece.
CUT = r"(?<=[.!?,;:|\n])|(?<=e )"
WIDE = 4
WIDE_BITS = 60
LANES = 32
LANE_BITS = 16
GROUPS = 12
#: Documents that are put in order together, and the most groups of them.
ROWS = 4096
MOST_BUCKETS = 10_000


def pieces(text: Column) -> Column:
    """Hashes of the pieces of a text; empty pieces don't count."""
    kept = F.filter(F.split(text, CUT), lambda p: p != "")
    return F.transform(kept, lambda p: F.xxhash64(p))


def _bits(value: Column, at: int, count: int) -> Column:
    return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << count) - 1))


def _total(hashes: Column, of, bits: int) -> Column:
    """Sum of ``of(hash)`` modulo a power of two."""
    mask = F.lit((1 << bits) - 1)
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (acc + of(h)).bitwiseAND(mask))


def vector(hashes: Column) -> Column:
    """The fingerprint of a multiset of piece hashes: dense lanes, then the sparse groups."""
    dense = F.array(
        *(
            _total(hashes, lambda h: _bits(F.xxhash64(h, F.lit(n)), 0, WIDE_BITS), WIDE_BITS)
            for n in range(WIDE)
        )
    )
    zeros = F.array_repeat(F.lit(0).cast("long"), LANES)
    groups = []
    for group in range(GROUPS):
        own = F.filter(hashes, lambda h: _bits(h, 40, 2 * group) == 0) if group else hashes
        # The lambda must not see the filter, or each lane would run it again.
        lanes = F.transform(
            F.array(own),
            lambda own: F.when(F.size(own) == 0, zeros).otherwise(
                F.transform(
                    F.sequence(F.lit(0), F.lit(LANES - 1)),
                    lambda lane: _total(
                        own,
                        lambda h: F.when(
                            _bits(h, 0, 5) == lane, _bits(h, 8, LANE_BITS).bitwiseOR(F.lit(1))
                        ).otherwise(F.lit(0).cast("long")),
                        LANE_BITS,
                    ),
                )
            ),
        )
        groups.append(lanes[0])
    return F.concat(dense, *groups)


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two multisets together; ``sign`` -1 takes the second one away."""
    return F.zip_with(
        F.zip_with(a, b, lambda x, y: x + sign * y),
        F.sequence(F.lit(0), F.lit(WIDE + GROUPS * LANES - 1)),
        lambda x, n: x.bitwiseAND(
            F.when(n < WIDE, F.lit((1 << WIDE_BITS) - 1)).otherwise(F.lit((1 << LANE_BITS) - 1))
        ),
    )


def written(lanes: Column) -> Column:
    """A fingerprint as lower-case hex digits."""
    dense = F.transform(F.slice(lanes, 1, WIDE), lambda x: F.lpad(F.hex(x), WIDE_BITS // 4, "0"))
    sparse = F.transform(
        F.slice(lanes, WIDE + 1, GROUPS * LANES), lambda x: F.lpad(F.hex(x), LANE_BITS // 4, "0")
    )
    return F.lower(F.concat(F.array_join(dense, ""), F.array_join(sparse, "")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of pieces that two multisets have in common (Jaccard), 0 to 1.

    1 for equal fingerprints. Lanes in use and lanes that differ are counted in the first group
    that isn't crowded; linear counting turns both into numbers of pieces.
    """
    found = None
    for group in reversed(range(GROUPS)):
        at = WIDE + 1 + group * LANES
        both = F.arrays_zip(F.slice(a, at, LANES).alias("x"), F.slice(b, at, LANES).alias("y"))
        used = F.size(F.filter(both, lambda p: (p["x"] != 0) | (p["y"] != 0)))
        apart = F.size(F.filter(both, lambda p: p["x"] != p["y"]))
        count = lambda n: -F.log(1 - F.least(n, F.lit(LANES - 0.5)) / LANES)
        share = F.when(used == 0, 0.0).otherwise(1 - count(apart) / count(used))
        found = share if found is None else F.when(used <= LANES * 7 // 8, share).otherwise(found)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), found))


def with_next(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with the text of the next one by ascending doc_id.

    After the last comes the first. Equal ids are ordered by a hash of the text; a null id
    comes before all others. Rows get the columns ``place`` (bucket, after, doc_id and hash),
    by which a window may be ordered, and ``nth``: 1 in rows that only stand for the first
    document of the bucket that follows, to be dropped in the end.

    The ids are cut at actual ids into at most ``MOST_BUCKETS`` buckets, and the documents at
    the cuts are also dealt to the bucket before theirs. So one shuffle does, and no task
    sees more than a bucket.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("k"))
    count, least = docs.agg(F.count("*"), F.min("k")).first()
    if not count:
        cuts = [0]
    else:
        buckets = min(MOST_BUCKETS, -(-count // ROWS))
        shares = [n / buckets for n in range(1, buckets)]
        inner = docs.agg(F.percentile_approx("k", shares)).first()[0] if shares else []
        cuts = sorted({least, *inner})
    steps = [1 << n for n in reversed(range(len(cuts).bit_length()))]
    docs = docs.withColumn("cuts", F.array(*map(F.lit, cuts)).cast("array<long>"))
    # Binary search for the last cut that isn't above the id.
    at = F.expr(
        f"aggregate(array({', '.join(map(str, steps))}), 0, (a, s) -> "
        f"if(a + s <= {len(cuts)} and element_at(cuts, least(a + s, {len(cuts)})) <= k, a + s, a))"
    )
    docs = docs.withColumn("bucket", at)
    before = F.when(F.col("bucket") > 1, F.col("bucket") - 1).otherwise(len(cuts))
    own = F.struct(F.col("bucket"), F.lit(0).alias("nth"))
    stand = F.struct(before.alias("bucket"), F.lit(1).alias("nth"))
    first = F.expr("element_at(cuts, bucket) = k")
    both = F.when(first, F.array(own, stand)).otherwise(F.array(own))
    docs = docs.select("doc_id", "text", "k", F.explode(both).alias("b"))
    docs = docs.select("doc_id", "text", "k", "b.bucket", "b.nth", F.xxhash64("text").alias("tie"))
    return docs.withColumn("next_text", F.lead("text").over(in_order()))


def in_order():
    return Window.partitionBy("bucket").orderBy("nth", "k", "tie")


def edited(text: Column, after: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of another text."""
    count = F.char_length(text)
    gone = F.floor(count / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), count - gone), F.substring(after, F.lit(1), gone))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with their fingerprint and that of their edited text.

    ``vec`` and ``edited_vec`` are the fingerprints as lanes, ``next_vec`` that of the next
    document. Null texts count as empty; empty texts have no pieces and fingerprint zero. Every
    row comes back once, repeated rows included; a table of one row follows itself.
    """
    rows = with_next(docs).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    rows = rows.select(
        "doc_id",
        "bucket",
        "nth",
        "k",
        "tie",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        pieces(F.col("text")).alias("hashes"),
        pieces(F.col("edited")).alias("edited_hashes"),
    )
    rows = rows.select(
        "doc_id",
        "bucket",
        "nth",
        "k",
        "tie",
        "n_chars",
        "edited_sha256",
        vector(F.col("hashes")).alias("vec"),
        vector(F.col("edited_hashes")).alias("edited_vec"),
    )
    rows = rows.withColumn("next_vec", F.lead("vec").over(in_order()))
    return rows.where("nth = 0").drop("bucket", "nth", "k", "tie")
