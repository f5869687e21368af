"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions.

Every document draws an exponential key, -ln(u) over its quality weight, so that sorting by
key samples without replacement in proportion to quality. A source is taken as often as its
target holds it whole (complete epochs); the rest of its target is a prefix of the key order,
found by prefix sums of sizes.

No task sorts a source. Keys are cut into a fixed number of ranges of equal mass; the sums of
the ranges tell in which one the budget of a source ends, and only that range is ordered. A
source with a third of all rows costs 1/1024 of that in a task. The result is one threshold
for each source, and documents are compared with it where they lie.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.settle import settle

#: Words end at white space of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
#: Ranges of keys for each source.
RANGES = 1024


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Quality weight in (0, 1]: 1 at six characters a word, less the further from it."""
    mean = F.char_length(text) / size
    return F.when(size > 0, 1 / (1 + F.abs(mean - 6) / 6)).otherwise(1.0)


def _drawn(docs: DataFrame) -> Column:
    """What the draw needs of a document: size, and its place in the order of its source.

    The key depends on doc_id and text alone, so reruns agree. Equal keys are ordered by
    doc_id and then by the hash of both.
    """
    text, size = F.col("text"), words(F.col("text"))
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), text).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    place = F.struct(
        (-F.log(u) / quality(text, size)).alias("key"),
        F.col("doc_id").alias("doc_id"),
        digest.alias("digest"),
    )
    return F.struct(size.alias("size"), place.alias("place"))


def targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """Sources (source, source_size) to their targets; they share the sum of all sizes.

    Sources by code point, null last, weigh 1, 2, 3, repeating. No target is above ``cap``
    times its source's size; the excess is shared by weight among the others. One row for each
    source is all that this orders.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1)
    weighed = weighed.withColumn("most", F.col("source_size") * F.lit(cap))
    # Sources reach their cap in the order of most / weight; the level all others share is the
    # highest one that any prefix of capped sources leaves.
    rising = every.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to = rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.sum("source_size").over(every) - F.sum("most").over(up_to) + F.col("most")
    weights = F.sum("weight").over(every) - F.sum("weight").over(up_to) + F.col("weight")
    return (
        weighed.withColumn("level", left / weights)
        .withColumn("level", F.max("level").over(every))
        .select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))
    )


def plan(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """One row for each source: how often it is taken whole, and where its last epoch ends.

    ``upto`` is the last place of the prefix that fits the rest of the target; ``closing`` is
    one further document whose size comes nearest to what is then missing, if it comes nearer
    than leaving it out.
    """
    drawn = docs.select("source", _drawn(docs).alias("d")).select("source", "d.size", "d.place")
    units = drawn.groupBy("source", "size", "place").agg(F.count("*").alias("n"))
    part = F.lit(RANGES - 1) - F.floor(F.exp(-F.col("place.key") / 2) * RANGES)
    units = units.select(
        "source",
        "place",
        (F.col("size") * F.col("n")).alias("size"),
        F.greatest(part, F.lit(0)).cast("int").alias("part"),
    )
    units = settle(units, "units")
    parts = units.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    sizes = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    goals = targets(sizes, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("epochs", F.floor(ratio).cast("int"))
    goals = goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goals = settle(goals, "goals")
    in_order = Window.partitionBy("source").orderBy("part")
    parts = parts.withColumn("before", F.sum("part_size").over(in_order) - F.col("part_size"))
    rests = goals.select(F.col("source").alias("s"), "rest")
    parts = parts.join(rests, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ends = parts.where("before <= rest and before + part_size > rest").select(
        F.col("source").alias("s"), F.col("part").alias("p"), "before", "rest"
    )
    ends = settle(ends, "ends")
    same = F.col("source").eqNullSafe(F.col("s"))
    inside = units.join(ends, same & (F.col("part") == F.col("p"))).drop("s", "p")
    within = Window.partitionBy("source", "part").orderBy("place")
    inside = inside.withColumn("sum", F.col("before") + F.sum("size").over(within))
    cuts = inside.groupBy("source").agg(
        F.max(F.when(F.col("sum") <= F.col("rest"), F.col("place"))).alias("upto"),
        F.max(F.when(F.col("sum") <= F.col("rest"), F.col("sum")).otherwise(F.col("before"))).alias("sum"),
        F.first("part").alias("end_part"),
        F.first("rest").alias("rest"),
    )
    cuts = settle(
        cuts.select(
            F.col("source").alias("s"), "upto", "end_part", (F.col("rest") - F.col("sum")).alias("gap")
        ),
        "cuts",
    )
    left = units.join(cuts, same).where(
        (F.col("part") >= F.col("end_part"))
        & ~F.coalesce(F.col("place") <= F.col("upto"), F.lit(False))
        & (F.col("size") > 0)
        & (F.col("size") < 2 * F.col("gap"))
    )
    missing = F.abs(F.col("gap") - F.col("size"))
    closing = left.groupBy(F.col("source").alias("c")).agg(
        F.min_by("place", F.struct(missing, "place")).alias("closing")
    )
    found = goals.join(cuts, same, "left").drop("s")
    found = found.join(closing, F.col("source").eqNullSafe(F.col("c")), "left")
    # A prefix that ends exactly with a range leaves upto to the ranges before it.
    full = parts.where("before + part_size <= rest").groupBy(F.col("source").alias("f")).agg(
        F.max("part").alias("full_part")
    )
    found = found.join(full, F.col("source").eqNullSafe(F.col("f")), "left")
    return settle(
        found.select(
            "source", "source_size", "target", "epochs", "upto", "closing", "full_part"
        ),
        "mix",
    )


def mixed(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """All rows and columns, and how often the mix takes each row.

    Needs doc_id, text and source. Added are the columns ``mix_size``, ``mix_source_size``,
    ``mix_target`` and ``mix_copies``; columns of these names are replaced. Null texts and
    texts without words have size 0; documents without a source form a source of their own.
    Repeated rows (same doc_id, text and source) are one unit of the draw: taken together or
    not at all.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    names = docs.columns
    chosen = plan(docs.select("doc_id", "text", "source"), cap).select(
        F.struct("*").alias("__m"), F.col("source").alias("__s")
    )
    rows = docs.withColumn("__d", _drawn(docs))
    rows = rows.join(chosen, F.col("source").eqNullSafe(F.col("__s")), "left")
    place, m = F.col("__d.place"), "__m."
    part = F.greatest(
        F.lit(RANGES - 1) - F.floor(F.exp(-F.col("__d.place.key") / 2) * RANGES), F.lit(0)
    )
    taken = (
        F.coalesce(place <= F.col(m + "upto"), F.lit(False))
        | F.coalesce(part <= F.col(m + "full_part"), F.lit(False))
        | F.coalesce(place == F.col(m + "closing"), F.lit(False))
    )
    return rows.select(
        *(F.col(f"`{n}`") for n in names),
        F.col("__d.size").alias("mix_size"),
        F.col(m + "source_size").alias("mix_source_size"),
        F.col(m + "target").alias("mix_target"),
        (F.col(m + "epochs") + taken.cast("int")).alias("mix_copies"),
    )


def mix(docs: DataFrame, cap: float = 3.0) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns it came with."""
    rows = mixed(docs, cap)
    names = [n for n in docs.columns if not n.startswith("mix_")]
    again = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    rows = rows.where("mix_copies > 0").withColumn("__again", again)
    return rows.select(*(F.col(f"`{n}`") for n in names))


#: The mix of all documents, written without ranges.
SQL = r"""
with d as (
  select doc_id, source, text, md5(concat_ws(':', doc_id, text)) as digest,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
  from documents),
k as (
  select *, -ln((('0x' || substr(digest, 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
       / case when size > 0 then 1 / (1 + abs(length(text) / size - 6) / 6) else 1.0 end as key
  from d),
s as (select source, sum(size)::bigint as source_size, 3.0::double * sum(size) as most from k group by 1),
w as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s),
v as (
  select *, (sum(source_size) over () - sum(most) over r + most)
          / (sum(weight) over () - sum(weight) over r + weight) as level
  from w window r as (order by most / weight, source nulls last rows unbounded preceding)),
t as (select source, source_size, least(most, max(level) over () * weight) as target from v),
g as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as epochs from t),
o as (
  select k.*, source_size, target, epochs, target - epochs * source_size as rest,
         sum(size) over (partition by k.source order by key, doc_id nulls first, digest
                         rows unbounded preceding) as upto
  from k join g on k.source is not distinct from g.source),
p as (
  select *, upto <= rest as chosen,
         rest - coalesce(max(upto) filter (upto <= rest) over (partition by source), 0) as gap
  from o),
c as (
  select *, row_number() over (
    partition by source,
                 not chosen and size > 0 and size < 2 * gap
    order by abs(gap - size), key, doc_id nulls first, digest) as nth
  from p)
select doc_id, size::bigint as size, source_size, target,
       (size * (epochs + case when chosen or (size > 0 and size < 2 * gap and nth = 1)
                              then 1 else 0 end))::bigint as taken
from c
"""
