"""Near-duplicate embeddings by int8 tile products with proven error bounds.

All distinct vectors are compared. They are dealt at random into groups of a bounded size, and
every pair of groups is one task's cell. In a cell, unit vectors are quantised to int8, tiles of
products are exact integers, and the norm of each vector's quantisation error bounds how far
the product of two quantised vectors is from their cosine:

    |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|

Only pairs that may reach the threshold are computed again in double precision. A cell returns
the number of links of each vector and spanning links, never the pairs themselves, so a group
of near copies of any size costs no more rows than it has vectors.

Equal vectors are one node with a count. The cost is quadratic in the number of distinct
vectors: exact links need that where vectors don't cluster tightly.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.llm.components import components, forest
from gaugelake.settle import settle

THRESHOLD = 0.9
#: Vectors in a group on average; a cell holds two groups.
GROUP = 8192
TILE = 1024


def valid(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components present and finite."""
    inf = float("inf")
    finite = F.forall(
        embedding, lambda x: F.coalesce(~F.isnan(x) & (x < inf) & (x > -inf), F.lit(False))
    )
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def quantised(unit: np.ndarray):
    """Integer parts, scales, error norms and norms of quantised unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    parts = np.rint(unit / scale[:, None]).astype(np.int8)
    restored = parts * scale[:, None]
    return parts, scale, np.linalg.norm(unit - restored, axis=1), np.linalg.norm(restored, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray, qx, qy, threshold: float = THRESHOLD):
    """Pairs (i, j) of unit vectors whose cosine reaches the threshold, in double precision."""
    (a, sa, ea, na), (b, sb, eb, _) = qx, qy
    # Integer sums stay below 2^24 up to 1040 dimensions, where single precision is exact.
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    near = a.astype(kind) @ b.astype(kind).T
    near *= sa[:, None].astype(kind)
    near *= sb[None, :].astype(kind)
    # |y| is 1; the slack covers the rounding of this sum in single precision.
    near += (ea + 1e-5)[:, None].astype(kind)
    reach = (threshold - na.max() * eb).astype(kind)
    i, j = np.nonzero(near >= reach[None, :])
    if len(i) > near.size // 16:
        exact = x @ y.T
        return np.nonzero(exact >= threshold)
    kept = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        kept[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= threshold
    return i[kept], j[kept]


def cell(a: int, b: int, groups, vectors, counts, threshold: float = THRESHOLD):
    """Links of one cell: number of linked vectors for each row, and smallest linked row.

    ``groups`` tells which rows belong to ``a`` and ``b``; within one group each pair is seen
    once.
    """
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    quant = quantised(unit)
    left, right = np.flatnonzero(groups == a), np.flatnonzero(groups == b)
    linked = np.zeros(len(unit), np.int64)
    low = np.arange(len(unit))
    for at in range(0, len(left), TILE):
        rows = left[at : at + TILE]
        for to in range(at if a == b else 0, len(right), TILE):
            columns = right[to : to + TILE]
            i, j = tile_links(
                unit[rows],
                unit[columns],
                [q[rows] for q in quant],
                [q[columns] for q in quant],
                threshold,
            )
            i, j = rows[i], columns[j]
            if a == b and at == to:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            linked += np.bincount(i, counts[j], len(unit)).astype(np.int64)
            linked += np.bincount(j, counts[i], len(unit)).astype(np.int64)
            own = np.flatnonzero(low != np.arange(len(unit)))
            low = forest(np.concatenate([own, i]), np.concatenate([low[own], j]), len(unit))
    return linked, low


def _cells(nodes: DataFrame, groups: int, threshold: float) -> DataFrame:
    """Nodes (node, n, embedding) to rows (node, n_links, other): counts or spanning links."""
    own = F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int")
    dealt = nodes.select(
        "node",
        "n",
        "embedding",
        own.alias("own"),
        F.size("embedding").alias("dims"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other"),
    ).select(
        "node", "n", "embedding", "own", "dims",
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
    )

    def run(key, table):
        _, a, b = (k.as_py() for k in key)
        names = table.column("node").to_numpy()
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.astype(np.float64).reshape(len(names), -1)
        counts = table.column("n").to_numpy()
        linked, low = cell(a, b, table.column("own").to_numpy(), vectors, counts, threshold)
        some, tied = np.flatnonzero(linked), np.flatnonzero(low != np.arange(len(low)))
        return pa.table(
            {
                "node": np.concatenate([names[some], names[tied]]),
                "n_links": np.concatenate([linked[some], np.zeros(len(tied), np.int64)]),
                "other": pa.array(
                    [None] * len(some) + names[low[tied]].tolist(), pa.int64()
                ),
            }
        )

    return dealt.groupBy("dims", "a", "b").applyInArrow(run, "node long, n_links long, other long")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, group: int = GROUP
) -> DataFrame:
    """Vectors (vec_id, embedding) to rows (vec_id, n_links, component_id, kept).

    ``n_links`` counts the other rows whose cosine reaches the threshold; ``component_id`` is
    the smallest vec_id reachable; ``kept`` tells whether that is the row's own. Vectors that
    are null, zero or hold a null or a component that isn't finite link with nothing, and
    vectors link only with those of as many dimensions. A row without vec_id links like any
    other but names no component. Every row comes back.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(valid(F.col("embedding")), F.col("embedding")).alias("embedding"),
    )
    some = rows.where("embedding is not null")
    nodes = some.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    groups = max(1, -(-nodes.count() // group))
    found = settle(_cells(nodes, groups, threshold), "cells")
    sums = found.groupBy("node").agg(F.sum("n_links").alias("links"))
    ties = found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    nodes = nodes.join(sums, "node", "left").join(components(ties), "node", "left")
    nodes = nodes.select(
        "embedding",
        "least",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"),
    )
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(named, "root").select(F.col("embedding").alias("e"), "n_links", "component_id")
    joined = rows.join(nodes, F.col("embedding") == F.col("e"), "left")
    alone = F.col("e").isNull()
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: Links and components in DuckDB's SQL, over all pairs; for tables on which that is possible.
SQL = f"""
with recursive vectors as (
  select vec_id, e, sqrt(list_dot_product(e, e)) as norm
  from (select vec_id, embedding::double[] as e from embeddings) v
  where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and list_max(e) - list_min(e) + abs(list_min(e)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.vec_id <> b.vec_id
  where case when len(a.e) = len(b.e) then list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {THRESHOLD} else false end),
reached(vec_id, other) as (
  select vec_id, vec_id from embeddings union select r.vec_id, l.b from reached r join links l on l.a = r.other),
roots as (select vec_id, min(other) as component_id from reached group by vec_id),
counts as (select a, count(*) as n from links group by a)
select r.vec_id, coalesce(n, 0) as n_links, component_id, r.vec_id = component_id as kept
from roots r left join counts c on c.a = r.vec_id
"""
