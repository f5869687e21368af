"""A Merkle manifest of a table: a digest for each row, trees over them, and proofs.

Each row is a leaf; leaves of a group are ordered and joined to a subroot, subroots to the root.
A tree is climbed level by level, for all groups at once. At every level the rows in slot zero of
their run compute the indices of their siblings (XOR for binary trees, slot offsets otherwise) and
meet them in an equijoin with the nodes of the same level; each then emits the parent. Keys are
(group, index), so a group that holds a third of all rows is as many keys as any other rows.
Proofs come down the same levels: each run hands its own proof to its nodes, so no node is joined
with more than its run.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.llm.ranks import ranked
from gaugelake.settle import settle

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof: digests to the left and to the right within the run, as joined hex text.
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as ``-`` if null, else its UTF-8 bytes' count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of texts one after another."""
    return F.sha2(F.concat(*values), 256)


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def joined(items: Column) -> Column:
    """The digests of a run's items, one after another."""
    return F.array_join(F.transform(items, lambda i: i["digest"]), "")


def _runs(nodes: DataFrame, arity: int, label: str) -> DataFrame:
    """The runs of one level: rows (g, run, n, items), items by slot; groups of one node are left out."""
    nodes = nodes.where("n > 1")
    zero = nodes.where(F.col("idx") % arity == 0)
    step = "idx ^ s" if arity == 2 else "idx + s"
    wanted = zero.select(
        "g",
        F.col("idx").alias("first"),
        F.explode(F.expr(f"filter(transform(sequence(1, {arity - 1}), s -> {step}), i -> i < n)")).alias("idx"),
    )
    found = wanted.join(nodes, ["g", "idx"])
    members = zero.withColumn("first", F.col("idx")).unionByName(found.select("first", *zero.columns))
    kept = [c for c in nodes.columns if c not in ("g", "idx", "n")]
    item = F.struct((F.col("idx") - F.col("first")).cast("int").alias("slot"), *kept)
    runs = members.groupBy("g", "first").agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items")
    )
    run = (F.col("first") / arity).cast("long").alias("run")
    return settle(runs.select("g", run, "n", "items"), label)


def _climbed(leaves: DataFrame, arity: int, label: str):
    """The runs of all levels, and the last node of each group: rows (g, height, digest)."""
    tall = leaves.agg(F.max("n")).first()[0] or 0
    nodes, levels = leaves, []
    tops = nodes.where("n = 1").select("g", F.lit(0).alias("height"), "digest")
    while tall > 1:
        levels.append(_runs(nodes, arity, f"{label}-{len(levels)}"))
        tall = -(-tall // arity)
        nodes = levels[-1].select(
            "g",
            F.col("run").alias("idx"),
            F.ceil(F.col("n") / arity).alias("n"),
            digest(joined(F.col("items"))).alias("digest"),
        )
        top = nodes.where("n = 1").select("g", F.lit(len(levels)).alias("height"), "digest")
        tops = tops.unionByName(top)
    return levels, settle(tops, f"{label}-tops")


def _with_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """Rows (digest, row, path) of all leaves, with the further columns of their group's ``tops``.

    ``tops`` holds (g, height, path, ...) of each group's last node. A leaf's path starts at its own
    run and ends with the path of that node.
    """
    more = [c for c in tops.columns if c not in ("g", "height", "path")]

    def ends(height):
        return tops.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("idx"), "path", *more)

    nodes = ends(len(levels))
    for level in range(len(levels) - 1, -1, -1):
        runs = levels[level].select("g", F.col("run").alias("idx"), "items")
        below = runs.join(nodes, ["g", "idx"]).select("*", F.posexplode("items").alias("nth", "item"))
        step = F.struct(
            joined(F.slice("items", F.lit(1), F.col("nth"))).alias("left"),
            joined(F.slice("items", F.col("nth") + 2, F.size("items"))).alias("right"),
        )
        path = F.concat(F.array(step), F.col("path")).alias("path")
        if level:
            idx = (F.col("idx") * arity + F.col("item.slot")).alias("idx")
            nodes = below.select("g", idx, path, *more).unionByName(ends(level))
        else:
            nodes = below.select("item.digest", "item.row", path, *more)
    alone = leaves.where("n = 1").join(tops, "g").select("digest", "row", "path", *more)
    return nodes.select("digest", "row", "path", *more).unionByName(alone) if levels else alone


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, arity: int = ARITY) -> DataFrame:
    """Rows (doc_id, lang, leaf, subroot, root, path, and what is carried) for each document.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Leaves of a language ascend by
    doc_id (null first; rows with equal doc_id by their digest) and give its subroot; subroots by
    language (null first, then by bytes) give the root. While several nodes remain, every
    ``arity`` consecutive ones become the digest of their hex digests; a last run may be shorter,
    even one node. ``carry`` names columns computed from the documents that come along. Repeated
    rows are leaves of their own. An empty table has no rows. Other columns are left out.
    """
    carry = carry or {}
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("g"),
        leaf(*(F.col(c) for c in FIELDS)).alias("digest"),
        F.struct("doc_id", "lang", *(c.alias(n) for n, c in carry.items())).alias("row"),
    )
    leaves = ranked(rows, "g", [F.col("row.doc_id"), F.col("digest")], "leaves")
    leaves = leaves.select("g", "idx", "n", "digest", "row")
    levels, tops = _climbed(leaves, arity, "level")

    # The same again over the subroots, as one group.
    upper = tops.select(F.lit("").alias("all"), "g", "height", "digest")
    upper = ranked(upper, "all", [F.col("g")], "subroots")
    upper = upper.select(
        F.col("all").alias("g"), "idx", "n", "digest", F.struct("g", "height").alias("row")
    )
    above, root = _climbed(upper, arity, "upper")
    root = root.select("g", "height", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    found = _with_paths(upper, above, root, arity)
    subroots = found.select(
        "row.g", "row.height", F.col("digest").alias("subroot"), "root", "path"
    )
    subroots = settle(subroots, "subroots-proofs")

    found = _with_paths(leaves, levels, subroots, arity)
    return found.select(
        "row.doc_id", "row.lang", F.col("digest").alias("leaf"), "subroot", "root", "path",
        *(F.col("row")[n].alias(n) for n in carry),
    )


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, left to right, level by level."""
    steps = F.transform(path, lambda p: F.concat(p["left"], p["right"]))
    return F.sha2(F.array_join(steps, ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda a, p: F.sha2(F.concat(p["left"], a, p["right"]), 256))


def tampered() -> Column:
    """The leaf after a change of the text's A-Z to a-z, where 3 divides the CRC-32 of doc_id."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = [F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, leaf(*changed))


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB's SQL, bit by bit; 3988292384 is the fixed polynomial."""
    bit = "case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end"
    byte = f"list_reduce([xor(c, b)] || range(8), lambda a, i: {bit})"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)"
    return f"xor(list_reduce([4294967295::bigint] || {codes}, lambda c, b: {byte}), 4294967295)"


def _field_sql(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar) || ':' || {value}::varchar end"


_LEAF = "sha256(" + " || ".join(map(_field_sql, FIELDS)) + ")"
_CHANGED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TAMPERED = "sha256(" + " || ".join(_field_sql(_CHANGED if c == "text" else c) for c in FIELDS) + ")"
_CLIMB = f"""
  select g, level + 1, idx // {ARITY} as idx, (n + {ARITY - 1}) // {ARITY} as n, sha256(string_agg(digest, '' order by idx))
  from {{0}} where n > 1 group by g, level, idx // {ARITY}, n"""

#: The manifest in DuckDB's SQL.
SQL = f"""
with recursive leaves as (
  select doc_id, coalesce('=' || lang, '') as g, {_LEAF} as leaf,
    case when {crc32_sql("doc_id::varchar")} % 3 = 0 then {_TAMPERED} end as tampered
  from documents),
placed as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as idx,
    count(*) over (partition by g) as n
  from leaves),
nodes(g, level, idx, n, digest) as (
  select g, 0, idx, n, leaf from placed union all {_CLIMB.format("nodes")}),
subroots as (
  select g, digest as subroot, row_number() over (order by g) - 1 as nth, count(*) over () as n from nodes where n = 1),
upper(g, level, idx, n, digest) as (
  select '', 0, nth, n, subroot from subroots union all {_CLIMB.format("upper")}),
walked as (
  select p.g, p.idx, s.level, s.digest, s.idx as place, p.idx // ({ARITY} ** s.level)::bigint as own
  from placed p join nodes s on s.g = p.g and s.n > 1
    and s.idx // {ARITY} = p.idx // ({ARITY} ** (s.level + 1))::bigint
  union all
  select p.g, p.idx, 1000 + u.level, u.digest, u.idx, s.nth // ({ARITY} ** u.level)::bigint
  from placed p join subroots s on s.g = p.g join upper u on u.n > 1
    and u.idx // {ARITY} = s.nth // ({ARITY} ** (u.level + 1))::bigint),
steps as (
  select g, idx, level, row_number() over (partition by g, idx order by level) as step,
    coalesce(string_agg(digest, '' order by place) filter (place < own), '') as l,
    coalesce(string_agg(digest, '' order by place) filter (place > own), '') as r
  from walked group by g, idx, level),
folds(g, idx, step, digest) as (
  select g, idx, 0, coalesce(tampered, leaf) from placed
  union all
  select f.g, f.idx, f.step + 1, sha256(s.l || f.digest || s.r)
  from folds f join steps s on s.g = f.g and s.idx = f.idx and s.step = f.step + 1),
proofs as (select g, idx, sha256(string_agg(l || r, '' order by step)) as proof_sha256 from steps group by g, idx),
ends as (select g, idx, arg_max(digest, step) as folded_root from folds group by g, idx)
select p.doc_id, p.leaf, s.subroot, u.digest as root, coalesce(q.proof_sha256, sha256('')) as proof_sha256,
  e.folded_root, e.folded_root = u.digest as verified
from placed p join subroots s on s.g = p.g join upper u on u.n = 1
  join ends e on e.g = p.g and e.idx = p.idx left join proofs q on q.g = p.g and q.idx = p.idx
"""
