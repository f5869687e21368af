"""Repair of the structure of conversations by the cheapest edits, on a suffix-shared automaton.

What the repair depends on is a conversation's signature: one letter for each row, from its
role's initial and its first fault. Signatures are deduplicated over all conversations and dealt
out by ranges of the reversed signature, so those with a common ending meet in order. Their common
endings are nodes of an automaton built from the end: each node is made once, and holds for every
state of the grammar the cost to go and the first edit of the best way on. Nodes whose costs
differ by a constant go on alike and are one entry of a table. Only the nodes of the present
signature are held.

The grammar of role initials is ``(s?(ua)+)?``. In every state, only one initial may be written
anew, so each edit leads to one state, and among equally cheap ways the first edits already differ.
"""

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.llm.manifest import crc32_sql
from gaugelake.llm.ranks import in_order
from gaugelake.settle import settle

ROLES = {"s": "system", "u": "user", "a": "assistant"}
INITIALS, FAULTS = "sua?", ("", "blank", "duplicate", "truncated")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a. What may be kept in each, and what may be written.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WRITTEN = ("u", "u", "a", "u")
FAR = 1 << 30
#: Rows of a conversation whose letters are put together first.
CHUNK = 10


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage by crc32(conv_id:turn) % 20; nulls read as one space."""

    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    found = rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        F.struct(shown("role"), shown("text")).alias("tie"),
        F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"),
        kind.alias("kind"),
    )
    found = found.where("kind != 0").select("*", F.explode("copies").alias("copy"))
    return found.drop("copies", "kind")


def letter(initial: str, fault: str) -> str:
    return chr(ord("A") + 4 * INITIALS.index(initial) + FAULTS.index(fault))


def _letters(duplicate: Column) -> Column:
    """The letter of each row, by its role's initial and first fault."""
    initial = F.substring("role", 1, 1)
    of = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    whole = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    fault = F.when(blank, 1).when(duplicate, 2).when(~whole, 3).otherwise(0)
    return F.char(F.lit(ord("A")) + 4 * of + fault)


@lru_cache(maxsize=None)
def _step(symbol: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], str, int]:
    """A node before ``after`` (costs by state, least 0): its costs, first edits, and what was taken off.

    Costs of the states differ by a few edits at most, so there are few such tuples.
    """
    at = ord(symbol) - ord("A")
    initial, fault = INITIALS[at // 4], FAULTS[at % 4]
    costs, edits = [], []
    extra = TRUNCATED if fault == "truncated" else 0
    for state in range(4):
        ways = [(DELETE + after[state], "D")]
        if fault not in ("blank", "duplicate"):
            ways.append((REROLE + extra + after[NEXT[state][WRITTEN[state]]], "R"))
            if initial in NEXT[state]:
                ways.append((KEEP + extra + after[NEXT[state][initial]], "K"))
        best = min(ways)
        costs.append(best[0])
        edits.append(best[1])
    return _inserted(costs, edits)


def _inserted(costs, edits):
    """Let every state insert a row first where that is cheaper, or as cheap and earlier in ASCII."""
    for _ in range(3):  # No way inserts more than two rows in a place.
        for state in range(4):
            way = INSERT + costs[NEXT[state][WRITTEN[state]]], "I"
            if way < (costs[state], edits[state]):
                costs[state], edits[state] = way
    least = min(costs)
    return tuple(c - least for c in costs), "".join(edits), least


def _end():
    """The end: nothing, or a closed pair, may end; elsewhere rows are inserted."""
    return _inserted([0, FAR, FAR, 0], [" ", "?", "?", " "])


class Automaton:
    """The nodes of the present signature's endings; the next one shares those of its own ending."""

    def __init__(self):
        costs, edits, least = _end()
        self.signature = ""
        self.costs, self.edits, self.taken = [costs], [edits], [least]

    def repaired(self, backwards: str) -> tuple[int, str]:
        """Least cost and edits of the signature given from its end."""
        shared = 0
        if backwards.startswith(self.signature):
            shared = len(self.signature)
        else:
            while self.signature[shared : shared + 1] == backwards[shared : shared + 1] != "":
                shared += 1
        for part in (self.costs, self.edits, self.taken):
            del part[shared + 1 :]
        for symbol in backwards[shared:]:
            costs, edits, least = _step(symbol, self.costs[-1])
            self.costs.append(costs)
            self.edits.append(edits)
            self.taken.append(self.taken[-1] + least)
        self.signature = backwards
        state, at, audit = START, len(backwards), []
        while (edit := self.edits[at][state]) != " ":
            audit.append(edit)
            if edit != "D":
                write = INITIALS[(ord(backwards[at - 1]) - ord("A")) // 4] if edit == "K" else WRITTEN[state]
                state = NEXT[state][write]
            at -= edit != "I"
        return self.taken[-1] + self.costs[-1][START], "".join(audit)


def _counts(signature: str):
    """Blank, duplicate and truncated rows, and adjacent initials that the grammar doesn't know."""
    at = [ord(c) - ord("A") for c in signature]
    faults = [sum(a % 4 == n for a in at) for n in (1, 2, 3)]
    initials = "".join(INITIALS[a // 4] for a in at)
    legal = sum(a + b in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return *faults, max(0, len(at) - 1 - legal)


def repairs(signatures: DataFrame) -> DataFrame:
    """Distinct signatures to (signature, blank, duplicate, truncated, illegal, cost, audit)."""
    schema = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        automaton = Automaton()
        for batch in batches:
            rows = []
            for backwards in batch.column(0).to_pylist():
                signature = backwards[::-1]
                rows.append((signature, *_counts(signature), *automaton.repaired(backwards)))
            if rows:
                columns = zip(*rows, strict=True)
                kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
                )

    backwards = signatures.select(F.reverse("signature").alias("b")).distinct()
    return backwards.repartitionByRange("b").sortWithinPartitions("b").mapInArrow(run, schema)


class Repair:
    """Conversations (conv_id, turn, role, text) with damage, their audits and repaired rows.

    Rows are taken by turn, nulls first; rows of one turn by role and text as given. Null roles and
    texts read as one space. A null conv_id is a conversation of its own. Repeated rows are
    duplicates. Other columns are left out. ``damage=False`` repairs the rows as they are.
    """

    def __init__(self, rows: DataFrame, damage: bool = True):
        self.given = rows.select("conv_id", "turn", "role", "text")
        if damage:
            found = damaged(self.given)
        else:
            plain = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
            found = self.given.select("conv_id", "turn", *plain)
            found = found.select("*", F.struct("role", "text").alias("tie"), F.lit(1).alias("copy"))
        order = [F.col(c) for c in ("conv_id", "turn", "tie", "copy")]
        self.rows = in_order(found, order, "rows").select("conv_id", "turn", "role", "text", "at")
        self.audits = settle(self._audited(), "audits")

    def _audited(self) -> DataFrame:
        """One row for each conversation given: conv_id, gaps and the columns of its signature."""
        same = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)
        first = self.rows.groupBy("conv_id", same).agg(F.min("at").alias("at"))
        first = first.select("at", F.lit(True).alias("new"))
        marked = self.rows.join(first, "at", "left")
        marked = marked.select("conv_id", "at", _letters(F.col("new").isNull()).alias("letter"))
        for chunk in (F.shiftright("at", CHUNK), F.lit(0).cast("long")):
            parts = marked.groupBy("conv_id", chunk.alias("chunk"))
            letters = F.sort_array(F.collect_list(F.struct("at", "letter")))
            word = F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("letter")
            marked = parts.agg(word).select("conv_id", F.col("chunk").alias("at"), "letter")
        signed = settle(marked.select("conv_id", F.col("letter").alias("signature")), "signatures")
        turns = self.rows.groupBy("conv_id").agg(
            (F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps")
        )
        found = signed.join(settle(repairs(signed), "repairs"), "signature")
        known = [c for c in found.columns if c not in ("conv_id", "signature")]
        every = self.given.select("conv_id").distinct()
        for table in (turns, found.select("conv_id", *known)):
            table = table.withColumnRenamed("conv_id", "_conv")
            every = every.join(table, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
        numbers = ["gaps", *known[:-1]]
        return every.select(
            "conv_id",
            *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
            F.coalesce("audit", F.lit("")).alias("audit"),
        )

    def _by_conversation(self, run, schema: str) -> DataFrame:
        """Feed each conversation's audit and then its rows, in order, to ``run``.

        A conversation's rows stream through one task, as its repaired text is hashed as a whole;
        nothing of it is held but the batch at hand and its audit.
        """
        heads = self.audits.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), "audit")
        rows = self.rows.select("conv_id", "at", "role", F.col("text").alias("audit"))
        both = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "at")
        return both.mapInArrow(run, schema)

    def repaired(self) -> DataFrame:
        """The repaired rows: conv_id, nth (from 0), role, text, edit (K, R or I)."""
        schema = "conv_id long, nth long, role string, text string, edit string"

        def run(batches):
            for batch in _blocks(_edited(batches)):
                columns = list(zip(*batch, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["conv_id", "nth", "role", "text", "edit"],
                )

        return self._by_conversation(run, schema)

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of the repaired ``role:text`` rows, joined by line ends."""

        def hashed(batches):
            for conv_id, rows in groupby(_edited(batches, heads=True), key=lambda r: r[0]):
                found = hashlib.sha256()
                for _, nth, role, text, _ in rows:
                    if nth >= 0:
                        found.update(("\n" if nth else "").encode() + f"{role}:{text}".encode())
                yield conv_id, found.hexdigest()

        def run(batches):
            for block in _blocks(hashed(batches)):
                names, found = zip(*block, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"]
                )

        return self._by_conversation(run, "conv_id long, repaired_sha256 string")


def _blocks(rows, size=1024):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _edited(batches, heads: bool = False):
    """Apply audits: rows (conv_id, nth, role, text, edit); with ``heads`` one more of nth -1 before each."""
    audit, at, state, nth, conv = "", 0, START, 0, None

    def inserted():
        nonlocal at, state, nth
        while at < len(audit) and audit[at] == "I":
            write = WRITTEN[state]
            yield conv, nth, ROLES[write], "", "I"
            at, state, nth = at + 1, NEXT[state][write], nth + 1

    for batch in batches:
        for some in range(0, batch.num_rows, 1024):
            for conv_id, place, role, text in zip(*(c.to_pylist() for c in batch.slice(some, 1024).columns), strict=True):
                if place < 0:
                    audit, at, state, nth, conv = text, 0, START, 0, conv_id
                    if heads:
                        yield conv, -1, "", "", ""
                    yield from inserted()
                    continue
                edit = audit[at]
                at += 1
                if edit != "D":
                    write = role[:1] if edit == "K" else WRITTEN[state]
                    yield conv, nth, role if edit == "K" else ROLES[write], text, edit
                    state, nth = NEXT[state][write], nth + 1
                yield from inserted()


def _sql() -> str:
    """The repair in DuckDB's SQL: costs to go from each conversation's end, then a walk from its start."""

    def ways(state):
        after = NEXT[state][WRITTEN[state]]
        keep = " ".join(f"when initial = '{i}' then c{to} + extra" for i, to in NEXT[state].items())
        return (
            f"c{state} + {DELETE} as d{state}, "
            f"case when bad then {FAR} else c{after} + extra + {REROLE} end as r{state}, "
            f"case when bad then {FAR} {keep} else {FAR} end as k{state}"
        )

    best = ", ".join(f"least(d{s}, r{s}, k{s}) as b{s}" for s in range(4))
    near = {USER: ASSISTANT, ASSISTANT: USER}
    final = [f"least(b{s}, {INSERT} + {f'b{near[s]}' if s in near else f'least(b{USER}, {INSERT} + b{ASSISTANT})'})" for s in range(4)]
    edits = [
        f"case when d{s} = n{s} then 'D' when n{NEXT[s][WRITTEN[s]]} + {INSERT} = n{s} then 'I' "
        f"when k{s} = n{s} then 'K' else 'R' end"
        for s in range(4)
    ]
    one_of = lambda name: f"case state {' '.join(f'when {s} then {name}{s}' for s in range(4))} end"
    written = f"case state {' '.join(f'when {s} then {chr(39)}{WRITTEN[s]}{chr(39)}' for s in range(4))} end"
    moved = "case initial when 's' then 1 when 'u' then 2 else 3 end"
    end = [0, 2 * INSERT, INSERT, 0]
    return f"""
with recursive given as (
  select *, {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind
  from (select conv_id, turn, coalesce(role, ' ') as role0, coalesce(text, ' ') as text0 from conversations) t),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role0 end as role,
    case kind when 1 then '' when 2 then regexp_replace(text0, '[.!?]', '', 'g') else text0 end as text,
    row_number() over (partition by conv_id order by turn nulls first, role0, text0, copy) as pos
  from given, (values (1), (2)) copies(copy) where kind <> 0 and (copy = 1 or kind = 3)),
faulty as (
  select *, substr(role, 1, 1) as initial,
    case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank'
      when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate'
      when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as fault,
    lag(substr(role, 1, 1)) over (partition by conv_id order by pos) as before
  from damaged),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) as n,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id),
every as (
  select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(n, 0) as n, coalesce(blank, 0) as blank,
    coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal
  from (select distinct conv_id from conversations) c left join counts k on k.conv_id is not distinct from c.conv_id),
back(conv_id, pos, c0, c1, c2, c3, e0, e1, e2, e3) as (
  select conv_id, n + 1, {end[0]}, {end[1]}, {end[2]}, {end[3]}, '', 'I', 'I', '' from every
  union all
  select conv_id, pos, n0, n1, n2, n3, {", ".join(edits)}
  from (select *, {", ".join(f"{f} as n{s}" for s, f in enumerate(final))}
    from (select *, {best} from (select *, {", ".join(map(ways, range(4)))}
      from (select b.c0, b.c1, b.c2, b.c3, f.conv_id, f.pos, f.initial, f.fault in ('blank', 'duplicate') as bad,
          case when f.fault = 'truncated' then {TRUNCATED} else 0 end as extra
        from back b join faulty f on f.conv_id is not distinct from b.conv_id and f.pos = b.pos - 1) x) y) z) v),
walk(conv_id, pos, state, audit, out) as (
  select conv_id, 1, {START}, '', null::varchar from every
  union all
  select conv_id, case when edit = 'I' then pos else pos + 1 end,
    case edit when 'D' then state when 'K' then {moved}
      else case {written} when 'u' then {USER} else {ASSISTANT} end end,
    audit || edit,
    case when edit = 'D' then out else coalesce(out || chr(10), '') ||
      case edit when 'K' then role else case {written} when 'u' then 'user' else 'assistant' end end || ':' ||
      case edit when 'I' then '' else text end end
  from (select w.*, {one_of("b.e")} as edit, f.role, f.text, f.initial
    from walk w join back b on b.conv_id is not distinct from w.conv_id and b.pos = w.pos
    left join faulty f on f.conv_id is not distinct from w.conv_id and f.pos = w.pos) x
  where edit <> ''),
ends as (select conv_id, max_by(audit, length(audit)) as audit, max_by(coalesce(out, ''), length(audit)) as out from walk group by conv_id)
select e.conv_id, gaps, blank, duplicate, truncated, illegal, b.c0::bigint as cost, audit, sha256(out) as repaired_sha256
from every e join ends n on n.conv_id is not distinct from e.conv_id
  join back b on b.conv_id is not distinct from e.conv_id and b.pos = 1
"""


SQL = _sql()
