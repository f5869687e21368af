"""Merkle manifest, repair of conversations, packing: against plain versions."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugelake.llm import conversations, manifest, packing, segments
from gaugelake.llm.ranks import ranked

# Merkle manifest


def plain_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(row, change=False):
    values = {c: row[c] for c in manifest.FIELDS}
    if change and values["text"] is not None:
        values["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in values["text"])
    return plain_hash(*(plain_field(values[c]) for c in manifest.FIELDS))


def plain_levels(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([plain_hash(*last[n : n + arity]) for n in range(0, len(last), arity)])
    return levels


def plain_path(levels, n, arity):
    out = []
    for level in levels[:-1]:
        base = n // arity * arity
        out.append(("".join(level[base:n]), "".join(level[n + 1 : base + arity])))
        n //= arity
    return out


def plain_manifest(rows, arity):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    trees = {g: plain_levels([plain_leaf(r) for r in groups[g]], arity) for g in langs}
    upper = plain_levels([trees[g][-1][0] for g in langs], arity)
    for nth, g in enumerate(langs):
        for n, row in enumerate(groups[g]):
            path = plain_path(trees[g], n, arity) + plain_path(upper, nth, arity)
            yield row, trees[g][-1][0], upper[-1][0], path


def found_manifest(docs, arity):
    rows = manifest.manifest(docs, {"changed": manifest.tampered()}, arity)
    path = F.col("path")
    rows = rows.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof(path).alias("p"),
        manifest.folded(F.col("leaf"), path).alias("same"),
        manifest.folded(F.coalesce("changed", "leaf"), path).alias("folded"),
    )
    return Counter(tuple(r) for r in rows.collect())


def wanted_manifest(docs, arity):
    out = Counter()
    for row, subroot, root, path in plain_manifest(docs.collect(), arity):
        chosen = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
        folded = plain_leaf(row, chosen)
        for left, right in path:
            folded = plain_hash(left, folded, right)
        out[(row["doc_id"], plain_leaf(row), subroot, root, plain_hash(*itertools.chain(*path)), root, folded)] += 1
    return out


@pytest.mark.parametrize("arity", [8, 2])
def test_manifest_equals_a_plain_one(spark, repeated, arity):
    langs = F.when(F.col("doc_id") % 7 < 5, "en").when(F.col("doc_id") % 7 == 5, "é")
    lang = F.when(F.col("doc_id") == 11, "one").when(F.col("doc_id") == 12, "").otherwise(langs)
    docs = repeated.withColumn("lang", lang).withColumns({"g": F.lit(1), "idx": F.lit(2), "row": F.lit(3), "n": F.lit(4)})
    assert found_manifest(docs, arity) == wanted_manifest(docs, arity)


def test_manifest_of_few_rows(spark, docs, nothing):
    assert manifest.manifest(nothing).count() == 0
    for n in (1, 2, 9):
        some = docs.where(f"doc_id < {n}")
        assert found_manifest(some, 8) == wanted_manifest(some, 8)


def test_a_change_is_noticed(docs):
    rows = manifest.manifest(docs, {"changed": manifest.tampered(), "t": F.col("text"), "c": F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3})
    folded = manifest.folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded")
    for r in rows.select("t", "c", "root", folded).collect():
        assert (r["folded"] == r["root"]) == (r["c"] != 0 or not re.search("[A-Z]", r["t"] or ""))


def test_places_in_groups(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, concat('g', id % 5), 'hot') as g", "id % 50 as k", "id")
    found = ranked(rows.repartition(7), "g", [F.col("k")], "t").collect()
    by = {}
    for r in found:
        by.setdefault(r["g"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["idx"])
        assert [r["idx"] for r in own] == list(range(len(own))) and {r["n"] for r in own} == {len(own)}
        assert [r["k"] for r in own] == sorted(r["k"] for r in own)


# Conversations

GRAMMAR, OPEN = re.compile(r"(s?(ua)+)?\Z"), re.compile(r"s?(ua)*u?\Z")
WHITE = " \t\n\x0b\f\r"


def plain_damage(rows):
    for conv, turn, role, text in rows:
        conv_text, turn_text, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        kind, tie = zlib.crc32(f"{conv_text}:{turn_text}".encode()) % 20, (role, text)
        if kind:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            yield from [(conv, turn, tie, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def plain_faults(rows):
    seen, faults = set(), []
    for role, text in rows:
        body = text.strip(WHITE)
        if not body:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def plain_repair(rows, faults):
    """The cheapest edits, then the least in ASCII, by search over all of them."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, word, out = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.match(word):
            return cost, audit, out
        if (at, word[-1:]) in done:
            continue
        done.add((at, word[-1:]))
        new = [(c, name) for c, name in (("u", "user"), ("a", "assistant")) if OPEN.match(word + c)]
        for c, name in new:
            heapq.heappush(heap, (cost + 2, audit + "I", at, word + c, (*out, (name, ""))))
        if at < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, word, out))
            role, text = rows[at]
            if faults[at] not in ("blank", "duplicate"):
                more = cost + (faults[at] == "truncated")
                if role[:1] and OPEN.match(word + role[:1]):
                    heapq.heappush(heap, (more, audit + "K", at + 1, word + role[:1], (*out, (role, text))))
                for c, name in new:
                    heapq.heappush(heap, (more + 2, audit + "R", at + 1, word + c, (*out, (name, text))))


def plain_conversations(table, damage=True):
    groups = {row[0]: [] for row in table}
    rows = plain_damage(table) if damage else ((*r[:2], ("", ""), *(" " if v is None else v for v in r[2:])) for r in table)
    for row in rows:
        groups[row[0]].append(row)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        rows = [r[3:] for r in own]
        faults = plain_faults(rows)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        first = [r[0][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        cost, audit, out = plain_repair(rows, faults)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        yield conv, (gaps, *counts, illegal, cost, audit), out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def odd_conversations():
    rng, rows = random.Random(3), []
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "sage"]
    texts = ["Hi.", "Well!", "so", "", " \n", None, "Really?", "a.b", "é. ", "...", "x" * 3000]
    for conv in [*range(120), None]:
        for turn in range(rng.randrange(1, 9)):
            turn = None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 3])
            rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}."))
    rows += rows[:40]
    rows += [(1000, n, ("user", "assistant")[n % 2], f"turn {n}.") for n in range(3000)]
    # A conversation of one row, which the damage drops.
    lost = next(n for n in itertools.count(2000) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    return [*rows, (lost, 0, "user", "gone.")], lost


def test_conversations_equal_a_search(spark):
    table, lost = odd_conversations()
    df = spark.createDataFrame(table, CONVERSATIONS).withColumn("at", F.lit(1)).withColumn("kind", F.lit("x")).repartition(5)
    found = conversations.Repair(df)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in found.digests().collect()}
    audits = {r["conv_id"]: tuple(r)[1:] for r in found.audits.collect()}
    repaired = {}
    for r in found.repaired().orderBy("conv_id", "nth").collect():
        repaired.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    want = list(plain_conversations(table))
    assert len(audits) == len(want) == len(digests)
    for conv, columns, out in want:
        assert audits[conv] == columns
        assert repaired.get(conv, []) == list(out)
        assert digests[conv] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
    assert audits[lost] == (0, 0, 0, 0, 0, 0, "") and digests[lost] == hashlib.sha256(b"").hexdigest()


def test_conversations_as_they_are_and_empty_tables(spark):
    table = [(1, 0, "system", "Be."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Hm"), (3, None, None, None)]
    found = conversations.Repair(spark.createDataFrame(table, CONVERSATIONS), damage=False)
    audits = {r["conv_id"]: (r["cost"], r["audit"]) for r in found.audits.collect()}
    assert audits == {1: (0, "KKK"), 2: (3, "D"), 3: (3, "D")}
    nothing = conversations.Repair(spark.createDataFrame([], CONVERSATIONS))
    assert nothing.audits.count() == nothing.digests().count() == nothing.repaired().count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ABCDEFGHIJKLMNOP", max_size=7), max_size=8))
def test_automaton_equals_a_search(signatures):
    """Endings are shared between signatures in any order, and every audit is the best one."""
    automaton = conversations.Automaton()
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        at = [ord(c) - ord("A") for c in signature]
        rows = [(("system", "user", "assistant", "tool")[a // 4], str(n)) for n, a in enumerate(at)]
        faults = [conversations.FAULTS[a % 4] for a in at]
        assert automaton.repaired(signature[::-1]) == plain_repair(rows, faults)[:2]


def test_a_node_is_made_once(monkeypatch):
    made, step = [], conversations._step
    monkeypatch.setattr(conversations, "_step", lambda *a: made.append(a) or step(*a))
    automaton = conversations.Automaton()
    for backwards in sorted(["JFIE", "JFIEA", "JFII", "JF", "JJ"]):
        automaton.repaired(backwards)
    assert len(made) == len({b[:n] for b in ["JFIE", "JFIEA", "JFII", "JF", "JJ"] for n in range(1, len(b) + 1)})


# Packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.data())
def test_fullest_combination(room, data):
    counts = data.draw(st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=6))
    lengths = sorted((x for x in counts if x <= room), reverse=True)
    taken = packing.fullest(lengths, counts, room)
    sums = {sum(c) for c in itertools.product(*([x * n for n in range(counts[x] + 1)] for x in lengths))}
    assert sum(x * n for x, n in taken) == max(s for s in sums if s <= room)
    assert all(0 < n <= counts[x] for x, n in taken)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 50), max_size=12))
def test_bins_hold_every_piece_once(histogram):
    seen, capacity = Counter(), 30
    for times, taken in packing.combinations(histogram, capacity):
        assert times > 0 and sum(x * n for x, n in taken) <= capacity
        for x, n in taken:
            seen[x] += times * n
    assert seen == Counter(histogram)
    for x, rows in packing.places(histogram, capacity).items():
        assert rows[0, 0] == 0 and (np.diff(rows[:, 0]) > 0).all() and rows[-1, 0] < histogram[x]


def test_few_bins():
    """Close to the least number that could do, and equal to it where every bin can be filled."""
    rng = random.Random(2)
    for _ in range(20):
        histogram = Counter(rng.randrange(1, 400) for _ in range(2000))
        bins = sum(times for times, _ in packing.combinations(histogram, 1000))
        assert bins == -(-sum(x * n for x, n in histogram.items()) // 1000)
    assert sum(t for t, _ in packing.combinations({6: 5, 4: 5, 10: 2, 3: 2, 7: 2}, 10)) == 9


def test_packed_documents(spark, repeated, texts, nothing):
    plain = Tokenizer.from_file(WORDS)
    odd = repeated.withColumns({"length": F.lit(1), "part": F.lit(2), "nth": F.lit(3), "offset": F.lit(4)})
    rows = packing.packed(odd, WORDS, capacity=64, with_ids=True).cache()
    found = rows.collect()
    wanted = Counter()
    for r in repeated.collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for n in range(-(-len(ids) // 64)):
            part = ids[64 * n : 64 * (n + 1)]
            wanted[(r["doc_id"], n, 64 * n, len(part), zlib.crc32(part.tobytes()), part.tobytes())] += 1
    assert Counter((*tuple(r)[:5], bytes(r["ids"])) for r in found) == wanted
    bins = {}
    for r in found:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= 64
    # Which lengths are left for the last bins depends on the texts: a few may stay open.
    assert len(bins) <= -(-sum(r["length"] for r in found) // 64) + 3
    whole = packing.sequences(rows).collect()
    assert sorted(r["sequence_id"] for r in whole) == sorted(bins)
    assert all(len(r["ids"]) == 4 * r["length"] for r in whole)
    assert packing.packed(nothing, WORDS).count() == 0


def test_word_vocabulary_by_segments(texts):
    """Lower-casing, composed characters and white space come out as from the whole text."""
    tokenizer = Tokenizer.from_file(WORDS)
    encoder = segments.Encoder(tokenizer, lower=True, memory=50)
    for text in [*texts, "It's WE'LL Ünïcode é̀, á. A  b　 c İ ß", "a,b 12½\x85 x̸,y"]:
        ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids
