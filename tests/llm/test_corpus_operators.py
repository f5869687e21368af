"""Dedup operators, token files, language models, pipeline: against plain versions."""

import hashlib
import math
import pickle
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from plain_texts import similar_groups
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gaugelake.llm import (
    bpe,
    attention,
    components,
    embedding_dedup,
    lm,
    mixing,
    pii,
    quality,
    queries,
    simhash,
    suffix_dedup,
    suffixes,
    token_files,
)

DATA = "/root/testdata"

# Components


def plain_components(n, links):
    low = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_components(spark):
    rng = random.Random(3)
    links = [(n, n + 1) for n in range(0, 60)] + [(100, k) for k in range(101, 160)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5)]
    want = plain_components(400, links)
    a, b = np.array(links).T
    assert components.forest(a, b, 400).tolist() == want
    edges = spark.createDataFrame([*links, *links[:9], (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {n: want[n] for n in {x for p in links if p[0] != p[1] for x in p} if want[n] != n}
    assert components.components(edges.limit(0)).count() == 0


# SimHash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[n : n + 3]) for n in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_trie_finds_all_pairs():
    rng = random.Random(5)
    for size, flips in ((300, 3), (50, 1), (1, 0), (0, 0)):
        base = [rng.getrandbits(64) for _ in range(5)]
        values = set()
        while len(values) < size:
            v = rng.choice(base)
            for _ in range(rng.randrange(flips + 1)):
                v ^= 1 << rng.randrange(64)
            values.add(v if size > 1 else 7)
        values = sorted(values)
        found = simhash.trie_pairs(np.array(values, np.uint64), [(0, len(values), 0, len(values))])
        want = {(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2}
        assert {(max(p), min(p)) for p in found.tolist()} == want
        assert len(found) == len(want)


def grouped(ids, fps):
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    low = plain_components(len(fps), links)
    least = {}
    for root, i in zip(low, ids, strict=True):
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return [least.get(root) for root in low]


@pytest.mark.parametrize("large", [simhash.LARGE, 1])
def test_near_duplicates(repeated, large):
    rows = simhash.near_duplicates(repeated, large).collect()
    texts = {(r["doc_id"], plain_fingerprint(r["text"])) for r in repeated.collect()}
    assert {(r["doc_id"], int(r["fingerprint"], 16)) for r in rows} == texts
    want = grouped([r["doc_id"] for r in rows], [int(r["fingerprint"], 16) for r in rows])
    assert [r["component_id"] for r in rows] == want and len(rows) == repeated.count()


def test_split_blocks_lose_no_link(spark):
    """Fingerprints that share a block, dealt out as pairs of sub-tries."""
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        v = base
        for _ in range(rng.randrange(1, 6)):
            v ^= 1 << rng.randrange(22, 64)
        fps.add(v)
    fps = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in components.components(simhash.links(table, large=10)).collect()}
    plain = [f & (1 << 64) - 1 for f in fps]
    links = [(i, j) for i in range(400) for j in range(i) if (plain[i] ^ plain[j]).bit_count() <= 2]
    low = plain_components(400, links)
    members = {}
    for n, root in enumerate(low):
        members.setdefault(root, []).append(fps[n])
    assert {f: got.get(f, f) for f in fps} == {f: min(members[low[n]]) for n, f in enumerate(fps)}


def test_one_of_each_group_stays(docs, repeated, nothing):
    kept = simhash.keep_one(repeated)
    assert kept.columns == repeated.columns
    rows = simhash.near_duplicates(docs).collect()
    named = [r["doc_id"] for r in kept.where("doc_id is not null").collect()]
    assert sorted(named) == sorted(r["doc_id"] for r in rows if r["doc_id"] == r["component_id"])
    assert kept.where("doc_id is null").count() == 2
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


# Suffixes


@settings(max_examples=150, deadline=None)
@given(
    st.one_of(st.text("ab", max_size=200), st.text("the of\x00", max_size=150), st.text(max_size=80)),
    st.integers(0, 80), st.sampled_from([3, 1 << 20]),
)
def test_induced_sorting(text, again, memory):
    data = text.encode()
    data = (data + b"\0" + data[:again]).rstrip(b"\0")
    blocks = suffixes.suffixes(np.frombuffer(data + bytes(suffixes.END), np.uint8), memory)
    order = [p for b in blocks for p in b[0].tolist()]
    shared = [p for b in blocks for p in b[1].tolist()]
    cap, size = suffixes.CAP, len(data)
    key = lambda p: (data[p:] + bytes(cap))[:cap]
    assert sorted(order) == list(range(size))
    assert [key(p) for p in order] == sorted(map(key, range(size)))
    for a, b, found in zip(order, order[1:], shared[1:], strict=False):
        want = 0
        while want < min(cap, size - a, size - b) and data[a + want] == data[b + want]:
            want += 1
        assert found == want or want == min(size - a, size - b) < cap


def plain_removal(docs):
    first = {}
    for k, data in docs:
        for j in range(len(data) - 49):
            s = data[j : j + 50]
            first[s] = min(first.get(s, k), k)
    out = []
    for k, data in docs:
        gone = bytearray(len(data))
        for j in range(len(data) - 49):
            if first[data[j : j + 50]] < k:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for a, b in zip(b"\0" + bytes(gone), bytes(gone), strict=False) if b and not a)
        out.append((len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_go(repeated, nothing):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in repeated.collect()]
    want = plain_removal([(-(1 << 63) if i is None else i, d) for i, d in rows])
    got = suffix_dedup.deduplicated(repeated).collect()
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert Counter(found) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert sum(w[1] for w in want) > 1000
    assert suffix_dedup.deduplicated(nothing).count() == 0


def test_strings_of_one_byte_length_matter(spark):
    """49 equal bytes stay, 50 go; other contexts around the same string don't hide it."""
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n))
    short, long = fresh(49), fresh(50)
    texts = [fresh(30) + s + fresh(30) for s in (short, long) for _ in range(3)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.deduplicated(table).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 50, 5: 50}


@pytest.mark.parametrize("size", [21, 23, 27, 30])
def test_periodic_strings_of_unequal_length(spark, size):
    """A context that holds its gram once and one that holds it again have strings in common."""
    rng = random.Random(size)
    fresh = lambda n: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n))
    texts = []
    for _ in range(20):
        phrase = fresh(size) * 5
        pair = [fresh(40) + phrase[: size + 35] + fresh(40), fresh(40) + phrase + fresh(40)]
        texts += pair if rng.random() < 0.5 else pair[::-1]
    rows = list(enumerate(texts))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.deduplicated(table).collect()}
    want = plain_removal([(n, t.encode()) for n, t in rows])
    assert got == {n: w[1] for n, w in enumerate(want)}


@pytest.mark.parametrize("many", [1, 20])
def test_hot_grams_are_dealt_out(spark, repeated, many):
    """Contexts of a gram that many documents hold are compared string by string."""
    rng = random.Random(12)
    fresh = lambda n: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(n))
    line, sides = fresh(35), [fresh(30) for _ in range(6)]
    hot = [fresh(50) + rng.choice(sides)[-n:] + line + rng.choice(sides)[:n] + fresh(50) for n in range(31) for _ in range(3)]
    table = spark.createDataFrame([(1000 + n, t) for n, t in enumerate(hot)], "doc_id long, text string")
    table = table.unionByName(repeated.select("doc_id", "text"))
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in table.collect()]
    want = plain_removal([(-(1 << 63) if i is None else i, d) for i, d in rows])
    got = suffix_dedup.deduplicated(table, many=many).collect()
    found = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got]
    assert Counter(found) == Counter((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert any(w[1] for (i, _), w in zip(rows, want, strict=True) if i is not None and i >= 1000)


# Embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(6, 16))
    vectors = [base[n % 6] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.35]) for n in range(150)]
    vectors = [[float(np.float32(x)) for x in v] for v in vectors]
    vectors += [vectors[0]] * 30 + [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [1.0, None] + [1.0] * 14]
    vectors += [[float("inf")] + [0.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    rows = list(enumerate(vectors))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table = table.unionByName(table.where("vec_id = 3")).withColumn("n_links", F.lit("clash"))
    plain = [r["embedding"] for r in table.collect()]
    ids = [r["vec_id"] for r in table.collect()]

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.linalg.norm(v)

    units = [unit(v) for v in plain]
    near = lambda a, b: a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9
    links = [(i, j) for i in range(len(ids)) for j in range(i) if near(units[i], units[j])]
    count = Counter(x for p in links for x in p)
    low = plain_components(len(ids), links)
    least = {}
    for n, root in enumerate(low):
        least[root] = min(least.get(root, ids[n]), ids[n])
    want = Counter((ids[n], count[n], least[low[n]], ids[n] == least[low[n]]) for n in range(len(ids)))
    for group in (8192, 20):
        assert Counter(map(tuple, embedding_dedup.near_duplicates(table, group=group).collect())) == want
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_error_bound_holds():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(300, 24)) * rng.exponential(size=(300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts, scale, error, norm = embedding_dedup.quantised(x)
    near = (parts.astype(float) @ parts.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(near - x @ x.T) <= error[:, None] + norm[:, None] * error + 1e-12).all()
    edge = float(np.sort((x @ x.T).ravel())[-400])
    q = (parts, scale, error, norm)
    got = set(zip(*(a.tolist() for a in embedding_dedup.tile_links(x, x, q, q, edge)), strict=True))
    assert got == set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= edge)), strict=True))


# Token files

WORDS = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=600))
def test_packed_ids(ids):
    data = token_files.pack(np.array(ids, np.uint64))
    assert token_files.unpack(data).tolist() == ids
    for a, b in ((0, 1), (len(ids) // 3, len(ids) // 2), (len(ids), len(ids) + 5)):
        assert token_files.unpack(data, a, b).tolist() == ids[a:b]


def test_token_files(spark, docs, repeated, nothing, texts, tmp_path):
    plain = Tokenizer.from_file(WORDS)
    rows = {r["doc_id"]: r for r in token_files.written(docs, WORDS).collect()}
    start = 0
    for n, text in enumerate(texts):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        row = rows[n]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = str(tmp_path / "ids")
    token_files.write(repeated, path, WORDS)
    found = token_files.read(spark, path, with_ids=True).collect()
    assert len(found) == repeated.count()
    found.sort(key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:], strict=False))
    named = [r["doc_id"] for r in found if r["doc_id"] is not None]
    assert [r["doc_id"] for r in found[:2]] == [None, None] and named == sorted(named)
    assert all(r["ids"][-1] == 0 and len(r["ids"]) == r["n_tokens"] for r in found)
    assert token_files.written(nothing, WORDS).count() == 0


# Language models


def test_slopes():
    rng = np.random.default_rng(0)
    size = attention.ROWS
    tables = attention.Tables(rng.integers(0, 50, size), *rng.integers(0, 3, (2, size, size)))
    w = {n: v.astype(float) + 0.05 * rng.standard_normal(v.shape) for n, v in attention.initial(tables).items()}
    x, y = rng.integers(0, size, (3, 12)), rng.integers(-1, size, (3, 12))
    _, slopes = attention.gradients(w, tables, x, y)
    for name in w:
        at = tuple(rng.integers(0, s) for s in w[name].shape)
        at = (x[0, 3], *at[1:]) if name == "embed" else (2, *at[1:]) if name == "place" else at
        found = []
        for step in (1e-3, -1e-3):
            w[name][at] += step
            found.append(attention.gradients(w, tables, x, y)[0])
            w[name][at] -= step
        assert math.isclose((found[0] - found[1]) / 2e-3, slopes[name][at], rel_tol=0.05, abs_tol=2e-5), name


def test_model_is_causal_and_proper():
    """Later ids don't change a probability; those of all targets sum to one."""
    rng = np.random.default_rng(1)
    size = attention.ROWS
    tables = attention.Tables(rng.integers(0, 50, size), *rng.integers(0, 3, (2, size, size)))
    w = {n: v + 0.1 * rng.standard_normal(v.shape).astype(np.float32) for n, v in attention.initial(tables).items()}
    x = rng.integers(0, size, (1, 10))
    y = np.full((1, 10), -1)
    y[0, 4] = 7
    before = attention.forward(w, tables, x, y)[0]
    x[0, 5:] = 0
    assert np.allclose(before, attention.forward(w, tables, x, y)[0], atol=1e-5)
    every = np.repeat(x[:, :5], size, axis=0)
    target = np.full((size, 5), -1)
    target[:, 4] = np.arange(size)
    assert math.isclose(np.exp(attention.forward(w, tables, every, target)[0]).sum(), 1, rel_tol=1e-3)


def test_scores(spark, docs, repeated, nothing):
    rows = lm.score(repeated, WORDS).collect()
    assert len(rows) == repeated.count()
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    null = [r for r in repeated.collect() if r["doc_id"] is None]
    train = Counter()
    for r in repeated.collect():
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            train.update([*(r["text"] or "").encode().lower().split(), None])
    total, scale = train.total(), math.log10(train.total() + 0.5 * (len(train) + 1))
    for r in rows:
        if r["doc_id"] is None:
            continue
        words = [*texts[r["doc_id"]], None]
        assert r["n_tokens"] == len(words) and r["train_tokens"] == total
        assert r["n_known"] == sum(train[w] > 0 for w in words)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert math.isclose(r["base_score"], sum(math.log10(train[w] + 0.5) - scale for w in words), rel_tol=1e-9)
        assert -1e6 < r["score"] < 0
    assert len(null) == 2 and lm.score(nothing, WORDS).count() == 0
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    assert lm.score(held, WORDS).count() == held.count()


def test_every_id_is_scored_once(spark):
    """With a context that covers the text, windows give what one long pass gives."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, 3000)
    words = lm.Vocabulary(counts, np.arange(3000))
    size = attention.ROWS
    tables = attention.Tables(np.bincount(words.column, counts, size), *rng.integers(0, 3, (2, size, size)))
    w = attention.initial(tables)
    ids = [rng.integers(0, 3000, n) for n in (0, 1, 31, 32, 33, 100, 57)]
    each = lm.log_probability(ids, w, tables, words, 2999)
    got = [part.sum() for part in np.split(each, np.cumsum([len(i) for i in ids])[:-1])]
    # Before training, attention adds nothing, so each id depends on the two before it only.
    for n, seq in enumerate(ids):
        seq = np.concatenate([[2999], seq])
        want = 0.0
        for t in range(1, len(seq)):
            x = words.column[seq[max(0, t - 2) : t]][None]
            y = np.full(x.shape, -1)
            y[0, -1] = words.column[seq[t]]
            want += float(attention.forward(w, tables, x, y)[0][0]) + words.within[seq[t]]
        assert math.isclose(got[n], want, rel_tol=1e-3, abs_tol=1e-3)


def test_words_own_their_ids(docs, texts):
    """Each word's ids decode to the white space before it and the word, those of the end to what is left."""
    name = lm._name
    frequent = {name(b"the"): 9, name(b"of"): 4}
    table = bpe.token_bytes(bpe.from_file(WORDS))
    for r in lm.encoded(docs, WORDS, frequent).collect():
        text = (texts[r["doc_id"]] or "").encode().lower()
        words, ids = text.split(), np.frombuffer(r["ids"], "<u2")
        spans, counts = np.frombuffer(r["spans"], "<u4"), np.frombuffer(r["counts"], "<f4")
        assert len(spans) == len(words) + 1 == r["n_tokens"] and spans.sum() == len(ids)
        parts = [b"".join(table[i] for i in part) for part in np.split(ids, np.cumsum(spans)[:-1])]
        assert [p.strip() for p in parts[:-1]] == words and b"".join(parts[:-1]) + parts[-1].removesuffix(b"<|endoftext|>") == text
        assert counts.tolist() == [{b"the": 9, b"of": 4}.get(w, 0) for w in words]
        assert np.frombuffer(r["earlier"], "<f4").tolist() == [words[:n].count(w) for n, w in enumerate(words)]


def test_scores_equal_a_plain_loop(spark):
    """A tiny model: every word by its ids, its share in the corpus and in the text before it."""
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 9, 3000)
    words = lm.Vocabulary(counts, np.arange(3000))
    size = attention.ROWS
    tables = attention.Tables(np.bincount(words.column, counts, size), *rng.integers(0, 3, (2, size, size)))
    w = attention.initial(tables)
    texts, rows = [[3, 1, 2, 2], [], [1] * 60, [2, 1, 0, 5]], []
    for n, spans in enumerate(texts):
        ids = np.append(rng.integers(0, 2999, sum(spans)), 2999)
        own = rng.integers(0, 5, len(spans)) * 1.0
        before = rng.integers(0, 3, len(spans)) * 1.0
        rows.append((n, ids, [*spans, 1], own, before))
    sent = [
        (n, i.astype("<u2").tobytes(), np.array(s, "<u4").tobytes(), c.astype("<f4").tobytes(), b.astype("<f4").tobytes())
        for n, i, s, c, b in rows
    ]
    df = spark.createDataFrame(sent, "n long, ids binary, spans binary, counts binary, earlier binary")
    found = lm.scored(df, w, spark.sparkContext.broadcast(tables), words, 2999, 100, 4)
    got = {r["n"]: r["score"] for r in found.collect()}
    for n, ids, spans, own, before in rows:
        seq, at, want = np.concatenate([[2999], ids]), 1, 0.0
        for k, span in enumerate(spans):
            logs = 0.0
            for t in range(at, at + span):
                x = words.column[seq[max(0, t - 2) : t]][None]
                y = np.full(x.shape, -1)
                y[0, -1] = words.column[seq[t]]
                logs += float(attention.forward(w, tables, x, y)[0][0]) + words.within[seq[t]]
            at += span
            c, b = (4, 0) if k == len(spans) - 1 else (own[k], before[k])
            cache = lm.CACHE * k / (k + lm.PRIOR)
            share = lm.SHARE * max(c - 0.5, 0) / 100 + cache * b / max(k, 1)
            want += math.log(share + (1 - lm.SHARE - cache) * math.exp(logs))
        assert math.isclose(got[n], want / math.log(10), rel_tol=1e-3, abs_tol=1e-3)


def test_rarer_words_meet_their_counts_in_a_join(docs, monkeypatch):
    """With few words sent to all tasks the rest comes by the join, and the sums stay."""
    columns = ["doc_id", "n_known", "train_tokens", "base_score"]
    plain = {r["doc_id"]: tuple(r) for r in lm.score(docs, WORDS).select(*columns).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 5)
    for r in lm.score(docs, WORDS).select(*columns).collect():
        assert tuple(r)[:3] == plain[r["doc_id"]][:3] and math.isclose(r["base_score"], plain[r["doc_id"]][3], rel_tol=1e-9)


def test_all_ids_are_trained_on(spark):
    """Rows of the model that only the later parts of a long text use are learnt as well."""
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 9, 3000)
    words = lm.Vocabulary(counts, np.arange(3000))
    size = attention.ROWS
    long = np.concatenate([rng.permutation(3000), rng.integers(0, 3000, 5000)])
    texts = [long, *(rng.integers(0, 3000, n) for n in (0, 1, attention.WINDOW, attention.WINDOW + 1))]
    seen = Counter(y for _, part in lm.windows(texts, words, 2999) for y in part.ravel().tolist() if y >= 0)
    assert seen == Counter(words.column[np.concatenate(texts)].tolist())
    tables = attention.Tables(np.bincount(words.column, counts, size), *rng.integers(0, 3, (2, size, size)))
    rows = spark.createDataFrame([(False, long.astype("<u2").tobytes())], "held_out boolean, ids binary")
    got = lm.train(rows, words, spark.sparkContext.broadcast(tables), 2999)
    changed = (got["embed"] != attention.initial(tables)["embed"]).any(axis=1)
    assert changed[np.unique(words.column[long[:-1]])].all()


def test_descent_is_adam():
    """Weights moved in parts equal those of the formulas, name by name."""
    rng = np.random.default_rng(6)
    size = attention.ROWS
    tables = attention.Tables(rng.integers(0, 50, size), *rng.integers(0, 3, (2, size, size)))
    w = attention.initial(tables)
    batches = [(rng.integers(0, size, (3, 20)), rng.integers(-1, size, (3, 20))) for _ in range(3)]
    got = attention.descend(w, tables, batches)
    m, r = ({n: np.zeros(v.shape) for n, v in w.items()} for _ in range(2))
    for step, (x, y) in enumerate(batches, 1):
        for n, slope in attention.gradients(w, tables, x, y)[1].items():
            m[n] = 0.9 * m[n] + 0.1 * slope
            r[n] = 0.99 * r[n] + 0.01 * slope.astype(float) ** 2
            move = 0.004 * m[n] / (1 - 0.9**step) / (np.sqrt(r[n] / (1 - 0.99**step)) + 1e-8)
            w = w | {n: (w[n] - move).astype(np.float32)}
    for n in w:
        assert np.allclose(got[n], w[n], atol=2e-3) and np.mean(abs(got[n] - w[n])) < 1e-5, n


def test_lookups_equal_products():
    """What weights that stay say of every id, looked up, gives the log probabilities of the products."""
    rng = np.random.default_rng(7)
    size = attention.ROWS
    tables = attention.Tables(rng.integers(0, 50, size), *rng.integers(0, 3, (2, size, size)))
    w = {n: v + 0.1 * rng.standard_normal(v.shape).astype(np.float32) for n, v in attention.initial(tables).items()}
    still = attention.Still(w, tables)
    for length, first in ((attention.WINDOW, 0), (attention.WINDOW, 32), (5, 0), (1, 0)):
        x, y = rng.integers(0, size, (4, length)), rng.integers(-1, size, (4, length))
        plain = attention.forward(w, tables, x, y, first)[0]
        assert len(plain) == (y[:, first:] >= 0).sum()
        assert np.allclose(plain, attention.forward(w, tables, x, y, first, still)[0], atol=1e-4)


def test_steps_keep_their_memory(tmp_path):
    """Steps in a worker that was sent the counts use memory it has already, not new pages each time."""
    rng = np.random.default_rng(8)
    size = attention.ROWS
    tables = attention.Tables(rng.integers(0, 50, size), *rng.integers(0, 3, (2, size, size)))
    x, y = rng.integers(0, size, (2, 32, attention.WINDOW))
    (tmp_path / "sent").write_bytes(pickle.dumps((tables, x, y)))
    code = """
import pickle, resource, sys
from gaugelake.llm import attention
attention.one_thread()
tables, x, y = pickle.load(open(sys.argv[1], "rb"))
w = attention.initial(tables)
faults = []
for _ in range(25):
    attention.gradients(w, tables, x, y)
    faults.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
print(faults[-1] - faults[4])
"""
    root = Path(lm.__file__).parents[2]
    run = [sys.executable, "-c", code, str(tmp_path / "sent")]
    said = subprocess.run(run, cwd=root, capture_output=True, text=True, check=True)
    assert int(said.stdout) < 2000


def test_odd_words_in_one_batch(spark):
    """Null, empty and blank texts among others: each text's words are its own, repeats counted in it only."""
    texts = [None, "", " \t\n", "The the  THE of x", "of the x\n", None, "x " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    frequent = {lm._name(b"the"): 9, lm._name(b"of"): 4}
    found = {r["doc_id"]: r for r in lm.encoded(docs, WORDS, frequent).collect()}
    assert sorted(found) == list(range(len(texts)))
    for n, text in enumerate(texts):
        words, r = (text or "").lower().encode().split(), found[n]
        times = Counter(words)
        assert r["n_tokens"] == len(words) + 1 and r["n_known"] == times[b"the"] + times[b"of"]
        assert math.isclose(r["log_counts"], times[b"the"] * math.log10(9.5) + times[b"of"] * math.log10(4.5))
        assert dict(zip(r["rare"], r["rare_n"], strict=True)) == {lm._name(w): c for w, c in times.items() if w == b"x"}
        assert np.frombuffer(r["earlier"], "<f4").tolist() == [words[:at].count(w) for at, w in enumerate(words)]
        assert np.frombuffer(r["spans"], "<u4").sum() * 2 == len(r["ids"])


def test_scoring_is_dealt_over_the_cores(docs, monkeypatch):
    """A table in one split is scored by several tasks; all rows come back."""
    plain, seen = lm.scored, []

    def watched(rows, *more):
        seen.append(rows.rdd.getNumPartitions())
        return plain(rows, *more)

    monkeypatch.setattr(lm, "scored", watched)
    assert lm.score(docs.coalesce(1), WORDS).count() == docs.count()
    assert seen[0] > 1


# Queries and pipeline


def test_queries_and_pipeline_are_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE) <= set(entry.oracle_sql())


def test_pipeline(spark):
    """Each stage does to its input what plain versions do."""
    folder = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    (_, good), (_, distinct), (_, private), (_, mixed), (_, tokens) = corpus_pipeline.STAGES
    kept = good(spark, docs, folder).cache()
    scores = {r["doc_id"]: r["predicted"] for r in quality.score(docs, labels).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, p in scores.items() if p)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    one = distinct(spark, kept, folder).cache()
    rows = kept.collect()
    groups = similar_groups([r["doc_id"] for r in rows], [r["text"] for r in rows])
    assert {r["doc_id"] for r in one.collect()} == set(groups)
    hidden = private(spark, one, folder).cache()
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in hidden.collect():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]] or pii.base_spans(before[r["doc_id"]])
    mix = mixed(spark, hidden, folder).cache()
    copies = {r["doc_id"]: r["mix_copies"] for r in mixing.mixed(hidden).collect() if r["mix_copies"]}
    assert Counter(r["doc_id"] for r in mix.collect()) == Counter(copies)
    last = tokens(spark, mix, folder).collect()
    texts = {r["doc_id"]: r["text"].encode() for r in mix.collect()}
    assert len(last) == mix.count()
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]]).hexdigest() for r in last)
    whole = corpus_pipeline.run(spark, folder).drop("ids").collect()
    assert Counter(whole) == Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in last)


def test_pipeline_stages_on_odd_tables(spark, repeated, docs, nothing):
    """Nulls, empty texts, repeated rows, clashing columns and empty tables go through every stage."""
    folder = f"{DATA}/sf0.001"
    (_, good), (_, distinct), (_, private), (_, mixed), (_, tokens) = corpus_pipeline.STAGES
    clash = {"row": "text", "stats": "text", "__place": "doc_id", "__kept": "doc_id", "place": "doc_id", "tie": "text", "score": "doc_id"}
    odd = repeated.withColumns({name: F.col(of) for name, of in clash.items()})
    rows = Counter(odd.collect())
    kept = good(spark, odd, folder)
    assert kept.columns == odd.columns and set(kept.collect()) <= set(rows)
    one = distinct(spark, odd, folder)
    found = one.collect()
    assert one.columns == odd.columns and set(found) <= set(rows)
    ids = [r["doc_id"] for r in found if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and sum(r["doc_id"] is None for r in found) == 2
    blank = [r["doc_id"] for r in found if r["doc_id"] is not None and not (r["text"] or "").split()]
    assert len(blank) == 1
    assert [r["doc_id"] for r in found].count(3) == 1 and not set(ids) & {47, 48, 49, 50, 51}
    hidden = private(spark, odd, folder)
    assert hidden.columns == odd.columns and hidden.count() == odd.count()
    assert Counter(r["doc_id"] for r in hidden.collect() if r["text"] is None) == Counter(r["doc_id"] for r in odd.collect() if r["text"] is None)
    mix = mixed(spark, odd, folder)
    assert mix.columns == odd.columns and max(Counter(mix.collect()).values()) <= 3 * max(rows.values())
    last = tokens(spark, odd, folder)
    assert last.count() == odd.count() and {r["n_tokens"] for r in last.where("doc_id in (40, 41)").collect()} == {0}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0


def test_queries_equal_their_sql(spark):
    import duckdb

    folder = f"{DATA}/sf0.001"
    base = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        base.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    for name, sql in queries.ORACLE.items():
        found = queries.QUERIES[name](spark, folder)
        answer = base.execute(sql)
        names = [d[0] for d in answer.description]
        assert sorted(names) == sorted(found.columns)
        want = Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in answer.fetchall())
        assert Counter(tuple(round(r[n], 9) if isinstance(r[n], float) else r[n] for n in names) for r in found.collect()) == want
