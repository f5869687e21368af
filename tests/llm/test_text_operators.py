"""Mixing, quality, BPE, personal data, fingerprints: against plain versions."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugelake.llm import bpe, fingerprints, mixing, pii, quality

# Mixing


def shares(sizes, cap=3.0):
    """Targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + n % 3 for n, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        over = {s for s in open_ if target[s] + part[s] >= cap * sizes[s] - 1e-9}
        if not over:
            for s in open_:
                target[s] += part[s]
            break
        for s in over:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= over
    return target


def test_mix_meets_its_targets(repeated):
    rows = mixing.mixed(repeated).collect()
    assert len(rows) == repeated.count()
    size = defaultdict(int)
    for r in rows:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["mix_size"] == words and 0 <= r["mix_copies"] <= 3
        size[r["source"]] += words
    want, taken, largest = shares(size), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["mix_source_size"] == size[r["source"]]
        assert math.isclose(r["mix_target"], want[r["source"]], rel_tol=1e-9)
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
        largest[r["source"]] = max(largest[r["source"]], r["mix_size"])
    for source in size:
        assert abs(taken[source] - want[source]) <= largest[source]
    again = mixing.mixed(repeated.repartition(5)).select("doc_id", "source", "mix_copies").collect()
    assert Counter(again) == Counter((r["doc_id"], r["source"], r["mix_copies"]) for r in rows)


def test_mix_takes_whole_epochs_first(spark):
    rows = [(n, "w " * 10, "big" if n else "small") for n in range(100)]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    small = next(r for r in found if r["source"] == "small")
    assert (small["mix_target"], small["mix_copies"]) == (30.0, 3)
    big = [r["mix_copies"] for r in found if r["source"] == "big"]
    assert set(big) == {0, 1} and abs(sum(big) * 10 - 970) <= 10


def test_mix_keeps_columns_and_empty_tables(docs, nothing):
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs).count() > 0
    assert mixing.mix(nothing).count() == 0
    blank = docs.where("text is null or trim(text) = ''")
    assert {r["mix_copies"] for r in mixing.mixed(blank).collect()} <= {0, 1}


def test_better_documents_are_drawn_first(spark):
    rows = [(n, " ".join(["abcdef" if n % 2 else "ab"] * 20), "s") for n in range(2000)]
    rows += [(5000 + n, "w " * 20, "t") for n in range(4000)]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    found = found.where("source = 't' or doc_id < 5000").groupBy((F.col("doc_id") % 2).alias("good"), "source")
    kept = {(r["source"], r["good"]): r["m"] for r in found.agg(F.avg("mix_copies").alias("m")).collect()}
    assert kept["s", 1] >= kept["s", 0]


# Quality


def labelled(spark, docs):
    ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
    return spark.createDataFrame([(i, int(i % 2)) for i in ids if i is not None], "doc_id long, quality int")


def test_discriminant_separates(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice(["alpha", "beta,", "gamma."]) + str(rng.randrange(9)) for _ in range(60)) for _ in range(80)]
    bad = ["BUY!! " * rng.randrange(20, 60) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(n, int(n < 80)) for n in range(160)], "doc_id long, quality int")
    rows = quality.score(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["predicted"] == (r["doc_id"] < 80) for r in held)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(range(80))


def test_scores_match_densities(spark, docs):
    """The score is the logistic of Gaussian log densities computed without factors."""
    labels = labelled(spark, docs)
    rows = quality.with_statistics(docs.select("doc_id", "text")).collect()
    import zlib

    stats = {r["doc_id"]: np.array(r["stats"]) for r in rows}
    train = [i for i in stats if zlib.crc32(str(i).encode()) % 4 != 2]
    groups = [np.array([stats[i] for i in train if i % 2 == k]) for k in (0, 1)]
    n = sum(map(len, groups))
    pooled = sum((g - g.mean(0)).T @ (g - g.mean(0)) for g in groups) / n + 1e-3 * np.eye(quality.N_STATS)
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled))
    log = []
    for g in groups:
        cov = 0.7 * np.cov(g.T, bias=True) + 0.3 * pooled
        log.append(lambda x, g=g, cov=cov: math.log(len(g) / n) - 0.5 * (
            np.linalg.slogdet(cov)[1] + (x - g.mean(0)) @ np.linalg.solve(cov, x - g.mean(0))))
    for r in quality.score(docs, labels).collect():
        x = stats[r["doc_id"]]
        assert math.isclose(r["score"], 1 / (1 + math.exp(min(500, log[0](x) - log[1](x)))), abs_tol=1e-6)
        assert r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_odd_tables(spark, docs, repeated, nothing):
    labels = labelled(spark, docs)
    assert quality.score(repeated, labels).count() == repeated.count()
    assert quality.score(nothing, labels).count() == 0
    none = quality.score(docs, labels.where("quality = 5")).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {0}
    nulls = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    assert quality.score(docs, labels.unionByName(nulls)).count() == docs.count()
    assert quality.keep_good(docs, labels).columns == docs.columns


# BPE

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


PLAIN = reference()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeè ,.'s\n\t\x85 漢1½-=  "), st.characters(exclude_categories=["Cs"]))))
def test_encoding_equals_tiktoken(text):
    encoder = bpe.rank_encoder(PATH, public_tokenizers.PATTERN)
    ids = np.frombuffer(encoder.encode(text), "<u4")
    assert ids.tolist() == PLAIN.encode_ordinary(text)
    assert bpe.decode(ids, bpe.token_bytes(encoder.tokenizer)) == text.encode()


def test_bpe_rows(repeated, nothing, texts):
    rows = bpe.encoded(repeated, PATH, public_tokenizers.PATTERN, with_offsets=True).collect()
    assert len(rows) == repeated.count()
    for r in rows:
        text = (texts[r["doc_id"]] if r["doc_id"] is not None else None) or ""
        ids = np.frombuffer(r["ids"], "<u4")
        if r["doc_id"] is not None:
            assert ids.tolist() == PLAIN.encode_ordinary(text) and r["decoded"] == text.encode()
        if ids.size and r["doc_id"] is not None:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(text)
            parts = [PLAIN.decode_single_token_bytes(i) for i in ids.tolist()]
            split = 0
            for a, b, part in zip(r["starts"], r["ends"], parts, strict=True):
                whole = text[a:b].encode()
                assert part in whole
                split += whole != part
            assert r["n_split"] == split
    assert bpe.digests(nothing, PATH, public_tokenizers.PATTERN).count() == 0
    row = bpe.digests(repeated.where("doc_id = 40"), PATH, public_tokenizers.PATTERN).first()
    assert (row["n_tokens"], row["ids_sha256"]) == (0, hashlib.sha256(b"").hexdigest())


# Personal data


def plain_spans(t):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for k, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m.group())
            if low <= len(digits) <= high and (k == 3 or pii.luhn(digits)):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.one_of(*(st.text(alphabet=a, max_size=70) for a in ("a@.-1 +", "0123456789.", "12 -+()3.4", "ab@c.d+e%"))))
def test_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


CALL = (
    "call +1 (407) 555-7710 now. Or, at home, (407) 555-7710 works; card 4111 1111 1111 1111, "
    "mail jo.smith@mail.org, from 10.0.0.255. In 2024 we had 12.5 of 4015."
)


def test_field_adds_repeated_data_only():
    rng = random.Random(4)
    calls = [(rng.randrange(200, 999), rng.randrange(1000, 9999)) for _ in range(60)]
    texts = [f"x +1 ({a}) 555-{b} y 9.9. z +1 ({a}) 555-{b} w 12 v {a}. u 3.14" for a, b in calls]
    field = pii.Field().train(texts)
    base = pii.base_spans(CALL)
    added = pii.added_spans(CALL, base, field)
    assert [CALL[a:b] for a, b, _ in added] in (["555-7710"], ["(407) 555-7710"])
    assert all(k == 3 for *_, k in added)
    assert pii.added_spans("555-7710 in 2024", [], field) == []
    clean = pii.redact(CALL, field)
    assert "555-7710" not in clean and "4015" in clean and "[EMAIL]" in clean


def test_messages_pass_both_ways():
    """On a chain of three, loopy propagation gives the exact marginals."""
    field = pii.Field()
    rng = np.random.default_rng(2)
    field.node = rng.normal(size=field.node.shape)
    field.chain = rng.normal(size=field.chain.shape)
    field.chain = field.chain + field.chain.T
    graph = pii.Graph("12 7345 6a", [])
    energy = np.array([field.node[f].sum(axis=0) for f in graph.features])
    assert graph.chain == [(0, 1), (1, 2)] and not graph.skip
    joint = np.exp(
        energy[0][:, None, None] + energy[1][None, :, None] + energy[2][None, None, :]
        + field.chain[:, :, None] + field.chain[None, :, :]
    )
    joint /= joint.sum()
    exact = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))])
    assert np.allclose(field.beliefs(graph, rounds=60), exact, atol=1e-6)


def test_pii_rows(repeated, nothing):
    field = pii.train(repeated)
    rows = pii.find(repeated, field).collect()
    assert len(rows) == repeated.count()
    assert pii.find(nothing, pii.train(nothing)).count() == 0
    some = repeated.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit(CALL)).otherwise(F.col("text")))
    row = pii.find(some.where("doc_id = 0"), field).first()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in plain_spans(CALL))
    assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) <= set(row["spans"].split(","))
    hidden = pii.redacted(some, field)
    assert hidden.columns == repeated.columns and hidden.dtypes == repeated.dtypes
    for r in hidden.collect():
        assert r["text"] is None or (not plain_spans(r["text"]) and r["n_chars"] == len(r["text"]))


# Fingerprints


def test_edited_texts(repeated, texts, docs):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprinted(docs).collect()}
    assert len(rows) == len(texts)
    for n, text in enumerate(texts):
        text, after = text or "", texts[(n + 1) % len(texts)] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        assert rows[n]["n_chars"] == len(text)
        assert rows[n]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[n]["next_vec"] == rows[(n + 1) % len(texts)]["vec"]
    assert fingerprints.fingerprinted(repeated).count() == repeated.count()


def test_equality_and_likeness(spark, docs, texts, nothing):
    vec, other = F.col("vec"), F.col("edited_vec")
    rows = fingerprints.fingerprinted(docs).select(
        "doc_id", "vec", fingerprints.likeness(vec, other).alias("near"),
        fingerprints.likeness(vec, F.col("next_vec")).alias("far"),
    ).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len({tuple(by[n]["vec"]) for n in range(40)}) == 40
    assert all(by[n]["vec"] == by[3]["vec"] for n in range(47, 52))
    assert all(0 <= r["near"] <= 1 and 0 <= r["far"] <= 1 for r in rows)
    assert np.mean([by[n]["near"] for n in range(39)]) > 0.35
    assert np.mean([by[n]["far"] for n in range(39)]) < 0.2
    assert fingerprints.fingerprinted(nothing).count() == 0
    assert fingerprints.fingerprinted(docs.limit(1)).count() == 1


def test_order_and_increments(spark):
    rows = [(0, "One.Two.Three."), (1, "Three.One.Two."), (2, "One.Two."), (3, "Three.")]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    found = found.select("doc_id", fingerprints.pieces(F.col("text")).alias("h"))
    vec = {r["doc_id"]: r["v"] for r in found.select("doc_id", fingerprints.vector(F.col("h")).alias("v")).collect()}
    assert vec[0] == vec[1] != vec[2]
    arrays = spark.createDataFrame([(vec[0], vec[2], vec[3])], "a array<long>, b array<long>, c array<long>")
    got = arrays.select(
        fingerprints.added(F.col("b"), F.col("c")).alias("sum"),
        fingerprints.added(F.col("a"), F.col("c"), -1).alias("rest"),
    ).first()
    assert got["sum"] == vec[0] and got["rest"] == vec[2]


def test_likeness_of_very_long_texts(spark):
    """Texts of several MB that share 0.6 of their pieces don't look unrelated."""
    a = ", ".join(f"clause number {n}" for n in range(240_000))
    b = ", ".join(f"clause number {n}" for n in range(60_000, 300_000))
    c = ", ".join(f"other clause {n}" for n in range(240_000))
    table = spark.createDataFrame([(a, b, c)], "a string, b string, c string")
    vecs = table.select(*(fingerprints.vector(fingerprints.pieces(F.col(n))).alias(n) for n in "abc"))
    near = fingerprints.likeness(F.col("a"), F.col("b")).alias("near")
    far = fingerprints.likeness(F.col("a"), F.col("c")).alias("far")
    row = vecs.select(near, far).first()
    assert len(a) > 4_000_000 and 0.35 < row["near"] < 0.85 and row["far"] < 0.3
