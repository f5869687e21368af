"""Personal data: patterns, and a skip-chain conditional random field on top of them.

Patterns find e-mail addresses, IP addresses, card and phone numbers. A document may then
repeat such data in a form that no pattern accepts: a phone number without its country code, an
address without its domain. The tokens of a document that may be part of personal data are the
nodes of a random field. Neighbours in the text share a chain potential; distant tokens that are
equal or alike (same letters and digits, same digits, same local part) share a skip potential.
Loopy belief propagation passes what the patterns know along both, and tokens that come out as
personal data add spans. Spans of the patterns stay as they are.

The weights are trained here by pseudo-likelihood, with the patterns' spans as labels.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field learns from, at most: those with the smallest hashes of doc_id.
TRAINING_DOCS = 500
#: Belief from which a token counts.
SURE = 0.9
ROUNDS = 8
CLAMP = 30.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


def _emails(text):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _ips(text):
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for n in range(0, len(parts) - 3, 4):
            four = parts[n : n + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(map(int, reversed(digits))):
        total += d if n % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def _digits(text):
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """Spans (start, end, number of the kind) by the patterns, in order.

    Leftmost matches that don't overlap, for each kind on its own; a match that fails its check
    is dropped. All in time linear in the text.
    """
    text = text or ""
    if not _HINT.search(text):
        return []
    spans = [(a, b, 0) for a, b in _emails(text)] + [(a, b, 1) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((*m.span(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            spans.append((*m.span(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2]))


def _features(token: str) -> list[int]:
    """Active features of a token's shape, out of ``N_FEATURES``."""
    digits = _digits(token)
    core = token.strip(".,;:!?&$%*#|\"'")
    on = [0, 1 + min(len(digits), 20)]
    on += [22] if "@" in token else []
    on += [23] if token.startswith("+") else []
    on += [24] if "(" in token else []
    on += [25 + min(core.count("."), 4)]
    on += [30] if "-" in core else []
    on += [31] if any(c.isalpha() for c in core) else []
    on += [32] if core.isdigit() else []
    on += [33] if 14 <= len(digits) <= 19 and luhn(digits) else []
    on += [34] if len(core) == len(digits) + 3 and core.count(".") == 3 else []
    return on


N_FEATURES, N_LABELS = 35, len(KINDS) + 1


class Graph:
    """Nodes and links of one document; labels 0 none, 1.. the kinds, -1 unknown."""

    def __init__(self, text: str, spans):
        self.tokens, self.labels, self.features = [], [], []
        self.chain, self.skip = [], []
        locals_ = {text[a:b].partition("@")[0].lower() for a, b, k in spans if k == 0}
        locals_ = {x for x in locals_ if len(x) >= 5}
        at, places, seen = 0, [], {}
        for place, m in enumerate(_TOKEN.finditer(text)):
            token = m.group()
            core = token.strip(".,;:!?&$%*#|\"'()").lower()
            if not _HINT.search(token) and core not in locals_:
                continue
            a, b = m.span()
            # Spans are in order of their starts; leading ones that end before are done with.
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            label = 0
            for s in spans[at:]:
                if s[0] >= b:
                    break
                if s[1] > a:
                    label = s[2] + 1
                    break
            node = len(self.tokens)
            if places and places[-1] == place - 1:
                self.chain.append((node - 1, node))
            places.append(place)
            for key in self._keys(core):
                if key in seen:
                    self.skip.append((seen[key], node))
                seen[key] = node
            self.tokens.append((a, b))
            self.labels.append(label)
            self.features.append(_features(token))
        self.places = places

    @staticmethod
    def _keys(core):
        plain = "".join(c for c in core if c.isalnum())
        digits = _digits(core)
        keys = {("text", plain)} if len(plain) >= 4 else set()
        if len(digits) >= 4:
            keys.add(("digits", digits))
        before = "".join(c for c in core.partition("@")[0] if c.isalnum())
        if len(before) >= 4:
            keys.add(("text", before))
        return keys


class Field:
    """Weights of the random field: features, chain and skip potentials (symmetric)."""

    def __init__(self):
        self.node = np.zeros((N_FEATURES, N_LABELS))
        self.chain = np.zeros((N_LABELS, N_LABELS))
        self.skip = np.zeros((N_LABELS, N_LABELS))

    def train(self, texts, steps: int = 400, rate: float = 1.0, decay: float = 1e-4) -> "Field":
        """Pseudo-likelihood: each label given its neighbours', by gradient ascent."""
        on, labels, chain, skip = [], [], [], []
        for text in texts:
            g = Graph(text or "", base_spans(text))
            shift = len(labels)
            on += g.features
            labels += g.labels
            chain += [(a + shift, b + shift) for a, b in g.chain]
            skip += [(a + shift, b + shift) for a, b in g.skip]
        if not labels:
            return self
        x = np.zeros((len(labels), N_FEATURES))
        for n, features in enumerate(on):
            x[n, features] = 1
        y = np.eye(N_LABELS)[labels]

        def around(links):
            links = np.array(links, dtype=int).reshape(-1, 2)
            out = np.zeros_like(y)
            np.add.at(out, links[:, 0], y[links[:, 1]])
            np.add.at(out, links[:, 1], y[links[:, 0]])
            return out

        near, far = around(chain), around(skip)
        for _ in range(steps):
            energy = x @ self.node + near @ self.chain + far @ self.skip
            energy -= energy.max(axis=1, keepdims=True)
            p = np.exp(energy)
            rest = (y - p / p.sum(axis=1, keepdims=True)) / len(y)
            self.node += rate * (x.T @ rest - decay * self.node)
            for weights, seen in ((self.chain, near), (self.skip, far)):
                slope = seen.T @ rest
                weights += rate * ((slope + slope.T) / 2 - decay * weights)
        return self

    def beliefs(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Marginals of all nodes by loopy belief propagation; known labels are held."""
        size = len(graph.tokens)
        energy = np.zeros((size, N_LABELS))
        for n, features in enumerate(graph.features):
            energy[n] = self.node[features].sum(axis=0)
            if graph.labels[n]:
                energy[n, graph.labels[n]] += CLAMP
        links = np.array(graph.chain + graph.skip, dtype=int).reshape(-1, 2)
        kind = np.array([0] * len(graph.chain) + [1] * len(graph.skip))
        kind = np.concatenate([kind, kind])
        source = np.concatenate([links[:, 0], links[:, 1]])
        target = np.concatenate([links[:, 1], links[:, 0]])
        back = np.concatenate([np.arange(len(links)) + len(links), np.arange(len(links))])
        potential = np.stack([self.chain, self.skip])[kind]
        sent = np.zeros((len(source), N_LABELS))
        for _ in range(rounds):
            total = energy.copy()
            np.add.at(total, target, sent)
            rest = total[source] - sent[back]
            mixed = rest[:, :, None] + potential
            top = mixed.max(axis=1)
            new = top + np.log(np.exp(mixed - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            sent = 0.5 * sent + 0.5 * new
        total = energy.copy()
        np.add.at(total, target, sent)
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, spans, field: Field) -> list[tuple[int, int, int]]:
    """Spans that the field adds to those of the patterns.

    A token can only be added if links lead from it to a token of a pattern's span, so a text
    without such spans is left alone. Added spans don't overlap those of the patterns.
    """
    if not spans:
        return []
    graph = Graph(text, spans)
    if not graph.skip or all(graph.labels):
        return []
    beliefs = field.beliefs(graph)
    linked = _reach(len(graph.tokens), graph.chain + graph.skip, graph.labels)
    runs = []
    for n, (a, b) in enumerate(graph.tokens):
        kind = int(beliefs[n].argmax())
        if graph.labels[n] or not kind or beliefs[n, kind] < SURE or not linked[n]:
            continue
        if runs and runs[-1][3] == graph.places[n] - 1 and runs[-1][2] == kind:
            runs[-1][1], runs[-1][3] = b, graph.places[n]
        else:
            runs.append([a, b, kind, graph.places[n]])
    out = []
    for a, b, kind, _ in runs:
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            out.append((a, b, kind - 1))
    return out


def _reach(size, links, labels):
    """Whether each node is joined to a labelled one."""
    links = np.array(links, dtype=int).reshape(-1, 2)
    seen = np.array(labels) > 0
    while True:
        new = seen.copy()
        np.logical_or.at(new, links[:, 1], seen[links[:, 0]])
        np.logical_or.at(new, links[:, 0], seen[links[:, 1]])
        if (new == seen).all():
            return seen
        seen = new


def train(docs: DataFrame, limit: int = TRAINING_DOCS) -> Field:
    """Learn from a bounded sample of the documents with digits or an @.

    The bound on the hash is found without the texts; only the sample's texts reach the driver.
    """
    rows = docs.where(F.col("text").rlike("[0-9@]"))
    rows = rows.select("text", F.xxhash64(F.col("doc_id"), F.lit(7), F.col("text")).alias("h"))
    lowest = rows.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    if lowest is None:
        return Field()
    sample = rows.where(F.col("h") <= lowest).dropDuplicates(["h"])
    return Field().train(r["text"] for r in sorted(sample.collect(), key=lambda r: r["h"]))


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """Documents (doc_id, text) to their personal data.

    Columns: doc_id, n_email, n_ip, n_card, n_phone (spans of the patterns), base_sha256, spans
    (all, "kind:start:end" in code points, comma-joined), n_added. Null and empty texts have
    none. One row comes back for each row.
    """
    names = [*(f"n_{k}" for k in KINDS)]
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names)
    schema += ", base_sha256 string, spans string, n_added long"

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, field)
                every = sorted(base + more, key=lambda s: (s[0], s[2], s[1]))
                counts = [sum(s[2] == k for s in base) for k in range(len(KINDS))]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((*counts, digest, written(every), len(more)))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays], ["doc_id", *names, "base_sha256", "spans", "n_added"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(text: str | None, field: Field) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping ones are one."""
    spans = base_spans(text)
    if not spans:
        return text
    spans = sorted(spans + added_spans(text, spans, field))
    out, at, n = [], 0, 0
    while n < len(spans):
        a, b, kind = spans[n]
        n += 1
        while n < len(spans) and spans[n][0] < b:
            b = max(b, spans[n][1])
            n += 1
        out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field) -> DataFrame:
    """All rows and columns, personal data in ``text`` replaced; ``n_chars`` follows if present."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = pa.array([redact(t.as_py(), field) for t in batch.column(at)], pa.string())
            columns = list(batch.columns)
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out.select(*(F.col(f"`{n}`") for n in docs.columns))
