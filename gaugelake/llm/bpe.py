"""Byte-level BPE over Arrow batches with the tokenizers library, and the way back.

Vocabularies are read where the tasks run, from a path that every machine has; nothing is
trained. A rank file becomes a BPE model whose merges are all the ways in which a token splits
into two others, in the order of the token's rank.

Under a pattern that never matches across the place where a white space character follows another
character, or a mark like a comma a letter, texts are cut there, and each distinct segment is encoded
once per worker while it stays in a bounded memory (``segments``). Under any other pattern a text is
encoded as a whole.
"""

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from gaugelake.llm.segments import Encoder, as_bytes, byte_table, portions, spread


@lru_cache(maxsize=4)
def from_ranks(path: str, pattern: str) -> Tokenizer:
    """A tokenizer from a file of lines "base64 rank"."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    table = byte_table()
    names = {token: "".join(map(table.__getitem__, token)) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        cuts = ((token[:n], token[n:]) for n in range(1, len(token)))
        cuts = [(a, b) for a, b in cuts if a in ranks and b in ranks]
        cuts.sort(key=lambda c: (ranks[c[0]], ranks[c[1]]))
        merges += [(names[a], names[b]) for a, b in cuts]
    vocabulary = {names[t]: n for t, n in ranks.items()}
    made = Tokenizer(models.BPE(vocabulary, merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return made


@lru_cache(maxsize=4)
def from_file(path: str) -> Tokenizer:
    """A tokenizer from its own file; strings of special tokens in a text are plain text."""
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@lru_cache(maxsize=4)
def rank_encoder(path: str, pattern: str) -> Encoder:
    """An encoder by ranks; texts are cut only under the pattern that is known to allow it."""
    return Encoder(from_ranks(path, pattern), cut=pattern == public_tokenizers.PATTERN)


@lru_cache(maxsize=4)
def file_encoder(path: str, lower: bool = False) -> Encoder:
    """An encoder by a tokenizer's own file, which matches by letters, digits, marks and white space."""
    return Encoder(from_file(path), lower=lower)


@lru_cache(maxsize=4)
def token_bytes(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id, by the byte table reversed."""
    back = {c: b for b, c in enumerate(byte_table())}
    size = tokenizer.get_vocab_size()
    tokens = (tokenizer.id_to_token(n) or "" for n in range(size))
    return [bytes(map(back.__getitem__, t)) if all(c in back for c in t) else t.encode() for t in tokens]


def decode(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The bytes of ids; characters whose bytes are split over tokens come out whole."""
    return b"".join(map(table.__getitem__, ids.tolist()))


def offsets(ids: np.ndarray, lengths: np.ndarray, data: bytes):
    """Characters that each token touches, as start and end, and whether it splits one.

    ``lengths`` holds the bytes of each id, ``data`` the UTF-8 text. A token that holds a part
    of a character touches it whole, so neighbours may overlap in one character.
    """
    ends = np.cumsum(lengths[ids], dtype=np.int64)
    starts = ends - lengths[ids]
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    char = np.cumsum(lead, dtype=np.int64) - 1
    lead = np.append(lead, True)
    return char[starts], char[ends - 1] + 1, ~lead[starts] | ~lead[ends]


def _binary(data: np.ndarray, places: np.ndarray) -> pa.Array:
    """Values that follow one another; a portion of texts is far below the 2 GB of such a column."""
    return pa.Array.from_buffers(
        pa.binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data.tobytes())]
    )


def _lists(values: np.ndarray, places: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(values, pa.int64()))


def encoded(docs: DataFrame, path: str, pattern: str, with_offsets: bool = False) -> DataFrame:
    """Documents (doc_id, text) to rows with ids and the decoded bytes.

    Columns: doc_id, ids (binary: little-endian unsigned 32-bit), decoded (binary), n_split
    (tokens that begin or end within a character), and with ``with_offsets`` starts and ends
    (arrays, in characters). Null and empty texts have no ids. Rows keep their number and
    order; repeated rows are encoded alike. Other columns are left out.
    """
    schema = "doc_id long, ids binary, decoded binary, n_split long"
    if with_offsets:
        schema += ", starts array<long>, ends array<long>"

    def run(batches):
        encoder = rank_encoder(path, pattern)
        table = token_bytes(encoder.tokenizer)
        lengths = np.fromiter(map(len, table), np.int64, len(table))
        firsts, letters = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            # Some rows at a time, so that long texts don't pile up.
            for at, size in portions(batch.column(1)):
                part = batch.slice(at, size)
                data, _ = as_bytes(part.column(1))
                ids, places = encoder.encode_column(part.column(1))
                ends = np.append(0, np.cumsum(lengths[ids]))
                decoded = letters[spread(firsts[ids], lengths[ids])]
                starts, stops, split = offsets(ids, lengths, data)
                splits = np.append(0, np.cumsum(split))
                arrays = [
                    part.column(0),
                    _binary(ids.astype("<u4").view(np.uint8), places * 4),
                    _binary(decoded, ends[places]),
                    pa.array(np.diff(splits[places])),
                ]
                if with_offsets:
                    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                    base = np.repeat(lead[ends[places[:-1]]], np.diff(places))
                    arrays += [_lists(starts - base, places), _lists(stops - base, places)]
                names = ["doc_id", "ids", "decoded", "n_split", "starts", "ends"]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of ids, and SHA-256 of the ids and of the decoded bytes, for each document."""
    rows = encoded(docs, path, pattern)
    return rows.selectExpr(
        "doc_id",
        "cast(length(ids) / 4 as long) as n_tokens",
        "sha2(ids, 256) as ids_sha256",
        "sha2(decoded, 256) as decoded_sha256",
        "n_split",
    )
