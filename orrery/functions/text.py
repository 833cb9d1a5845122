"""Words, keyword weights and offline embeddings."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import InvalidArgument

# The English stop words that encoders drop.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he",
    "her", "his", "i", "if", "in", "into", "is", "it", "its", "me", "my", "no", "not", "of", "on",
    "or", "our", "she", "so", "such", "than", "that", "the", "their", "them", "then", "there",
    "these", "they", "this", "to", "was", "we", "were", "what", "when", "where", "which", "who",
    "will", "with", "you", "your",
)
_STOP = frozenset(STOP_WORDS)
# FNV-1a offsets and primes.
FNV32, PRIME32 = 0x811C9DC5, 0x01000193
FNV64, PRIME64 = 0xCBF29CE484222325, 0x100000001B3
BM25_K, BM25_B, BM25_AVERAGE = 1.2, 0.75, 256.0


def words(text: Column) -> Column:
    """Lower-cased maximal runs of letters and numbers, as an array."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def content_words(text: Column) -> Column:
    """words() without stop words, unless nothing else remains."""
    every = words(text)
    kept = F.array_except(F.array_distinct(every), F.array(*map(F.lit, STOP_WORDS)))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.when(F.size(kept) == 0, every).otherwise(F.filter(every, lambda w: ~F.array_contains(stop, w)))


def split_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def fnv(texts: Sequence[str], bits: int) -> np.ndarray:
    """FNV-1a hashes of 32 or 64 bits of many strings at once, a byte position at a time."""
    kind, start, prime = (np.uint32, FNV32, PRIME32) if bits == 32 else (np.uint64, FNV64, PRIME64)
    raw = [t.encode() for t in texts]
    length = np.array([len(r) for r in raw], dtype=np.int64)
    order = np.argsort(-length, kind="stable")
    first = np.concatenate([[0], np.cumsum(length)])[order] if len(raw) else length
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    many = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
    h = np.full(len(raw), start, dtype=kind)
    for j, n in enumerate(many.tolist()):  # the n longest have a byte here
        h[:n] = (h[:n] ^ data[first[:n] + j]) * kind(prime)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv32(data: str) -> int:
    return int(fnv([data], 32)[0])


def fnv64(data: str) -> int:
    return int(fnv([data], 64)[0])


def term_dimensions(terms: Sequence[str]) -> np.ndarray:
    """The 31-bit sparse dimensions of terms; terms that collide add up."""
    return (fnv(terms, 32) & np.uint32(0x7FFFFFFF)).astype(np.int64)


def bm25_weight(tf: Column, length: Column, k: float = BM25_K, b: float = BM25_B, average: float = BM25_AVERAGE) -> Column:
    """Saturated term frequency; length counts the tokens that are no stop words."""
    norm = F.lit(k) * (F.lit(1 - b) + F.lit(b) * length / F.lit(average))
    return tf * F.lit(k + 1) / (tf + norm)


def encode_documents(texts: Sequence[str], k: float = BM25_K, b: float = BM25_B, average: float = BM25_AVERAGE) -> list[dict]:
    """{"indices", "values", "tokens"} of each document; see bm25_weight(). All terms are hashed at once."""
    counted = [Counter(w for w in split_words(t) if w not in _STOP) for t in texts]
    every = list({w for c in counted for w in c})
    dimension = dict(zip(every, term_dimensions(every).tolist(), strict=True))
    out = []
    for counts in counted:
        norm = k * (1 - b + b * sum(counts.values()) / average)
        weight: dict[int, np.float32] = {}
        name: dict[int, str] = {}
        for term, tf in counts.items():
            at = dimension[term]
            weight[at] = np.float32(weight.get(at, np.float32(0)) + np.float32(tf * (k + 1) / (tf + norm)))
            name[at] = term
        order = sorted(weight)
        out.append({"indices": order, "values": [float(weight[i]) for i in order], "tokens": [name[i] for i in order]})
    return out


def encode_document(text: str, k: float = BM25_K, b: float = BM25_B, average: float = BM25_AVERAGE) -> dict:
    return encode_documents([text], k, b, average)[0]


def encode_query(text: str) -> dict:
    """Weight 1 for each distinct term that is no stop word."""
    kept = [w for w in split_words(text) if w not in _STOP]
    name = dict(zip(term_dimensions(kept).tolist(), kept, strict=True))
    order = sorted(name)
    return {"indices": order, "values": [1.0] * len(order), "tokens": [name[i] for i in order]}


SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType())), T.StructField("tokens", T.ArrayType(T.StringType()))])


@F.pandas_udf(SPARSE)
def sparse_documents(texts: pd.Series) -> pd.DataFrame:
    """Column form of encode_document; a null text has no terms."""
    made = encode_documents([t or "" for t in texts])
    return pd.DataFrame({c: [m[c] for m in made] for c in ("indices", "values", "tokens")})


def bm25_schema(key: str) -> dict:
    """A collection schema with a keyword index on `key` whose queries are scaled by inverse document frequency."""
    return {"defaults": {}, "keys": {key: {"sparse_vector": {"sparse_vector_index": {"enabled": True, "config": {"bm25": True}}}}}}


# What each kind of feature begins with, and its share.
WORD, TRIPLE, PAIR = "w:", "c:", "b:"
SHARES = {WORD: 1.0, TRIPLE: 0.5, PAIR: 0.75}


def embed_all(texts: Sequence[str], dimension: int) -> np.ndarray:
    """Signed feature hashing of words, word pairs and letter triples, of length 1; the first axis for text without words.

    The features of all texts are hashed at once.
    """
    features: list[Counter] = []
    for text in texts:
        every = split_words(text)
        kept = [w for w in every if w not in _STOP] or every
        counts: Counter = Counter(WORD + w for w in kept)
        for w in kept:
            padded = f"^{w}$"
            counts.update(TRIPLE + padded[i : i + 3] for i in range(len(padded) - 2))
        counts.update(f"{PAIR}{a} {b}" for a, b in zip(kept, kept[1:], strict=False))
        features.append(counts)
    number = {f: i for i, f in enumerate(dict.fromkeys(f for c in features for f in c))}
    hashes = fnv(list(number), 64)
    axis, minus = (hashes % np.uint64(dimension)).astype(np.int64), (hashes >> np.uint64(63)) == 1
    out = np.zeros((len(texts), dimension))
    for v, counts in zip(out, features, strict=True):
        if counts:
            which = np.array([number[f] for f in counts])
            weight = np.array([(1 + math.log(n)) * SHARES[f[:2]] for f, n in counts.items()])
            np.add.at(v, axis[which], np.where(minus[which], -weight, weight))
    norm = np.sqrt((out * out).sum(axis=1))
    out[norm == 0, 0] = 1.0
    return (out / np.where(norm == 0, 1.0, norm)[:, None]).astype(np.float32)


def embed(text: str, dimension: int) -> np.ndarray:
    return embed_all([text], dimension)[0]


def hashing_embedder(dimension: int):
    """A column function ARRAY<FLOAT> of a text column; a null text embeds as the empty one."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embedded(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed_all([t or "" for t in texts], dimension)), index=texts.index)

    return embedded


def embedder(config: Mapping | None = None):
    """The column function that a configuration names: {"type": "hashing", "dimension": 384}, the default.

    Embedders that ask a network service are not part of this library.
    """
    config = {"type": "hashing", "dimension": 384} | dict(config or {})
    if config["type"] != "hashing":
        raise InvalidArgument(f"unknown embedder: {config['type']}")
    return hashing_embedder(int(config["dimension"]))
