"""Content identity: texts as a dictionary, digests of subtrees, structural sharing.

Ids derive from content, so they are the same in every run and partition; there is no key space to exhaust.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..sources import forest
from ..sources.forest import Rows, spans, taken
from ..sources.languages import Language, static_text
from ..sources.text_trees import bytes_of, texts_at


def text_id(text):
    """A 64-bit id of a text; `dictionary` reports collisions."""
    return F.xxhash64(text)


def dictionary(elements: DataFrame) -> DataFrame:
    """text_id, text, uses: each interned text once. Large texts stay inline, static and missing tokens need no entry."""
    own = forest.only(elements, "storage", "text").where("storage = 'interned'")
    return own.groupBy("text").agg(F.count(F.lit(1)).alias("uses")).select(text_id(F.col("text")).alias("text_id"), "text", "uses")


def collisions(texts: DataFrame) -> DataFrame:
    return texts.groupBy("text_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def encoded(elements: DataFrame) -> DataFrame:
    """elements with text_id in place of the text of interned tokens."""
    keyed = F.when(F.col("storage") == "interned", text_id(F.col("text")))
    return elements.withColumn("text_id", keyed).withColumn("text", F.when(F.col("storage") == "large", F.col("text")))


#: So many of the most used texts, up to so many characters, are brought to the elements; only elements of other texts are shuffled.
FREQUENT, SHORT = 1_000, 200


def decoded(keyed: DataFrame, texts: DataFrame, language: Language) -> DataFrame:
    """The inverse of `encoded`: texts from the dictionary, from the language's fixed texts, or empty. `uses`, if the dictionary has it, tells frequent texts."""
    spark, kind = keyed.sparkSession, texts.schema["text_id"].dataType
    top = [] if "uses" not in texts.columns else texts.where(F.length("text") <= SHORT).orderBy(F.desc("uses"), "text_id").limit(FREQUENT).select("text_id", "text").collect()
    hot = F.broadcast(spark.createDataFrame([tuple(r) for r in top], f"text_id {kind.simpleString()}, _t string"))
    rare = F.col("text_id").isNotNull() & ~F.coalesce(F.col("text_id").isin([r["text_id"] for r in top]), F.lit(False))
    text = F.when(F.col("storage") == "static", static_text(language, F.col("kind"))).when(F.col("storage") == "missing", "").otherwise(F.coalesce("text", "_t"))
    both = keyed.where(~rare).join(hot, "text_id", "left").unionByName(keyed.where(rare).join(texts.select("text_id", F.col("text").alias("_t")), "text_id", "left"))
    return both.withColumn("text", text).drop("_t", "text_id")


def source_texts(elements: DataFrame) -> DataFrame:
    """tree_id, text: the tokens of each tree joined in preorder. Equal to the source for every tree."""
    def run(e: Rows) -> Rows:
        trees = np.unique(e.tree)
        token = np.flatnonzero(~e["is_node"])
        data, places = bytes_of(taken(e["text"], token).fill_null(""))
        ends = places[np.append(np.searchsorted(e.tree[token], trees), len(token))]
        return Rows(e.ids, trees, {"text": texts_at(data, ends)})

    return forest.by_tree(elements, run, {"text": "string"})


SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's last steps: every bit of 64 depends on all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _own(e: Rows) -> np.ndarray:
    """128 bits of each element by itself, as two numbers: its kind, length, storage and text."""
    words, text = _numbered(e["text"])
    places, storage = _numbered(e["storage"])
    known = np.frombuffer(b"".join(hashlib.blake2b((x or "").encode(), digest_size=16).digest() for x in words), np.uint64).reshape(-1, 2)
    stored = np.frombuffer(b"".join(hashlib.blake2b((x or "").encode(), digest_size=8).digest() for x in places), np.uint64)
    said = [x.astype(np.int64).astype(np.uint64) for x in (e["kind"], e["end"] - e["start"])]
    out = np.empty((len(e), 2), np.uint64)
    for lane, seed in enumerate(SEEDS):
        h = _mixed(known[text, lane] + seed) if len(e) else np.zeros(0, np.uint64)
        for x in (stored[storage], *said):
            h = _mixed((h ^ x) + seed)
        out[:, lane] = h
    return out


def _numbered(texts: pa.Array) -> tuple[list, np.ndarray]:
    """The different texts, null as the empty one, and the number of each row's."""
    coded = texts.fill_null("").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def digests(elements: DataFrame, depth: int | None = None) -> DataFrame:
    """elements with `digest`, equal exactly for equal subtrees: kind, length and storage and text of tokens, children of nodes.

    A subtree is its preorder sequence of (depth below its root, kind, length, storage, text), so one pass over each node's interval
    gives its digest; no level is computed after another. 128 bits are unlike in all but astronomically few cases. With `depth`, nodes so deep or deeper have none."""
    def run(e: Rows) -> Rows:
        own, level = _own(e), e["depth"].astype(np.int32)
        out, node = own.copy(), np.flatnonzero(e["is_node"] if depth is None else e["is_node"] & (level < depth))
        ends = np.searchsorted(e.key(), e.key("last")[node], "right")
        for a, b in zip(node.tolist(), ends.tolist()):
            found = hashlib.blake2b(own[a:b], digest_size=16)
            found.update(level[a:b] - level[a])
            out[a] = np.frombuffer(found.digest(), np.uint64)
        known = ~e["is_node"]
        known[node] = True
        return Rows(e.ids, e.tree, {**{c: (lambda c=c: e[c]) for c in e.columns}, "digest": lambda: _hexadecimal(out, ~known)})

    return forest.by_tree(elements, run, forest.columns_of(elements) | {"digest": "string"})


def _hexadecimal(numbers: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Each row's bytes as a text of hexadecimal digits."""
    raw = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1)
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)[np.stack([raw >> 4, raw & 15], 2)]
    width = 2 * raw.shape[1]
    known = np.zeros(len(numbers), bool) if null is None else null
    return texts_at(digits.reshape(-1), np.arange(len(numbers) + 1) * width, known)


def green(with_digests: DataFrame) -> DataFrame:
    """digest, kind, len, occurrences: each different subtree once."""
    own = forest.only(with_digests, "digest", "kind", "start", "end", "is_node")
    return own.groupBy("digest").agg(F.first("kind").alias("kind"), F.first(F.col("end") - F.col("start")).alias("len"), F.first("is_node").alias("is_node"), F.count(F.lit(1)).alias("occurrences"))


PRIME, OFFSET = np.uint64(0x100000001B3), np.uint64(0xCBF29CE484222325)


def _folded(h: np.ndarray, data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """FNV-1a carried on over the bytes of each row, from places[i] to places[i + 1]: the first bytes of all rows, then the second, and so on."""
    h, size, start = h.copy(), np.diff(places), places[:-1]
    order = np.argsort(-size, kind="stable")
    longest = np.searchsorted(-size[order], -np.arange(size.max(initial=0)))  # rows longer than each number
    for i, n in enumerate(longest):
        at = order[:n]
        h[at] = (h[at] ^ data[start[at] + i]) * PRIME
    return h


def structural_hash(elements: DataFrame) -> DataFrame:
    """elements with `hash`: 64-bit FNV-1a over (tag, kind, length, then text bytes of tokens or child hashes), with wrap-around.

    ANSI arithmetic does not wrap, so the fold runs in numpy: over all tokens, then over nodes, deepest first."""
    def run(e: Rows) -> Rows:
        token, seen, number = forest.different_tokens(e)
        node = np.flatnonzero(e["is_node"])
        some = np.append(node, seen)  # tokens that are alike are hashed once
        head = np.zeros(len(some), np.dtype([("tag", "u1"), ("kind", "<u4"), ("len", "<u4")]))
        head["tag"], head["kind"], head["len"] = np.where(e["is_node"][some], 1, 2), e["kind"][some], (e["end"] - e["start"])[some]
        found = _folded(np.full(len(some), OFFSET), head.view(np.uint8), np.arange(len(some) + 1) * head.itemsize)
        kept, alike = found[: len(node)], found[len(node) :]
        for column, end in (("storage", "\0"), ("text", "")):
            data, places = bytes_of(pc.binary_join_element_wise(taken(e[column], seen).fill_null(""), end, ""))
            alike = _folded(alike, data, places)
        h = np.empty(len(e), np.uint64)
        h[node], h[token] = kept, alike[number]
        own, first = e.brothers()
        up, heads = e.up(), np.flatnonzero(first == np.arange(len(first)))
        tails = np.append(heads[1:], len(own))[: len(heads)]
        parent = up[own[heads]]
        level = e["depth"][parent]
        for d in np.unique(level)[::-1]:
            at = np.flatnonzero((level == d) & (parent >= 0))
            _, kids = spans(heads[at], tails[at])
            places = np.append(0, np.cumsum(tails[at] - heads[at])) * 8
            h[parent[at]] = _folded(h[parent[at]], h[own[kids]].view(np.uint8), places)
        return Rows(e.ids, e.tree, {**{c: (lambda c=c: e[c]) for c in e.columns}, "hash": lambda: _hexadecimal(h.byteswap())})

    return forest.by_tree(elements, run, forest.columns_of(elements) | {"hash": "string"})


def fnv1a(text):
    """FNV-1a of a text's bytes, 16 hexadecimal digits, as an Arrow UDF."""
    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            h = 0xCBF29CE484222325
            for b in x.encode():
                h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            return f"{h:016x}"

        return s.map(one)

    return run(text)
