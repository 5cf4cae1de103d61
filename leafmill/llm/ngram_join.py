"""N-gram Jaccard join by MinHash banding.

Words are runs without ASCII white space, lower-cased; a text's n-grams are its
runs of `n` words (five), or the whole text if it has fewer. Texts with the same set are
one class of copies and take part once. For each set, MinHash values in b bands of r
rows are computed, b and r being chosen for the target recall at the threshold; sets
that agree in a band are candidates. They meet by a shuffle on the band's hash, where each
is tied to the band's least member only (a partial minimum and a join, so a band shared
by very many costs one row each), and the components of these ties bring all candidates
together. Inside a component every pair is verified on the full sets; components of more than
`BLOCK` sets are cut into blocks, and each pair of blocks is a task of its own. Pairs are
counted, not emitted: a block returns for each set its number of links and a forest.

Defined results: a text without words (null or empty) has no n-grams, no links and a
class by itself; texts of one to four words have one n-gram; ties and repeated rows are copies
of each other (linked); class_id is the smallest id in the class, links counted between all
documents of it or not; a null id is larger than any; an empty table gives no rows; other columns are
ignored by `classes` and kept by `one_per_class`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import literal, slices, table, written
from .components import components

N, THRESHOLD, RECALL = 5, 0.8, 0.9995
#: Most sets in a block; a task verifies two blocks.
BLOCK = 256
WORD_CACHE = 120_000
#: Most words of the bit array that finds the documents whose sets are wanted (16 MB).
FILTER_WORDS = 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """The most rows, then the fewest bands, that reach the recall at the threshold with `most` hashes at most."""
    for r in range(most, 0, -1):
        for b in range(1, most // r + 1):
            if 1 - (1 - threshold**r) ** b >= recall:
                return b, r
    raise ValueError("no banding reaches this recall")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


_WORDS = _WordHashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-grams."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = _mixed(out + h[i : i + len(out)] + np.uint64(i + 1))
    return np.unique(out)


def _key(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _signer(n: int, b: int, r: int):
    rng = np.random.default_rng(20240607)
    a = rng.integers(0, 1 << 63, b * r, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    c = rng.integers(0, 1 << 63, b * r, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, bands = [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, n)
                keys.append(_key(s))
                if not len(s):
                    bands.append(None)
                    continue
                least = np.full(b * r, np.iinfo(np.uint64).max, np.uint64)
                for i in range(0, len(s), 2048):  # bounded memory for very long texts
                    least = np.minimum(least, ((s[i : i + 2048, None] * a) + c).min(axis=0))
                h = np.zeros(b, np.uint64)
                for row in least.reshape(b, r).T:
                    h = _mixed(h + row)
                bands.append(h.view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "th": batch.column("th"), "key": pa.array(keys, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return run


def _setter(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": pa.array([_key(s) for s in sets], pa.binary()), "grams": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def among(ids: DataFrame, column: str = "first_id", most: int = FILTER_WORDS):
    """A predicate on an id: true for all of ids, and for few others while these are fewer than 16 * most.

    It is a bit array of one hash, as long as the ids are many but of `most` 64-bit words at most. Beyond that it
    lets more and more ids pass, which costs work and loses nothing."""
    words = 1 << min(most.bit_length() - 1, max(4, (ids.count() // 4).bit_length()))
    word = lambda c: F.pmod(F.xxhash64(c), F.lit(words)).cast("int")
    bit = lambda c: F.pmod(F.shiftright(F.xxhash64(c), 32), F.lit(64)).cast("int")
    # Shifting a column by a column is only in SQL.
    marks = ids.select(word(F.col(column)).alias("id"), bit(F.col(column)).alias("b")).groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m"))
    filled = ids.sparkSession.range(0, words, 1, 1).join(marks, "id", "left").select("id", F.coalesce("m", F.lit(0)).alias("m"))
    bits = literal(filled.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "m"))), lambda x: x["m"]).alias("bits")), "wanted")
    return lambda c: F.call_function("getbit", F.get(bits, word(c)), bit(c)) == 1


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of pairwise intersections; n-grams of one set only are left out, the rest taken in strips."""
    m = len(sets)
    grams, at = np.unique(np.concatenate(sets), return_inverse=True)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    common = np.bincount(at, minlength=len(grams)) > 1
    place = np.cumsum(common) - 1
    use = common[at]
    at, who = place[at[use]], who[use]
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    total, strip = np.zeros((m, m), np.float32), 4096
    for start in range(0, int(common.sum()), strip):
        lo, hi = np.searchsorted(at, [start, start + strip])
        x = np.zeros((m, strip), np.float32)
        x[who[lo:hi], at[lo:hi] - start] = 1
        total += x @ x.T
    return total


def _verifier(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Within a block the pairs of its own sets; between two blocks only the pairs across.
        across = bool((group["i"] != group["j"]).iloc[0])
        sets = [np.frombuffer(g, np.uint64) for g in group["grams"]]
        size = np.array([len(s) for s in sets], np.float64)
        both = _shared(sets).astype(np.float64)
        linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if across:
            part = group["part"].to_numpy()
            linked &= part[:, None] != part[None, :]
        parent = list(range(len(sets)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(*np.nonzero(np.triu(linked))):
            parent[find(y)] = find(x)
        copies = group["copies"].to_numpy()
        keys = group["key"].tolist()
        return pd.DataFrame({"key": keys, "other": [keys[find(x)] for x in range(len(keys))], "links": (linked * copies[None, :]).sum(axis=1).astype("int64"), "texts": linked.sum(axis=1).astype("int64")})

    return run


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, th (hash of the text), key (of its n-gram set, null if empty), class_id, n_links (documents of
    similarity `threshold` or more, copies included), n_texts (different n-gram sets among them, its own not counted),
    first (whether key and id are those of the one document that stands for the class)."""
    b, r = bands_and_rows(threshold, recall)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = written(rows.mapInArrow(_signer(n, b, r), f"doc_id {kind}, th bigint, key binary, bands array<bigint>"), "signatures")
    sets = signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    sets = written(sets, "sets")
    members = sets.select("key", F.posexplode("bands").alias("band", "h"))
    hubs = members.groupBy("band", "h").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    ties = members.join(hubs, ["band", "h"]).where("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v"))
    candidates = components(ties)
    # Parts of a component, by its size; a pair of parts is a block.
    sizes = candidates.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    wanted = written(candidates.join(sizes, "root").select(F.col("node").alias("key"), "root", "parts").join(sets.select("key", "first_id", "copies"), "key"), "candidates")
    chosen = rows.where(among(wanted)(F.col("doc_id"))).mapInArrow(_setter(n), f"doc_id {kind}, key binary, grams binary")
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (chosen["key"] == wanted["key"])
    grams = chosen.hint("merge").join(wanted, same).select(wanted["key"], "grams", "copies", "root", "parts")
    grams = grams.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    placed = grams.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = placed.withColumn("i", F.least("part", "with")).withColumn("j", F.greatest("part", "with"))
    # An id that repeats with the same text would bring a set twice.
    found = blocks.groupBy("root", "i", "j").applyInPandas(_once(_verifier(threshold)), "key binary, other binary, links bigint, texts bigint")
    found = written(found, "verified")
    counted = found.groupBy("key").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    joined = components(found.select(F.col("key").alias("u"), F.col("other").alias("v"))).withColumnRenamed("node", "key")
    known = sets.select("key", "first_id", "copies").join(counted, "key", "left").join(joined, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # Two classes may share an id that repeats with other texts, so a class is its root; the least set of its least id stands for it.
    least = F.min(F.struct(F.col("first_id").isNull().alias("null"), "first_id", "key")).alias("least")
    ids = known.groupBy("root").agg(least).select("root", F.col("least.first_id").alias("class_id"), F.col("least.key").alias("first_key"))
    n_links = (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    known = known.join(ids, "root").select("key", "class_id", n_links, F.coalesce("texts", F.lit(0)).cast("bigint").alias("n_texts"), (F.col("key") == F.col("first_key")).alias("stands"))
    plain = signed.select("doc_id", "th", "key")
    first = (F.col("stands") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("first")
    with_set = plain.where("key is not null").join(known, "key").select("doc_id", "th", "key", "class_id", "n_links", "n_texts", first)
    none = F.lit(0).cast("bigint")
    return with_set.unionByName(plain.where("key is null").select("doc_id", "th", "key", F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_texts"), F.lit(True).alias("first")))


def _once(verify):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return verify(group.drop_duplicates("key").reset_index(drop=True))

    return run


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of docs for each class, of the smallest id in it; of texts without words, each id's."""
    found = classes(docs, doc_id, text, **options).where("first")
    # An id may repeat with texts of one set: the least hash stays, and one row of it.
    kept = found.groupBy("key", "doc_id").agg(F.min("th").alias("_kh")).select(F.col("doc_id").alias("_kept"), "_kh").distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th"))
    joined = rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_th") == F.col("_kh")), "left_semi")
    return joined.dropDuplicates(["_id", "_th"]).select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_texts")
