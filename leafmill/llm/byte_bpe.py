"""Byte-level BPE by Spark's higher-order functions.

A text is cut into words by the tokenizer's pattern. A word that is in the rank
table is one token. Any other word is folded: its bytes are an array of pieces,
and each step of the fold merges the leftmost adjacent pair of lowest rank, until
no pair has a rank. Ranks come from a literal map of pairs of ids, kept as two flat arrays
(a sparse table, in which a pair has one slot), so that it is small and a look-up is two reads.

Words repeat, so the words found more than once in a bounded sample of texts
(`SAMPLE_TEXTS`, `MEMO_WORDS`) are folded once and their ids put into a second literal, an
array of small maps chosen by the key's hash, as Spark looks a key up in a map by scanning it. There is a map for every two to
four words, so that the literal, of which the driver makes several copies for a job, grows with the words. It only saves work: a word that is not in it is folded where it
stands, so results do not depend on the sample. Nothing is shuffled but the words
of the sample.

Decoding takes each id's piece from a literal array and concatenates the pieces'
bytes (joined as characters of one byte each, so that long texts stay linear).

Defined results: null text counts as empty, an empty text has no ids and decodes to
no bytes; special tokens are ordinary text; repeated rows are encoded each; an empty
table gives no rows; other columns are ignored by `encode_documents` and kept by
`with_tokens`. A single word of n bytes that is not in the table takes time in
proportion to n squared. Letter, number and white space classes are Java's Unicode tables.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import largest, literal, table, written

#: A piece in the fold is one number: the rank of the pair that begins with it, its offset in the word, its id, of so many bits.
ID_BITS, OFFSET_BITS = 20, 24
#: What stands for a rank where there is none; the bits of an id.
NONE, ID = 1 << 18, (1 << ID_BITS) - 1
#: A free slot of the table of pairs: no pair's bits.
FREE = 1 << 61
HIGH = 1 << (ID_BITS + OFFSET_BITS)
SAMPLE_TEXTS, MEMO_WORDS = 20_000, 120_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def unmade(ranks: dict[bytes, int]) -> dict[str, int]:
    """Texts that are one piece though merges do not make it of them."""

    def merged(key: bytes) -> list[bytes]:
        parts = [key[i : i + 1] for i in range(len(key))]
        while len(parts) > 1:
            least, i = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if least == NONE:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    out = {}
    for key, rank in ranks.items():
        if len(merged(key)) > 1:
            with contextlib.suppress(UnicodeDecodeError):  # no word has such bytes
                out[key.decode()] = rank
    return out


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _hashed(rows: DataFrame, buckets: int, name: str) -> Column:
    """A literal array of maps from rows (key, value), by the key's hash."""
    maps = rows.groupBy(_bucket(F.col("key"), buckets).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    filled = rows.sparkSession.range(0, buckets, 1, 1).join(maps, F.col("id") == F.col("b"), "left")
    in_order = F.array_sort(F.collect_list(F.struct(F.col("id"), F.map_entries("m").alias("m"))))
    return literal(filled.groupBy().agg(F.transform(in_order, lambda x: F.map_from_entries(x["m"])).alias("maps")), name)


def _bucket(key: Column, buckets: int) -> Column:
    """buckets is a power of two."""
    return F.hash(key).bitwiseAND(F.lit(buckets - 1))


def _array(spark: SparkSession, values, kind: pa.DataType, name: str) -> Column:
    """A literal array, kept in flat binary form."""
    return literal(spark.createDataFrame(pa.table({"a": pa.array([values], pa.list_(kind))})), name)


def pair_table(pairs: np.ndarray, ids: int, room: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A sparse table of pairs as two arrays: the pair (left, right) stands in slot right ^ shift[left] and nowhere else.

    pairs: rows (left, right, rank). Lefts with many rights get their shift first, the first of a fixed random sequence that
    leaves each of their pairs a free slot; the table doubles if none does."""
    size = 1 << max(8, int(max(ids, room * len(pairs))).bit_length())
    order = np.argsort(pairs[:, 0], kind="stable")
    pairs = pairs[order]
    lefts, at, n = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    r = np.random.default_rng(7)
    slots, shift = np.full(size, FREE, np.int64), np.zeros(ids, np.int64)
    for k in np.argsort(-n, kind="stable"):
        some = pairs[at[k] : at[k] + n[k]]
        for d in r.integers(0, size, 2000):
            to = some[:, 1] ^ d
            if (slots[to] == FREE).all():
                break
        else:
            return pair_table(pairs, ids, 2 * room)
        slots[to] = (some[:, 0] << 2 * ID_BITS) + (some[:, 1] << ID_BITS) + some[:, 2]
        shift[lefts[k]] = d
    return slots, shift


class ByteBPE:
    """Encoder and decoder for one rank file and pattern.

    The rank map has a row for each pair of pieces whose bytes together are a piece: (id of the left, id of the right) ->
    rank of both, which is the id of the merged piece. So a fold over byte pieces carries their ids."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.spark, self.pattern = spark, "(?U)" + pattern
        ranks = read_ranks(path)
        most = max(ranks.values(), default=-1)
        if most >= NONE or any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError(f"ranks must be below {NONE}, and every byte must have one")
        self.name = hashlib.sha256((path + pattern).encode()).hexdigest()[:16]
        pairs = [(ranks[key[:i]], ranks[key[i:]], rank) for key, rank in ranks.items() for i in range(1, len(key)) if key[:i] in ranks and key[i:] in ranks]
        slots, shift = pair_table(np.array(pairs, np.int64).reshape(-1, 3), most + 1)
        self.names = [f"{kind}_{self.name}" for kind in ("slots", "shift", "starts", "pieces", "words")]
        self._slots, self._shift = _array(spark, slots, pa.int64(), self.names[0]), _array(spark, shift, pa.int32(), self.names[1])
        # What a byte and the next one start from: the rank of their pair and the id of the first; 256 stands for the end.
        own = [ranks[bytes([i])] for i in range(256)]
        starts = [(ranks.get(bytes([i, j]), NONE) if j < 256 else NONE) * HIGH + own[i] for i in range(256) for j in range(257)]
        self._starts = _array(spark, np.array(starts, np.int64), pa.int64(), self.names[2])
        pieces: list[str] = [""] * (most + 1)
        for key, value in ranks.items():
            pieces[value] = key.decode("latin-1")
        self._pieces = _array(spark, pieces, pa.string(), self.names[3])
        self._unmade = unmade(ranks)
        self._memo: Column | None = None
        self._buckets = 0

    def forget(self) -> None:
        """Drop the session's variables. Plans that were made before keep their values."""
        for name in self.names:
            self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS leafmill_{name}")

    def pair(self, left: Column, right: Column) -> Column:
        """The rank of two adjacent pieces, NONE if their bytes are no piece: a slot of another pair differs above the rank's bits."""
        here = F.get(self._slots, right.bitwiseXOR(F.get(self._shift, left)))
        return F.least(here.bitwiseXOR(left * (1 << 2 * ID_BITS) + right * (1 << ID_BITS)), F.lit(NONE).cast("bigint"))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def fold(self, word: Column) -> Column:
        """The ids of one word, by ranked merges.

        The least piece begins the leftmost pair of lowest rank, and that rank is the id of what the pair makes."""
        none = F.lit(NONE * HIGH)
        of = lambda x: x.bitwiseAND(F.lit(ID))

        def merged(x: Column, least: Column) -> Column:
            m = F.shiftright(least, ID_BITS + OFFSET_BITS)

            def piece(e: Column, i: Column) -> Column:
                after = F.coalesce(self.pair(m, of(F.get(x, i + 2))), F.lit(NONE))
                both = after * HIGH + least.bitwiseAND(F.lit(HIGH - 1 - ID)) + m
                left = self.pair(of(e), m) * HIGH + e.bitwiseAND(F.lit(HIGH - 1))
                return F.when(e == least, both).when(F.get(x, i + 1) == least, left).when(F.get(x, i - 1) == least, F.lit(None)).otherwise(e)

            return F.filter(F.transform(x, piece), lambda e: e.isNotNull())

        def folded(bytes_: Column) -> Column:
            start = F.transform(bytes_, lambda c, i: F.get(self._starts, c * 257 + F.coalesce(F.get(bytes_, i + 1), F.lit(256))) + i * (1 << ID_BITS))
            # A fold over one value names it, as _let does, and does not copy what it returns.
            step = lambda x, _: F.aggregate(F.array(F.array_min(x)), x, lambda x, least: F.when(least >= none, x).otherwise(merged(x, least)))
            return F.aggregate(bytes_, start, step, lambda x: F.transform(x, of))

        letters = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
        ids = _let(F.transform(letters, F.ascii), folded)
        if not self._unmade:
            return ids
        whole = F.element_at(F.create_map(*[F.lit(x) for entry in self._unmade.items() for x in entry]), word)
        return F.when(whole.isNotNull(), F.array(whole.cast("bigint"))).otherwise(ids)

    def remember(self, docs: DataFrame, text: str = "text", sample_texts: int = SAMPLE_TEXTS, words: int = MEMO_WORDS) -> None:
        """Fold the words that a sample of the texts repeats, once and for all."""
        every = max(1, docs.count() // sample_texts)
        sample = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(every)) == 0)
        counted = written(sample.select(F.explode(self.words(F.col(text))).alias("key")).groupBy("key").count().where("count > 1"), "bpe-sample")
        folded = written(largest(counted, "count", words, F.col("key")).select("key").repartition(64).select("key", self.fold(F.col("key")).alias("value")), "bpe-words")
        self._buckets = 1 << (max(folded.count() // 4, 1) - 1).bit_length()
        self._memo = _hashed(folded, self._buckets, self.names[4])

    def encode(self, text: Column) -> Column:
        """array<bigint>: the ids of a text."""
        if self._memo is None:
            return F.flatten(F.transform(self.words(text), self.fold))
        known = lambda w: F.element_at(F.get(self._memo, _bucket(w, self._buckets)), w)
        return F.flatten(F.transform(self.words(text), lambda w: F.coalesce(known(w), self.fold(w))))

    def decode(self, ids: Column) -> Column:
        """binary: the bytes of the ids' pieces, one after the other."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(self._pieces, i)), ""), "ISO-8859-1")


def encode_documents(docs: DataFrame, bpe: ByteBPE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids."""
    return docs.select(F.col(doc_id).alias("doc_id"), bpe.encode(F.col(text)).alias("ids"))


def public_bpe(spark: SparkSession, name: str = "byte_bpe_multi_50k.tiktoken") -> ByteBPE:
    import public_tokenizers

    return ByteBPE(spark, public_tokenizers.path(name), public_tokenizers.PATTERN)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bpe = public_bpe(spark)
    bpe.remember(docs, sample_texts=30_000, words=300_000)
    ids = encode_documents(docs, bpe)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(bpe.decode(F.col("ids")), 256).alias("decoded_sha256"),
    )
