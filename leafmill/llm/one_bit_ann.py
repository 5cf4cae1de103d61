"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are scaled to length one and rotated by a random orthogonal matrix, fixed by a
seed. A vector's code is the sign of each rotated component, packed; beside it two
correction scalars are kept: f, the inner product of the rotated vector with its code
(scaled to length one), and the width of the error, sqrt(1 - f^2) / f. For a query q
the inner product <o, q> is estimated as <code, q'> / f from the packed bits, and with high
probability lies within epsilon * width / sqrt(dim - 1) of that. Candidates whose upper
bound reaches the k-th largest lower bound are reranked on the original vectors, in
double precision.

Index rows and queries are dealt into blocks that bound a task's memory; a task has one block of each, estimates by look-ups of
packed bytes in a table of a query's partial sums, reranks what passes the bound on the vectors, and returns the k best per query, so that few rows
leave a block however many pass. (To send on what passes, and to join vectors afterwards, was tried: at 64 dimensions a fifth of all pairs pass.)
Equal vectors have equal codes, so of each different vector only the k + 1 rows first in order are candidates: no others can be among
the k nearest. No vector is broadcast and none goes to the driver.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, neither as query nor as candidate; vectors of another dimension than a
query's are no candidates of it; a query's own row is no candidate, but other rows of its id are; a row with a null id is a candidate, behind
others in ties; ties go to the smaller id; rows that repeat an id are rows of their own, each a query if its id is one; fewer
candidates than k are all returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table, written

SEED = 20240521
#: Rows of a task: candidates and queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 16_384, 2_048
#: Small tables are dealt into up to so many blocks all the same, for the sake of parallel tasks.
LEAST_BLOCKS = 24
#: How many standard widths the error bound spans.
EPSILON = 2.5


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes and f of the rows of x."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


_TURNS: dict[int, np.ndarray] = {}


def turn(dim: int) -> np.ndarray:
    """The rotation of a dimension, made once in a worker."""
    if dim not in _TURNS:
        _TURNS[dim] = rotation(dim)
    return _TURNS[dim]


def index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """row (a number), vec_id, dim, vector, code, f: every usable row."""

    def code(batches):
        for rows in batches:
            out = []
            for dim, part in rows.groupby("dim"):
                codes, f = encode(np.array(part["vector"].tolist(), np.float64), turn(dim))
                out.append(part.assign(code=[c.tobytes() for c in codes], f=f))
            if out:
                yield pd.concat(out)

    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    return rows.select("row", "vec_id", F.size("vector").alias("dim"), "vector").mapInPandas(code, "row bigint, vec_id bigint, dim int, vector array<double>, code binary, f double")


#: The signs of the eight bits of each byte, the highest first.
SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1


def estimates(turned: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Inner products of the rows of turned with the signs of packed codes: a sum of looked-up sums of eight components each."""
    padded = np.zeros((len(turned), codes.shape[1] * 8), np.float32)
    padded[:, : turned.shape[1]] = turned  # the bits behind the last component meet zeros
    out = np.zeros((len(turned), len(codes)), np.float32)
    for i in range(codes.shape[1]):
        sums = padded[:, 8 * i : 8 * i + 8] @ SIGNS.T
        out += np.take(sums, codes[:, i], axis=1)
    return out


def _nearest(k: int, epsilon: float):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"asker": np.empty(0, np.int64), "query_id": np.empty(0, np.int64), "row": np.empty(0, np.int64), "key": np.empty(0, np.int64), "none": np.empty(0, bool), "score": np.empty(0)})]
        if queries.empty or candidates.empty:
            return found[0]
        dim = int(queries["dim"].iloc[0])
        askers, rows = queries["row"].to_numpy(), candidates["row"].to_numpy()
        ids, key, none = queries["vec_id"].to_numpy(), candidates["key"].to_numpy(), candidates["none"].to_numpy()
        o = np.array(candidates["vector"].tolist())
        norms = np.linalg.norm(o, axis=1)
        f = np.maximum(candidates["f"].to_numpy(), 1e-9)
        codes = np.frombuffer(b"".join(candidates["code"]), np.uint8).reshape(len(rows), -1)
        # A margin for single precision, so that the bounds hold as they would in double.
        width = epsilon * np.sqrt(np.maximum(0, 1 - f * f)) / f / np.sqrt(max(dim - 1, 1)) + 1e-5 / f
        for start in range(0, len(queries), 128):
            v = np.array(queries["vector"].iloc[start : start + 128].tolist())
            turned = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ turn(dim)
            about = estimates(turned.astype(np.float32), codes) / (np.sqrt(dim) * f)
            about[askers[start : start + 128, None] == rows[None, :]] = -np.inf
            floor = np.partition(about - width, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(about), -np.inf)
            for i, row in enumerate(about):
                pick = np.nonzero((row + width >= floor[i]) & (row > -np.inf))[0]
                score = (o[pick] * v[i]).sum(axis=1) / (norms[pick] * np.sqrt((v[i] * v[i]).sum()))
                best = np.lexsort((rows[pick], key[pick], -score))[:k]
                pick = pick[best]
                found.append(pd.DataFrame({"asker": askers[start + i], "query_id": ids[start + i], "row": rows[pick], "key": key[pick], "none": none[pick], "score": score[best]}))
        return pd.concat(found)

    return run


def search(coded: DataFrame, query: Column, k: int = 5, epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of the index where `query` holds, its k nearest other rows."""
    coded = written(coded, "codes")
    rows, asked = coded.count(), coded.where(query).count()
    n, m = max(1, -(-rows // CANDIDATE_BLOCK), min(LEAST_BLOCKS, rows // 1024)), max(1, -(-asked // QUERY_BLOCK))
    deal = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    same = Window.partitionBy("dim", "code", "f", F.xxhash64("vector"), F.xxhash64(F.lit(1), F.col("vector"))).orderBy(F.col("vec_id").asc_nulls_last(), "row")
    first = coded.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1).drop("place")
    # A null id stands behind all others; pandas knows no null integers.
    first = first.select("row", F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("key"), F.col("vec_id").isNull().alias("none"), "dim", "vector", "code", "f")
    queries = coded.where(query).select("row", "vec_id", "dim", "vector", deal(m).alias("q")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    candidates = first.withColumn("c", deal(n)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    by = ["dim", "q", "c"]
    found = queries.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInPandas(_nearest(k, epsilon), "asker bigint, query_id bigint, row bigint, key bigint, none boolean, score double")
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "key", "none", "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.when(~F.col("none"), F.col("key")).alias("vec_id"), "score")


def op1_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)

