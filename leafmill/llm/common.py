"""Helpers shared by the text operators: table reading, shared folders, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The white space of the contracts, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; a local one is set only where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def slices(batches, rows: int = 512):
    """Small pieces of Arrow batches, so that what Python builds for each stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def held_out(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: remainder 1 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == 1


def size_in_words(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def literal(row: DataFrame, name: str) -> Column:
    """The one value of a row of one column, as a literal: a session variable, whose value plans hold in binary form.

    A name that is given again is given a new value; plans that were made before keep the old one."""
    spark, name = row.sparkSession, f"leafmill_{name}"
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} {row.schema[0].dataType.simpleString()}")
    row.createOrReplaceTempView(name)
    spark.sql(f"SET VAR {name} = (SELECT * FROM {name})")
    spark.catalog.dropTempView(name)
    return F.expr(f"system.session.{name}")


def largest(rows: DataFrame, column: str, most: int, fill: Column | None = None) -> DataFrame:
    """At most `most` rows: all whose positive `column` reaches a limit, in steps of 1 %.

    The limit comes from a histogram of a few thousand rows. orderBy().limit() would send `most` rows of each partition
    to the driver. With `fill`, a key, what room is left goes to rows of the next step, chosen by the key's hash."""
    step = F.floor(F.log(F.col(column)) * 100).cast("int")
    total, limit, more = 0, None, F.lit(False)
    for row in sorted(rows.groupBy(step.alias("step")).count().collect(), reverse=True):
        if total + row["count"] > most:
            share = 0.97 * (most - total) / row["count"]
            more = F.lit(False) if fill is None else (step == row["step"]) & (F.pmod(F.xxhash64(fill), F.lit(1 << 30)) < int(share * (1 << 30)))
            break
        total, limit = total + row["count"], row["step"]
    return rows.where((F.lit(False) if limit is None else step >= limit) | more)


def sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows of smallest hash of key, `most` at most. A share of the rows is chosen before they are sorted, so that partitions send few."""
    n = rows.count()
    share = min(1.0, 2 * (most + 50) / n) if n else 1.0
    few = rows.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return few.orderBy(F.xxhash64(key), key).limit(most)


#: Keys that hold one row in so many are joined by broadcast; there are at most so many of them.
HOT = 1_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, n: str = "n") -> DataFrame:
    """rows joined to counted, which has each key once, with the number of its rows in column `n`; without that column.

    A key that holds a thousandth of all `total` rows or more would be one task's work in a shuffle. There are a
    thousand such keys at most, so that these are broadcast, and the rows of all other keys are shuffled. Keys are not null."""
    hot = F.broadcast(counted.where(F.col(n) * HOT >= total).drop(n))
    cold = counted.where(F.col(n) * HOT < total).drop(n)
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys))
