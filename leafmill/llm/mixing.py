"""Mixing sources to target weights by Pareto order sampling.

Targets: every source gets a share of all words by its weight, stopped at `cap`
times its own words; what is cut off is shared again by weight until no source
is above. That fixed point is one water level: sort the sources by cap/weight and
take the first level that its own source does not exceed, so two running sums
over the small table of sources replace the iteration.

Documents: document j of a source is expected pi_j = min(cap, rate * w_j) times,
where w_j = (1 + size)^(-1/4) favours short documents a little, so that few very
long ones are repeated, and rate is the source's target over its sum of w_j *
size. Where cap then leaves too few words, even with one copy of each document
above floor(pi_j), the rate is a water level over documents instead: those at cap
are fixed, and the others share the rest until sum(pi_j * size) is the target. It gets floor(pi_j) certain whole copies. The rest of the target is drawn
by Pareto order sampling: with p_j the remaining inclusion probability and u_j a
uniform number from the MD5 of the id, documents are ranked by
[u/(1-u)] / [p/(1-p)] and taken from the front until the source's words are
reached, so the sample's size is fixed in words. Of the documents behind the cut
the one whose size is nearest to the words still missing closes the gap, if that
brings the source nearer to its target.

No window runs over a whole source: ranks are cut into `SLICES` slices of their
odds, partial sums per slice find the slice where the target falls, and only
that slice is sorted. Rows before it are taken and rows behind it are not.

Defined results: null text counts as size 0; a document of size 0 is never
taken; a null source is a source of its own, last in the order; ties in rank go
to the smaller id, then to the larger size, then to the text's hash; an empty table gives no rows; a
repeated row is a document of its own with the same random number, and one of them at most closes the gap;
other columns of the input are ignored by `mix` and kept by `mixed_documents`, but that rows equal in all columns
are dealt their copies together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import size_in_words, table, written

CAP = 3
#: Slices of the rank per source.
SLICES = 1024
#: Parts into which a source's rows are dealt when something is joined to them.
SALTS = 64
#: Sums of weighted sizes are sums of integers, so that they do not depend on the order of rows.
UNIT = 1 << 20
TWO_52 = float(1 << 52)


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, weighted, target from one row per source. One task sorts the sources, not the documents."""
    by_name = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    by_level = Window.orderBy("limit", "weight", F.col("source").cast("binary").asc_nulls_last())
    sources = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("limit", cap * F.col("source_size") / F.col("weight"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("spent", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") - F.col("spent")).cast("double") / F.col("left"))
    )
    level = F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "level"))).over(everything)["level"]
    target = F.least((cap * F.col("source_size")).cast("double"), level * F.col("weight"))
    return ranked.withColumn("target", F.coalesce(target, F.lit(0.0))).select("source", "source_size", "weighted", "target")


def _weight(size: Column) -> Column:
    return F.lit(1.0) / F.sqrt(F.sqrt(F.lit(1.0) + size))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    The texts are read once; everything else works on the written ids and sizes."""
    return _taken(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_in_words(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("th")), cap).drop("th")


def _taken(base: DataFrame, cap: int) -> DataFrame:
    """The columns of `mix` and th from doc_id, source, size, th. Each row gets a number, so that rows which repeat are told apart."""
    out = _mixed(written(base.withColumn("row", F.monotonically_increasing_id()), "sizes"), cap)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "th")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cap: int = CAP) -> DataFrame:
    """The mix itself: the rows of docs with their own columns, each as often as it is taken.

    Rows that agree in id, source, size and the hash of all columns stand together: of several, one is read as often as all are taken."""
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("d"), F.col(source).alias("s"), size_in_words(F.col(text)).alias("z"), whole.alias("h"))
    base = rows.select(F.col("d").alias("doc_id"), F.col("s").alias("source"), F.col("z").alias("size"), F.col("h").alias("th"))
    taken = _taken(base, cap).groupBy("doc_id", "source", "size", "th").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    same = F.col("d").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")) & (F.col("h") == F.col("th"))
    found = rows.join(written(taken, "taken"), same)
    few = found.where("n = 1").select("row", "copies")
    repeated = found.where("n > 1").groupBy("d", "s", "z", "h").agg(F.first("row").alias("row"), F.first("copies").alias("copies")).select("row", "copies")
    return few.unionByName(repeated).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def _mixed(base: DataFrame, cap: int) -> DataFrame:
    units = F.floor(_weight(F.col("size")) * F.col("size") * UNIT) * F.col("n")
    # Each table is written as soon as it is needed twice, so that plans stay small and nothing is computed again.
    spread = written(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("words", F.col("size") * F.col("n")).withColumn("units", units), "spread")
    sizes = spread.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("units").alias("weighted"))
    goal = targets(sizes, cap).select(F.col("source").alias("s"), "source_size", "target", (F.when(F.col("weighted") > 0, F.col("target") / (F.col("weighted") / UNIT)).otherwise(0.0)).alias("rate"))
    goal = written(_reaching(spread, written(goal, "targets"), cap), "goal")
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / TWO_52
    rows = (
        _by_source(base.withColumn("salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")), goal, "s")
        .withColumn("pi", F.least(F.lit(float(cap)), F.col("rate") * _weight(F.col("size"))))
        .withColumn("whole", F.floor("pi").cast("long"))
        .withColumn("p", F.col("pi") - F.col("whole"))
        .withColumn("u", u)
        # The odds ratio r becomes r/(1+r), which has the same order and lies in (0, 1).
        .withColumn("a", F.col("u") * (1 - F.col("p"))).withColumn("b", F.col("p") * (1 - F.col("u")))
        .withColumn("rank", F.when((F.col("size") > 0) & (F.col("whole") < cap), F.when(F.col("b") > 0, F.col("a") / (F.col("a") + F.col("b"))).otherwise(1.0)))
        .withColumn("slice", F.floor(F.col("rank") * SLICES))
        .drop("a", "b", "u", "p", "pi", "rate")
    )
    rows = written(rows, "ranked")
    # Where in each source's ranking does the target fall?
    slices = rows.groupBy("source", "slice").agg(F.sum(F.when(F.col("slice").isNotNull(), F.col("size")).otherwise(0)).alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    along = Window.partitionBy("source").orderBy(F.col("slice").asc_nulls_first())
    all_of = Window.partitionBy("source")
    slices = slices.withColumn("need", F.col("target") - F.sum("certain").over(all_of)).withColumn("upto", F.sum("words").over(along))
    cut = slices.groupBy("source").agg(
        F.first("need").alias("need"),
        F.min(F.when(F.col("slice").isNotNull() & (F.col("upto") > F.col("need")), F.struct("slice", "upto", "words"))).alias("at"),
    ).select(F.col("source").alias("cs"), "need", F.col("at.slice").alias("cut"), (F.col("at.upto") - F.col("at.words")).alias("before"))
    placed = _by_source(rows, written(cut, "cut"), "cs")
    # Only the slice of the cut is sorted; the rows of other slices are dealt by slice and each is a group by itself.
    here = F.col("slice") == F.col("cut")
    order = Window.partitionBy("source", F.when(here, F.lit(-1)).otherwise(F.xxhash64("doc_id", "size"))).orderBy("rank", "doc_id", F.desc("size"), "th", "row")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("before")
    placed = placed.withColumn("upto", F.when(here, upto))
    extra = F.when(F.col("slice").isNull(), False).when(F.col("cut").isNull() | (F.col("slice") < F.col("cut")), True).when(here, F.col("upto") <= F.col("need")).otherwise(False)
    return _closed(written(placed.withColumn("extra", extra), "placed"))


def _reaching(spread: DataFrame, goal: DataFrame, cap: int) -> DataFrame:
    """goal, with the rate of a water level over documents where the plain rate cannot reach the target.

    Documents at cap are the shortest ones, so running sums over a source's distinct sizes find the first size that its own rate leaves under cap."""
    w = _weight(F.col("size"))
    joined = spread.where("size > 0").join(goal.select("s", "target", "rate"), F.col("source").eqNullSafe(F.col("s")))
    all_of = Window.partitionBy("source")
    upto = all_of.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    capped, rest = F.sum("words").over(upto) - F.col("words"), F.sum("units").over(all_of) - F.sum("units").over(upto) + F.col("units")
    levels = joined.withColumn("level", (F.col("target") - cap * capped) / (rest / UNIT))
    first = F.min(F.when(F.col("level") * w <= cap, F.struct("size", "level")))["level"]
    most = F.sum(F.least(F.lit(cap), F.floor(F.col("rate") * w) + 1) * F.col("words"))
    # Where no size is left under cap, all documents are at cap.
    short = levels.groupBy("source").agg(most.alias("most"), F.first("target").alias("goal"), F.coalesce(first, F.lit(cap * 1e9)).alias("level")).where("most < goal")
    found = goal.join(short.select(F.col("source").alias("ss"), "level"), F.col("s").eqNullSafe(F.col("ss")), "left")
    return found.select("s", "source_size", "target", F.coalesce("level", "rate").alias("rate"))


def _by_source(rows: DataFrame, small: DataFrame, name: str) -> DataFrame:
    """Join one row per source to the rows. A source's rows are dealt over SALTS keys, so that a large one is many tasks' work."""
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = rows["source"].eqNullSafe(salted[name]) & (rows["salt"] == salted["_salt"])
    return rows.join(salted, same).drop(name, "_salt")


def _closed(placed: DataFrame) -> DataFrame:
    """Add the document whose size is nearest to the words still missing, if it brings the source nearer."""
    spent = F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))
    gap = placed.groupBy("source").agg((F.first("need") - spent).alias("gap")).select(F.col("source").alias("gs"), "gap")
    joined = _by_source(placed, gap, "gs")
    off = F.abs(F.col("size") - F.col("gap"))
    best = F.when(~F.col("extra") & F.col("slice").isNotNull() & (off < F.col("gap")), F.struct(off.alias("off"), F.col("rank"), F.col("doc_id"), F.col("size"), F.col("th"), F.col("row")))
    close = joined.groupBy("source").agg(F.min(best).alias("best")).select(F.col("source").alias("bs"), F.col("best.row").alias("best_row"))
    out = _by_source(joined, close, "bs")
    chosen = F.coalesce(F.col("row") == F.col("best_row"), F.lit(False))
    return out.withColumn("copies", F.col("whole") + F.when(F.col("extra") | chosen, 1).otherwise(0))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, row_number() OVER () AS row FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(sum(CAST(floor(1::DOUBLE / sqrt(sqrt(1::DOUBLE + size)) * size * 1048576) AS BIGINT)) AS BIGINT) AS weighted
  FROM base GROUP BY source
), weights AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes
), limits AS (
  SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS lim FROM weights
), ranked AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY lim, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY lim, weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev
  FROM limits
), water AS (
  SELECT arg_min(lev, lim) AS lev FROM ranked WHERE lev <= lim
), goal AS (
  SELECT source, source_size, weighted, coalesce(least(CAST(3 * source_size AS DOUBLE), (SELECT lev FROM water) * weight), 0::DOUBLE) AS target FROM limits
), expected AS (
  SELECT b.doc_id, b.source, b.size, b.row, g.source_size, g.target,
         least(3::DOUBLE, CASE WHEN g.weighted > 0 THEN g.target / (CAST(g.weighted AS DOUBLE) / 1048576) ELSE 0 END * (1::DOUBLE / sqrt(sqrt(1::DOUBLE + b.size)))) AS pi,
         (CAST(('0x' || substr(md5(coalesce(CAST(b.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source
), odds AS (
  SELECT *, CAST(floor(pi) AS BIGINT) AS whole, u * (1 - (pi - floor(pi))) AS a, (pi - floor(pi)) * (1 - u) AS b FROM expected
), placed AS (
  SELECT *, CASE WHEN size > 0 AND whole < 3 THEN CASE WHEN b > 0 THEN a / (a + b) ELSE 1 END END AS pos,
         target - sum(whole * size) OVER (PARTITION BY source) AS need
  FROM odds
), run AS (
  SELECT *, pos IS NOT NULL AND sum(CASE WHEN pos IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY pos NULLS LAST, doc_id NULLS FIRST, size DESC, row ROWS UNBOUNDED PRECEDING) <= need AS extra
  FROM placed
), gaps AS (
  SELECT *, need - sum(CASE WHEN extra THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM run
), closing AS (
  SELECT source AS s, arg_min(row, struct_pack(o := abs(size - gap), r := pos, d := doc_id, z := size, w := row)) AS best
  FROM gaps WHERE NOT extra AND pos IS NOT NULL AND abs(size - gap) < gap GROUP BY source
), final AS (
  SELECT g.*, whole + CASE WHEN extra OR g.row IS NOT DISTINCT FROM c.best THEN 1 ELSE 0 END AS copies
  FROM gaps g LEFT JOIN closing c ON g.source IS NOT DISTINCT FROM c.s
)
SELECT doc_id, source, size, source_size, target, copies, CAST(size * copies AS BIGINT) AS taken FROM final
"""
