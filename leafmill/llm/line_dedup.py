"""Removal of passages that occurred before, by winnowing over line hashes.

A text is its lines (split at line feeds); a line's content is the line without
leading and trailing white space, and lines without content are not counted.
A window starts at every line and takes lines until it has `min_words` words; where the window that ends
at a line, taken backwards, is a longer one, it counts too. So a run of `min_words` words or more is
covered by the windows inside it, wherever it stands.

1. Winnowing: each window selects the line of least hash (the leftmost of equal ones). A fingerprint is a
   selected place, keyed by that line's hash; neighbouring windows select the same place, so there are fewer
   fingerprints than lines. Equal windows select the same line: no repeat is without a common fingerprint.
2. Positions are joined: keys that one place has are dropped, with all windows that selected it.
3. Around the places that are left, matches are extended both ways: the windows that selected a place reach to both
   sides of it, and each is compared, by the hash of its whole content, with the first place of that content, which a partial
   minimum finds before the shuffle. Places are never paired with each other, so a passage in a third of
   all documents costs one row per document and window.
4. Windows that stand at an earlier place are merged to runs, and the runs are deleted, with the blank lines inside the windows.

Hence a line goes if, and only if, it lies in a run of `min_words` words or more that stands at an earlier place.
Passages that begin or end inside a line are out of reach.

Defined results: null text stays null; texts shorter than `min_words` words stay
as they are; a text of which nothing is left becomes empty; the earlier of
two places is that with the smaller id (a null id is smallest), then the
smaller text hash, then the smaller line; rows that repeat an id with another text are
texts of their own, and exact repeats of id and text are treated as one text, all of
them alike; an empty table gives no rows; all other columns are kept by
`without_repeats`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, join_counted, table, written

MIN_WORDS = 50
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _lines(text: Column) -> Column:
    """array<struct<h: content hash, w: words, at: index among all lines>> of the lines that have content."""
    cut = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line, i: F.struct(F.regexp_replace(line, TRIM, "").alias("s"), i.alias("at")))
    return F.transform(F.filter(cut, lambda x: x["s"] != ""), lambda x: F.struct(F.xxhash64(x["s"]).alias("h"), F.regexp_count(x["s"], F.lit(WORD)).alias("w"), x["at"].alias("at")))


def _windows(texts: DataFrame, min_words: int) -> DataFrame:
    """doc_id, th, pos and key (place and hash of the selected line), start, first, last (among all lines), c1, c2 (content): all windows."""
    lines = texts.select("doc_id", "th", F.posexplode("lines").alias("start", "line")).select("doc_id", "th", "start", "line.h", "line.w", "line.at")
    one = Window.partitionBy("doc_id", "th")
    lines = lines.withColumn("before", F.coalesce(F.sum("w").over(one.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("end", F.col("before") + F.col("w"))
    # A line is in the window while the words before it, counted from the window's start, are fewer than min_words; backwards alike.
    ahead, back = one.orderBy("before").rangeBetween(0, min_words - 1), one.orderBy("end").rangeBetween(1 - min_words, 0)

    def window(over, words: Column, start: Column) -> Column:
        content = F.collect_list("h").over(over)
        sides = F.min("at").over(over).alias("first"), F.max("at").over(over).alias("last")
        hashes = F.xxhash64(content).alias("c1"), F.xxhash64(F.lit(min_words), content, F.size(content)).alias("c2")
        return F.when(words >= min_words, F.struct(F.min(F.struct("h", "start")).over(over).alias("chosen"), start.alias("start"), *sides, *hashes))

    begun = F.min("before").over(back)
    # A window backwards that would reach min_words without its last line; all others are windows ahead of their first line.
    longer = window(back, F.when(F.col("before") - begun >= min_words, F.col("end") - begun).otherwise(0), F.min("start").over(back))
    both = lines.select("doc_id", "th", window(ahead, F.max("end").over(ahead) - F.col("before"), F.col("start")).alias("a"), longer.alias("b"))
    found = both.select("doc_id", "th", F.explode(F.array_compact(F.array("a", "b"))).alias("x"))
    return found.select("doc_id", "th", F.col("x.chosen.start").alias("pos"), F.col("x.chosen.h").alias("key"), "x.start", "x.first", "x.last", "x.c1", "x.c2")


def fingerprints(windows: DataFrame) -> DataFrame:
    """doc_id, th, pos, key, windows: the distinct selected places, with the number of windows that selected each."""
    return windows.groupBy("doc_id", "th", "pos", "key").agg(F.count(F.lit(1)).alias("windows"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), ranges: the runs of lines to delete, in order and apart, for texts that have any."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), _lines(F.col(text)).alias("lines"))
    texts = written(own.where(F.size("lines") > 0), "lines").groupBy("doc_id", "th").agg(F.first("lines").alias("lines"))
    windows = written(_windows(texts, min_words), "windows")
    shared = fingerprints(windows).groupBy("key").agg(F.sum("windows").alias("n"), F.count(F.lit(1)).alias("places")).where("places > 1").drop("places")
    met = written(join_counted(windows, written(shared, "shared"), ["key"], windows.count()).drop("pos", "key"), "met")
    place = F.struct("doc_id", "th", "start")
    firsts = met.groupBy("c1", "c2").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = join_counted(met, written(firsts, "firsts"), ["c1", "c2"], met.count()).where(~place.eqNullSafe(F.col("earliest")))
    # Windows that overlap are one run.
    along = Window.partitionBy("doc_id", "th").orderBy("first", "last")
    upto = F.max("last").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("new", F.when(F.col("first") <= upto, 0).otherwise(1)).withColumn("run", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("doc_id", "th", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """docs with the repeated runs taken out of its text; with counts, also removed_lines (blank ones included)."""
    found = repeats(docs, doc_id, text, min_words).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("ranges").alias("_r"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th"), F.col(text).alias("_text"))
    joined = rows.join(found, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    parts, r = F.split("_text", "\n", -1), F.col("_r")
    # The pieces before, between and behind the runs.
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get(r, i - 1)["last"] + 1)
    end = lambda i: F.coalesce(F.get(r, i)["first"], F.size(parts))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(r)), lambda i: F.slice(parts, begin(i) + 1, end(i) - begin(i))))
    new = F.when(r.isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    out = [new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns]
    if counts:
        gone = F.aggregate(r, F.lit(0), lambda n, x: n + x["last"] - x["first"] + 1)
        out.append(F.when(r.isNull(), 0).otherwise(gone).alias("removed_lines"))
    return joined.select(*out)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs, counts=True).select("doc_id", "removed_lines", "text")


#: A line goes if it lies in a shortest run of 50 words or more, from or up to a line, that stands at an earlier place too.
OP6_SQL = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ln FROM documents
), trimmed AS (
  SELECT doc_id, ln, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM cut
), lines AS (
  SELECT doc_id, ln, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS pos FROM trimmed WHERE s <> ''
), summed AS (
  SELECT *, CAST(coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM lines
), ahead AS (
  SELECT doc_id, pos, min(ln) OVER f AS first, max(ln) OVER f AS last, list(s) OVER f AS content, max(b + w) OVER f - b AS words FROM summed
  WINDOW f AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), back AS (
  SELECT doc_id, min(pos) OVER f AS pos, min(ln) OVER f AS first, max(ln) OVER f AS last, list(s) OVER f AS content, b + w - min(b) OVER f AS words FROM summed
  WINDOW f AS (PARTITION BY doc_id ORDER BY b + w RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), shortest AS (
  SELECT DISTINCT * FROM (FROM ahead UNION ALL FROM back) WHERE words >= 50
), repeated AS (
  SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) AS place FROM shortest) WHERE place > 1
), gone AS (
  SELECT DISTINCT c.doc_id, c.ln FROM cut c JOIN repeated r ON c.doc_id = r.doc_id AND c.ln BETWEEN r.first AND r.last
), left_over AS (
  SELECT c.doc_id, string_agg(CASE WHEN g.ln IS NULL THEN c.raw END, chr(10) ORDER BY c.ln) AS rest, count(g.ln) AS removed
  FROM cut c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.ln = g.ln GROUP BY c.doc_id
)
SELECT d.doc_id, CAST(coalesce(o.removed, 0) AS INTEGER) AS removed_lines, CASE WHEN coalesce(o.removed, 0) = 0 THEN d.text ELSE coalesce(o.rest, '') END AS text
FROM documents d LEFT JOIN left_over o ON d.doc_id = o.doc_id
"""
