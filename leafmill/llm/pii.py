"""Personal data by candidate generation and gradient boosted trees, in column expressions only.

Base spans are the matches of four patterns (e-mail, IP address, card, phone) that
pass their checks; they are always kept. Generators propose more spans, which may overlap: numbers
that stand free, look like cards or phones, but fail a check or lack a plus, phones in national
format, and e-mail addresses with "(at)" or "[dot]". Each is described by its format and context
(digits, groups, separators, cue words, neighbouring characters) and scored by boosted trees. The trees
are fitted to the base checks' verdicts on the candidates of every text, from format and context
alone, so what they accept is what looks like checked data. Proposed spans that overlap base spans are left out, checked phones
count without plus and country code too, and a proposed phone behind a cue word counts as neither right nor wrong unless its context speaks against it. Before fitting, equal feature vectors are counted together in
Spark, and every one reaches the driver with its counts, none left out: features are small integers of at most 19 digits, so fewer than 4.5 million
vectors can exist, however large the table is. A threshold per kind is calibrated so that accepted vectors
are right with `PRECISION`, each of them rather than not; where no threshold is, no span is added. The trees become one CASE expression.

Positions come from splitting a text at the matches and adding lengths up, in code points. Everything is computed in the
row: there is no shuffle and no Python in the main path. Patterns use possessive loops and start only where a run starts, so
long runs neither recurse nor take quadratic time; they match as the plain patterns do.

Defined results: null text counts as empty; texts without spans have counts of 0, the digest of the empty string and an
empty list; added spans that overlap a base span, or an earlier added span, are left out; repeated rows are
searched each; an empty table gives no rows and fits nothing; other columns are ignored. Adding up positions takes time in
proportion to the square of the matches of one text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
NUMBER = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators beside these.
NATIONAL = r"(?<![0-9+])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"
MASKED = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|@)[\])]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(](?:dot|\.)[\])]\x20?)[A-Za-z0-9-]+)++"
CUES = {
    "card": r"(?i)\b(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|cc)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|whatsapp|telefon|handy|tél|teléfono|móvil)\b",
}
NEVER = r"(?i)\b(?:order|invoice|isbn|issn|ean|sku|version|ref|id|no|nr|serial|tracking)\b[^A-Za-z]*$"

PRECISION, LEAST_SUPPORT = 0.97, 20
TREES, DEPTH, RATE = 24, 3, 0.3
FEATURES = ("digits", "groups", "longest", "shortest", "distinct", "first", "brackets", "dots", "cue", "never", "letter_before", "letter_behind", "phone")
SPAN = "array<struct<start:int,end:int,kind:int,m:string,left:string,right:string>>"


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, end, kind, m, left, right>> of a pattern's matches, from the left, with their surroundings."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def placed(m: Column) -> Column:
        def with_pieces(p: Column) -> Column:
            steps = F.zip_with(F.slice(p, 1, F.greatest(F.size(m), F.lit(0))), m, lambda a, b: F.length(a) + F.length(b))
            ends = F.aggregate(steps, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

            def spans(e: Column) -> Column:
                return F.transform(
                    m,
                    lambda s, i: F.struct(
                        (F.get(e, i + 1) - F.length(s)).cast("int").alias("start"), F.get(e, i + 1).cast("int").alias("end"), F.lit(kind).alias("kind"), s.alias("m"),
                        F.right(F.get(p, i), F.lit(40)).alias("left"), F.substring(F.get(p, i + 1), 1, 4).alias("right"),
                    ),
                )

            return _let(ends, spans)

        return F.when(F.size(m) > 0, _let(between, with_pieces)).otherwise(F.array().cast(SPAN))

    return _let(found, placed)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _where(text: Column, hint: Column, spans: Column) -> Column:
    """spans, but for texts in which the hint does not hold, which are not searched."""
    return F.when(hint, spans).otherwise(F.array().cast(SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits = F.split(F.reverse(_digits(m)), "")
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(digits, lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: int, m: Column) -> Column:
    """The checks of the base patterns."""
    if kind == 1:
        part = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda x: F.when(F.length(part(x)) <= 3, part(x).cast("int") <= 255).otherwise(False))
    if kind == 2:
        return F.when(F.length(_digits(m)).between(14, 19), _luhn(m)).otherwise(False)
    if kind == 3:
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _checked(kind: int):
    return lambda s: valid(kind, s["m"])


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def searched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base (checked spans of all kinds), more (spans of the generators)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    number = t.rlike(r"[0-9](?:[\x20-]?[0-9]){9}")
    found = rows.select(
        "doc_id",
        _where(t, F.contains(t, F.lit("@")), _matches(t, EMAIL, 0)).alias("e"),
        _where(t, t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), _matches(t, IP, 1)).alias("i"),
        _where(t, number, F.filter(_matches(t, NUMBER, 2), lambda s: F.length(s["m"]) >= 10)).alias("n"),
        _where(t, F.contains(t, F.lit("+")), _matches(t, PHONE, 3)).alias("p"),
        _where(t, t.rlike(r"[0-9]{2}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3}"), _matches(t, NATIONAL, 3)).alias("l"),
        _where(t, F.lower(t).rlike(r"[\[(](?:at|@)[\])]"), _matches(t, MASKED, 0)).alias("a"),
    )
    kept = [F.filter(c, _checked(k)) for k, c in enumerate(("e", "i", "n", "p"))]
    order = lambda a: F.array_sort(a, lambda x, y: F.when((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["kind"] < y["kind"])), -1).otherwise(1))
    glued = lambda s: s["left"].rlike("[A-Za-z0-9]$") | s["right"].rlike("^[A-Za-z0-9]")
    spare = F.filter("n", lambda s: ~glued(s) & F.length(_digits(s["m"])).between(10, 19) & ~valid(2, s["m"]))
    spare = F.transform(spare, lambda s: s.withField("kind", F.when(F.length(_digits(s["m"])) >= 13, 2).otherwise(3)))
    return found.select("doc_id", order(F.concat(*kept)).alias("base"), F.concat(spare, "l", "a").alias("more"))


def features(s: Column) -> list[Column]:
    """FEATURES of a span, small integers, without what the checks look at: the plus and the checksum."""
    m = F.regexp_replace(s["m"], r"^\+", "")
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    cue = F.when(s["kind"] == 2, s["left"].rlike(CUES["card"])).when(s["kind"] == 3, s["left"].rlike(CUES["phone"])).otherwise(False)
    number = [
        F.length(_digits(m)), F.size(groups), F.array_max(sizes), F.array_min(sizes), F.size(F.array_distinct(F.split(_digits(m), ""))), F.substring(_digits(m), 1, 1).try_cast("int"),
        F.contains(m, F.lit("(")).cast("int"), F.contains(m, F.lit(".")).cast("int"), cue.cast("int"), s["left"].rlike(NEVER).cast("int"),
        s["left"].rlike(r"\p{L}$").cast("int"), s["right"].rlike(r"^\p{L}").cast("int"), (s["kind"] == 3).cast("int"),
    ]
    return [F.least(F.coalesce(x, F.lit(-1)), F.lit(30)) for x in number]


class Trees:
    """Boosted regression trees on counted feature vectors; a tree is (feature, limit, left, right) or a number."""

    def __init__(self, x: np.ndarray, good: np.ndarray, total: np.ndarray):
        self.trees: list = []
        self.start = float(np.log((good.sum() + 0.5) / (total.sum() - good.sum() + 0.5)))
        self.z = np.full(len(x), self.start)
        low = int(x.min())
        columns = np.ascontiguousarray(x.T - low)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-self.z))
            g, h = good - total * p, total * p * (1 - p)
            self.trees.append(self._grow(columns, low, g, h, np.arange(len(x)), DEPTH))

    def _grow(self, columns, low, g, h, rows, depth):
        """A tree of these rows, whose values are added to z. Sums by value of a feature weigh all its limits in one pass over the rows."""
        gain = lambda a, b: a * a / (b + 1.0)
        best, gs, hs = (1e-6, None), g[rows], h[rows]
        if depth:
            for j, column in enumerate(columns):
                values = column[rows]
                gl, hl = np.cumsum(np.bincount(values, gs)), np.cumsum(np.bincount(values, hs))
                more = (gain(gl, hl) + gain(gl[-1] - gl, hl[-1] - hl) - gain(gl[-1], hl[-1]))[:-1]
                if len(more) and more.max() > best[0]:
                    best = (more.max(), (j, int(more.argmax())))
        if best[1] is None:
            value = float(RATE * gs.sum() / (hs.sum() + 1.0))
            self.z[rows] += value
            return value
        j, limit = best[1]
        left = columns[j][rows] <= limit
        return (j, limit + low, self._grow(columns, low, g, h, rows[left], depth - 1), self._grow(columns, low, g, h, rows[~left], depth - 1))

    def score(self, vector: Column) -> Column:
        def node(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            j, limit, left, right = tree
            return F.when(F.get(vector, j) <= limit, node(left)).otherwise(node(right))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + node(tree)
        return total


class Detector:
    """Trees and the least score of an added span, by kind: None where none is added."""

    def __init__(self, trees: Trees | None, limits: dict[int, float]):
        self.trees, self.limits = trees, limits

    def accepts(self, s: Column) -> Column:
        if self.trees is None:
            return s["kind"] == 0
        limit = F.when(s["kind"] == 0, float("-inf"))  # a masked address is one by its form
        for kind, least in self.limits.items():
            limit = limit.when(s["kind"] == kind, least)
        return _let(F.array(*features(s)), lambda v: self.trees.score(v) >= F.coalesce(limit, F.lit(float("inf"))))


def _clash(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _apart(spans: str, base: str) -> Column:
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: _clash(s, b)))


def greedy(spans: Column) -> Column:
    """Of spans in the order of their starts, those that begin behind the last one kept; one that is dropped blocks no other."""
    start = F.struct(F.lit(0).cast("int").alias("to"), F.array().cast(SPAN).alias("kept"))
    take = lambda a, s: F.struct(s["end"].cast("int").alias("to"), F.concat(a["kept"], F.array(s)).alias("kept"))
    return F.aggregate(spans, start, lambda a, s: F.when(s["start"] >= a["to"], take(a, s)).otherwise(a), lambda a: a["kept"])


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Detector:
    """Fit trees and thresholds to the checks' verdicts on the numbers of all texts."""
    found = searched(docs, doc_id, text)
    numbers = F.filter(F.col("base"), lambda s: s["kind"] >= 2)
    # Checked phones as they would stand in national format, which is what the generators propose.
    abroad = r"^\+[0-9]{1,3}[\x20.-]+(?=[(0-9])"
    national = F.transform(F.filter("base", lambda s: (s["kind"] == 3) & s["m"].rlike(abroad)), lambda s: s.withField("m", F.regexp_replace(s["m"], abroad, "")))
    against = lambda s: s["left"].rlike(NEVER) | s["left"].rlike(r"\p{L}$") | s["right"].rlike(r"^\p{L}")
    wrong = F.filter(_apart("more", "base"), lambda s: (s["kind"] == 2) | ((s["kind"] == 3) & (~s["left"].rlike(CUES["phone"]) | against(s))))
    labelled = lambda spans, good: F.transform(spans, lambda s: F.struct(s.alias("s"), F.lit(good).alias("good")))
    both = found.select(F.explode(F.concat(labelled(numbers, 1), labelled(national, 1), labelled(wrong, 0))).alias("c"))
    counted = both.select(F.array(*features(F.col("c.s"))).alias("x"), F.col("c.s.kind").alias("kind"), F.col("c.good").alias("good")).groupBy("x", "kind").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    rows = counted.select(*[F.get("x", j).cast("tinyint").alias(name) for j, name in enumerate(FEATURES)], "kind", "good", "n").toArrow()
    x, (kinds, good, n) = np.column_stack([rows[name].to_numpy() for name in FEATURES]), (rows[name].to_numpy() for name in ("kind", "good", "n"))
    if not good.any():
        return Detector(None, {})
    order = np.lexsort((*x.T[::-1], -n))
    x, kinds, good, n = x[order], kinds[order], good[order].astype(float), n[order].astype(float)
    trees, limits = Trees(x, good, n), {}
    for kind in (2, 3):
        here = np.nonzero(kinds == kind)[0]
        here = here[np.argsort(-trees.z[here], kind="stable")]
        right = np.cumsum(good[here]) / np.maximum(np.cumsum(n[here]), 1)
        enough = np.nonzero((right >= PRECISION) & (trees.z[here] > 0) & (np.cumsum(good[here]) >= LEAST_SUPPORT))[0]
        if len(enough):
            limits[kind] = float(trees.z[here[enough[-1]]])
    return Detector(trees, limits)


def detect(docs: DataFrame, detector: Detector, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base, spans: arrays of spans, by start and then kind."""
    found = searched(docs, doc_id, text)
    added = F.filter(_apart("more", "base"), detector.accepts)
    found = found.withColumn("added", F.when(F.size("more") > 0, F.array_sort(added, lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).otherwise(y["end"] - x["end"]))).otherwise(F.array().cast(SPAN)))
    order = lambda a: F.array_sort(a, lambda x, y: F.when((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["kind"] < y["kind"])), -1).otherwise(1))
    return found.select("doc_id", "base", order(F.concat("base", greedy(F.col("added")))).alias("spans"))


def redacted(docs: DataFrame, detector: Detector, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets."""
    spans = detect(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), detector, "_row", "_text").withColumnsRenamed({"doc_id": "_row", "spans": "_spans"})
    t, names = F.coalesce(F.col("_row")[text], F.lit("")), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    parts = F.transform("_spans", lambda s, i: F.concat(F.substring(t, F.when(i == 0, 1).otherwise(F.get(F.col("_spans"), i - 1)["end"] + 1), F.greatest(F.lit(0), s["start"] - F.when(i == 0, 0).otherwise(F.get(F.col("_spans"), i - 1)["end"]))), F.get(names, s["kind"])))
    tail = F.substring(t, F.get(F.col("_spans"), F.size("_spans") - 1)["end"] + 1, F.length(t))
    new = F.when(F.size("_spans") == 0, F.col("_row")[text]).otherwise(F.concat(F.array_join(parts, ""), tail))
    return spans.select(*[new.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns])


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, fit(docs))
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
