"""Queries over the driver tables and their SQL equivalents.

Each query is named after the operator it shows. Results are one row per tree, token or group of a whole table; where an
operator gives a row per element, the query sums places up per tree, which still depends on every one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ranges, text as texts
from ..operators import calc, content, edits, sidecar, trees
from ..sources import builder, calc_trees, forest, languages as lang, snapshot, text_trees
from ..streaming import sessions
from . import oracle

T = lang.TEXT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_trees.document_elements(table(spark, sf_dir, "documents"))


def talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_trees.conversation_elements(table(spark, sf_dir, "conversations"))


def sums(df: DataFrame, *names: str) -> DataFrame:
    """Per tree: rows, and the sum of each column."""
    one = forest.totals(df, *names)  # again below, as an id may have come twice
    return one.groupBy("tree_id").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def census(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.explode(text_trees.tokens(F.coalesce("text", F.lit("")))).alias("t"))
    kinds = rows.select("lang", lang.kind_name(T, text_trees.token_kind(F.col("t"))).alias("kind"), "t")
    return kinds.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(ranges.byte_length(F.col("t"))).alias("bytes"), F.countDistinct("t").alias("different"))


def kinds_table(spark, sf_dir):
    k = F.broadcast(lang.kinds(spark, T))  # as long as the declaration
    found = forest.only(docs(spark, sf_dir), "kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(k, "kind")
    return found.select("language_id", "kind", "name", F.coalesce(F.length("static_text"), F.lit(0)).alias("static_length"), "is_trivia", "is_node", "is_token", "n")


def unknown_kinds(spark, sf_dir):
    known = lang.is_known(T, F.col("shifted"))
    rows = forest.only(docs(spark, sf_dir), "kind").withColumn("shifted", F.col("kind") * 3).groupBy("shifted").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.when(known, lang.kind_name(T, F.col("shifted"))).otherwise("error").alias("name"), lang.kind_name(T, F.col("shifted")).alias("shown"), "n")


def round_trip(spark, sf_dir):
    back = content.source_texts(docs(spark, sf_dir))
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tree_id"), F.coalesce("text", F.lit("")).alias("source"))
    return own.join(back, "tree_id").groupBy((F.col("source") == F.col("text")).alias("same")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


def elements_summary(spark, sf_dir):
    return sums(docs(spark, sf_dir), "pre", "last", "parent_pre", "slot", "node_slot", "depth", "start", "end", "child_count", "node_child_count")


def conversation_summary(spark, sf_dir):
    return sums(talks(spark, sf_dir), "pre", "last", "parent_pre", "slot", "node_slot", "depth", "start", "end", "child_count", "node_child_count")


def invariants(spark, sf_dir):
    nodes = forest.only(trees.child_totals(docs(spark, sf_dir)), "kind", "pre", "last", "start", "end", "child_count", "n", "bytes")
    good = (F.col("n") == F.col("child_count")) & (F.col("bytes") == F.col("end") - F.col("start")) & (F.col("last") >= F.col("pre"))
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"), F.sum(good.cast("int")).alias("good"))


def _lines(e: DataFrame) -> DataFrame:
    return forest.where(e, forest.of_kind(T["line"]))


def line_spans(spark, sf_dir):
    return forest.only(_lines(docs(spark, sf_dir)), "node_slot", "start", "end", "child_count")


def parents(spark, sf_dir):
    return forest.only(trees.parents(docs(spark, sf_dir)), "parent_kind", "kind", "parent_start", "parent_end").groupBy("parent_kind", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("parent_start").alias("starts"), F.sum("parent_end").alias("ends"))


def ends_of_children(spark, sf_dir):
    return sums(trees.first_last_children(docs(spark, sf_dir)), "pre", "first", "last_child", "first_node", "last_node")


def nth_children(spark, sf_dir):
    e = docs(spark, sf_dir)
    named = [(trees.child_at(e, 1), "second"), (trees.child_at(e, -1), "last"), (trees.child_at(e, 2, True), "third_node")]
    out = None
    for df, name in named:
        one = forest.only(df, "kind", "start").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts")).select(F.lit(name).alias("which"), "kind", "n", "starts")
        out = one if out is None else out.unionByName(one)
    return out


def siblings(spark, sf_dir):
    return sums(trees.siblings(docs(spark, sf_dir)), "pre", "previous", "next", "previous_node", "next_node")


def _first_words(e: forest.Rows) -> np.ndarray:
    """The first word of every tree, as anchors."""
    words = np.flatnonzero(e["kind"] == T["word"])
    return words[np.unique(e.tree[words], return_index=True)[1]]


def sibling_sets(spark, sf_dir):
    e = talks(spark, sf_dir)
    back = trees.sibling_sets(e, forest.of_kind(T["turn"]), forward=False, including_self=True)
    return back.groupBy("tree_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("step") * F.col("pre")).alias("weighted"))


def ancestors(spark, sf_dir):
    e = talks(spark, sf_dir)
    found = trees.ancestors(e, forest.of_kind(T["word"]))
    return forest.only(found, "step", "pre").groupBy("tree_id", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("pre").alias("places"))


def descendants(spark, sf_dir):
    e = talks(spark, sf_dir)
    found = trees.descendants(e, forest.of_kind(T["turn"], T["line"]))
    return forest.only(found, "anchor", "pre", "is_node").groupBy("tree_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.sum("pre").alias("places"), F.sum(F.col("is_node").cast("int")).alias("nodes"))


def walk_events(spark, sf_dir):
    w = forest.only(trees.walk(talks(spark, sf_dir), with_tokens=True), "what", "event", "pre")
    return w.groupBy("tree_id", "what").agg(F.count(F.lit(1)).alias("n"), F.sum("event").alias("events"), F.sum(F.col("event") * F.col("pre")).alias("weighted"))


def walk_nodes(spark, sf_dir):
    w = forest.only(trees.walk(docs(spark, sf_dir)), "what", "event", "pre")
    return w.groupBy("tree_id", "what").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("event") * F.col("pre")).alias("weighted"))


def visit_control(spark, sf_dir):
    e = docs(spark, sf_dir)
    seen = trees.visit(e, skip=lambda x: (x["kind"] == T["line"]) & (x["child_count"] > 40), stop=forest.of_kind(T["number"]), with_tokens=True)
    return sums(seen, "pre")


def _ranges(e: DataFrame, n: int = 3) -> DataFrame:
    """Range queries of each tree, that fall apart by query: query, q_start, q_end, offset."""
    roots = forest.only(forest.where(e, forest.is_root), "end").select("tree_id", F.col("end").alias("length"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("query"))
    start = (F.col("length") * F.col("query")) / F.lit(n + 2)
    roots = roots.withColumn("q_start", F.floor(start).cast("bigint"))
    return roots.withColumn("q_end", F.least(F.col("length"), F.col("q_start") + 7 * (F.col("query") - 1))).withColumn("offset", F.col("q_start"))


def tokens_in_range(spark, sf_dir):
    e = docs(spark, sf_dir)
    found = forest.only(trees.tokens_in_range(e, _ranges(e)), "query", "pre")
    return found.groupBy("tree_id", "query").agg(F.count(F.lit(1)).alias("n"), F.sum("pre").alias("places"))


def token_at_offset(spark, sf_dir):
    e = docs(spark, sf_dir)
    return trees.token_at_offset(e, _ranges(e)).fillna(-1, ["left", "right"])


def covering_element(spark, sf_dir):
    e = docs(spark, sf_dir)
    return trees.covering_element(e, _ranges(e))


def find_bytes(spark, sf_dir):
    t = F.coalesce(F.col("text"), F.lit(""))
    r, none = texts.first_range(t, F.lit("é")), F.lit(-1)
    return table(spark, sf_dir, "documents").select("doc_id", texts.contains(t, F.lit("the ")).alias("has"), F.coalesce(texts.first_index(t, F.lit(". ")), none).alias("first"), F.coalesce(r["start"], none).alias("s"), F.coalesce(r["end"], none).alias("e"), ranges.byte_length(t).alias("bytes"))


def slice_bytes(spark, sf_dir):
    t = F.coalesce(F.col("text"), F.lit(""))
    n = F.octet_length(t)
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(texts.sliced(t, F.floor(n / 3), F.floor(n / 3) + F.least(n - F.floor(n / 3), F.lit(20))))).alias("bytes"), texts.sliced(t, n, n + F.lit(1)).isNull().alias("outside"))


def dictionary(spark, sf_dir):
    return content.dictionary(docs(spark, sf_dir)).select("text", "uses")


def dictionary_round_trip(spark, sf_dir):
    e = forest.only(docs(spark, sf_dir), "storage", "kind", "text")
    words = content.dictionary(e).select("text_id", "text", "uses")
    back = content.decoded(content.encoded(e), words, T)
    return back.groupBy("storage").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"))


def dedup_stats(spark, sf_dir):
    g = content.green(content.digests(docs(spark, sf_dir), 2))
    return g.groupBy("is_node", "kind").agg(F.count(F.lit(1)).alias("different"), F.sum("occurrences").alias("occurrences"), F.sum(F.col("occurrences") - 1).alias("hits"))


def structural_hash(spark, sf_dir):
    return forest.only(forest.where(content.structural_hash(docs(spark, sf_dir)), forest.is_root), "hash")


def fnv1a(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content.fnv1a(F.col("text")).alias("fnv"))


def _edits(spark, sf_dir) -> DataFrame:
    """Three edits of each document, at code point boundaries: characters 10 %, 40 % and 70 % in."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tree_id"), t.alias("t"), F.explode(F.array(F.lit(1), F.lit(4), F.lit(7))).alias("seq"))
    at = F.floor(F.length("t") * F.col("seq") / 10).cast("int")
    start = F.octet_length(F.left("t", at)).cast("bigint")
    return rows.select("tree_id", "seq", start.alias("e_start"), F.octet_length(F.left("t", at + F.col("seq") - 1)).cast("bigint").alias("e_end"), F.repeat(F.lit("é"), F.col("seq")).alias("replacement"))


def map_ranges(spark, sf_dir):
    lines = forest.only(_lines(docs(spark, sf_dir)), "pre", "start", "end").withColumnRenamed("pre", "range_id")
    m = edits.map_ranges(lines, _edits(spark, sf_dir))
    return m.groupBy("tree_id", "seq", "outcome").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("start"), F.lit(0)).alias("starts"), F.coalesce(F.sum("end"), F.lit(0)).alias("ends"))


def apply_edit(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tree_id"), F.coalesce("text", F.lit("")).alias("text"))
    new = edits.apply_edits(own, _edits(spark, sf_dir).where("seq = 4"))
    return new.select("tree_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.octet_length("text").alias("bytes"))


def _requests(e: DataFrame) -> DataFrame:
    return forest.only(_lines(e), "node_slot", "start", "kind").select("tree_id", F.col("node_slot").alias("request"), F.col("start").alias("offset"), "kind")


def reuse_candidates(spark, sf_dir):
    e = docs(spark, sf_dir)
    found = edits.reusable(e, _requests(e), _edits(spark, sf_dir))
    return sums(found, "request", "pre", "start", "end")


def reuse_counters(spark, sf_dir):
    e = docs(spark, sf_dir)
    return edits.reuse_counters(_requests(e), edits.reusable(e, _requests(e), _edits(spark, sf_dir)))


def classify_paths(spark, sf_dir):
    """Every element of a conversation against a replacement of line 0 of its turn 1."""
    e = edits.paths(talks(spark, sf_dir), 3)
    kind = edits.classify(F.col("path"), F.array(F.lit(1), F.lit(0)))
    return e.select("tree_id", kind.alias("outcome")).groupBy("tree_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


def resolve_path(spark, sf_dir):
    e = edits.paths(docs(spark, sf_dir), 2)
    roots = forest.only(forest.where(e, forest.is_root))
    wanted = roots.select("tree_id", F.explode(F.array(F.array(F.lit(0)), F.array(F.lit(1), F.lit(2)), F.array(F.lit(9), F.lit(0)))).alias("path"))
    return edits.resolve(e, wanted).select("tree_id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), "pre", "start", "kind")


def replace_line(spark, sf_dir):
    after = _new_first_line(docs(spark, sf_dir))
    out = sums(after, "pre", "last", "parent_pre", "start", "end", "depth")
    text = content.source_texts(after).select("tree_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return out.join(text, "tree_id")


def diagnostics(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.array(
        F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.struct(sidecar.severity("note").alias("severity"), F.lit("empty text").alias("message"))),
        F.when(F.length("text") > 5000, F.struct(sidecar.severity("warning").alias("severity"), F.lit("long text").alias("message"))),
        F.when(F.contains("text", F.lit("\t")), F.struct(sidecar.severity().alias("severity"), F.lit("tab").alias("message"))),
    ), lambda x: x.isNotNull())).alias("d"))
    return d.groupBy("d.severity", "d.message").agg(F.count(F.lit(1)).alias("n")).select("severity", "message", "n")


def metadata(spark, sf_dir):
    """Each line's byte length under `size`, written twice, and its number under `order` as text: the last write and the type count."""
    lines = forest.only(_lines(docs(spark, sf_dir)), "pre", "node_slot", "start", "end").withColumn("seq", F.lit(1))
    rows = sidecar.metadata_rows(lines, "size", F.col("end") - F.col("start"), "bigint")
    rows = rows.unionByName(sidecar.metadata_rows(lines.withColumn("seq", F.lit(2)).where("node_slot % 2 = 0"), "size", F.lit(-1), "bigint"))
    rows = rows.unionByName(sidecar.metadata_rows(lines, "order", F.col("node_slot"), "string"))
    size, order = sidecar.read(rows, "size", "bigint"), sidecar.read(rows, "order", "bigint")
    return size.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).join(order.groupBy("tree_id").agg(F.count(F.lit(1)).alias("wrong")), "tree_id", "left").select("tree_id", "n", "total", F.coalesce("wrong", F.lit(0)).alias("wrong"))


def cache_translate(spark, sf_dir):
    """Lengths cached on conversation lines, moved with turn 0 to the place of turn 1 of the same tree."""
    e = edits.paths(talks(spark, sf_dir), 3)
    cache = forest.only(_lines(e), "pre", "start", "end").select("tree_id", "pre", (F.col("end") - F.col("start")).alias("value"))
    places = forest.only(e, "pre", "path")
    reuses = forest.only(forest.where(e, forest.is_root)).select("tree_id", F.array(F.lit(0)).alias("old_path"), F.array(F.lit(1)).alias("new_path"))
    return sums(sidecar.translate(cache, places, places, reuses), "pre", "value")


def cache_evict(spark, sf_dir):
    e = talks(spark, sf_dir)
    turns = forest.where(e, forest.of_kind(T["turn"]))
    cache = forest.only(turns, "pre", "start", "end").select("tree_id", "pre", (F.col("end") - F.col("start")).alias("value"))
    current = forest.only(forest.where(e, lambda x: forest.is_root(x) & (x["node_child_count"] > 4)))
    kept = sidecar.evict(cache, current)
    filled = sidecar.get_or_compute(kept, cache.select("tree_id", "pre"), lambda m: m.withColumn("value", F.lit(0).cast("bigint")))
    return sums(filled, "value")


def typed_overlay(spark, sf_dir):
    o = sidecar.overlay(docs(spark, sf_dir), T["line"], {"word": T["word"], "number": T["number"], "newline": T["newline"]})
    return sums(o, "node", "word", "number", "newline")


def dumps(spark, sf_dir):
    e = talks(spark, sf_dir)
    return sidecar.dump(e, lang.kind_name(T, F.col("kind")), with_tokens=False)


def _calc(spark, sf_dir) -> DataFrame:
    """An expression of every line item: `(linenumber + quantity) * tax - round(discount)`, in plain decimals."""
    number = lambda c: F.col(c).cast("decimal(12,2)").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tree_id"), "l_linenumber", "l_quantity", "l_tax", "l_discount", "l_partkey", "l_suppkey",
        F.concat(F.lit("("), F.col("l_linenumber").cast("string"), F.lit(" + "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(") * "), number("l_tax"), F.lit(" - round("), number("l_discount"), F.lit(")")).alias("real"),
        F.concat(F.col("l_partkey").cast("string"), F.lit(" * -"), F.col("l_linenumber").cast("string"), F.lit(" + "), F.col("l_suppkey").cast("string"), F.lit(" / "), (F.col("l_linenumber") - 1).cast("string")).alias("whole"),
    )


def calc_eval(spark, sf_dir):
    r = calc.evaluate(_calc(spark, sf_dir), text="real")
    return r.select("tree_id", "value_kind", F.round("real_value", 6).alias("value"), F.coalesce("error", F.lit("")).alias("error"), "calls", "forks")


def calc_errors(spark, sf_dir):
    r = calc.evaluate(_calc(spark, sf_dir), text="whole")
    return r.select("tree_id", F.coalesce("int_value", F.lit(0)).alias("int_value"), F.coalesce("error", F.lit("")).alias("error"))


def calc_fold(spark, sf_dir):
    r = calc.evaluate(_calc(spark, sf_dir), text="whole")
    return r.select("tree_id", "folded", "fold_steps")


def calc_elements(spark, sf_dir):
    e = calc_trees.elements(calc_trees.parsed(_calc(spark, sf_dir), text="whole"))
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.sum("depth").alias("depths"))


def calc_diagnostics(spark, sf_dir):
    cut = _calc(spark, sf_dir).select("tree_id", F.expr("left(whole, length(whole) - 1)").alias("t"))
    return calc_trees.diagnostics(calc_trees.parsed(cut, text="t")).groupBy("severity", "message").agg(F.count(F.lit(1)).alias("n"))


def calc_dictionary(spark, sf_dir):
    """Report of parsing all expressions with one dictionary: dynamic tokens, and different ones."""
    e = calc_trees.elements(calc_trees.parsed(_calc(spark, sf_dir), text="whole")).where("storage = 'interned'")
    return e.agg(F.count(F.lit(1)).alias("dynamic_tokens"), F.countDistinct("text").alias("different"))


def snapshot_round_trip(spark, sf_dir):
    """Documents encoded to bytes and decoded again: texts that came back, and bytes."""
    coded = snapshot.encode(docs(spark, sf_dir), T)
    back = snapshot.decode(coded, T)
    text = content.source_texts(snapshot.valid(back))
    own = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tree_id"), F.coalesce("text", F.lit("")).alias("source"))
    return own.join(text, "tree_id").groupBy((F.col("source") == F.col("text")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_corrupt(spark, sf_dir):
    """The same bytes with the last one cut off: all are quarantined."""
    coded = snapshot.encode(docs(spark, sf_dir), T)
    cut = coded.select("tree_id", F.expr("substring(snapshot, 1, octet_length(snapshot) - 1)").alias("snapshot"))
    return forest.only(snapshot.decode(cut, T), "error").groupBy("error").agg(F.countDistinct("tree_id").alias("n"))


def session_batch(spark, sf_dir):
    """The incremental session over batches: each conversation is a document whose turns are versions."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("version"), F.coalesce("text", F.lit("")).alias("text"))
    return sessions.replay(turns)


def _event(op: str, kind: str | None = None, text: str | None = None, mark: int | None = None) -> tuple:
    return op, T[kind] if kind else -1, text, mark


EVENTS = {"seq": "bigint", "op": "string", "kind": "number", "text": "string", "mark": "bigint"}


def _events(spark, sf_dir, head: list, tail: list) -> DataFrame:
    """Events of every document: head, its lines, tail. A line comes by way of a wrap: a checkpoint, a try that is taken back, the tokens, then the node around them."""
    before = [_event("checkpoint"), _event("start", "line"), _event("token", "word", "junk"), _event("revert")]
    after = [_event("wrap", "line"), _event("finish")]
    single = [_event("token"), _event("static"), _event("missing")]
    fixed = [*before, *after, *single, *head, *tail]

    def run(e: forest.Rows) -> forest.Rows:
        n, token, line = len(e), ~e["is_node"], np.flatnonzero(e["kind"] == T["line"])
        closing = e.find(e.key("last")[line])
        first = np.searchsorted(e.tree, np.unique(e.tree))
        last = np.append(first[1:], n) - 1
        counts = token.astype(np.int64)
        counts[line] += len(before)
        counts[closing] += len(after)
        inner = counts[last]
        counts[first] += len(head)
        counts[last] += len(tail)
        at = np.cumsum(counts) - counts
        of = np.repeat(np.arange(n), counts)
        which, mark, text = np.zeros(len(of), np.int64), np.full(len(of), -1), np.full(len(of), -1)

        def put(places, number, marks=None):
            which[places] = number
            if marks is not None:
                mark[places] = marks

        slot = e["node_slot"][line]
        for i in range(len(before)):
            put(at[line] + i, i, slot if i in (0, 3) else None)
        put(at[closing] + 1, 4, slot)
        put(at[closing] + 2, 5)
        own = np.flatnonzero(token)
        stored = e["storage"].dictionary_encode()
        known = np.array([{"static": 7, "missing": 8}.get(x, 6) for x in stored.dictionary.to_pylist()], np.int64)[stored.indices.to_numpy()][own]
        put(at[own], known)
        text[at[own]] = np.where(known == 6, own, -1)
        for i in range(len(head)):
            put(at[first] + i, 9 + i)
        behind = at[last] + inner + np.where(first == last, len(head), 0)
        for i in range(len(tail)):
            put(behind + i, 9 + len(head) + i)
        said = np.array([n + i if f[2] is not None else -1 for i, f in enumerate(fixed)])[which]
        text = np.where(text >= 0, text, said)
        texts = pa.concat_arrays([e["text"], pa.array([f[2] for f in fixed], pa.string())])
        kind = np.where((which >= 6) & (which <= 8), e["kind"][of], np.array([f[1] for f in fixed])[which])
        marks = pa.array([f[3] for f in fixed], pa.int64()).take(pa.array(which))
        tree = e.tree[of]
        return forest.Rows(e.ids, tree, {
            "seq": lambda: np.arange(len(of)) - np.searchsorted(tree, tree), "op": pa.array([f[0] for f in fixed]).take(pa.array(which)), "kind": kind,
            "text": texts.take(pa.array(text, mask=text < 0)), "mark": pc.if_else(pa.array(mark >= 0), pa.array(mark), marks),
        })

    return forest.by_tree(docs(spark, sf_dir), run, EVENTS)


def builder_events(spark, sf_dir):
    """Every document built from events, with a wrap and a revert at each line."""
    e = builder.build(_events(spark, sf_dir, [_event("start", "root")], [_event("finish")]), T)
    return sums(snapshot.valid(e), "pre", "last", "parent_pre", "slot", "node_slot", "depth", "start", "end", "child_count", "node_child_count")


def builder_errors(spark, sf_dir):
    """The same events with a mistake each, and without a root: what every document ends with."""
    root, finish = _event("start", "root"), _event("finish")
    wrong = {
        "extra_finish": ([root], [finish, finish]), "open_root": ([root], []), "unknown_mark": ([root], [_event("wrap", "line", mark=-5), finish, finish]),
        "no_static_text": ([root, _event("static", "word")], [finish]), "static_as_token": ([root, _event("token", "newline", "\n")], [finish]), "no_root": ([], []), "token_alone": ([_event("large", "word", "x")], []),
    }
    out = None
    for name, (head, tail) in wrong.items():
        if name in ("no_root", "token_alone"):  # a document without lines has no events at all without this one pair
            head = [*head, _event("checkpoint", mark=-1)]
        e = forest.only(forest.where(builder.build(_events(spark, sf_dir, head, tail), T), lambda x: x["pre"] <= 0), "error")
        one = e.groupBy("error").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("mistake"), F.coalesce("error", F.lit("")).alias("error"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def range_arithmetic(spark, sf_dir):
    """Lines as ranges: lengths, empty ones, moved ones, sums and differences of offsets, and offsets that are none."""
    lines = line_spans(spark, sf_dir)
    s, e = F.col("start"), F.col("end")
    moved = ranges.shifted(s, e, F.lit(100))
    rows = lines.select(
        "tree_id", ranges.length(s, e).alias("length"), ranges.is_empty(s, e).alias("empty"), ranges.is_range(s, e).alias("range"), ranges.is_range(e, s).alias("reversed"), moved[0].alias("moved_start"), moved[1].alias("moved_end"),
        ranges.add(s, e).alias("added"), ranges.subtract(e, s).alias("taken"), ranges.is_offset(s - 50).alias("offset"), ranges.contains_or_end(s, e, e).alias("at_end"), ranges.contains(s, e, e).alias("inside_end"),
    )
    return rows.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(c) for c in rows.columns[1:]])


def text_equality(spark, sf_dir):
    """Composed and decomposed letters are different texts."""
    t = F.coalesce(F.col("text"), F.lit(""))
    other = F.replace(t, F.lit("\u00e9"), F.lit("e\u0301"))
    return table(spark, sf_dir, "documents").select("doc_id", texts.equals(t, other).alias("decomposed"), texts.equals(t, F.lower(t)).alias("lower"))


def sibling_tokens(spark, sf_dir):
    """All elements behind the first word of each document, in its line."""
    e = docs(spark, sf_dir)
    found = trees.sibling_sets(e, _first_words, nodes_only=False)
    return found.groupBy("tree_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("step") * F.col("pre")).alias("weighted"))


def dumps_with_tokens(spark, sf_dir):
    d = sidecar.dump(talks(spark, sf_dir), lang.kind_name(T, F.col("kind")))
    return d.select("tree_id", F.sha2(F.col("dump").cast("binary"), 256).alias("sha"))


def _new_first_line(e: DataFrame) -> DataFrame:
    """Every document's first line becomes the line `NEW 1`."""
    spot = forest.only(forest.where(e, lambda x: (x["kind"] == T["line"]) & (x["node_slot"] == 0)), "pre").withColumnRenamed("pre", "at")
    line = text_trees.document_elements(spot.select("tree_id", F.lit("NEW 1\n").alias("t")), "tree_id", "t").where("pre > 0")
    new = line.join(spot, "tree_id").select("at", *[
        {"pre": (F.col("pre") - 1).alias("pre"), "last": (F.col("last") - 1).alias("last"), "depth": (F.col("depth") - 1).alias("depth"), "parent_pre": F.when(F.col("pre") > 1, F.col("parent_pre") - 1).alias("parent_pre")}.get(c, F.col(c)) for c in text_trees.ELEMENTS
    ])
    return edits.replace_subtrees(e, new)


def reuse_witness(spark, sf_dir):
    """What a document keeps when its first line is replaced: places of equal subtrees, old and new."""
    e = docs(spark, sf_dir)
    w = edits.witness(content.digests(e, 2), content.digests(_new_first_line(e), 2))
    return sums(w, "old_pre", "new_pre")


ALL = {
    "token_census": census, "kinds_table": kinds_table, "unknown_kinds": unknown_kinds, "lossless_roundtrip": round_trip, "elements_summary": elements_summary,
    "conversation_summary": conversation_summary, "invariants": invariants, "line_spans": line_spans, "parents": parents, "first_last_children": ends_of_children,
    "nth_children": nth_children, "siblings_next_prev": siblings, "sibling_sets": sibling_sets, "ancestors_of_tokens": ancestors, "descendants": descendants,
    "walk_events": walk_events, "walk_nodes": walk_nodes, "visit_control": visit_control, "tokens_in_range": tokens_in_range, "token_at_offset": token_at_offset,
    "covering_element": covering_element, "find_bytes": find_bytes, "slice_bytes": slice_bytes, "dictionary": dictionary, "dictionary_roundtrip": dictionary_round_trip,
    "dedup_stats": dedup_stats, "structural_hash": structural_hash, "fnv1a": fnv1a, "map_ranges": map_ranges, "apply_edit": apply_edit, "reuse_candidates": reuse_candidates,
    "reuse_counters": reuse_counters, "classify_paths": classify_paths, "resolve_path": resolve_path, "replace_line": replace_line, "diagnostics_by_severity": diagnostics,
    "metadata_typed": metadata, "cache_translate": cache_translate, "cache_evict": cache_evict, "typed_overlay": typed_overlay, "dumps": dumps, "calc_eval": calc_eval,
    "calc_errors": calc_errors, "calc_fold": calc_fold, "calc_elements": calc_elements, "calc_diagnostics": calc_diagnostics, "calc_dictionary": calc_dictionary,
    "snapshot_roundtrip": snapshot_round_trip, "snapshot_corrupt": snapshot_corrupt, "session_batch": session_batch,
    "builder_events": builder_events, "builder_errors": builder_errors, "range_arithmetic": range_arithmetic, "text_equality": text_equality, "sibling_tokens": sibling_tokens,
    "dumps_with_tokens": dumps_with_tokens, "reuse_witness": reuse_witness,
}


def queries() -> dict:
    return dict(ALL)


def oracle_sql() -> dict:
    return oracle.statements()
