"""Edits, range mapping, subtree replacement, reuse between versions, and their witnesses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ranges, text as texts
from ..sources import forest
from ..sources.forest import Rows, taken


def map_ranges(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows (tree_id, range_id, start, end) x edits (tree_id, e_start, e_end, replacement): one mapping each, in old coordinates."""
    joined = rows.join(edits, "tree_id")
    m = ranges.mapped(F.col("start"), F.col("end"), F.col("e_start"), F.col("e_end"), F.octet_length("replacement").cast("bigint"))
    return joined.select("tree_id", "range_id", "seq", m.alias("m")).select("tree_id", "range_id", "seq", "m.*")


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs (tree_id, text) with one edit each spliced in, as bytes; decoded where they are UTF-8, else with replacement characters."""
    new = texts.spliced(F.col("text"), F.col("e_start"), F.col("e_end"), F.col("replacement"))
    return docs.join(edits, "tree_id").select("tree_id", F.decode(new, "UTF-8").alias("text"))


def classify(path: Column, replaced: Column, no_op: Column | None = None) -> Column:
    """unchanged, ancestor, replaced_root or deleted: what a replacement at `replaced` makes of an old path."""
    shared = F.least(F.size(path), F.size(replaced))
    same = F.slice(path, 1, shared) == F.slice(replaced, 1, shared)
    out = F.when(~same, "unchanged").when(F.size(path) < F.size(replaced), "ancestor").when(F.size(path) == F.size(replaced), "replaced_root").otherwise("deleted")
    return out if no_op is None else F.when(no_op, "unchanged").otherwise(out)


def paths(elements: DataFrame, depth: int) -> DataFrame:
    """elements with `path`: child slots from the root; null for elements deeper than `depth`."""
    def run(e: Rows) -> Rows:
        up, slot, level = e.up(), e["slot"], np.zeros(len(e), np.int64)
        over = up.copy()
        for _ in range(depth + 1):
            level += over >= 0
            over = np.where(over >= 0, up[over], -1)
        places = np.append(0, np.cumsum(np.where(level > depth, 0, level)))
        flat, own = np.empty(places[-1], np.int32), np.flatnonzero((level > 0) & (level <= depth))
        over, to = own, places[own + 1] - 1
        while len(over):
            flat[to] = slot[over]
            over, to = up[over], to - 1
            inner = up[over] >= 0
            over, to = over[inner], to[inner]
        path = pa.Array.from_buffers(pa.list_(pa.int32()), len(e), [pa.py_buffer(np.packbits(level <= depth, bitorder="little")), pa.py_buffer(places.astype(np.int32))], children=[pa.array(flat)])
        return Rows(e.ids, e.tree, {**{c: (lambda c=c: e[c]) for c in e.columns}, "path": path})

    return forest.by_tree(elements, run, forest.columns_of(elements) | {"path": "array<int>"})


def resolve(elements_with_paths: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (tree_id, path): the elements there; a path that leaves the tree gives no row."""
    def run(e: Rows, w: Rows) -> Rows:
        steps = w["path"].value_lengths().fill_null(-1).to_numpy()
        flat, begin = forest.plain(w["path"].flatten()).astype(np.int64), np.append(0, np.cumsum(np.maximum(steps, 0)))
        own, _ = e.brothers()
        up = e.up()[own]
        child = up.astype(np.int64) << 32 | e["slot"][own]
        order = np.argsort(child, kind="stable")
        child, own = child[order], own[order]
        root = np.full(len(e.ids), -1)
        roots = np.flatnonzero(e["parent_pre"] < 0)
        root[e.tree[roots]] = roots
        at = np.where(steps < 0, -1, root[w.tree])
        for i in range(steps.max(initial=0)):
            deeper = np.flatnonzero((steps > i) & (at >= 0))
            key = at[deeper] << 32 | flat[begin[deeper] + i]
            place = np.searchsorted(child, key)
            there = (place < len(child)) & (flat[begin[deeper] + i] >= 0)
            there[there] = child[place[there]] == key[there]
            at[deeper] = np.where(there, own[np.where(there, place, 0)] if len(own) else -1, -1)
        known = e["path"].is_valid().to_numpy(zero_copy_only=False)
        return e.take(at[(at >= 0) & known[at]]) if len(e) else e

    return forest.by_tree(elements_with_paths, run, forest.columns_of(elements_with_paths), wanted.select("tree_id", F.col("path").cast("array<int>").alias("path")))


def replace_subtrees(elements: DataFrame, replacements: DataFrame) -> DataFrame:
    """New versions of trees: replacements (tree_id, at, then ELEMENTS of the new subtree, re-based on 0) swap the subtree at `at`.

    One replacement per tree. Rows outside the old interval stay, those behind it shift, ancestors grow, the new rows are re-based;
    trees without a replacement stay as they are."""
    cols = [c for c in elements.columns if c != "tree_id"]

    def run(e: Rows, r: Rows) -> Rows:
        spot = np.full(len(e.ids), -1)
        spot[r.tree] = e.find(r.key("at"))
        size = np.zeros((2, len(e.ids)), np.int64)
        np.maximum.at(size[0], r.tree, r["pre"])
        np.maximum.at(size[1], r.tree, r["end"])
        has = spot >= 0
        a, b, s, t, d0, p0, slot0, node_slot0 = (e[c].astype(np.int64)[spot] for c in ("pre", "last", "start", "end", "depth", "parent_pre", "slot", "node_slot"))
        dn, dl = size[0] - (b - a), size[1] - (t - s)
        tree, pre, last = e.tree, e["pre"].astype(np.int64), e["last"].astype(np.int64)
        behind = has[tree] & (pre > b[tree])
        above = has[tree] & (pre < a[tree]) & (last >= a[tree])
        kept = np.flatnonzero(~has[tree] | (pre < a[tree]) | (pre > b[tree]))
        moved = lambda c, by, when: np.where(when, e[c] + by[tree], e[c])[kept]
        old = {
            "pre": moved("pre", dn, behind), "last": moved("last", dn, behind | above), "start": moved("start", dl, behind), "end": moved("end", dl, behind | above),
            "parent_pre": moved("parent_pre", dn, behind & (e["parent_pre"] > b[tree])),
        }
        new = np.flatnonzero(has[r.tree])
        at, root = r.tree[new], r["pre"][new] == 0
        own = {c: r[c][new] for c in ("pre", "last", "start", "end", "depth", "parent_pre", "slot", "node_slot")}
        fresh = {
            "pre": own["pre"] + a[at], "last": own["last"] + a[at], "start": own["start"] + s[at], "end": own["end"] + s[at], "depth": own["depth"] + d0[at],
            "parent_pre": np.where(root, p0[at], own["parent_pre"] + a[at]), "slot": np.where(root, slot0[at], own["slot"]), "node_slot": np.where(root, node_slot0[at], own["node_slot"]),
        }
        both_trees, both_pre = np.append(tree[kept], at), np.append(old["pre"], fresh["pre"])
        order = np.argsort(both_trees << 32 | both_pre, kind="stable")

        def column(c):
            x, y = old[c] if c in old else taken(e[c], kept), fresh[c] if c in fresh else taken(r[c], new)
            return taken(np.append(x, y) if isinstance(x, np.ndarray) else pa.concat_arrays([x, y.cast(x.type)]), order)

        return Rows(e.ids, both_trees[order], {c: (lambda c=c: column(c)) for c in cols})

    return forest.by_tree(elements, run, forest.columns_of(elements), replacements.select("tree_id", "at", *cols), how="left")


def reusable(elements: DataFrame, requests: DataFrame, edits: DataFrame) -> DataFrame:
    """requests (tree_id, request, offset, kind) against the old tree: the first node in preorder that starts there, is of the kind, and that
    no edit (each taken by itself, in old coordinates) invalidates."""
    nodes = forest.only(forest.where(elements, forest.is_node), "pre", "kind", "start", "end")
    r = requests.select("tree_id", "request", F.col("offset").alias("start"), "kind")
    offers = nodes.join(r, ["tree_id", "start", "kind"])
    e = edits.select(F.col("tree_id").alias("t"), "e_start", "e_end")
    broken = (F.col("tree_id") == F.col("t")) & ~((F.col("end") <= F.col("e_start")) | (F.col("e_end") <= F.col("start")))
    return offers.join(e, broken, "left_anti").groupBy("tree_id", "request").agg(F.min(F.struct("pre", "start", "end")).alias("n")).select("tree_id", "request", "n.*")


def reuse_counters(requests: DataFrame, offers: DataFrame) -> DataFrame:
    """tree_id, queries, hits, hit_bytes. An offer is a hit whether or not it is taken."""
    joined = requests.join(offers.select("tree_id", "request", (F.col("end") - F.col("start")).alias("bytes")), ["tree_id", "request"], "left")
    return joined.groupBy("tree_id").agg(F.count(F.lit(1)).alias("queries"), F.count("bytes").alias("hits"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("hit_bytes"))


def witness(old: DataFrame, new: DataFrame) -> DataFrame:
    """Subtrees of the new version that the old has too: old_pre, new_pre, digest; the first old place of each digest."""
    nodes = lambda e: forest.only(forest.where(e, forest.is_node), "pre", "digest")
    first = nodes(old).groupBy("tree_id", "digest").agg(F.min("pre").alias("old_pre"))
    return nodes(new).select("tree_id", F.col("pre").alias("new_pre"), "digest").join(first, ["tree_id", "digest"])
