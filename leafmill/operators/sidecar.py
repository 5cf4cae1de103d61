"""Analysis results beside trees: diagnostics, typed metadata, cached values and their translation to new versions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..sources import forest
from ..sources.forest import Rows

SEVERITIES = ("note", "warning", "error")


def severity(name: str | None = None) -> Column:
    return F.lit(SEVERITIES.index(name or "error"))


def metadata_rows(values: DataFrame, key: str, value: Column, value_type: str) -> DataFrame:
    """values (tree_id, pre, seq) -> rows of the metadata table."""
    return values.select("tree_id", "pre", F.lit(key).alias("key"), F.lit(value_type).alias("value_type"), value.cast("string").alias("value"), "seq")


def latest(metadata: DataFrame) -> DataFrame:
    """The last written value of each (element, key)."""
    return metadata.groupBy("tree_id", "pre", "key").agg(F.max(F.struct("seq", "value_type", "value")).alias("m")).select("tree_id", "pre", "key", "m.value_type", "m.value")


def read(metadata: DataFrame, key: str, value_type: str) -> DataFrame:
    """Values of a key; a value written under another type is not found, rather than converted."""
    rows = latest(metadata).where((F.col("key") == key) & (F.col("value_type") == value_type))
    return rows.select("tree_id", "pre", F.col("value").cast(value_type).alias("value"))


def get_or_compute(cache: DataFrame, wanted: DataFrame, compute) -> DataFrame:
    """cache (tree_id, pre, value) completed for wanted (tree_id, pre): what is missing is computed, once."""
    missing = wanted.join(cache, ["tree_id", "pre"], "left_anti")
    return cache.unionByName(compute(missing).select("tree_id", "pre", "value"))


def evict(cache: DataFrame, current: DataFrame) -> DataFrame:
    """Entries of trees that are no longer current go."""
    return cache.join(current.select("tree_id").distinct(), "tree_id", "left_semi")


def translate(cache: DataFrame, old_paths: DataFrame, new_paths: DataFrame, reuses: DataFrame) -> DataFrame:
    """Cached values of old elements at their places in the new version.

    old_paths and new_paths (tree_id, pre, path); reuses (tree_id, old_path, new_path) of subtrees. A value moves with the subtree
    that holds its element: its path's head is exchanged."""
    at = cache.join(old_paths.select("tree_id", "pre", "path"), ["tree_id", "pre"]).drop("pre")
    depth = F.size("old_path")
    inside = at.join(reuses, "tree_id").where((F.size("path") >= depth) & (F.slice("path", 1, depth) == F.col("old_path")))
    moved = inside.select("tree_id", F.concat("new_path", F.slice("path", depth + 1, F.lit(1 << 20))).alias("path"), "value")
    return moved.join(new_paths.select("tree_id", "path", "pre"), ["tree_id", "path"]).select("tree_id", "pre", "value").distinct()


def typed(elements: DataFrame, kind: int) -> DataFrame:
    """The elements of one kind: a typed view."""
    return elements.where(F.col("kind") == kind)


def overlay(elements: DataFrame, node_kind: int, parts: dict[str, int]) -> DataFrame:
    """Nodes of a kind with the place of their first child of each named kind."""
    def run(e: Rows) -> Rows:
        own, up = e.brothers()[0][::-1], e.up()
        own = own[up[own] >= 0]
        nodes, found = np.flatnonzero(e["kind"] == node_kind), {}
        for name, kind in parts.items():
            at, some = np.full(len(e), -1), own[e["kind"][own] == kind]
            at[up[some]] = e["pre"][some]  # in falling order of slots, so that the first child's stays
            found[name] = at[nodes]
        return Rows(e.ids, e.tree[nodes], {"node": e["pre"][nodes], **found})

    return forest.by_tree(elements, run, {"node": "int", **dict.fromkeys(parts, "place")})


def dump(elements: DataFrame, name: Column, with_tokens: bool = True) -> DataFrame:
    """tree_id, dump: one indented line per element, in preorder."""
    from ..functions.text import escaped

    own = elements if with_tokens else forest.where(elements, forest.is_node)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), name, F.lit(" "), F.col("start").cast("string"), F.lit("..<"), F.col("end").cast("string"), F.when(~F.col("is_node"), F.concat(F.lit(' "'), escaped(F.coalesce("text", F.lit(""))), F.lit('"'))).otherwise(""))
    rows = own.select("tree_id", "pre", line.alias("line")).groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("pre", "line"))).alias("lines"))
    return rows.select("tree_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("dump"))
