"""Navigation, traversal and position queries over an elements table.

All operators take `elements` (see sources.forest.ELEMENTS). None looks further than one tree, so each runs where the tree is
(forest.by_tree), by place numbers and preorder intervals, never by recursion. Anchors are a table (tree_id, pre) or a mask over the elements'
columns, and queries are a table; thousands of look-ups run as one plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources import forest
from ..sources.forest import Rows, spans, taken

Mask = Callable[[Rows], np.ndarray]


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """df with all columns but tree_id renamed."""
    return df.select(*[F.col(c).alias(c if c == "tree_id" else prefix + c) for c in df.columns])


def anchored(elements: DataFrame, anchors: DataFrame | Mask, run: Callable[[Rows, np.ndarray, np.ndarray], Rows], types: dict[str, str]) -> DataFrame:
    """run(elements, trees and places of the anchors): each anchor once."""
    if not isinstance(anchors, DataFrame):
        return forest.by_tree(elements, lambda e: run(e, e.tree[m := anchors(e)], e["pre"][m].astype(np.int64)), types)
    keys = anchors.select("tree_id", F.col("pre").cast("bigint").alias("pre")).distinct()

    def keyed(e: Rows, k: Rows) -> Rows:
        order = np.argsort(k.key())
        return run(e, k.tree[order], k["pre"][order])

    return forest.by_tree(elements, keyed, types, keys)


# -- navigation ------------------------------------------------------------------------------------


def parents(elements: DataFrame) -> DataFrame:
    """Each element with its parent's columns as parent_*; roots are left out. A token always has a parent."""
    def run(e: Rows) -> Rows:
        up = e.up()
        own = np.flatnonzero((up >= 0) & e["is_node"][up])
        return e.take(own, **{f"parent_{c}": e[c][up[own]] for c in ("kind", "start", "end")})

    return forest.by_tree(elements, run, forest.columns_of(elements) | {"parent_kind": "bigint", "parent_start": "bigint", "parent_end": "bigint"})


def children(elements: DataFrame, nodes_only: bool = False) -> DataFrame:
    """Elements that have a parent, keyed by (tree_id, parent_pre), in slot order."""
    return forest.where(elements, lambda e: (e["parent_pre"] >= 0) & e["is_node"] if nodes_only else e["parent_pre"] >= 0)


def child_at(elements: DataFrame, n: int, nodes_only: bool = False) -> DataFrame:
    """The n-th child of every node that has one; negative n counts from the end."""
    place = "node_slot" if nodes_only else "slot"

    def run(e: Rows) -> Rows:
        own, first = e.brothers(e["is_node"] if nodes_only else None)
        slot = e[place][own].astype(np.int64)
        if n >= 0:
            return e.take(np.sort(own[slot == n]))
        groups = np.flatnonzero(first == np.arange(len(first)))
        most = np.repeat(np.maximum.reduceat(slot, groups), np.diff(np.append(groups, len(slot)))) if len(slot) else slot
        return e.take(np.sort(own[slot == most + n + 1]))

    return forest.by_tree(elements, run, forest.columns_of(elements))


def first_last_children(elements: DataFrame) -> DataFrame:
    """For every node with children: the places of its first and last child and of its first and last node child."""
    def run(e: Rows) -> Rows:
        own, first = e.brothers()
        head = first == np.arange(len(first))
        tail = np.append(head[1:], True)[: len(head)]
        nodes, first_node = e.brothers(e["is_node"])
        node_head = first_node == np.arange(len(nodes))
        node_tail = np.append(node_head[1:], True)[: len(nodes)]
        key, pre = e.key("parent_pre"), e["pre"]
        group = np.searchsorted(key[own[head]], key[nodes[node_head]])
        ends = np.full((2, head.sum()), -1)
        ends[0, group], ends[1, group] = pre[nodes[node_head]], pre[nodes[node_tail]]
        return Rows(e.ids, e.tree[own[head]], {"pre": e["parent_pre"][own[head]], "first": pre[own[head]], "last_child": pre[own[tail]], "first_node": ends[0], "last_node": ends[1]})

    return forest.by_tree(elements, run, {"pre": "int", "first": "int", "last_child": "int", "first_node": "place", "last_node": "place"})


def child_totals(elements: DataFrame) -> DataFrame:
    """Every node with the number `n` of its children and their length `bytes` together."""
    def run(e: Rows) -> Rows:
        up, size = e.up(), e["end"] - e["start"]
        own = np.flatnonzero(up >= 0)
        total = np.zeros(len(e), np.int64)
        np.add.at(total, up[own], size[own])
        return e.take(e["is_node"], n=np.bincount(up[own], minlength=len(e))[e["is_node"]], bytes=total[e["is_node"]])

    return forest.by_tree(elements, run, forest.columns_of(elements) | {"n": "bigint", "bytes": "bigint"})


def siblings(elements: DataFrame) -> DataFrame:
    """Every element with previous and next sibling of any sort, and previous and next node sibling. A root has none."""
    def run(e: Rows) -> Rows:
        own, first = e.brothers()
        n, place = len(own), np.arange(len(own))
        last = np.zeros(n, np.int64)
        head = np.flatnonzero(first == place)
        last = np.repeat(np.append(head[1:], n) - 1, np.diff(np.append(head, n)))
        pre, node = e["pre"][own], e["is_node"][own]
        at = lambda i, there: np.where(there, pre[np.clip(i, 0, max(n - 1, 0))], -1)
        before = np.concatenate([[-1], np.maximum.accumulate(np.where(node, place, -1))])[:n]
        behind = np.concatenate([np.minimum.accumulate(np.where(node, place, n)[::-1])[::-1], [n]])[1:][:n]
        found = np.full((4, len(e)), -1)
        for row, values in enumerate((at(place - 1, place > first), at(place + 1, place < last), at(before, before >= first), at(behind, behind <= last))):
            found[row, own] = values
        kept = e["parent_pre"] >= 0
        return e.take(kept, **{c: found[i][kept] for i, c in enumerate(("previous", "next", "previous_node", "next_node"))})

    return forest.by_tree(elements, run, forest.columns_of(elements) | dict.fromkeys(("previous", "next", "previous_node", "next_node"), "place"))


def sibling_sets(elements: DataFrame, anchors: DataFrame | Mask, forward: bool = True, including_self: bool = False, nodes_only: bool = True) -> DataFrame:
    """anchors (tree_id, pre): siblings in a direction, with their distance `step`, nearest first. Self comes with step 0, even a root."""
    def run(e: Rows, tree: np.ndarray, pre: np.ndarray) -> Rows:
        here = e.find(tree << 32 | pre)
        here = here[here >= 0]
        own, first = e.brothers(e["is_node"] if nodes_only else None)
        # Brothers stand in rows of the other elements' order; a row is found by its parent, an anchor's place in it by its slot.
        parent = e.key("parent_pre")
        head = np.flatnonzero(first == np.arange(len(own)))
        tail = np.append(head[1:], len(own))[: len(head)]
        row = np.searchsorted(parent[own[head]], parent[here])
        known = (e["parent_pre"][here] >= 0) & (row < len(head))
        known[known] = parent[own[head]][row[known]] == parent[here][known]
        number = np.repeat(np.arange(len(head)), tail - head).astype(np.int64) << 32 | e["slot"][own]
        wanted = np.where(known, row, 0).astype(np.int64) << 32 | e["slot"][here]
        if forward:
            low, high = np.searchsorted(number, wanted, "right"), tail[np.where(known, row, 0)] if len(head) else np.zeros(len(here), np.int64)
        else:
            low, high = head[np.where(known, row, 0)] if len(head) else np.zeros(len(here), np.int64), np.searchsorted(number, wanted)
        which, at = spans(np.where(known, low, 0), np.where(known, high, 0))
        step = at - low[which] + 1 if forward else high[which] - at
        found = own[at]
        if including_self:
            which, found, step = np.append(which, np.arange(len(here))), np.append(found, here), np.append(step + 1, np.ones(len(here), np.int64))
            order = np.argsort(which, kind="stable")
            which, found, step = which[order], found[order], step[order]
        return Rows(e.ids, e.tree[here[which]], {"anchor": e["pre"][here[which]], "pre": e["pre"][found], "kind": e["kind"][found], "slot": e["slot"][found], "step": step - including_self})

    return anchored(elements, anchors, run, {"anchor": "int", "pre": "int", "kind": "bigint", "slot": "int", "step": "int"})


# -- traversal -------------------------------------------------------------------------------------


def ancestors(elements: DataFrame, anchors: DataFrame | Mask, including_self: bool = False) -> DataFrame:
    """anchors (tree_id, pre): their ancestors, nearest first by `step`."""
    types = forest.columns_of(elements) | {"anchor": "int", "step": "int"}

    def run(e: Rows, tree: np.ndarray, pre: np.ndarray) -> Rows:
        up, keys = e.up(), e.key()
        which, level = np.arange(len(pre)), np.searchsorted(keys, tree << 32 | pre, "right") - 1
        count, parts = np.zeros(len(pre), np.int64), []
        here = level >= 0
        here[here] = e.tree[level[here]] == tree[here]
        which, level = which[here], level[here]
        while len(which):
            own, last = e["pre"][level], e["last"][level]
            hit = (pre[which] <= last) & ((own <= pre[which]) if including_self else (own < pre[which]) & e["is_node"][level])
            parts.append((which[hit], level[hit], count[which[hit]]))
            count[which[hit]] += 1
            level = up[level]
            which, level = which[level >= 0], level[level >= 0]
        which, found, step = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        order = np.argsort(which, kind="stable")
        return e.take(found[order], anchor=pre[which[order]], step=step[order])

    return anchored(elements, anchors, run, types)


def descendants(elements: DataFrame, anchors: DataFrame | Mask, including_self: bool = False, nodes_only: bool = False) -> DataFrame:
    """anchors (tree_id, pre): the elements of their subtrees, in preorder."""
    types = forest.columns_of(elements) | {"anchor": "int", "anchor_last": "int"}

    def run(e: Rows, tree: np.ndarray, pre: np.ndarray) -> Rows:
        here = e.find(tree << 32 | pre)
        here = here[here >= 0]
        last = e["last"][here].astype(np.int64)
        which, found = spans(here + (not including_self), np.searchsorted(e.key(), e.tree[here].astype(np.int64) << 32 | last, "right"))
        if nodes_only:
            which, found = which[e["is_node"][found]], found[e["is_node"][found]]
        return e.take(found, anchor=e["pre"][here[which]], anchor_last=last[which])

    return anchored(elements, anchors, run, types)


def walk(elements: DataFrame, with_tokens: bool = False) -> DataFrame:
    """Enter and leave events of every tree, numbered 0, 1, ... by `event`.

    With the elements walked numbered densely in preorder, an element is entered at 2 * pre - depth and left at
    2 * last - depth + 1, so no recursion makes the walk."""
    def run(e: Rows) -> Rows:
        if with_tokens:
            own, n, m = np.arange(len(e)), e["pre"].astype(np.int64), e["last"].astype(np.int64)
        else:
            # Nodes up to an element's last place: those of its own subtree come before any later node.
            own, upto = np.flatnonzero(e["is_node"]), np.cumsum(e["is_node"])
            before = np.searchsorted(own, np.searchsorted(e.tree, e.tree[own]))  # nodes of earlier trees
            n, m = np.arange(len(own)) - before, upto[e.find(e.key("last")[own])] - 1 - before
        twice = np.repeat(own, 2)
        event = np.stack([2 * n - e["depth"][own], 2 * m - e["depth"][own] + 1], 1).reshape(-1)
        what = pa.array(["enter", "leave"]).take(pa.array(np.tile([0, 1], len(own))))
        return Rows(e.ids, e.tree[twice], {"event": event, "what": what, **{c: e[c][twice] for c in ("pre", "depth", "kind")}})

    return forest.by_tree(elements, run, {"event": "bigint", "what": "string", "pre": "int", "depth": "int", "kind": "bigint"})


def visit(elements: DataFrame, skip: Column | Mask | None = None, stop: Column | Mask | None = None, with_tokens: bool = False) -> DataFrame:
    """Preorder visit with control: below an element where `skip` holds nothing is visited, and behind the first visited element
    where `stop` holds nothing is. Both elements themselves are visited. Conditions are columns, or masks over columns."""
    types, masks = forest.columns_of(elements), []
    for name, condition in (("_skip", skip), ("_stop", stop)):
        if isinstance(condition, Column):
            elements = elements.withColumn(name, F.coalesce(condition, F.lit(False)))
            condition = lambda e, name=name: e[name]
        masks.append(condition or (lambda e: np.zeros(len(e), bool)))

    def run(e: Rows) -> Rows:
        own = e if with_tokens else e.take(e["is_node"])
        # Intervals that are skipped cover what lies behind their start: a running maximum of their ends tells.
        covered = np.concatenate([[-1], np.maximum.accumulate(np.where(masks[0](own), own.key("last"), -1))])[: len(own)]
        own = own.take(own.key() > covered)
        ends = np.flatnonzero(masks[1](own))
        trees, first = np.unique(own.tree[ends], return_index=True)
        end = np.full(len(own.ids), len(own))
        end[trees] = ends[first]
        return own.take(np.arange(len(own)) <= end[own.tree])

    return forest.by_tree(elements, run, types)


def tokens_in_range(elements: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (tree_id, query, q_start, q_end): tokens in the ranges. A token counts if it and all its ancestors are included.

    That prunes as a walk does: an empty token at the end of a node that the range only touches is out."""
    def run(e: Rows, q: Rows) -> Rows:
        low, high, start, end = q["q_start"], q["q_end"], e["start"], e["end"]

        def includes(i, x):
            empty = (low[i] <= start[x]) & (start[x] < high[i])
            return np.where(start[x] == end[x], empty, (low[i] < end[x]) & (start[x] < high[i]))

        token, which, at = _near(e, q.tree, low, high)
        hit = includes(which, token[at])
        which, found = which[hit], token[at[hit]]
        up, over, ok = e.up(), e.up()[found], np.zeros(len(found), np.int64)
        while (over >= 0).any():
            ok += (over >= 0) & includes(which, over)
            over = np.where(over >= 0, up[over], -1)
        good = (ok == e["depth"][found]) & (ok > 0)
        which, found = which[good], found[good]
        return e.take(found, query=taken(q["query"], which))

    own = {c: forest.ELEMENTS[c] for c in ("pre", "depth", "start", "end", "kind")}
    q = queries.select("tree_id", "query", F.col("q_start").cast("bigint").alias("q_start"), F.col("q_end").cast("bigint").alias("q_end"))
    return forest.by_tree(elements, run, {"query": queries.schema["query"].dataType.simpleString()} | own, q)


# -- position --------------------------------------------------------------------------------------


def _near(e: Rows, tree: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, and pairs of a query and one of them: those that touch [low, high] of the query's tree. Tokens stand in the order of both ends."""
    token = np.flatnonzero(~e["is_node"])
    key = lambda t, x: t.astype(np.int64) << 33 | np.clip(x + 1, 0, (1 << 33) - 1)
    first = np.searchsorted(key(e.tree[token], e["end"][token]), key(tree, low))
    behind = np.searchsorted(key(e.tree[token], e["start"][token]), key(tree, high), "right")
    which, at = spans(first, behind)
    return token, which, at


def token_at_offset(elements: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (tree_id, query, offset): outcome none, single (left = right) or between two tokens.

    The right token is the first in preorder that holds the offset, or that is empty and stands there; the left one is the same for
    the offset before. An empty token at the offset is single, whatever stands around it; two tokens are between if one ends and the other
    begins at the offset. Offsets outside the tree give none."""
    def run(e: Rows, q: Rows) -> Rows:
        at = q["offset"]
        token, which, near = _near(e, q.tree, at - 1, at)
        start, end, pre = (e[c][token[near]] for c in ("start", "end", "pre"))
        n, none = len(at), len(near)
        reach = np.full(n, -1)
        np.maximum.at(reach, which, end)

        def first(x):
            holds = ((start <= x[which]) & (x[which] < end)) | ((start == end) & (start == x[which]))
            found = np.full(n, none)
            np.minimum.at(found, which[holds], np.flatnonzero(holds))
            return found

        right, left = first(at), first(at - 1)
        start, end, pre = (np.append(x, -1) for x in (start, end, pre))  # for `none`
        right = np.where(at <= reach, right, none)
        left = np.where((at > 0) & (at <= reach), left, none)
        neither = (left == none) & (right == none)
        single = (right != none) & (start[right] == at) & (end[right] == at) | (left == none) | (right == none)
        between = ~neither & ~single & (end[left] == at) & (start[right] == at) & (pre[left] != pre[right])
        one = np.where(right != none, pre[right], pre[left])
        outcome = pa.array(["none", "single", "between"]).take(pa.array(np.where(neither, 0, np.where(between, 2, 1))))
        return Rows(e.ids, q.tree, {"query": q["query"], "offset": at, "outcome": outcome, "left": np.where(between, pre[left], one), "right": np.where(between, pre[right], one)})

    kind = queries.schema["query"].dataType.simpleString()
    q = queries.select("tree_id", "query", F.col("offset").cast("bigint").alias("offset"))
    return forest.by_tree(elements, run, {"query": kind, "offset": "bigint", "outcome": "string", "left": "place", "right": "place"}, q, how="right")


def covering_element(elements: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (tree_id, query, q_start, q_end): the smallest element that covers the range, found greedily from the left.

    Among the covering elements, in preorder, those stay that lie in all covering ones before them; the last of these is the answer."""
    def run(e: Rows, q: Rows) -> Rows:
        begin = np.searchsorted(e.tree, np.arange(len(e.ids) + 1))
        pre, last, start, end = e["pre"], e["last"], e["start"], e["end"]
        best = np.full(len(q), -1)
        for i, (t, low, high) in enumerate(zip(q.tree, q["q_start"], q["q_end"])):
            a, b = begin[t], begin[t + 1]
            b = a + np.searchsorted(start[a:b], low, "right")  # starts ascend in preorder
            limit = None
            for x in a + np.flatnonzero(end[a:b] >= high):
                if limit is None or pre[x] <= limit:
                    best[i], limit = x, last[x] if limit is None else min(limit, last[x])
        which = np.flatnonzero(best >= 0)
        return e.take(best[which], query=taken(q["query"], which))

    own = {c: forest.ELEMENTS[c] for c in ("pre", "kind", "start", "end")}
    q = queries.select("tree_id", "query", F.col("q_start").cast("bigint").alias("q_start"), F.col("q_end").cast("bigint").alias("q_end"))
    return forest.by_tree(elements, run, {"query": queries.schema["query"].dataType.simpleString()} | own, q)
