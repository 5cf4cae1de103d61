"""Trees from event tables: a builder whose calls are rows.

events(tree_id, seq, op, kind, text, mark), in the order of seq (ties by the other columns), where op is one of

    start, finish            open a node of `kind`; close the innermost open one
    token, large, static     a token of `kind`: interned or large with `text` (null: empty), static with the text its kind has
    missing, missing_node    a token or a childless node of no length
    checkpoint               remember this place under `mark`; a mark may be set anew
    wrap                     open a node of `kind` around all children since the checkpoint `mark`, which must be of the innermost open node
    revert                   forget all since the checkpoint `mark`, whose node must still be open

The first mistake ends a tree: it gives one row with `error` and no elements. Errors: finish_without_node, invalid_checkpoint,
static_text_unavailable, static_kind_requires_static_token, unbalanced_start_nodes, no_root, multiple_roots, and unknown_event (also for a null
op, or a null kind where one is needed). Rows with a null tree_id are one tree. More columns of events are left out of the result.

Events that were made tree by tree (forest.py) are built where they are. Of other tables: a revert may take anything back, so a tree is known when its last event is: partitions are sorted by tree and read in Arrow batches, and a
task holds the elements of one tree at a time, whatever the partition's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .forest import Rows, by_tree, taken
from .languages import Language, kind_number
from .snapshot import DECODED
from .text_trees import ELEMENTS, bytes_of

COLUMNS = ("tree_id", "seq", "op", "kind", "text", "mark")
ROWS = 8_192
TYPES = "pre int, last int, parent_pre int, slot int, node_slot int, depth int, is_node boolean, kind bigint, start bigint, end bigint, child_count int, node_child_count int, storage string, text string, error string"


class EventError(Exception):
    """Its text is the error's code."""


class Node:
    __slots__ = ("kind", "items")

    def __init__(self, kind: int | None):
        self.kind, self.items = kind, []


class Builder:
    """One tree. Open nodes hold their own children; `open[0]` is no node and holds the top level."""

    def __init__(self, static: dict[int, str]):
        self.static, self.open, self.marks = static, [Node(None)], {}

    def add(self, op: str | None, kind: int | None, text: str | None, mark: int | None) -> None:
        run = getattr(self, f"on_{op}", None)
        if run is None or (kind is None and op not in ("finish", "checkpoint", "revert")):
            raise EventError("unknown_event")
        run(kind, text or "", mark)

    def on_start(self, kind, text, mark):
        self.open.append(Node(kind))

    def on_finish(self, kind, text, mark):
        if len(self.open) == 1:
            raise EventError("finish_without_node")
        done = self.open.pop()
        self.open[-1].items.append(done)

    def on_token(self, kind, text, mark, storage="interned"):
        if kind in self.static:
            raise EventError("static_kind_requires_static_token")
        self.open[-1].items.append((kind, storage, text))

    def on_large(self, kind, text, mark):
        self.on_token(kind, text, mark, "large")

    def on_static(self, kind, text, mark):
        if kind not in self.static:
            raise EventError("static_text_unavailable")
        self.open[-1].items.append((kind, "static", self.static[kind]))

    def on_missing(self, kind, text, mark):
        self.open[-1].items.append((kind, "missing", ""))

    def on_missing_node(self, kind, text, mark):
        self.open[-1].items.append(Node(kind))

    def on_checkpoint(self, kind, text, mark):
        self.marks[mark] = (self.open[-1], len(self.open[-1].items))

    def on_wrap(self, kind, text, mark):
        holder, size = self.marks.get(mark, (None, 0))
        if holder is not self.open[-1] or size > len(holder.items):
            raise EventError("invalid_checkpoint")
        inner = Node(kind)
        inner.items, holder.items = holder.items[size:], holder.items[:size]
        self.open.append(inner)

    def on_revert(self, kind, text, mark):
        holder, size = self.marks.get(mark, (None, 0))
        level = next((i for i, x in enumerate(self.open) if x is holder), None)
        # A wrap since then moved children down: those of the deeper open nodes count as well.
        later = [] if level is None else [x for deeper in self.open[level:] for x in deeper.items]
        if level is None or size > len(later):
            raise EventError("invalid_checkpoint")
        del self.open[level + 1 :]
        holder.items = later[:size]

    def root(self) -> Node:
        if len(self.open) > 1:
            raise EventError("unbalanced_start_nodes")
        top = self.open[0].items
        if len(top) > 1:
            raise EventError("multiple_roots")
        if not top or not isinstance(top[0], Node):
            raise EventError("no_root")
        return top[0]


def numbered(root: Node) -> list[list]:
    """ELEMENTS without the tree, in preorder, by one walk with a stack of its own."""
    rows: list[list] = []
    place = 0
    stack: list[list] = [[None, iter([root]), 0, 0]]  # row, children to come, next slot, next node slot

    def enter(node, parent, slot, node_slot):
        nodes = sum(isinstance(x, Node) for x in node.items)
        rows.append([len(rows), None, parent, slot, node_slot, len(stack) - 1, True, node.kind, place, None, len(node.items), nodes, "node", None])
        return [rows[-1], iter(node.items), 0, 0]

    while stack:
        frame = stack[-1]
        row, items = frame[0], frame[1]
        x = next(items, None)
        if x is None:
            if row is not None:
                row[1], row[9] = len(rows) - 1, place
            stack.pop()
            continue
        parent, slot = (None if row is None else row[0]), frame[2]
        frame[2] += 1
        if isinstance(x, Node):
            node_slot = None if row is None else frame[3]
            frame[3] += 1
            stack.append(enter(x, parent, slot, node_slot))
        else:
            kind, storage, text = x
            n = len(text.encode())
            rows.append([len(rows), len(rows), parent, slot, None, len(stack) - 1, False, kind, place, place + n, 0, 0, storage, text])
            place += n
    return rows


def finished(builder: Builder | None, error: str | None) -> list[list]:
    """Rows of a tree after its last event: elements with a null error, or the error alone."""
    if error is None:
        try:
            return [r + [None] for r in numbered(builder.root())]
        except EventError as e:
            error = str(e)
    return [[None] * (len(ELEMENTS) - 1) + [error]]


class Numbered:
    """Elements of many trees in preorder, kept as runs of tokens and as nodes; a token is the number of its event."""

    def __init__(self):
        self.events: list[int] = []  # -1 for a node
        self.runs: list[tuple] = []  # tokens side by side: first place, how many, parent, first slot, depth
        self.nodes: list[list] = []  # place, parent, slot, node slot, depth, kind, children, node children, last

    def add(self, root: Node) -> None:
        base = len(self.events)
        todo: list[tuple] = [(root, -1, 0, -1, 0)]
        while todo:
            x = todo.pop()
            if isinstance(x, list):  # a node whose subtree is out
                x[8] = len(self.events) - 1 - base
                continue
            if x[0] is None:
                _, items, parent, slot, depth = x
                self.runs.append((len(self.events), len(items), parent, slot, depth))
                self.events += items
                continue
            node, parent, slot, node_slot, depth = x
            pre, items = len(self.events) - base, node.items
            inner = [i for i, y in enumerate(items) if y.__class__ is Node]
            row = [pre + base, parent, slot, node_slot, depth, node.kind, len(items), len(inner), 0]
            self.nodes.append(row)
            self.events.append(-1)
            below, at = [], 0
            for n, i in enumerate(inner):
                if i > at:
                    below.append((None, items[at:i], pre, at, depth + 1))
                below.append((items[i], pre, i, n, depth + 1))
                at = i + 1
            if at < len(items):
                below.append((None, items[at:], pre, at, depth + 1))
            todo.append(row)
            todo += below[::-1]


STORAGES = ("node", "interned", "large", "static", "missing")
PLAIN = {"token": 1, "large": 2, "static": 3, "missing": 4}


def built(v: Rows, static: dict[int, str]) -> Rows:
    """The trees of events (op, kind, text, mark) in order. Tokens that nothing is wrong with are added in runs, all other events one at a time."""
    ops, kinds, marks, texts = v["op"], v["kind"], v["mark"], v["text"]
    coded = ops.dictionary_encode()
    names = coded.dictionary.to_pylist()
    storage = np.array([PLAIN.get(x, 0) for x in names] + [0], np.int8)[coded.indices.fill_null(len(names)).to_numpy()]
    fixed = np.isin(kinds, list(static))
    storage[(kinds < 0) | (fixed & ((storage == 1) | (storage == 2))) | (~fixed & (storage == 3))] = 0
    stops = np.flatnonzero(storage == 0)
    calls = list(zip(stops.tolist(), *(taken(c, stops).to_pylist() for c in (ops, pa.array(kinds, mask=kinds < 0), texts, marks))))
    trees = np.unique(v.tree)
    bounds = np.append(np.searchsorted(v.tree, trees), len(v))
    steps = np.searchsorted(stops, bounds).tolist()
    bounds = bounds.tolist()
    out, firsts, errors = Numbered(), [], []
    for i in range(len(trees)):
        builder, at, error = Builder(static), bounds[i], None
        firsts.append(len(out.events))
        try:
            for place, op, kind, text, mark in calls[steps[i] : steps[i + 1]]:
                if place > at:
                    builder.open[-1].items.extend(range(at, place))
                builder.add(op, kind, text, mark)
                at = place + 1
            builder.open[-1].items.extend(range(at, bounds[i + 1]))
            out.add(builder.root())
        except EventError as e:
            error = str(e)
            out.events.append(-1)
            out.nodes.append([len(out.events) - 1] + [-1] * 8)
        errors.append(error)
    total = len(out.events)
    event, first = np.array(out.events, np.int64), np.array(firsts, np.int64)
    number = np.repeat(np.arange(len(trees)), np.diff(np.append(first, total)))
    c = {x: np.full(total, -1, np.int64) for x in ("last", "parent_pre", "slot", "node_slot", "depth", "kind", "child_count", "node_child_count")}
    run = np.array(out.runs, np.int64).reshape(-1, 5)
    token = np.flatnonzero(event >= 0)
    within = np.arange(len(token)) - np.repeat(np.cumsum(run[:, 1]) - run[:, 1], run[:, 1])
    for name, values in (("parent_pre", run[:, 2]), ("slot", run[:, 3]), ("depth", run[:, 4])):
        c[name][token] = np.repeat(values, run[:, 1]) + (within if name == "slot" else 0)
    node = np.array(out.nodes, np.int64).reshape(-1, 9)
    for i, name in enumerate(("parent_pre", "slot", "node_slot", "depth", "kind", "child_count", "node_child_count", "last")):
        c[name][node[:, 0]] = node[:, i + 1]
    bad = np.array([x is not None for x in errors], bool)[number]
    pre = np.where(bad, -1, np.arange(total) - first[number])
    c["last"][token], c["kind"][token], c["child_count"][token], c["node_child_count"][token] = pre[token], kinds[event[token]], 0, 0
    stored = np.zeros(total, np.int64)
    stored[token] = storage[event[token]]
    # A token's text: its event's, its kind's, or none; the texts of kinds stand behind those of the events.
    places = {k: len(v) + i for i, k in enumerate(static)}
    which = np.where(stored == 3, np.array([places.get(k, -1) for k in range(max([*places, 0]) + 1)], np.int64)[np.where(stored == 3, c["kind"], 0)], np.where((stored == 1) | (stored == 2), event, len(v) + len(static)))
    all_texts = pa.concat_arrays([texts.fill_null("").cast(pa.string()), pa.array([*static.values(), ""], pa.string())])
    text = all_texts.take(pa.array(which, mask=event < 0))
    data, ends = bytes_of(text.fill_null(""))
    size = np.diff(ends)
    start = ends[:-1] - ends[first[number]] if total else ends[:-1]
    end = np.where(event >= 0, start + size, ends[np.where(bad, 0, first[number] + c["last"]) + 1] - ends[first[number]] if total else 0)
    flag = pa.array(event >= 0, mask=bad)
    return Rows(v.ids, trees[number], c | {
        "pre": pre, "is_node": pc.invert(flag), "start": np.where(bad, -1, start), "end": np.where(bad, -1, end),
        "storage": pa.array(STORAGES).take(pa.array(stored, mask=bad)), "text": text, "error": pa.array(errors, pa.string()).take(pa.array(number)),
    })


def build(events: DataFrame, language: Language) -> DataFrame:
    """ELEMENTS and `error` of the trees that the events describe; see above. No events give no rows."""
    static = {kind_number(k.number): k.static_text for k in language.kinds if k.static_text is not None}
    if "_plan" in events.__dict__:  # whole trees are at hand, in order
        return by_tree(events, lambda v: built(v, static), DECODED)
    id_field = events.schema["tree_id"]
    schema = f"tree_id {id_field.dataType.simpleString()}, {TYPES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(ELEMENTS) + ["error"]
        types = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        arrow = [types[t.split()[1]] for t in TYPES.split(", ")]
        id_type, current, builder, error, started = None, None, None, None, False
        out: list[list] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(out), ROWS):
                columns = list(zip(*out[at : at + ROWS]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_type, *arrow])], names=names)
            out.clear()

        for batch in batches:
            id_type = batch.schema.field("tree_id").type
            columns = [batch.column(c).to_pylist() for c in ("tree_id", "op", "kind", "text", "mark")]
            for tree, op, kind, text, mark in zip(*columns):
                if not started or tree != current:
                    if started:
                        out.extend([current, *r] for r in finished(builder, error))
                        if len(out) >= ROWS:
                            yield from flush()
                    current, builder, error, started = tree, Builder(static), None, True
                if error is None:
                    try:
                        builder.add(op, kind, text, mark)
                    except EventError as e:
                        builder, error = None, str(e)
        if started:
            out.extend([current, *r] for r in finished(builder, error))
            yield from flush()

    own = events.selectExpr("tree_id", "cast(seq as bigint) as seq", "cast(op as string) as op", "cast(kind as bigint) as kind", "cast(text as string) as text", "cast(mark as bigint) as mark")
    return own.repartition("tree_id").sortWithinPartitions(*COLUMNS).mapInArrow(run, schema)
