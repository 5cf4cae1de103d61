"""The event builder: checkpoints, errors, storage classes, and tables with nulls, ties and more columns."""

import pytest

from leafmill.operators import content
from leafmill.sources import builder
from leafmill.sources.languages import TEXT as T

STATIC = {T["newline"]: "\n"}


def built(*calls):
    """Each call is (op, kind name or None, text, mark); the elements, or the error's code."""
    b = builder.Builder(STATIC)
    try:
        for op, *rest in calls:
            kind, text, mark = (*rest, None, None, None)[:3]
            b.add(op, T[kind] if isinstance(kind, str) else kind, text, mark)
        return builder.numbered(b.root())
    except builder.EventError as e:
        return str(e)


def shape(rows):
    return [(r[5], r[7], r[8], r[9], r[12]) for r in rows]


ROOT, END = ("start", "root"), ("finish",)


def mark(n=1):
    return ("checkpoint", None, None, n)


def test_wrap_takes_children_in():
    got = built(ROOT, mark(), ("token", "word", "a"), ("static", "newline"), ("wrap", "line", None, 1), END, END)
    assert shape(got) == [(0, 1, 0, 2, "node"), (1, 2, 0, 2, "node"), (2, 4, 0, 1, "interned"), (2, 7, 1, 2, "static")]
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [(0, 3, None, 0, None), (1, 3, 0, 0, 0), (2, 2, 1, 0, None), (3, 3, 1, 1, None)]


def test_wrap_needs_the_same_open_node():
    assert built(ROOT, mark(), ("start", "line"), ("token", "word", "n"), ("wrap", "line", None, 1)) == "invalid_checkpoint"
    assert built(ROOT, ("start", "line"), mark(), ("token", "word", "n"), END, ("start", "line"), ("wrap", "line", None, 1)) == "invalid_checkpoint"
    back = built(ROOT, mark(), ("start", "line"), ("token", "word", "n"), END, ("wrap", "line", None, 1), END, END)
    assert [r[5] for r in back] == [0, 1, 2, 3]


def test_revert():
    kept = built(ROOT, mark(), ("start", "line"), ("token", "word", "discard"), ("revert", None, None, 1), ("token", "word", "keep"), END)
    assert [r[13] for r in kept] == [None, "keep"]
    assert built(ROOT, ("start", "line"), mark(), END, ("revert", None, None, 1)) == "invalid_checkpoint"
    # A wrap around children that stood before the checkpoint is taken back with them where they were.
    unwrapped = built(ROOT, mark(1), ("token", "word", "a"), mark(2), ("token", "word", "b"), ("wrap", "line", None, 1), ("revert", None, None, 2), END)
    assert [(r[5], r[13]) for r in unwrapped] == [(0, None), (1, "a")]


@pytest.mark.parametrize(
    "calls, error",
    [
        ([ROOT], "unbalanced_start_nodes"), ([END], "finish_without_node"), ([], "no_root"), ([("token", "word", "a")], "no_root"), ([ROOT, END, ROOT, END], "multiple_roots"), ([ROOT, ("token", "newline", "\n")], "static_kind_requires_static_token"),
        ([ROOT, ("large", "newline", "\n")], "static_kind_requires_static_token"), ([ROOT, ("static", "word")], "static_text_unavailable"), ([ROOT, ("what", "word")], "unknown_event"), ([(None, "word")], "unknown_event"), ([("start", None)], "unknown_event"),
    ],
)
def test_errors(calls, error):
    assert built(*calls) == error


def test_deep_trees():
    n = 20_000
    rows = built(*[("start", "line")] * n, ("token", "word", "x"), *[END] * n)
    assert len(rows) == n + 1 and rows[-1][5] == n and rows[0][1] == n


def test_table(spark):
    w, root = T["word"], T["root"]
    rows = [
        (1, 3, "finish", None, None, None, "x"), (1, 1, "start", root, None, None, "x"), (1, 2, "large", w, "é" * 3, None, "x"),
        (None, 1, "start", root, None, None, "x"), (None, 2, "token", w, None, None, "x"), (None, 3, "missing_node", T["line"], None, None, "x"), (None, 4, "missing", T["newline"], None, None, "x"), (None, 5, "finish", None, None, None, "x"),
        (2, None, None, None, None, None, None), (3, 1, "start", root, None, None, "x"),
    ]
    events = spark.createDataFrame(rows, "tree_id long, seq long, op string, kind long, text string, mark long, pre string")
    e = builder.build(events, T)
    got = {}
    for r in e.orderBy("tree_id", "pre").collect():
        got.setdefault(r["tree_id"], []).append((r["pre"], r["storage"], r["start"], r["end"], r["error"]))
    assert got == {
        1: [(0, "node", 0, 6, None), (1, "large", 0, 6, None)],
        None: [(0, "node", 0, 0, None), (1, "interned", 0, 0, None), (2, "node", 0, 0, None), (3, "missing", 0, 0, None)],
        2: [(None, None, None, None, "unknown_event")], 3: [(None, None, None, None, "unbalanced_start_nodes")],
    }
    good = e.where("error is null and tree_id = 1").drop("error")
    assert content.dictionary(good).count() == 0  # large texts stay where they are
    back = content.decoded(content.encoded(good), content.dictionary(good), T)
    assert [r["text"] for r in back.where("not is_node").collect()] == ["é" * 3]
    assert builder.build(events.limit(0), T).count() == 0


def test_events_of_whole_trees(spark):
    """Events made tree by tree are built where they are, as the same events are from a table."""
    from leafmill.plans import catalog

    sf = "/root/testdata/sf0.001"
    root, finish = catalog._event("start", "root"), catalog._event("finish")
    for head, tail in (([root], [finish]), ([root], [finish, finish]), ([], []), ([catalog._event("large", "word", "x"), catalog._event("checkpoint", mark=-1)], [])):
        events = catalog._events(spark, sf, head, tail)
        here = builder.build(events, T)
        apart = builder.build(events.select("*"), T)  # a plain table, which is sorted by tree
        assert here.columns == apart.columns and here.count() == apart.count() > 0
        assert here.exceptAll(apart).count() == 0
