"""Golden rows and models for the tree engine."""

import random

import pytest
from pyspark.sql import functions as F

from leafmill.functions import ranges, text as texts
from leafmill.operators import calc, content, edits, sidecar, trees
from leafmill.sources import calc_trees, languages as lang, snapshot, text_trees
from leafmill.streaming import sessions

T = lang.TEXT


def made(spark, *trees_):
    """Elements of nested lists: a list is a node, a string a token, "" a missing token."""
    rows = []
    for tree_id, tree in enumerate(trees_):
        out = []

        def put(x, parent, slot, node_slot, depth, at, path):
            pre = len(out)
            row = [tree_id, pre, pre, parent, slot, node_slot, depth, isinstance(x, list), 1 if isinstance(x, list) else 4, at, at, 0, 0, "node" if isinstance(x, list) else "interned" if x else "missing", None if isinstance(x, list) else x]
            out.append(row)
            if not isinstance(x, list):
                row[10] = at + len(x.encode())
                return row[10]
            nodes = 0
            for i, c in enumerate(x):
                at = put(c, pre, i, nodes if isinstance(c, list) else None, depth + 1, at, [*path, i])
                nodes += isinstance(c, list)
            row[2], row[10], row[11], row[12] = len(out) - 1, at, len(x), nodes
            return at

        put(tree, None, 0, None, 0, 0, [])
        rows += out
    schema = "tree_id int, pre int, last int, parent_pre int, slot int, node_slot int, depth int, is_node boolean, kind bigint, start bigint, end bigint, child_count int, node_child_count int, storage string, text string"
    return spark.createDataFrame([tuple(r) for r in rows], schema)


F1 = ["a", " ", ["b", " ", ["c", " ", "+", " ", "d"], " ", "+", " ", ["e"]], " ", "+", " ", ["f"], " ", "z"]


def texts_of(df):
    return [r["text"] for r in df.orderBy("pre").collect()]


def test_navigation(spark):
    e = made(spark, F1)
    at = {r["pre"]: (r["start"], r["end"]) for r in e.collect()}
    root = trees.first_last_children(e).where("pre = 0").first()
    assert at[root["first"]] == (0, 1) and at[root["last_child"]] == (18, 19)
    assert at[root["first_node"]] == (2, 13) and at[root["last_node"]] == (16, 17)
    s = {r["pre"]: r for r in trees.siblings(e).collect()}
    outer = root["first_node"]
    assert s[outer]["next_node"] == root["last_node"] and s[outer]["previous_node"] is None
    assert at[s[outer]["next"]] == (13, 14) and at[s[outer]["previous"]] == (1, 2)
    anchor = spark.createDataFrame([(0, outer)], "tree_id int, pre int")
    assert [at[r["pre"]] for r in trees.sibling_sets(e, anchor, including_self=True).orderBy("step").collect()] == [(2, 13), (16, 17)]
    assert [r["pre"] for r in trees.child_at(e, 1, True).where("parent_pre = 0").collect()] == [root["last_node"]]


def test_traversal_and_walk(spark):
    e = made(spark, F1)
    inner = e.where("start = 4 and is_node and depth = 2").select("tree_id", "pre")
    assert [r["start"] for r in trees.ancestors(e, inner).orderBy("step").collect()] == [2, 0]
    assert [r["start"] for r in trees.ancestors(e, inner, True).orderBy("step").collect()] == [4, 2, 0]
    root = spark.createDataFrame([(0, 0)], "tree_id int, pre int")
    assert [(r["start"], r["end"]) for r in trees.descendants(e, root, nodes_only=True).orderBy("pre").collect()] == [(2, 13), (4, 9), (12, 13), (16, 17)]
    w = trees.walk(e).orderBy("event").collect()
    assert [r["event"] for r in w] == list(range(10))
    assert [r["what"] for r in w] == ["enter", "enter", "enter", "leave", "enter", "leave", "leave", "enter", "leave", "leave"]
    outer = F.col("start") == 2
    assert trees.visit(e, skip=outer).count() == 3
    assert trees.visit(e, stop=outer).count() == 2


@pytest.mark.parametrize(("tree", "offset", "outcome", "found"), [
    (["foo", " ", "bar"], 99, "none", None), (["foo", " ", "bar"], 1, "single", "foo"), (["foo", " ", "bar"], 0, "single", "foo"), (["foo", " ", "bar"], 7, "single", "bar"),
    (["foo", " ", "bar"], 3, "between", "foo"), ([["foo"], ["bar"]], 3, "between", "foo"), (["foo", "", "bar"], 3, "single", ""), ([["foo", ""], "bar"], 3, "single", ""), (["foo", ""], 3, "single", ""), (["foo", ""], 4, "none", None), ([], 0, "none", None),
])
def test_token_at_offset(spark, tree, offset, outcome, found):
    e = made(spark, tree)
    q = spark.createDataFrame([(0, 1, offset)], "tree_id int, query int, offset long")
    r = trees.token_at_offset(e, q).first()
    assert r["outcome"] == outcome
    if found is not None:
        assert e.where(F.col("pre") == r["left"]).first()["text"] == found


def random_tree(r, depth=0):
    return [random_tree(r, depth + 1) if depth < 3 and r.random() < 0.4 else r.choice(["a", "bc", "", "def"]) for _ in range(r.randrange(4))]


def test_range_and_covering_against_recursion(spark):
    r = random.Random(7)
    many = [random_tree(r) for _ in range(60)]
    e = made(spark, *many)
    rows = {}
    for x in e.collect():
        rows.setdefault(x["tree_id"], []).append(x)
    qs = []
    for t, own in rows.items():
        n = own[0]["end"]
        for k in range(4):
            a = r.randint(0, n)
            qs.append((t, k, a, r.randint(a, n)))
    q = spark.createDataFrame(qs, "tree_id int, query int, q_start long, q_end long")

    def included(x, a, b):
        return a <= x["start"] < b if x["start"] == x["end"] else a < x["end"] and x["start"] < b

    def tokens(own, x, a, b):
        kids = [y for y in own if y["parent_pre"] == x["pre"]]
        out = []
        for y in kids:
            if included(y, a, b):
                out += tokens(own, y, a, b) if y["is_node"] else [y["pre"]]
        return out

    def cover(own, x, a, b):
        for y in own:
            if y["parent_pre"] == x["pre"] and y["start"] <= a and b <= y["end"]:
                return cover(own, y, a, b) if y["is_node"] else y["pre"]
        return x["pre"]

    got = {}
    for x in trees.tokens_in_range(e, q).collect():
        got.setdefault((x["tree_id"], x["query"]), []).append(x["pre"])
    best = {(x["tree_id"], x["query"]): x["pre"] for x in trees.covering_element(e, q).collect()}
    for t, k, a, b in qs:
        own = rows[t]
        want = tokens(own, own[0], a, b) if included(own[0], a, b) else []
        assert sorted(got.get((t, k), [])) == sorted(want)
        assert best[t, k] == cover(own, own[0], a, b)


def test_ranges_and_edits(spark):
    row = spark.createDataFrame([(8, 10), (3, 5)], "s long, e long").select(ranges.mapped(F.col("s"), F.col("e"), F.lit(2), F.lit(4), F.lit(3)).alias("m")).collect()
    assert [tuple(r["m"]) for r in row] == [("shifted", 9, 11), ("invalidated", None, None)]
    p = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    out = spark.range(1).select(*[edits.classify(p(*a), p(*b)).alias(str(i)) for i, (a, b) in enumerate([((), (1,)), ((0,), (1,)), ((1,), (1,)), ((1, 0), (1,))])]).first()
    assert list(out) == ["ancestor", "unchanged", "replaced_root", "deleted"]
    e = made(spark, [["keep"], ["old"]])
    for cut, hit in (((5, 6), False), ((4, 4), True), ((7, 7), True), ((5, 5), False), ((1, 2), True)):
        req = spark.createDataFrame([(0, 1, 4, 1)], "tree_id int, request int, offset long, kind long")
        ed = spark.createDataFrame([(0, *cut)], "tree_id int, e_start long, e_end long")
        assert (edits.reusable(e, req, ed).count() == 1) is hit
    with pytest.raises(Exception, match="OFFSET_OUT_OF_RANGE"):
        spark.range(1).select(ranges.subtract(F.lit(1), F.lit(2))).collect()


def test_text(spark):
    t = F.lit("ab +cd éfg")
    r = spark.range(1).select(texts.first_index(t, F.lit("+")), texts.first_index(t, F.lit("é")), texts.first_index(t, F.lit("z")), texts.first_range(t, F.lit("b +c")), texts.first_range(t, F.lit("")), texts.contains(t, F.lit("")), texts.sliced(t, F.lit(1), F.lit(10)), texts.sliced(t, F.lit(1), F.lit(99))).first()
    assert list(r)[:3] == [3, 7, None] and tuple(r[3]) == (1, 5) and tuple(r[4]) == (0, 0) and r[5] is True
    assert bytes(r[6]) == "b +cd éf".encode()[:9] and r[7] is None


def test_content(spark):
    docs = spark.createDataFrame([(1, "a b\na b\n"), (2, "a b\n"), (3, ""), (4, None), (5, "é 1")], "doc_id int, text string")
    e = text_trees.document_elements(docs)
    back = {r["tree_id"]: r["text"] for r in content.source_texts(content.decoded(content.encoded(e), content.dictionary(e), T)).collect()}
    assert back == {1: "a b\na b\n", 2: "a b\n", 3: "", 4: "", 5: "é 1"}
    assert content.collisions(content.dictionary(e)).count() == 0
    d = content.digests(e)
    lines = d.where(F.col("kind") == T["line"]).groupBy("digest").count().collect()
    assert sorted(r["count"] for r in lines) == [1, 3]
    assert d.where("digest is null").count() == 0
    assert d.where((F.col("kind") == T["root"]) & F.col("tree_id").isin(3, 4)).select("digest").distinct().count() == 1
    assert spark.createDataFrame([("a",), (None,)], "s string").select(content.fnv1a(F.col("s"))).collect()[0][0] == "af63dc4c8601ec8c"
    h = content.structural_hash(e).where((F.col("kind") == T["line"])).groupBy("hash").count()
    assert sorted(r["count"] for r in h.collect()) == [1, 3]


def test_replacement_and_snapshots(spark):
    e = made(spark, [["keep"], ["old"]], ["x"])
    new = made(spark, ["n", "ew"]).withColumn("at", F.lit(3))
    after = edits.replace_subtrees(e, new)
    assert {r["tree_id"]: r["text"] for r in content.source_texts(after).collect()} == {0: "keepnew", 1: "x"}
    root = after.where("tree_id = 0 and pre = 0").first()
    assert (root["last"], root["end"]) == (5, 7)
    docs = text_trees.document_elements(spark.createDataFrame([(1, "a b\na 1"), (2, "")], "doc_id int, text string"))
    coded = snapshot.encode(docs, T)
    back = snapshot.decode(coded, T).drop("error")
    assert sorted(map(tuple, back.select(*text_trees.ELEMENTS).collect()), key=str) == sorted(map(tuple, docs.select(*text_trees.ELEMENTS).collect()), key=str)
    data = bytes(coded.where("tree_id = 1").first()["snapshot"])
    for bad, code in ((data[:-1], "truncated_input"), (data + b"x", "trailing_bytes"), (b"x" * 40, "bad_magic")):
        with pytest.raises(snapshot.SnapshotError) as err:
            snapshot.decode_bytes(bad, T)
        assert err.value.code == code
    with pytest.raises(snapshot.SnapshotError, match="language_mismatch"):
        snapshot.decode_bytes(data, lang.CALC)


def test_sidecar(spark):
    at = spark.createDataFrame([(0, 1, 1), (0, 2, 1)], "tree_id int, pre int, seq int")
    m = sidecar.metadata_rows(at, "k", F.lit(5), "int").unionByName(sidecar.metadata_rows(at.where("pre = 1").withColumn("seq", F.lit(2)), "k", F.lit(6), "int"))
    assert sorted(r["value"] for r in sidecar.read(m, "k", "int").collect()) == [5, 6]
    assert sidecar.read(m, "k", "string").count() == 0
    e = edits.paths(made(spark, [["a"], ["b", ["c"]]]), 3)
    cache = e.where("is_node and depth = 2").select("tree_id", "pre", F.lit(9).alias("value"))
    moved = sidecar.translate(cache, e, e, spark.createDataFrame([(0, [1], [1])], "tree_id int, old_path array<int>, new_path array<int>"))
    assert [tuple(r) for r in moved.collect()] == [tuple(r) for r in cache.select("tree_id", "pre", "value").collect()]


def test_languages(spark):
    assert lang.kind_number("0x1_0") == 16
    for kinds, code in (((lang.Kind(1, "root"), lang.Kind(1, "b")), "duplicate_kind"), ((lang.Kind("x", "root"),), "not_an_integer"), ((lang.Kind(1 << 32, "root"),), "out_of_range"), ((), "missing_kind"), ((lang.Kind(1, "b"),), "unknown_sentinel")):
        with pytest.raises(lang.LanguageError) as e:
            lang.Language("x", kinds, "root", "root", "root")
        assert e.value.code == code
    assert lang.kinds(spark, lang.CALC).count() == 20
    assert lang.languages(spark, T, lang.CALC).count() == 2


@pytest.mark.parametrize(("source", "value", "folded"), [
    ("1 + 2 * 3", 7, "7"), ("(1 + 2) * (3 + 4) - round(5.5) / 2", 18, "18"), ("round(2.6) + -(3)", 0, "0"), ("1.25 + 2", 3.25, "3.25"), ("1 / 0 + 2 * 3", "division_by_zero", "1 / 0 + 6"), ("1 +", "invalid_syntax", "1 +"),
    ("9223372036854775807 + 1", "overflow", "9223372036854775807 + 1"), ("-7 / 2", -3, "-3"), ("round(-2.5)", -3, "-3"), ("1e3", "invalid_syntax", "1e3"), ("", "invalid_syntax", ""), ("(" * 3000, "invalid_syntax", "(" * 3000),
])
def test_calculator(source, value, folded):
    r = calc.calculated(source)
    got = r["error"] or (r["int_value"] if r["value_kind"] == "integer" else r["real_value"])
    assert (got, r["folded"]) == (value, folded)


def test_calculator_trees(spark):
    p = calc_trees.parsed(spark.createDataFrame([(1, "1 + round(2.5)"), (2, "(1"), (3, None)], "tree_id int, text string"))
    e = calc_trees.elements(p)
    kinds = [(r["kind"], r["start"], r["end"]) for r in e.where("tree_id = 1 and is_node").orderBy("pre").collect()]
    k = calc_trees.K
    assert kinds == [(k["root"], 0, 14), (k["binaryExpr"], 0, 14), (k["integerExpr"], 0, 1), (k["roundCallExpr"], 4, 14), (k["realExpr"], 10, 13)]
    said = {r["tree_id"]: (r["start"], r["end"], r["message"]) for r in calc_trees.diagnostics(p).collect()}
    assert said == {2: (2, 2, "expected ')'"), 3: (0, 0, "expected expression")}
    assert e.where("tree_id = 2 and storage = 'missing'").count() == 1


def test_calculator_reads_deep_nesting():
    n = 50_000
    root, said = calc_trees.parse("(" * n + "7" + ")" * (n - 1))
    e = calc_trees.rows(root)
    assert len(said) == 1 and max(x["depth"] for x in e) == n + 2 and e[0]["last"] == len(e) - 1 and e[0]["end"] == 2 * n
    assert calc.calculated("-" * 3_000 + "7")["int_value"] == 7 and calc.calculated("+".join(["1"] * 5_000))["int_value"] == 5_000


def test_calculator_diagnostics():
    says = lambda s: [(a, b, m) for a, b, _, m in calc_trees.parse(s)[1]]
    assert says(")") == [(0, 1, "expected expression"), (0, 1, "unexpected ')' after expression")]
    assert says("round 2 $") == [(6, 7, "expected '(' after round"), (8, 9, "expected ')'"), (8, 9, "unexpected invalid token after expression")]
    assert says("* 2") == [(0, 1, "expected expression before '*'"), (2, 3, "unexpected number after expression")]
    assert says("1 + $") == [(4, 5, "invalid character '$'")]


def test_sessions(spark, tmp_path):
    rows = [(1, 0, "a\nb\n"), (1, 1, "a\nc\n"), (1, 1, "late\n"), (2, 5, "")]
    batch = sessions.replay(spark.createDataFrame(rows[:2] + rows[3:], "doc_id long, version long, text string"))
    assert {(r["doc_id"], r["version"]): (r["queries"], r["hits"], r["hit_bytes"]) for r in batch.collect()} == {(1, 0): (2, 0, 0), (1, 1): (2, 1, 2), (2, 5): (0, 0, 0)}
    state = None
    out = []
    for _, v, t in rows[:3]:
        state, c = sessions.advance(state, v, t)
        out.append(c)
    assert out == [(0, 2, 0, 0, False), (1, 2, 1, 2, False), (1, 0, 0, 0, True)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "doc_id long, version long, text string").coalesce(1).write.parquet(str(src))
    stream = sessions.stream(spark.readStream.schema("doc_id long, version long, text string").parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("versions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("versions").collect()
    assert sum(r["late"] for r in got) == 1 and len(got) == 4
