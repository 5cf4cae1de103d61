"""The text operators against brute force, on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import block_labeller, brown_lm, byte_bpe, common, components, exact_dedup, line_dedup, mixing, ngram_join, one_bit_ann, pii, toxicity

SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: Columns whose names clash with those the operators use inside.
CLASH = {"id": "x", "row": "y", "key": "z", "salt": 1, "start": 2, "_row": "r", "_id": 3, "size": 4, "n": 5}


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    df = spark.createDataFrame(rows, schema)
    for name, value in CLASH.items():
        df = df.withColumn(name, F.lit(value))
    return df


def docs(spark, texts, sources=None):
    return frame(spark, [(i, t, "en", sources[i] if sources else "s", len(t) if t is not None else None) for i, t in enumerate(texts)])


def words(r, n, size=400):
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


# -- 8 ---------------------------------------------------------------------------------------------


def test_exact_dedup(spark):
    texts = ["a  b", "a\tb", None, "", "a b ", "é", "é", "x" * 200_000]
    df = docs(spark, texts)
    index = exact_dedup.DigestIndex(spark, common.fresh_path(spark, "index"), buckets=4)
    got = {r["doc_id"]: r for r in exact_dedup.deduplicate(df, index).collect()}
    normal = [SPACES.sub(" ", t or "") for t in texts]
    for i, t in enumerate(normal):
        same = [j for j, u in enumerate(normal) if u == t]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (same[0], len(same), i == same[0])
        assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    # A later load is compared with what the index has, and appended.
    later = docs(spark, ["a b", "new"]).withColumn("doc_id", F.col("doc_id") + 100)
    more = {r["doc_id"]: r for r in exact_dedup.deduplicate(later, index).collect()}
    assert (more[100]["keep_id"], more[100]["kept"], more[101]["kept"]) == (0, False, True)
    assert index.table().count() == len(set(normal)) + 1
    assert exact_dedup.deduplicate(df.limit(0), exact_dedup.DigestIndex(spark, common.fresh_path(spark, "index"))).count() == 0


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    df = frame(spark, [(i, t, "en", "s", 1) for i, t in [(1, "a"), (1, "a"), (None, "a"), (2, "b"), (2, "c"), (2, " c"), (None, None), (None, ""), *[(3, "d  d")] * 50]])
    index = exact_dedup.DigestIndex(spark, common.fresh_path(spark, "index"), buckets=4)
    got = collections.defaultdict(list)
    for x in exact_dedup.deduplicate(df, index).collect():
        got[x["text_sha256"]].append(x)
    assert len(got) == 6 and all(sum(x["kept"] for x in g) == 1 and {x["group_size"] for x in g} == {len(g)} for g in got.values())
    assert all(x["doc_id"] == x["keep_id"] for g in got.values() for x in g if x["kept"])
    assert not any(x["kept"] for x in exact_dedup.deduplicate(df, index).collect())
    assert exact_dedup.buckets_for(0) == 64 and exact_dedup.buckets_for(10**9) == 256


def test_index_is_not_shuffled(spark):
    index = exact_dedup.DigestIndex(spark, common.fresh_path(spark, "index"), buckets=4)
    index.add(spark.createDataFrame([(1, "a", 1, 0)], "keep_id long, digest string, n long, keep_row long"), "x")
    new = spark.createDataFrame([(2, "b")], "id long, digest string").groupBy("digest").agg(F.min("id"))
    plan = new.hint("merge").join(index.table().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


# -- 2 ---------------------------------------------------------------------------------------------


def test_mix(spark):
    r = random.Random(3)
    sources = [r.choice(["a", "b", "b", "b", "c", None, "é"]) for _ in range(400)]
    texts = [r.choice([None, "", *[words(r, r.randrange(1, 60))] * 8]) for _ in sources]
    df = docs(spark, texts, sources)
    got = {x["doc_id"]: x for x in mixing.mix(df).collect()}
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    names = sorted({s for s in sources if s is not None}) + [None]
    own = {s: sum(z for z, x in zip(sizes, sources) if x == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(own.values()))
    while free:  # reshare until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * own[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * own[s]
            left -= target[s]
            free.discard(s)
    for i, s in enumerate(sources):
        x = got[i]
        assert x["size"] == sizes[i] and x["source_size"] == own[s] and x["target"] == pytest.approx(target[s])
        assert 0 <= x["taken"] <= 3 * sizes[i]
    for s in names:
        taken = sum(got[i]["taken"] for i in got if sources[i] == s)
        assert abs(taken - target[s]) <= 0.01 * target[s] + 2
    assert {x["doc_id"]: x["taken"] for x in mixing.mix(df.repartition(7)).collect()} == {i: x["taken"] for i, x in got.items()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    copies = collections.Counter(x["doc_id"] for x in out.collect())
    assert all(copies[i] == got[i]["copies"] or sizes[i] == 0 for i in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
    assert mixing.mix(docs(spark, ["", None])).agg(F.sum("taken")).first()[0] == 0


def test_mix_of_repeated_rows(spark):
    r = random.Random(21)
    texts = [words(r, n) for n in (3, 4, 5, 6, 7, 8)]
    rows = [(i, t, "en", "ab"[i % 2], 1) for i, t in enumerate(texts) for _ in range((2, 3, 5)[i % 3])]
    rows += [(0, words(r, 3), "en", "a", 1), (None, "x y", "en", "a", 1), (None, "x y", "en", "a", 1), (None, None, "en", None, None)]
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [x for x in got if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= max(x["size"] for x in own)
    out = collections.Counter((x["doc_id"], x["source"], len((x["text"] or "").split())) for x in mixing.mixed_documents(df).collect())
    want = collections.Counter()
    for x in got:
        want[x["doc_id"], x["source"], x["size"]] += x["copies"]
    assert out == +want


@pytest.mark.parametrize("rest, reach", [(200, 1.0), (92, 0.99)])  # targets of 3 and of 2.9 times the source's words
def test_mix_reaches_the_target_of_a_capped_source(spark, rest, reach):
    texts = ["w " * 1000] * rest + ["w " * 250] * 30 + ["w " * 20_000, "", None]
    got = mixing.mix(docs(spark, texts, ["a"] * rest + ["b"] * 33)).where("source = 'b'").collect()
    own, target = 27_500, min(82_500, (rest * 1000 + 27_500) * 2 / 3)
    assert all(x["source_size"] == own and x["target"] == pytest.approx(target) and 0 <= x["copies"] <= 3 for x in got if x["size"])
    taken = sum(x["taken"] for x in got)
    assert taken >= reach * target and taken <= 3 * own


# -- 3 ---------------------------------------------------------------------------------------------


def test_levenshtein_automaton_against_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    r = random.Random(1)
    terms = {"".join(r.choice("abc") for _ in range(r.randrange(3, 12))): 1.0 + r.random() for _ in range(60)}
    trie = toxicity.Trie(terms)
    hit = 0
    for _ in range(3000):
        w = "".join(r.choice("abcd") for _ in range(r.randrange(3, 13)))
        ok = [(distance(t, w), -x, t) for t, x in terms.items() if distance(t, w) <= toxicity.edits(t)]
        near = trie.near(w)
        assert (near[2], -near[1], near[0]) == min(ok) if ok else near is None
        if ok and min(ok)[0]:
            hit += 1
            assert any(toxicity.edits(t) for _, _, t in ok) and trie.may_match(w)
    assert hit > 50


def toxic_docs(r, n):
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        w = words(r, 60).split()
        if toxic:
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(["blarg", "snork!", "zupfel", "zupfelig"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity(spark):
    rows = toxic_docs(random.Random(2), 300)
    df = docs(spark, [t for _, t, _ in rows] + [None, "", "x " * 50_000])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (7, 1, None), (10**6, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, labels)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(df, model).collect()}
    assert len(got) == 303 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i] >= 0.7, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([p == bool(y) for p, y in held]) > 0.95
    kept = toxicity.accepted(df, model)
    assert kept.columns == df.columns and kept.count() == sum(s < 0.7 for s in got.values())
    assert got[300] == got[301] < 0.3
    extra = docs(spark, ["you are a stupiid idiot and a morron", 'they wrote the word "idiot" in quotes', "plain words here"])
    a = [x["score"] for x in toxicity.score(extra, toxicity.prior_model()).orderBy("doc_id").collect()]
    assert a[0] > a[1] > a[2]
    # Labels are never inputs: other labels on held-out rows change no score.
    flipped = labels.withColumn("toxic", F.when(common.held_out(F.col("doc_id"), 3), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {x["doc_id"]: x["score"] for x in toxicity.score(df, toxicity.fit(df, flipped)).collect()} == pytest.approx(got)
    empty = toxicity.fit(df.limit(0), labels.limit(0))
    assert toxicity.score(df.limit(0), empty).count() == 0


def test_misspelt_stems_and_the_words_they_cover(spark):
    lookup = toxicity.Lookup({"idiot": 4.0}, {"grumpel": 3.0, "abc": 2.0}, frozenset(["crumpelled"]))
    assert lookup.find("grumpelix") == (3.0, "stem") and lookup.find("abcd") == (2.0, "stem")
    for word in ["grunpelix", "grmpelix", "gruumpelix", "gromp" + "elator" * 9]:
        assert lookup.find(word) == (pytest.approx(3.0 * toxicity.FUZZY * 0.8), "fuzzy")
    assert lookup.find("crumpelled") is None and lookup.find("grunbelix") is None and lookup.find("axcd") is None
    # Labels with many forms of one word: a stem covers them, and a misspelling of a form or of the stem is still met.
    r = random.Random(5)
    rows = []
    for i in range(400):
        w = words(r, 25).split()
        if i % 4 == 0:
            for _ in range(4):
                w.insert(r.randrange(len(w) + 1), "achlich" + r.choice(["er", "ung", "keit", "sam", "lein", "tum", "end", "ig"]))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs(spark, [t for _, t, _ in rows]), labels)
    lookup = toxicity._lookup(model)
    assert any(x in model.stems for x in ["achli", "achlic", "achlich"]) and "achlichkeit" in model.covered
    assert not model.covered.keys() & model.words.keys()
    assert all(lookup.find(w) and lookup.find(w)[1] == "fuzzy" for w in ["axhlichkeit", "achlihckeit", "ahlichnis"])


# -- 4 ---------------------------------------------------------------------------------------------


def brute_links(texts, n=5, t=0.8):
    sets = []
    for x in texts:
        w = (x or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    links = collections.Counter()
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= t * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return links, [find(i) for i in range(len(sets))]


def near_texts(r):
    base = words(r, 200).split()
    out = [None, "", "one two", "one two", "One  TWO", words(r, 3000)]
    for _ in range(40):  # a group of near copies
        w = list(base)
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    chain = words(r, 150).split()
    for _ in range(6):  # a chain, whose ends are not alike
        out.append(" ".join(chain))
        chain = chain[8:] + words(r, 8).split()
    return out + [words(r, r.randrange(5, 80)) for _ in range(60)] + out[5:9]


def test_ngram_join(spark):
    texts = near_texts(random.Random(4))
    links, root = brute_links(texts)
    df = docs(spark, texts)
    got = {x["doc_id"]: x for x in ngram_join.classes(df).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == root
    assert [got[i]["n_links"] for i in range(len(texts))] == [links[i] for i in range(len(texts))]
    kept = ngram_join.one_per_class(df.unionByName(df))
    assert kept.columns == df.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(root))
    assert ngram_join.classes(df.limit(0)).count() == 0


def test_one_per_class_with_repeated_and_null_ids(spark):
    a, b, c = "p q r s t u v", "k l m n o p q", "a b c d e f g"
    rows = [(1, a), (2, a), (2, b), (2, b), (2, b.upper()), (None, a), (None, c), (3, b), (4, c), (None, "z"), (None, None), (5, None), (5, "")]
    got = sorted((x["doc_id"] or 0, (x["text"] or "").lower()) for x in ngram_join.one_per_class(frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect())
    assert got == sorted([(1, a), (2, b), (4, c), (0, "z"), (0, ""), (5, "")])


def test_ngram_join_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    texts = near_texts(random.Random(5))
    links, root = brute_links(texts)
    got = {x["doc_id"]: x for x in ngram_join.classes(docs(spark, texts)).collect()}
    assert [(got[i]["class_id"], got[i]["n_links"]) for i in range(len(texts))] == [(root[i], links[i]) for i in range(len(texts))]


def test_banding():
    b, r = ngram_join.bands_and_rows()
    assert 1 - (1 - 0.8**r) ** b >= ngram_join.RECALL and b * r <= 128


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


# -- 1 ---------------------------------------------------------------------------------------------


def test_packed_estimates():
    r = np.random.default_rng(0)
    q, o = r.normal(size=(5, 21)), r.normal(size=(40, 21))
    codes = np.packbits(o > 0, axis=1)
    assert np.allclose(one_bit_ann.estimates(q.astype(np.float32), codes), q @ np.where(o > 0, 1, -1).T, atol=1e-4)


def test_ann(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(30, 24))
    x = centres[r.integers(0, 30, 1500)] + 0.6 * r.normal(size=(1500, 24))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(2000, None, 0), (2050, [0.0] * 24, 0), (2100, [math.nan] * 24, 0), (2150, [], 0), (None, [1.0] * 24, 0), (2200, [float(c) for c in x[0]], 0), (2250, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("vector", F.lit(1)).withColumn("code", F.lit(2))
    got = [g for g in one_bit_ann.search(one_bit_ann.index(df.where("vec_id is not null")), F.col("vec_id") % 50 == 0).collect()]
    ids = np.array([*range(1500), 2200])
    v = np.vstack([x, x[0]])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    by = collections.defaultdict(list)
    for g in sorted(got, key=lambda g: g["rank"]):
        by[g["query_id"]].append((g["vec_id"], g["score"]))
    hits = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        s = unit @ unit[list(ids).index(q)]
        s[ids == q] = -9
        want = sorted(zip(-np.round(s, 12), ids))[:5]
        hits += len({w for _, w in want} & {w for w, _ in by[q]})
        total += 5
        for w, score in by[q]:
            assert score == pytest.approx(s[list(ids).index(w)], abs=1e-12)
        assert [sc for _, sc in by[q]] == sorted((sc for _, sc in by[q]), reverse=True) and len(by[q]) == 5
    assert hits / total >= 0.97
    assert not {2000, 2050, 2100, 2150} & set(by) and 2250 not in by
    assert by[2200][0][0] == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], 0), (50, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert [tuple(g)[:3] for g in one_bit_ann.search(one_bit_ann.index(few), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert one_bit_ann.search(one_bit_ann.index(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0
    # Rows that repeat an id are rows of their own, and so are those without one.
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (None, [1.0, 0.0]), (2, [0.5, 0.5]), (50, [1.0, 2.0]), (50, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = one_bit_ann.search(one_bit_ann.index(few), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(g["vec_id"], round(g["score"], 3)) for g in got if g["query_id"] == 0] == [(None, 1.0), (1, 0.995), (2, 0.707), (50, 0.447), (50, 0.447)]
    assert sorted((g["rank"], g["vec_id"]) for g in got if g["query_id"] == 50)[:2] == [(1, 50), (1, 50)]
    # A vector that a third of all rows share: ties go to the smaller ids, and each row has few candidates.
    x = np.random.default_rng(3).normal(size=(700, 16))
    x[::3] = x[0]
    got = one_bit_ann.search(one_bit_ann.index(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")), F.col("vec_id") % 50 == 0).collect()
    assert {(g["query_id"], g["rank"]): g["vec_id"] for g in got if g["query_id"] in (0, 150)} == {(0, 1): 3, (0, 2): 6, (0, 3): 9, (0, 4): 12, (0, 5): 15, (150, 1): 0, (150, 2): 3, (150, 3): 6, (150, 4): 9, (150, 5): 12}


# -- 5 ---------------------------------------------------------------------------------------------


def test_brown_lm(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "LISTED", 60)  # so that most words are joined
    r = random.Random(8)
    texts = []
    for _ in range(200):
        bank = r.choice(["abcd", "efgh"])
        texts.append(" ".join("".join(r.choice(bank) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 80))))
    texts += [None, "", "Ab ab\tAB\x0bé É", texts[3]]
    df = docs(spark, texts).unionByName(docs(spark, texts).where("doc_id = 5"))
    model, known = brown_lm.fit(df.where(~common.held_out(F.col("doc_id"), 5)))
    got = brown_lm.score(df, model, known).collect()
    assert len(got) == len(texts) + 1
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for t in texts]
    c = collections.Counter()
    for i in [*range(len(texts)), 5]:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(tokens[i])
    n, v = sum(c.values()), len(c)
    for x in got:
        t = tokens[x["doc_id"]]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    held = [x for x in got if zlib.crc32(str(x["doc_id"]).encode()) % 5 == 1]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)
    # The model is a distribution: transitions sum to 1, and emissions of a class with its unseen word too.
    assert np.allclose((10**model.transitions).sum(1), 1)
    # Scores by hand, from the classes of all words of the training texts.
    of = {(None if x["word"] == brown_lm.END else bytes(x["word"]).decode()): x["class"] for x in known.collect()}
    assert set(of) == set(c) and of[None] == model.rule.end
    cls = lambda w: of[w] if w in of else model.rule(w.encode())
    pairs, words_of, tokens_of = collections.Counter(), collections.Counter(of.values()), collections.Counter()
    for i in [*range(len(texts)), 5]:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            pairs.update((cls(a), cls(b)) for a, b in zip([None, *tokens[i]], tokens[i]))
    for w, k in c.items():
        tokens_of[of[w]] += k
    classes = model.rule.end + 1
    before = collections.Counter()
    for (a, _), k in pairs.items():
        before[a] += k

    def log_p(a, w):
        share = (tokens_of[cls(w)] + 0.5) / (n + 0.5 * classes)
        step = (pairs[cls(a), cls(w)] + brown_lm.BACK * share) / (before[cls(a)] + brown_lm.BACK)
        return math.log10(step) + math.log10((c[w] + brown_lm.DELTA) / (tokens_of[cls(w)] + brown_lm.DELTA * (words_of[cls(w)] + 1)))

    for x in got:
        t = tokens[x["doc_id"]]
        assert x["score"] == pytest.approx(sum(log_p(a, w) for a, w in zip([None, *t], t)))
    empty = df.limit(0)
    m, w = brown_lm.fit(empty)
    assert brown_lm.score(empty, m, w).count() == 0
    assert all(math.isfinite(x["score"]) for x in brown_lm.score(df, m, w).collect())


def test_words_outside_the_core_are_exchanged(spark, monkeypatch):
    """Few words are in the core; each of the others joins the class that the likelihood of the bigrams of core and word names."""
    r = np.random.default_rng(4)
    n = r.poisson(6, (6, 6)).astype(float)
    like = lambda m: sum(x * math.log(x) for x in m.flat if x) - sum(x * math.log(x) for x in [*m.sum(0), *m.sum(1)] if x)
    word, side, beside, count, best = [], [], [], [], []
    for w in range(30):
        gains = np.full(5, 0.0)
        entries = [(s, b, int(r.integers(1, 9))) for s in (0, 1) for b in range(6) if r.random() < 0.4] or [(0, 1, 2)]
        for target in range(5):
            m = n.copy()
            for s, b, k in entries:
                m[(b, target) if s == 0 else (target, b)] += k
            gains[target] = like(m)
        best.append(gains)
        for s, b, k in entries:
            word.append(w), side.append(s), beside.append(b), count.append(float(k))
    got = brown_lm.placed(n, *(np.array(x) for x in (word, side, beside, count)))
    assert all(g[k] >= g.max() - 1e-9 for g, k in zip(best, got))

    # Rows of a word may lie in any number of batches.
    rows = sorted((b"w%02d" % w, s * 6 + b, int(k), part) for w, s, b, k in zip(word, side, beside, count) for part in (0, 1))
    batch = pa.RecordBatch.from_pydict({"word": pa.array([x[0] for x in rows], pa.binary()), "n": pa.array([x[2] for x in rows]), "beside": pa.array([[x[2] * 12 + x[1]] for x in rows])})
    assign = brown_lm._assigner({}, n, brown_lm.ClassRule({}, {}, 5))
    read = lambda size: [y for x in assign(batch.slice(i, size) for i in range(0, len(rows), size)) for y in x.to_pylist()]
    whole = read(len(rows))
    assert whole == read(1) == read(3) and len(whole) == 30 and sum(x["n"] for x in whole) == sum(x[2] for x in rows)
    assert [x["class"] for x in whole] == list(brown_lm.placed(n, *(np.array(x) for x in (word, side, beside)), 2 * np.array(count)))

    monkeypatch.setattr(brown_lm, "CORE", 12)
    monkeypatch.setattr(brown_lm, "FEWEST_CLASSES", 2)
    monkeypatch.setattr(brown_lm, "class_count", lambda v: 2)
    monkeypatch.setattr(brown_lm, "ENTRIES", 7)  # several pieces a batch
    rnd = random.Random(3)
    names, verbs = [f"n{i}x" for i in range(40)], [f"v{i}x" for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    texts = [" ".join(w for _ in range(20) for w in (rnd.choices(names, weights)[0], rnd.choices(verbs, weights)[0])) for _ in range(60)]
    _, words = brown_lm.fit(docs(spark, texts))
    rows = {bytes(x["word"]).decode(): x["class"] for x in words.collect()}
    of_names, of_verbs = {rows[w] for w in names if w in rows}, {rows[w] for w in verbs if w in rows}
    assert len(of_names) == len(of_verbs) == 1 and of_names != of_verbs


@pytest.mark.parametrize("classes", [3, 300])  # one byte a token, and two
def test_brown_lm_classifies_texts_once(spark, monkeypatch, tmp_path, classes):
    """The query splits texts four times and joins tokens that are not listed once, for transitions and scores together; scores by hand."""
    monkeypatch.setattr(brown_lm, "LISTED", 5)
    monkeypatch.setattr(brown_lm, "CORE", 12)
    monkeypatch.setattr(brown_lm, "class_count", lambda v: classes)
    r = random.Random(5)
    texts = [" ".join(r.choices([f"w{i}" for i in range(400)], [1 / (i + 1) for i in range(400)], k=r.randrange(60))) for _ in range(70)]
    texts += [None, "", "new " * 30, "w0 w0 w0"]
    docs(spark, texts).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    split, joined = [], []
    run, join = type(df).mapInArrow, type(df).join
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: (split.append("text" in self.columns), run(self, *a, **b))[1])
    monkeypatch.setattr(type(df), "join", lambda self, other, *a, **b: (joined.append("word" in other.columns), join(self, other, *a, **b))[1])
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    try:
        spark.conf.set(rows, "7")  # a text's tokens go on in other batches
        got = brown_lm.op5_brown_lm(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(rows, before)
    assert (sum(split), sum(joined)) == (4, 1)
    assert sorted(x["doc_id"] for x in got) == list(range(len(texts)))
    learns = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    assert all(x["held_out"] != learns(x["doc_id"]) for x in got)
    model, known = brown_lm.fit(df.where(~common.held_out(F.col("doc_id"), 5)))
    of = {(None if x["word"] == brown_lm.END else bytes(x["word"]).decode()): (x["class"], x["n"]) for x in known.collect()}
    tokens = [(t or "").split() + [None] for t in texts]
    cls = lambda w: of[w][0] if w in of else model.rule(w.encode())
    steps, size = np.zeros((classes + 1, classes + 1)), np.zeros(classes + 1)
    for i, t in enumerate(tokens):
        for a, b in zip([None, *t], t):
            steps[cls(a), cls(b)] += learns(i)
            size[cls(b)] += learns(i)
    share = (size + 0.5) / (size.sum() + 0.5 * (classes + 1))
    step = np.log10((steps + brown_lm.BACK * share) / (steps.sum(1, keepdims=True) + brown_lm.BACK))
    words = collections.Counter(c for c, _ in of.values())
    emission = lambda w: math.log10((of.get(w, (0, 0))[1] + brown_lm.DELTA) / (size[cls(w)] + brown_lm.DELTA * (words[cls(w)] + 1)))
    n = int(size.sum())
    for x in got:
        t = tokens[x["doc_id"]]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (len(t), sum(w in of for w in t), n)
        assert x["base_score"] == pytest.approx(sum(math.log10((of.get(w, (0, 0))[1] + 0.5) / (n + 0.5 * (len(of) + 1))) for w in t))
        assert x["score"] == pytest.approx(sum(step[cls(a), cls(w)] + emission(w) for a, w in zip([None, *t], t)))


def test_exchange_finds_classes():
    r = np.random.default_rng(2)
    p = np.kron(np.array([[0, 1], [1, 0]]), np.ones((6, 6)))
    counts = r.poisson(20 * p + 0.2).astype(float)
    of = brown_lm.exchange(counts, 2)
    assert len(set(of[:6])) == 1 and len(set(of[6:])) == 1 and of[0] != of[6]


# -- 6 ---------------------------------------------------------------------------------------------


def check_line_dedup(texts, got):
    """What went lies in a run of 50 words that stands at an earlier place; every window of 50 words that occurred before went."""
    trim = [[x.strip("\x20\t\n\x0b\x0c\r") for x in (t or "").split("\n")] for t in texts]
    solid = [[(k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate(t) if x] for t in trim]

    def windows(d):
        for i in range(len(solid[d])):
            total = 0
            for j in range(i, len(solid[d])):
                total += solid[d][j][2]
                if total >= 50:
                    yield i, j, tuple(x for _, x, _ in solid[d][i : j + 1])
                    break

    seen, must = set(), collections.defaultdict(set)
    for d in range(len(texts)):
        for i, j, content in windows(d):
            if content in seen:
                must[d].update(k for k, _, _ in solid[d][i : j + 1])
            seen.add(content)
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        left = [] if got[d] in (None, "") and must[d] else (got[d] or "").split("\n")
        want = [x for k, x in enumerate(lines) if k not in must[d]]
        assert len(left) <= len(want)
        rest = iter(want)
        assert all(any(x == y for y in rest) for x in left)  # what is left is a part of what may be left, in order
        if not must[d]:
            assert (got[d] or "") == (t or "")


def test_line_dedup(spark):
    r = random.Random(9)
    passage = [words(r, 20), words(r, 25), "", words(r, 30)]
    long_line = words(r, 70)
    texts = [None, "", words(r, 10), "\n".join([words(r, 9), *passage, words(r, 8)]), "\n".join([words(r, 30), "  " + passage[0] + "\t", *passage[1:], words(r, 12)]), "a\n" + long_line + "\nb", "c\n" + long_line, "short line\n" * 3,
             "\n".join([long_line] * 4), words(r, 49) + "\nx", words(r, 5), "\n".join(passage), "\n".join([words(r, 3)] * 60), "\n"]
    texts += [texts[3], "\n".join(words(r, 4) for _ in range(2000))]
    df = docs(spark, texts)
    out = line_dedup.without_repeats(df, counts=True)
    assert out.columns == [*df.columns, "removed_lines"]
    got = {x["doc_id"]: x["text"] for x in out.collect()}
    assert len(got) == len(texts) and got[0] is None and got[11] == "" and got[6] == "c" and got[8] == ""
    assert got[4].split("\n") == [texts[4].split("\n")[0], texts[4].split("\n")[-1]]
    check_line_dedup(texts, got)
    assert line_dedup.without_repeats(df.limit(0)).count() == 0
    twice = line_dedup.without_repeats(df.unionByName(df)).collect()
    assert collections.Counter((x["doc_id"], x["text"]) for x in twice) == collections.Counter({(i, t): 2 for i, t in got.items()})


def test_winnowing_selects_fewer_places_than_lines_and_common_ones(spark):
    r = random.Random(20)
    common = [words(r, 9) for _ in range(12)]
    texts = ["\n".join([*(words(r, 7) for _ in range(r.randrange(1, 20))), *common, *(words(r, 11) for _ in range(15))]) for _ in range(12)]
    df = docs(spark, texts)
    own = df.select("doc_id", F.xxhash64("text").alias("th"), line_dedup._lines(F.col("text")).alias("lines"))
    prints = line_dedup.fingerprints(line_dedup._windows(own, 50)).collect()
    lines = sum(len(t.split("\n")) for t in texts)
    assert len(prints) < 0.5 * lines
    assert len({(x["doc_id"], x["pos"]) for x in prints}) == len(prints)
    # Each window's least hash is a print, and nothing else is; the common passage has the same one in all texts.
    by = collections.defaultdict(set)
    for x in prints:
        by[x["doc_id"]].add((x["pos"], x["key"]))
    for x in own.collect():
        h, w = [y["h"] for y in x["lines"]], [y["w"] for y in x["lines"]]
        want = set()
        for i in range(len(h)):
            for j in range(i, len(h)):
                if sum(w[i : j + 1]) >= 50 and (sum(w[i:j]) < 50 or sum(w[i + 1 : j + 1]) < 50):
                    at = min(range(i, j + 1), key=lambda k: (h[k], k))
                    want.add((at, h[at]))
        assert by[x["doc_id"]] == want
    assert set.intersection(*({k for _, k in v} for v in by.values()))


def brute_line_dedup(texts):
    """A line goes if it lies in a run of 50 words or more that stands at an earlier place; blank lines go with the shortest such runs."""
    solid = [[(k, x.strip("\x20\t\n\x0b\x0c\r")) for k, x in enumerate((t or "").split("\n"))] for t in texts]
    solid = [[(k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in t if x] for t in solid]
    seen, out = set(), []
    for t, own in zip(texts, solid):
        gone = set()
        for i in range(len(own)):
            for j in range(i, len(own)):
                run = tuple(x for _, x, _ in own[i : j + 1])
                total = sum(w for *_, w in own[i : j + 1])
                if total >= 50:
                    if run in seen:
                        shortest = min(total - own[i][2], total - own[j][2]) < 50
                        gone.update(range(own[i][0], own[j][0] + 1) if shortest else (k for k, *_ in own[i : j + 1]))
                    seen.add(run)
        out.append(t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))
    return out


def test_line_dedup_random(spark):
    r = random.Random(10)
    bank = [words(r, r.randrange(5, 60)) for _ in range(12)]
    texts = ["\n".join(r.choice(bank) if r.random() < 0.6 else words(r, 20) for _ in range(r.randrange(1, 12))) for _ in range(80)]
    texts += ["\n".join(r.choice(bank) if r.random() < 0.7 else r.choice(["", " ", words(r, 3)]) for _ in range(r.randrange(1, 25))) for _ in range(40)]
    got = {x["doc_id"]: x["text"] for x in line_dedup.without_repeats(docs(spark, texts)).collect()}
    check_line_dedup(texts, got)
    assert [got[i] for i in range(len(texts))] == brute_line_dedup(texts)


# -- 7 ---------------------------------------------------------------------------------------------


def test_leaves():
    page = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><!-- x <p>no</p> --><p>a <b>b</b>c &amp; d&nbsp;e<br>f<p>g<script>var t="</p>";</script></div><ul><li>1<li>2</ul><form>q</form><div hidden>h</div><p style="display: none">i</p><b>tail'
    assert [x[0] for x in block_labeller.leaves(page)] == ["a bc & d e", "f", "g", "1", "2", "tail"]
    assert block_labeller.leaves(None) == [] and block_labeller.leaves("<div></div>") == []
    assert [x[0] for x in block_labeller.leaves("a <!-- open")] == ["a"]
    text = lambda page: " ".join(x[0] for x in block_labeller.leaves(page))
    assert text('<form id="aspnetForm"><article><p>One.</p><p>Two.</p></article></form>') == "One. Two."
    assert text("<form><div><p>" + "Long text. " * 20 + '</p></div></form><p>x</p><form><label>Mail</label><input></form>').startswith("Long text.")
    assert "Mail" not in text("<form><label>Mail</label><input></form><p>The text of the page.</p>")
    assert text("<head><title>T</title><p>Body</p>") == "Body" and text("<p>a<button>Go<p>b") == "a b"
    assert text('<p>1 < 2 <a title="x > y">z</a> <b class="open>c</b> d</p>') == "1 < 2 z c d"


def test_leaves_take_linear_time():
    for page in ['<a "' * 250_000, "<div>" * 200_000 + "x", "<a b='" * 170_000, "<p><b>" * 170_000, "<" * 10**6, "</x>" * 250_000, '<a ="<a >"' * 100_000, "<b>x" * 250_000, "<form>" * 170_000, "<!" * 500_000]:
        began = time.process_time()
        block_labeller.leaves(page)
        assert time.process_time() - began < 5, page[:20]


def test_gradients():
    r = np.random.default_rng(3)
    m = block_labeller.Labeller()
    x = r.normal(size=(4, 3, block_labeller.SIZE)).astype(np.float32)
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], bool)
    y = (r.random((4, 3)) < 0.5).astype(np.float32)

    def loss():
        z = m.logits(x, mask).astype(np.float64)
        return (np.where(mask, np.logaddexp(0, z) - y * z, 0)).sum() / mask.sum()

    g = m.step(x, y, mask)
    for name in m.w:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old = m.w[name][at]
        m.w[name][at] = old + 1e-2
        up = loss()
        m.w[name][at] = old - 1e-2
        down = loss()
        m.w[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(g[name][at], rel=0.05, abs=1e-4)


def test_extract_against_pages_of_known_text(spark):
    """Composed pages, through the whole query: each text against the text known by construction, page by page."""
    r = np.random.default_rng(9)
    bank = [" ".join(r.choice(block_labeller.WORDS, 150)) for _ in range(60)]
    rows, want = [], {}
    for i in range(120):
        pieces = block_labeller.composed(bank, r)
        rows.append((i, "u", "<html><body>" + "".join(p for p, _ in pieces) + "</body></html>"))
        want[i] = " ".join(" ".join(x[0] for x in block_labeller.leaves(p)) for p, good in pieces if good).split()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = block_labeller.fit(pages)
    hit = got_words = want_words = 0
    for x in block_labeller.extract(pages, model).collect():
        a, b = collections.Counter(x["text"].split()), collections.Counter(want[x["page_id"]])
        hit, got_words, want_words = hit + sum((a & b).values()), got_words + sum(a.values()), want_words + sum(b.values())
        own = [y[0] for y in block_labeller.leaves(rows[x["page_id"]][2])]
        good = model.label([block_labeller.vectors(block_labeller.leaves(rows[x["page_id"]][2]))])[0]
        assert x["text"] == " ".join(t for t, y in zip(own, good) if y)
    assert hit / got_words > 0.97 and hit / want_words > 0.97


def test_block_labeller(spark):
    r = np.random.default_rng(4)
    bank = [" ".join(r.choice(block_labeller.WORDS, 150)) for _ in range(40)]
    model = block_labeller.train([], [])
    right = total = 0
    for _ in range(150):
        x, y = block_labeller.composed_example(bank, r)
        right += (model.label([x])[0] == (y > 0)).sum()
        total += len(y)
    assert right / total > 0.97
    rows = [(1, "u", f"<nav><a>menu</a></nav><article><h1>Head</h1><p>{bank[0]}.</p></article><div class='comments'><p>I liked this one.</p></div><footer>legal</footer>"), (2, "v", None), (3, None, ""), (1, "u", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = block_labeller.extract(pages, model).collect()
    assert len(got) == 4 and got[0]["text"] == "Head " + bank[0] + "." and got[1]["text"] == got[2]["text"] == ""
    assert block_labeller.extract(pages.limit(0), block_labeller.fit(pages.limit(0))).count() == 0


# -- 9 ---------------------------------------------------------------------------------------------

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(d) <= 19 and luhn(d)) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base(spark):
    r = random.Random(12)
    bits = ["a.b@c.de", "x@y", "@", "a@b.c-d%e@f.g", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0010.1.1.1", "4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "+1 (555) 123-4567", "+49 30 1234567", "+1", "12", "é", "𝒳", "word", "john (at) mail [dot] org", "(030) 1234-5678", ".", "-", " ", "\n", "+1234567890123456", "9" * 30]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " "]) for _ in range(r.randrange(1, 30))) for _ in range(300)]
    texts += [None, "", "1" * 30_000, "a" * 30_000, "1-" * 10_000, "x@" + "a." * 5_000 + "b", "+1" + " " * 10_000 + "2"]
    df = docs(spark, texts)
    got = {x["doc_id"]: x for x in pii.detect(df, pii.fit(df)).collect()}
    for i, t in enumerate(texts):
        assert [(s["start"], s["kind"], s["end"]) for s in got[i]["base"]] == base_spans(t), t
        every = [(s["start"], s["kind"], s["end"]) for s in got[i]["spans"]]
        assert set(base_spans(t)) <= set(every) and every == sorted(every)
        for s in got[i]["spans"]:
            assert (t or "")[s["start"] : s["end"]] == s["m"]
    assert pii.detect(df.limit(0), pii.fit(df.limit(0))).count() == 0


def test_pii_added_and_redacted(spark):
    df = docs(spark, ["mail john (at) example (dot) org now", "a.b@c.de and +49 30 1234567.", "nothing", None])
    d = pii.fit(df)
    got = [x["text"] for x in pii.redacted(df, d).orderBy("doc_id").collect()]
    assert got == ["mail [EMAIL] now", "[EMAIL] and [PHONE].", "nothing", None]
    assert pii.redacted(df, d).columns == df.columns


def test_pii_overlaps_are_resolved_greedily(spark):
    r = random.Random(9)
    rows = [[]] + [sorted((a, a + r.randrange(1, 12), r.randrange(4), "m", "l", "r") for a in (r.randrange(60) for _ in range(r.randrange(12)))) for _ in range(200)]
    names = [f.name for f in pii.detect(docs(spark, [""]), pii.Detector(None, {})).schema["base"].dataType.elementType.fields]
    order = {"start": 0, "end": 1, "kind": 2}
    data = [(i, [tuple(s[order.get(n, 3)] for n in names) for s in spans]) for i, spans in enumerate(rows)]
    got = spark.createDataFrame(data, f"id int, s {pii.SPAN}").select("id", pii.greedy(F.col("s")).alias("s")).collect()
    chained = 0
    for x in got:
        want, to = [], 0
        for a, b, *_ in rows[x["id"]]:
            if a >= to:
                want.append((a, b))
                to = b
        assert [(s["start"], s["end"]) for s in x["s"]] == want
        every = rows[x["id"]]
        chained += len(want) > sum(not any(c[0] < s[1] and s[0] < c[1] for c in every[:i]) for i, s in enumerate(every))
    assert len(got) == len(rows) and chained  # some span stays whose only rivals were dropped


def test_pii_adds_national_phones(spark):
    r = random.Random(4)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    number = lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"
    known = [f"{r.choice(['call', 'phone'])} +1 {number()} today" for _ in range(150)]
    wrong = [f"{r.choice(['order', 'invoice'])} {number()} today" for _ in range(60)]
    free = [f"call {number()} today" for _ in range(150)]
    df = docs(spark, known + wrong + free)
    got = [x["text"] for x in pii.redacted(df, pii.fit(df)).orderBy("doc_id").collect()]
    assert all(t.endswith(" [PHONE] today") for t in got[:150])
    assert got[150:210] == wrong
    assert got[210:] == ["call [PHONE] today"] * 150


def test_pii_learns_from_every_text(spark):
    r = random.Random(6)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    number = lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"
    few = docs(spark, [f"call +1 {number()} today" for _ in range(25)] + [f"order {number()} today" for _ in range(10)] + [f"call {number()} today" for _ in range(10)]).select("doc_id", "text")
    plain = spark.range(100, 100_100).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words "), "id").alias("text"))
    got = [x["text"] for x in pii.redacted(few, pii.fit(few.union(plain))).orderBy("doc_id").collect()]
    assert got[:25] == ["call [PHONE] today"] * 25 and not any("[" in t for t in got[25:35])
    assert got[35:] == ["call [PHONE] today"] * 10


def test_pii_learns_from_every_vector(spark):
    r = random.Random(8)

    def number():
        some = r.sample("0123456789", r.randrange(2, 11))
        share = r.random()
        return "".join(r.choice(some) + (r.choice(" -") if r.random() < share else "") for _ in range(r.randrange(13, 19))) + r.choice(some)

    texts = ["".join(f"{r.choice(['card', 'plain words that are longer than the window', 'é'])}{r.choice(['', ' '])}: {number()}{r.choice(['', 'é'])} and " for _ in range(60)) for _ in range(1_200)]
    seen, good, wrong = set(), 0, 0
    for t in texts:
        base = [s for s in base_spans(t) if s[1] >= 2]
        apart = lambda m: not any(m.start() < e and b < m.end() for b, _, e in base)  # noqa: E731, B023
        rest = [m for m in re.finditer(PATTERNS[2], t) if apart(m) and 10 <= len(re.sub("[^0-9]", "", m[0])) <= 19]
        good, wrong = good + len(base), wrong + len(rest) + sum(map(apart, re.finditer(pii.NATIONAL, t)))
        for m in rest:
            sizes, d = [len(g) for g in re.split("[ -]", m[0])], re.sub("[^0-9]", "", m[0])
            seen.add((len(d), len(sizes), max(sizes), min(sizes), len(set(d)), d[0], "card" in t[m.start() - 10 : m.start()], t[m.end()] == "é"))
    assert len(seen) > 20_000
    assert pii.fit(docs(spark, texts)).trees.start == pytest.approx(math.log((good + 0.5) / (wrong + 0.5)), abs=1e-12)


def test_trees_fit_and_score_alike(spark):
    r = np.random.default_rng(5)
    x = r.integers(0, 6, (200, len(pii.FEATURES)))
    n = r.integers(1, 9, 200).astype(float)
    good = np.where((x[:, 0] > 2) & (x[:, 3] < 3), n, 0.0)
    trees = pii.Trees(x, good, n)
    assert (((trees.z > 0) == (good > 0)) * n).sum() / n.sum() > 0.97
    rows = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "i int, v array<int>")
    got = {g["i"]: g["z"] for g in rows.select("i", trees.score(F.col("v")).alias("z")).collect()}
    assert [got[i] for i in range(200)] == pytest.approx(list(trees.z))


# -- 10 --------------------------------------------------------------------------------------------


def test_pair_table():
    r = np.random.default_rng(14)
    pairs = {(int(a), int(b)): int(k) for a, b, k in zip(r.zipf(1.3, 4000) % 300, r.integers(0, 300, 4000), r.integers(0, 500, 4000))}
    slots, shift = byte_bpe.pair_table(np.array([(a, b, k) for (a, b), k in pairs.items()]), 300)
    for a in range(300):
        for b in range(300):
            found = int(slots[b ^ shift[a]]) ^ (a << 40 | b << 20)
            assert min(found, byte_bpe.NONE) == pairs.get((a, b), byte_bpe.NONE)


def test_byte_bpe(spark):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    r = random.Random(13)
    letters = "abcdeéßñ中文 \n\t12'’.,!<|>🙂  "
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 60))) for _ in range(150)] + [None, "", "<|endoftext|>", "it's we'll   x  ", "a" * 400, "word " * 3000, " \n \n\n  y", "ſ ＡＢ Ⅷ ½"]
    df = docs(spark, texts)
    bpe = byte_bpe.public_bpe(spark)
    for memo in (False, True):
        if memo:
            bpe.remember(df)
        got = {x["doc_id"]: x for x in byte_bpe.encode_documents(df, bpe).withColumn("back", bpe.decode(F.col("ids"))).collect()}
        for i, t in enumerate(texts):
            assert got[i]["ids"] == enc.encode_ordinary(t or ""), t
            assert bytes(got[i]["back"]) == (t or "").encode()
    assert byte_bpe.encode_documents(df.limit(0), bpe).count() == 0
    before = byte_bpe.encode_documents(df, bpe)
    bpe.forget()
    assert {x["doc_id"]: x["ids"] for x in before.collect()} == {i: x["ids"] for i, x in got.items()}


def test_remembered_words_take_room_in_proportion(spark, monkeypatch):
    sizes = []

    def literal(row, name, real=byte_bpe.literal):
        if name.startswith("words"):
            sizes.append(row.select(F.size("maps"), F.aggregate("maps", F.lit(0), lambda n, m: n + F.when(m.isNull(), 0).otherwise(F.size(m)))).first())
        return real(row, name)

    monkeypatch.setattr(byte_bpe, "literal", literal)
    bpe = byte_bpe.public_bpe(spark)
    for n in (0, 1, 700):
        df = docs(spark, [" ".join(f"Wort{i}x" for i in range(n))] * 2)
        plain = bpe.encode(F.col("text")) if n == 0 else plain  # nothing is remembered yet
        bpe.remember(df)
        assert df.select(plain.alias("a")).collect() == df.select(bpe.encode(F.col("text")).alias("a")).collect()
    assert [n for _, n in sizes[:1]] == [0] and sizes[-1][1] >= 700
    for maps, remembered in sizes:
        assert maps <= max(1, remembered)
    bpe.forget()
