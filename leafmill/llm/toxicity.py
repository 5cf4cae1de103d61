"""Toxicity scoring with a learnt lexicon, misspelling automata and context windows.

1. A bounded sample of training labels (`LABEL_ROWS`, the smallest id hashes) is
   joined to the documents by broadcast; its bound is what makes that safe.
2. Over those texts, words and word beginnings are counted by label in Spark, and
   the ones whose log-likelihood ratio and document count are clear make the
   lexicon, beside a short seed list with a prior.
3. Each distinct token is looked up exactly, by its longest listed beginning, and,
   if it is no ordinary word, by a Levenshtein automaton run over the tries of
   the lexicon: one edit for terms of 5 to 8 letters, two beyond. Whole words are
   compared with words, those that a stem covers too, and the token's beginnings with stems.
4. A window of words around each hit tells quotation (quotation marks, verbs and
   nouns of reporting) from abuse (second person, capitals, exclamation).
5. Logistic regression over a dozen sums turns that into a score from 0 to 1.

Whole texts are scored, in Arrow batches of bounded size, without a shuffle.

Defined results: null and empty texts have no hits and get the score of the
intercept; a null id is held out or not by the empty text's CRC; labels other
than 0 and 1, and labels without a document, are ignored; an id labelled twice
counts as toxic if either is; a table without both labels leaves the prior
model; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import held_out, largest, sampled, slices, table, written

#: Bounds on what is fitted and broadcast.
LABEL_ROWS, LEXICON_ROWS, ORDINARY_ROWS = 20_000, 5_000, 60_000
#: A term needs this many toxic documents and this log-likelihood ratio.
LEAST_DOCS, LEAST_LLR, LEAST_LOG_ODDS = 3, 20.0, 2.0
#: A term must stand behind this share of the different words, of 64 hashes, that unrelated documents would give it.
CONTEXTS = 0.35
STEMS = range(3, 9)
CACHE = 150_000
WINDOW = 4

#: Terms that count as toxic before any label is seen, and how many toxic documents that is worth.
SEEDS = "idiot moron stupid dumb loser scum trash garbage pathetic worthless disgusting clown imbecile cretin bastard bitch asshole shit fuck fucking retard slut whore pig freak coward".split()
SEED_DOCS = 3
#: Words that report what others say, and words that address someone.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes quoting word words term terms phrase insult slur means meaning sagte nannte wort dit mot palabra dijo".split())
ADDRESSING = frozenset("you your you're youre u ur yourself du dich dein deine ihr tu te toi ton vous votre tú eres usted tus".split())
OPENING, CLOSING = "\"'“„«‘‹`", "\"'”“»’›`"
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
FEATURES = ("total", "largest", "hits", "terms", "stems", "quoted", "directed", "loud", "density")
SENSE = np.array([1, 1, 1, 1, 0, -1, 1, 1, 1])
#: What a misspelt hit counts for beside an exact one, before a fifth off for each edit.
FUZZY = 0.7


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) <= 8 else 2


def bare(token: str) -> str:
    """The token from its first to its last letter or digit."""
    token = token.strip(".,;:!?|*#$%&\"'()")
    return token if token and token[0].isalnum() and token[-1].isalnum() else EDGE.sub("", token)


def without(word: str, k: int) -> set[str]:
    """The word, and what is left of it without up to k letters."""
    out = last = {word}
    for _ in range(k):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Trie:
    """Terms by letter; a term's weight is kept at its last node under the empty key.

    Beside it, two filters that no misspelling fails, so that few words reach the automaton: with k edits
    one of a term's k + 1 pieces stays whole, moved by k places at most; and two words k edits apart have
    a common rest without k letters of each."""

    def __init__(self, terms: dict[str, float]):
        self.root: dict = {}
        self.rests: dict[int, set[str]] = {1: set(), 2: set()}
        #: By length of a word: where to look, the pieces that may be there, and the edits they allow.
        self.spots: dict[int, list[tuple[int, int, set[str], int]]] = {}
        spots: dict[tuple[int, int, int, int], set[str]] = {}
        for term, weight in terms.items():
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node[""] = (term, weight)
            k, n = edits(term), len(term)
            if not k:
                continue
            self.rests[k] |= without(term, k)
            for i in range(k + 1):
                at, end = n * i // (k + 1), n * (i + 1) // (k + 1)
                for size in range(n - k, n + k + 1):
                    for start in range(max(0, at - k), at + k + 1):
                        spots.setdefault((size, start, start + end - at, k), set()).add(term[at:end])
        for (size, start, end, k), pieces in spots.items():
            self.spots.setdefault(size, []).append((start, end, pieces, k))
        self.most = max([0, *map(edits, terms)])

    def may_match(self, word: str) -> bool:
        tried = set()
        for start, end, pieces, k in self.spots.get(len(word), ()):
            if word[start:end] in pieces and k not in tried:
                if not self.rests[k].isdisjoint(without(word, k)):
                    return True
                tried.add(k)
        return False

    def near(self, word: str) -> tuple[str, float, int] | None:
        """The term nearest to word within its allowed edits, heaviest first among equals.

        A state of the Levenshtein automaton of `word` is its row of edit distances; it is carried
        down the trie, and a branch ends where the whole row exceeds the most edits allowed."""
        best, most = None, self.most
        stack = [(self.root, tuple(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    term, weight = child
                    if row[-1] <= edits(term) and (best is None or (row[-1], -weight, term) < (best[2], -best[1], best[0])):
                        best = (term, weight, row[-1])
                    continue
                new = [row[0] + 1]
                for i, c in enumerate(word):
                    new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (c != letter)))
                if min(new) <= most:
                    stack.append((child, tuple(new)))
        return best


class Lookup(dict):
    """Raw token -> None or (weight, kind); filled as tokens come, emptied when too large."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], ordinary: frozenset[str], covered: dict[str, float] | None = None):
        super().__init__()
        self.words, self.stems, self.ordinary, self.trie = words, stems, ordinary, Trie(words | (covered or {}))
        self.stem_trie = Trie({x: weight for x, weight in stems.items() if edits(x)})
        self.begins = {x[: STEMS[0]] for x in stems}

    def __missing__(self, token: str):
        if len(self) >= CACHE:
            self.clear()
        out = self[token] = self.find(token if token.isalpha() else bare(token))
        return out

    def find(self, word: str):
        if len(word) < 3:
            return None
        if word in self.words:
            return self.words[word], "word"
        for n in reversed(STEMS) if word[: STEMS[0]] in self.begins else ():
            if len(word) >= n and word[:n] in self.stems:
                return self.stems[word[:n]], "stem"
        if len(word) >= 4 and word not in self.ordinary and (hit := self.near(word)):
            return hit[1] * FUZZY * (1 - 0.2 * hit[2]), "fuzzy"
        return None

    def near(self, word: str) -> tuple[str, float, int] | None:
        """The nearest term, of words by the whole word and of stems by its beginnings, heaviest first among equals."""
        hits = [self.trie.near(word)] if len(word) <= 40 and self.trie.may_match(word) else []
        for n in sorted(self.stem_trie.spots):
            if n <= len(word) and self.stem_trie.may_match(word[:n]):
                hits.append(self.stem_trie.near(word[:n]))
        return min((hit for hit in hits if hit), key=lambda hit: (hit[2], -hit[1], hit[0]), default=None)


_LOOKUPS: dict[str, Lookup] = {}


def _lookup(model: Model) -> Lookup:
    """One look-up per model in a worker, which several tasks use."""
    if model.name not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[model.name] = Lookup(model.words, model.stems, model.ordinary, model.covered)
    return _LOOKUPS[model.name]


def features(text: str, lookup: Lookup) -> list[float]:
    """FEATURES of one whole text."""
    tokens = text.lower().split()
    found = list(map(lookup.__getitem__, tokens))
    hits = [i for i, x in enumerate(found) if x is not None]
    if not hits:
        return [0.0] * len(FEATURES)
    raw = text.split()
    same = len(raw) == len(tokens)
    total = largest = n = 0.0
    stems = quoted = directed = loud = 0
    terms = set()
    for i in hits:
        weight, kind = found[i]
        around = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
        near = {bare(t) for t in around}
        told = bool(near & REPORTING) or _inside_quotes(tokens, i)
        aimed = bool(near & ADDRESSING)
        quoted += told
        directed += aimed
        loud += "!" in tokens[i] or same and len(raw[i]) > 3 and raw[i].isupper()
        weight *= (0.4 if told and not aimed else 1.0) * (1.2 if aimed else 1.0)
        n += FUZZY if kind == "fuzzy" else 1
        total += weight
        stems += kind == "stem"
        largest = max(largest, weight)
        terms.add(tokens[i])
    k = len(hits)
    return [math.log1p(total), largest / 5, math.log1p(n), math.log1p(len(terms)), math.log1p(stems), quoted / k, directed / k, loud / k, 10 * n / (len(tokens) + 10)]


def _inside_quotes(tokens: list[str], i: int) -> bool:
    """A mark opens at most three words before, or at the word, and closes at most three words behind, or at the word."""
    opens = any(t[0] in OPENING for t in tokens[max(0, i - 3) : i + 1])
    return opens and any(t.rstrip(".,;:!?)")[-1:] in CLOSING and t.rstrip(".,;:!?)") for t in tokens[i : i + 4])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words and stems by label: documents, occurrences (three at most per document), and a mask of hashed words before it.

    The mask tells a term that many authors use from one that copies of one text repeat."""
    n: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(n)
        return pa.RecordBatch.from_pydict(
            {"kind": [k[0] for k in keys], "term": [k[1] for k in keys], "toxic": pa.array([k[2] for k in keys], pa.int32()), "docs": pa.array([n[k] for k in keys], pa.int64()), "uses": pa.array([more[k] for k in keys], pa.int64()), "behind": pa.array([_signed(after.get(k, 0)) for k in keys], pa.int64())}
        )

    more: Counter = Counter()
    after: dict = {}
    for batch in slices(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            tokens = [t if t.isalpha() else bare(t) for t in (text or "").lower().split()]
            words = Counter(tokens)
            for last, w in zip(["", *tokens], tokens) if toxic else ():
                bit = 1 << (zlib.crc32(last.encode()) & 63)
                for key in (("w", w, 1), *(("s", w[:k], 1) for k in STEMS if len(w) > k)):
                    after[key] = after.get(key, 0) | bit
            per: Counter = Counter()
            for w, c in words.items():
                if 3 <= len(w) <= 40:
                    per["w", w, toxic] += c
                    for k in STEMS:
                        if len(w) > k:
                            per["s", w[:k], toxic] += c
            n.update(per.keys())
            for k, c in per.items():
                more[k] += min(c, 3)
            if len(n) > 100_000:
                yield out()
                n.clear()
                more.clear()
                after.clear()
    if n:
        yield out()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _llr(t, c, big_t, big_c):
    """Signed by the caller: Dunning's log-likelihood ratio of two rates, as a column."""
    rate = (t + c) / (big_t + big_c)
    part = lambda k, n: F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0)
    return 2 * (part(t, big_t) + part(c, big_c))


class Model:
    def __init__(self, words, stems, ordinary, coefficients, covered=None):
        self.words, self.stems, self.ordinary, self.coefficients = words, stems, ordinary, coefficients
        #: Words that begin with a stem, with the stem's weight: only their misspellings are looked up.
        self.covered = covered or {}
        self.name = uuid.uuid4().hex


def prior_model() -> Model:
    b = np.zeros(len(FEATURES) + 1)
    b[0], b[1], b[2] = -3.0, 1.5, 1.5
    return Model({w: 4.0 for w in SEEDS}, {}, frozenset(), b)


def fit(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS) -> Model:
    """Learn from rows whose crc32(id) mod 3 is not 1."""
    training = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), 3))
    sample = sampled(training.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), F.col("doc_id"), label_rows)
    texts = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxicity-sample")
    sizes = {r["toxic"]: (r["n"], r["w"]) for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.length("text"), F.lit(1))).alias("w")).collect()}
    if not (sizes.get(0, (0, 0))[0] and sizes.get(1, (0, 0))[0]):
        return prior_model()
    counts = texts.mapInArrow(_candidates, "kind string, term string, toxic int, docs bigint, uses bigint, behind bigint")
    of = lambda col, label: F.sum(F.when(F.col("toxic") == label, F.col(col)).otherwise(0))
    counts = written(counts.groupBy("kind", "term").agg(of("docs", 1).alias("td"), of("docs", 0).alias("cd"), of("uses", 1).alias("tu"), of("uses", 0).alias("cu"), F.bit_count(F.bit_or("behind")).alias("contexts")), "toxicity-counts")
    (n1, _), (n0, _) = sizes[1], sizes[0]
    # Uses are compared by words read, which characters stand for; documents by their number.
    w1, w0 = sizes[1][1] or 1, sizes[0][1] or 1
    odds = F.log((F.col("td") + 0.5) / (n1 + 1)) - F.log((F.col("cd") + 0.5) / (n0 + 1))
    llr = _llr(F.col("tu"), F.col("cu"), float(w1), float(w0))
    found = (
        counts.withColumn("odds", odds).withColumn("llr", llr)
        .where((F.col("contexts") >= F.greatest(F.lit(3), CONTEXTS * 64 * (1 - F.exp(-F.col("td") / 64)))) & (F.col("td") >= LEAST_DOCS) & (F.col("odds") >= LEAST_LOG_ODDS) & (F.col("llr") >= LEAST_LLR) & (F.col("tu") * w0 > F.col("cu") * w1))
        .orderBy(F.desc("llr"), "kind", "term").limit(LEXICON_ROWS).select("kind", "term", "odds", "tu").collect()
    )
    longer: Counter = Counter()  # by stem, the most uses of a longer term that begins with it
    for r in found:
        for n in STEMS:
            if len(r["term"]) > n or r["kind"] == "w" and len(r["term"]) == n:
                longer[r["term"][:n]] = max(longer[r["term"][:n]], r["tu"])
    words = {r["term"]: float(r["odds"]) for r in found if r["kind"] == "w"}
    stems = {r["term"]: float(r["odds"]) for r in found if r["kind"] == "s" and longer[r["term"]] < 0.8 * r["tu"]}
    for r in counts.where((F.col("kind") == "w") & F.col("term").isin(SEEDS)).collect():
        words[r["term"]] = math.log((r["td"] + 0.5 + SEED_DOCS) / (n1 + 1)) - math.log((r["cd"] + 0.5) / (n0 + 1))
    words = {w: 4.0 for w in SEEDS} | words
    words = {w: x for w, x in words.items() if x > 0.5}
    covered = {w: next(stems[w[:n]] for n in reversed(STEMS) if w[:n] in stems) for w in words if any(w[:n] in stems for n in STEMS)}
    words = {w: x for w, x in words.items() if w not in covered}
    usual = largest(counts.where((F.col("kind") == "w") & (F.col("cd") >= 2)), "cd", ORDINARY_ROWS).select("term").toArrow()
    model = Model(words, stems, frozenset(usual["term"].to_pylist()) - words.keys(), None, covered)
    rows = texts.mapInArrow(_scorer(model, ["toxic"]), "toxic int, x array<double>").toArrow()
    x, y = np.array(rows["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES)), np.array(rows["toxic"], dtype=float)
    for _ in FEATURES:  # a feature that speaks against its sense in this sample stays out
        b = logistic(x, y)
        if not (wrong := b[1:] * SENSE < 0).any():
            break
        x = np.where(wrong, 0, x)
    model.coefficients = b
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 60) -> np.ndarray:
    """Newton's method, intercept first. The ridge is on all but the intercept, and per row, so it shrinks alike at every size."""
    x = np.hstack([np.ones((len(x), 1)), x])
    b, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 0.0)
    penalty[1:] = ridge * min(len(y), 100) / 10
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * b)
        b = b + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _scorer(model: Model, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(model)
        for batch in slices(batches):
            x = [features(text or "", lookup) for text in batch.column("text").to_pylist()]
            columns = {c: batch.column(c) for c in keep}
            if model.coefficients is None:
                yield pa.RecordBatch.from_pydict(columns | {"x": pa.array(x, pa.list_(pa.float64()))})
                continue
            b = model.coefficients
            z = np.clip((np.array(x, dtype=float).reshape(len(x), -1) @ b[1:] if x else np.zeros(0)) + b[0], -30, 30)
            hits = [math.ceil(math.expm1(r[2]) - 1e-9) for r in x]
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(1 / (1 + np.exp(-z)), pa.float64()), "hits": pa.array(hits, pa.int64())})

    return run


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score, hits (words of the text that the lexicon or its automata matched, misspelt ones for FUZZY each, rounded up)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model, ["doc_id"]), f"doc_id {kind}, score double, hits bigint")


def _judge(model: Model, threshold: float, text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, b = _lookup(model), model.coefficients
        for batch in slices(batches):
            z = np.array([float(np.dot(features(t or "", lookup), b[1:])) + b[0] for t in batch.column(text_at).to_pylist()])
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < threshold))

    return run


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under the threshold."""
    return docs.mapInArrow(_judge(model, threshold, docs.columns.index(text)), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")
