"""Brown class-based bigram language model: P(w_i | w_i-1) = P(c_i | c_i-1) * P(w_i | c_i).

Tokens are words (runs without ASCII white space, A-Z lower-cased), then one end per
text. All training texts are counted:

1. Words are counted in batches and summed by a shuffle.
2. Bigrams of the `CORE` most frequent words are counted, and exchange clustering begins with them: each in turn
   moves to the class that raises the likelihood of the class bigrams most, until few move. The number of
   classes grows with the vocabulary (`class_count`).
3. Every other word of the training texts is exchanged by itself, in parallel: the classes that stand before and after
   it are counted over all texts, and it moves to the class that raises the likelihood of the bigrams of the core and
   the word most (`placed`). A word that never stands beside a word of the core, and a word that training never met, take the class
   that is most common among words of the same last letters (three, else two, else one, else the class of fewest words).
4. Class bigrams are counted over all tokens of the training texts. Transitions are smoothed with
   the class frequencies, emissions by adding `DELTA` to each word of the class and one unseen word more.

The `LISTED` most frequent words, with counts and classes, are sent to all tasks: a list of bounded size, which changes time
and not results. Every other token is joined to the table of words, once, and its class takes its place among the classes of
its text (one byte a token, two from 255 classes on). Class bigrams are counted and texts are scored from these.
Nothing that grows in proportion to the corpus is broadcast; the table of transitions grows with the root of the vocabulary.

Defined results: null and empty texts are the end alone; without training texts every token is
unknown and N and V are 0, scored as if V + 1 were 1; rows that repeat id and text are scored each; a null id counts as
the empty text for the held-out rule; ties in frequency go to the word of smaller bytes; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import held_out, largest, slices, table, written

LISTED, CORE, FEWEST_CLASSES = 150_000, 1_500, 40
DELTA, PASSES = 0.5, 12
#: Weight of the class bigrams against the class frequencies: n / (n + BACK) of it for a class seen n times before.
BACK = 5.0
END = b"\n"  # no word: words hold no white space
FLUSH = 300_000
#: Texts whose tokens are held at a time.
TEXTS = 64
#: Pairs of a word and a class beside it that are weighed at a time.
ENTRIES = 8_000


def class_count(vocabulary: int) -> int:
    """Twice the fourth root of the vocabulary, 40 at least: 50 for 400,000 words, 200 for a hundred million."""
    return max(FEWEST_CLASSES, math.ceil(2 * vocabulary**0.25))


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text and its end. Bytes split at exactly the six white space characters meant, and lower A-Z only."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(n.keys()), pa.binary()), "n": pa.array(list(n.values()), pa.int64())})

    for batch in slices(batches):
        for text in _texts(batch):
            n.update(tokens(text))
        if len(n) > FLUSH:
            yield out()
            n.clear()
    if n:
        yield out()


def _joined(batch: pa.RecordBatch) -> tuple[list[bytes], list[int]]:
    """The tokens of all texts of a batch, behind an end, and the place where each text begins. A text so follows the end of the one before."""
    out, starts = [END], []
    for text in _texts(batch):
        starts.append(len(out))
        out += tokens(text)
    return out, starts


def _looked_up(places: dict[bytes, int], t: list[bytes], otherwise: int) -> np.ndarray:
    return np.fromiter(map(places.get, t, repeat(otherwise)), np.int64, len(t))


def _pairs(codes: dict[bytes, int], size: int):
    """Counts of pairs of words that have codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in slices(batches, TEXTS):
            c = _looked_up(codes, _joined(batch)[0], -1)
            a, b = c[:-1], c[1:]
            use = (a >= 0) & (b >= 0)
            at, n = np.unique(a[use] * size + b[use], return_counts=True)
            total[at] += n
        at = np.nonzero(total)[0]
        for start in range(0, len(at), 100_000):
            part = at[start : start + 100_000]
            yield pa.RecordBatch.from_pydict({"pair": pa.array(part), "n": pa.array(total[part])})

    return run


def exchange(counts: np.ndarray, classes: int, passes: int = PASSES) -> np.ndarray:
    """Classes 0 .. classes - 1 of words, from their bigram counts, by the exchange algorithm.

    The class bigram likelihood is, up to terms that do not depend on the classes,
    sum f(N(c, d)) - sum f(left(c)) - sum f(right(d)), with f(x) = x log x. Moving one word changes two rows and two
    columns; the change is computed for all target classes at once."""
    size = len(counts)
    classes = min(classes, size)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    of = np.arange(size) % classes  # the most frequent words begin in classes of their own
    hot = np.zeros((size, classes))
    hot[np.arange(size), of] = 1
    after, before = counts @ hot, counts.T @ hot  # words x classes
    n = hot.T @ after
    left, right = n.sum(1), n.sum(0)
    for _ in range(passes):
        moved = 0
        for w in range(size):
            a, own = of[w], counts[w, w]
            out, into = after[w].copy(), before[w].copy()
            out[a] -= own
            into[a] -= own
            if not (out.any() or into.any() or own):
                continue
            # Take w out of its class.
            n[a] -= out
            n[:, a] -= into
            n[a, a] -= own
            sl, sr = out.sum() + own, into.sum() + own
            left[a] -= sl
            right[a] -= sr
            # Put it into each class b: row b gets out, column b gets into, (b, b) gets both and own.
            rows = f(n + out[None, :]).sum(1) - f(n).sum(1)
            columns = f(n + into[:, None]).sum(0) - f(n).sum(0)
            d, o, i = np.diag(n), out, into
            corner = f(d + o + i + own) - f(d + o) - f(d + i) + f(d)
            gain = rows + columns + corner - (f(left + sl) - f(left)) - (f(right + sr) - f(right))
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            n[b] += out
            n[:, b] += into
            n[b, b] += own
            left[b] += sl
            right[b] += sr
            if b != a:
                moved += 1
                of[w] = b
                after[:, a] -= counts[:, w]
                after[:, b] += counts[:, w]
                before[:, a] -= counts[w]
                before[:, b] += counts[w]
        if moved <= size // 200:
            break
    return of


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def placed(n: np.ndarray, word: np.ndarray, side: np.ndarray, beside: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The class that each of the words 0, 1, ... joins to raise the likelihood of the bigrams most.

    `n` has the bigrams of classes (the last is the end's, which no word joins); an entry says that class `beside` stands
    before (side 0) or after (side 1) a word `count` times, each at most once. Words are weighed one by one against `n`; ties go to the first class."""
    k, words = len(n) - 1, int(word[-1]) + 1
    into, out = np.zeros((words, k + 1)), np.zeros((words, k + 1))
    into[word[side == 0], beside[side == 0]] = count[side == 0]
    out[word[side == 1], beside[side == 1]] = count[side == 1]
    cell = np.where(side[:, None] == 1, n[:k, beside].T, n[beside, :k])  # (b, beside) or (beside, b) for every class b
    change = xlogx(cell + count[:, None]) - xlogx(cell)
    gain = np.zeros((words, k))
    np.add.at(gain, word, change)
    at, b = np.nonzero((into[:, :k] > 0) & (out[:, :k] > 0))  # (b, b) gets both
    d, o, i = n[b, b], out[at, b], into[at, b]
    gain[at, b] += xlogx(d + o + i) - xlogx(d + o) - xlogx(d + i) + xlogx(d)
    left, right = n.sum(1)[:k] + into[:, :k], n.sum(0)[:k] + out[:, :k]
    gain -= xlogx(left + out.sum(1, keepdims=True)) - xlogx(left)
    gain -= xlogx(right + into.sum(1, keepdims=True)) - xlogx(right)
    return gain.argmax(1)


class ClassRule:
    """word -> class by its last letters, from words whose classes are known. The end has a class of its own, the last."""

    def __init__(self, classes: dict[bytes, int], weights: dict[bytes, int], n: int):
        self.end = n
        votes: dict[bytes, Counter] = defaultdict(Counter)
        most: Counter = Counter()
        for w, c in classes.items():
            if w == END:
                continue
            most[c] += 1
            for end in dict.fromkeys(self.endings(w)):
                votes[end][c] += 1 + weights.get(w, 0) ** 0.5
        self.by_end = {e: min(v.items(), key=lambda x: (-x[1], x[0]))[0] for e, v in votes.items()}
        self.rest = min(most, key=lambda c: (most[c], c)) if most else 0

    @staticmethod
    def endings(word: bytes) -> tuple[bytes, bytes, bytes]:
        """The last three, two and one letters."""
        if word.isascii():
            return word[-3:], word[-2:], word[-1:]
        tail = word[-12:].decode(errors="ignore")  # three letters of four bytes at most
        return tail[-3:].encode(), tail[-2:].encode(), tail[-1:].encode()

    def __call__(self, word: bytes) -> int:
        if word == END:
            return self.end
        for end in self.endings(word):
            if (c := self.by_end.get(end)) is not None:
                return c
        return self.rest


def _contexts(core: dict[bytes, int], k: int):
    """Of each word outside the core, how often classes of the core stand before it (0 .. k) and after it (k + 1 ..)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of = np.fromiter(core.values(), np.int64, len(core))
        place: defaultdict[bytes, int] = defaultdict(None, zip(core, range(len(core))))
        place.default_factory = place.__len__  # words are numbered as they come, behind those of the core
        keys: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            number = key // (2 * k + 2)
            first = np.flatnonzero(np.diff(number, prepend=-1))
            entries = n * (2 * k + 2) + key % (2 * k + 2)  # number and class in one
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(entries))
            words = pa.array(list(place), pa.binary()).take(pa.array(number[first]))
            rows = pa.RecordBatch.from_arrays([words, pa.array(np.zeros(len(first), np.int64)), lists], ["word", "n", "beside"])
            yield from slices([rows], 10_000)
            place.clear()
            place.update(zip(core, range(len(core))))
            keys.clear()

        held = 0
        for batch in slices(batches, TEXTS):
            t, _ = _joined(batch)
            at = np.fromiter(map(place.__getitem__, t), np.int64, len(t))
            c = np.append(class_of, -1)[np.minimum(at, len(core))]
            rest = np.nonzero(c < 0)[0]  # never the first or the last: these are ends
            number = at[rest] * (2 * k + 2)
            before, after = c[rest - 1], c[rest + 1]
            keys.append(np.concatenate([(number + before)[before >= 0], (number + k + 1 + after)[after >= 0]]))
            held += len(keys[-1])
            if len(place) > FLUSH + len(core) or held > 8 * FLUSH:
                yield from out()
                held = 0
        if keys:
            yield from out()

    return run


def _assigner(core: dict[bytes, int], n: np.ndarray, rule: ClassRule):
    """word, n, class from rows in the order of their words: numbers to add up, and lists of the classes beside them."""
    k = len(n) - 1
    width = 2 * k + 2

    def out(words: list[bytes], numbers: np.ndarray, owner: np.ndarray, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        found = np.full(len(words), -1)
        last = np.searchsorted(owner, np.arange(len(words)), "right")  # where each word's entries end
        start = 0
        while start < len(key):
            # Whole words, of ENTRIES entries together or of one word's 2 k + 2 at most.
            end = int(last[max(np.searchsorted(last, start + ENTRIES, "right") - 1, owner[start])])
            which, local = np.unique(owner[start:end], return_inverse=True)
            part = key[start:end]
            found[which] = placed(n, local, part // (k + 1), part % (k + 1), count[start:end])
            start = end
        classes = [core[w] if w in core else int(c) if c >= 0 else rule(w) for w, c in zip(words, found)]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(numbers), pa.array(classes, pa.int32())], ["word", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last word of a batch may go on in the next: its sums so far, 2 k + 2 at most, wait.
        word, number, its_key, its_count = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, lists = word + batch.column("word").to_pylist(), batch.column("beside")
            flat = lists.flatten().to_numpy()
            new = np.fromiter((i == 0 or rows[i] != rows[i - 1] for i in range(len(rows))), bool, len(rows))
            of_row = np.cumsum(new) - 1
            numbers = np.add.reduceat(np.concatenate([number, batch.column("n").to_numpy()]), np.flatnonzero(new))
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            entry = np.repeat(of_row[len(word) :], length) * width + flat % width
            entry, at = np.unique(np.concatenate([its_key, entry]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([its_count, flat // width]), minlength=len(entry))
            words = [rows[i] for i in np.flatnonzero(new)]
            owner, key = entry // width, entry % width
            cut = int(np.searchsorted(owner, len(words) - 1))
            if len(words) > 1:
                yield out(words[:-1], numbers[:-1], owner[:cut], key[:cut], count[:cut])
            word, number, its_key, its_count = words[-1:], numbers[-1:], key[cut:], count[cut:]
        if word:
            yield out(word, number, np.zeros(len(its_key), np.int64), its_key, its_count)

    return run


class Model:
    """What is sent to every task: the listed words with counts and classes, the rule, and arrays of classes x classes."""

    def __init__(self, listed, classes, rule, n, v):
        self.listed, self.classes, self.rule, self.n, self.v = listed, classes, rule, n, v
        self.transitions = self.class_tokens = self.class_words = None

    def emission(self, c: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.log10((count + DELTA) / (self.class_tokens[c] + DELTA * (self.class_words[c] + 1)))

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.n + 0.5 * (self.v + 1)))


def most_frequent(words: DataFrame, most: int):
    """At most `most` rows of words, from the most frequent on, as columns of an Arrow table."""
    found = largest(words, "n", most).toArrow()
    order = sorted(range(found.num_rows), key=lambda i, n=found["n"].to_pylist(), w=found["word"].to_pylist(): (-n[i], w[i]))
    return found.take(pa.array(order, pa.int64()))


def clustered(rows: DataFrame, words: DataFrame, v: int) -> tuple[DataFrame, int]:
    """All words with their numbers and classes, word, n, class, and the number of classes without the end's."""
    k = class_count(v)
    first = most_frequent(words, CORE)
    weights = dict(zip(first["word"].to_pylist(), first["n"].to_pylist()))
    codes = {w: i for i, w in enumerate(weights)}
    # The end is clustered with the words, so that its neighbours count, and keeps a class of its own afterwards.
    end = codes.setdefault(END, len(codes))
    size = len(codes)
    pairs = rows.mapInArrow(_pairs(codes, size), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((size, size))
    counts.flat[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    of = exchange(counts, k)
    of[end] = k
    core = {w: int(of[i]) for w, i in codes.items()}
    hot = np.zeros((size, k + 1))
    hot[np.arange(size), of] = 1
    n = hot.T @ counts @ hot
    # Each task adds a word's classes up first. Rows then come in the order of their words, so that any number of them is added one by one.
    kind = "array<bigint>"
    beside = rows.mapInArrow(_contexts(core, k), f"word binary, n bigint, beside {kind}")
    both = beside.unionByName(words.select("word", "n", F.expr(f"cast(array() as {kind})").alias("beside")))
    listed = both.repartition("word").sortWithinPartitions("word")
    rule = ClassRule(core, weights, k)
    return written(listed.mapInArrow(_assigner(core, n, rule), "word binary, n bigint, class int"), "classes"), k


def learned(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model of training texts but for its transitions, and the table of all words: word, n, class."""
    counts = written(rows.mapInArrow(_counter, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    words, k = clustered(rows, counts, v)
    first = most_frequent(words, LISTED)
    listed = dict(zip(first["word"].to_pylist(), first["n"].to_pylist()))
    classes = first["class"].to_numpy().astype(np.int64)
    if END not in listed:  # it is always listed: texts begin and end in its class
        listed[END] = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        classes = np.append(classes, k)
    rule = ClassRule(dict(zip(listed, classes.tolist())), listed, k)
    model = Model(listed, classes, rule, int(n), int(v))
    of_class = words.groupBy("class").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).toPandas()
    model.class_words, model.class_tokens = np.zeros(k + 1), np.zeros(k + 1)
    model.class_words[of_class["class"].to_numpy(int)] = of_class["words"]
    model.class_tokens[of_class["class"].to_numpy(int)] = of_class["tokens"]
    return model, words


def _code(k: int) -> tuple[type, int]:
    """What holds a class in the sequences of texts, and the mark of a token whose class is not known yet."""
    kind = np.uint8 if k < 255 else np.uint16
    return kind, int(np.iinfo(kind).max)


def _binaries(codes: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Codes of texts one after the other, as one binary value for each text."""
    offsets = np.append(0, np.cumsum(sizes * codes.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])


def _reader(model: Model):
    """Per text, with a number r of its own: sums over listed words, the classes of tokens, and the list of tokens that have none yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = TaskContext.get().partitionId() << 33
        place = {w: i for i, w in enumerate(model.listed)}
        count = np.fromiter(model.listed.values(), np.float64, len(model.listed))
        # At place -1, which is the last: a token that is not listed.
        kind, mark = _code(model.rule.end)
        codes = np.append(model.classes, mark).astype(kind)
        base, emission = np.append(model.base(count), 0.0), np.append(model.emission(model.classes, count), 0.0)
        guess = model.rule.by_end.get
        for batch in slices(batches, TEXTS):
            if not batch.num_rows:
                continue
            t, starts = _joined(batch)
            del t[0]
            starts = np.array(starts, np.int64) - 1
            at = _looked_up(place, t, -1)
            rare = np.flatnonzero(at < 0)
            found = [t[i] for i in rare.tolist()]
            by_rule = [guess(w[-3:]) if w.isascii() else None for w in found]
            by_rule = [model.rule(w) if x is None else x for w, x in zip(found, by_rule)]
            offsets = np.searchsorted(rare, np.append(starts, len(at)))
            size = np.diff(starts, append=len(at))
            one = pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(by_rule, pa.int32())], ["word", "rule"])
            columns = {"doc_id": batch.column("doc_id"), "learns": batch.column("learns"), "r": pa.array(np.arange(r, r + len(starts)))}
            # Listed words are known, but for the end where there is no training text.
            columns |= {"n_tokens": pa.array(size), "n_known": pa.array((size - np.diff(offsets)) * (model.n > 0))}
            columns |= {"base_score": pa.array(np.add.reduceat(base[at], starts)), "emission": pa.array(np.add.reduceat(emission[at], starts))}
            columns |= {"classes": _binaries(codes[at], size), "rare": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), one)}
            r += len(starts)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _filled(model: Model):
    """Texts with the classes of all tokens, from rows in the order of r and pos: a text (pos -1), then its tokens that are not listed."""
    kind, mark = _code(model.rule.end)

    def whole(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        pos, of, c = (rows[x].to_numpy() for x in ("pos", "class", "c"))
        text, rare = np.flatnonzero(pos < 0), np.flatnonzero(pos >= 0)
        doc = rows["doc"].combine_chunks().take(pa.array(text))
        owner = np.searchsorted(text, rare) - 1
        add = lambda x: np.bincount(owner, weights=x, minlength=len(text))
        codes = np.frombuffer(b"".join(doc.field("classes").to_pylist()), kind).copy()
        codes[codes == mark] = of[rare]
        size = doc.field("n_tokens").to_numpy()
        columns = {"doc_id": doc.field("doc_id"), "learns": doc.field("learns"), "n_tokens": doc.field("n_tokens")}
        columns |= {"n_known": pa.array(doc.field("n_known").to_numpy() + add(c[rare] > 0).astype(np.int64))}
        columns |= {"base_score": pa.array(doc.field("base_score").to_numpy() + add(model.base(c[rare])))}
        columns |= {"emission": pa.array(doc.field("emission").to_numpy() + add(model.emission(of[rare], c[rare])))}
        return pa.RecordBatch.from_pydict(columns | {"classes": _binaries(codes, size)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []  # the last text of a batch may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            heads = np.flatnonzero(batch.column("pos").to_numpy() < 0)
            if not len(heads):
                wait.append(batch)
                continue
            cut = int(heads[-1])
            if wait or cut:
                yield whole(pa.Table.from_batches([*wait, batch.slice(0, cut)]))
            wait = [batch.slice(cut)]
        if wait:
            yield whole(pa.Table.from_batches(wait))

    return run


def classified(rows: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """doc_id, learns, n_tokens, n_known, base_score, emission (its sum over the text) and classes (of all tokens, in order) of rows of doc_id, learns and text.

    Each text is split and looked up once; tokens that are not listed are joined to the table of words once."""
    own = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, learns boolean"
    sums = "n_tokens bigint, n_known bigint, base_score double, emission double, classes binary"
    texts = written(rows.select("doc_id", "learns", "text").mapInArrow(_reader(model), f"{own}, r bigint, {sums}, rare array<struct<word:binary,rule:int>>"), "text-sums")
    doc = F.struct("doc_id", "learns", *(x.split()[0] for x in sums.split(", ")))
    rare = texts.select("r", F.posexplode("rare").alias("pos", "o")).select("r", "pos", "o.*")
    joined = rare.hint("merge").join(words.select("word", F.col("n").alias("c"), "class"), "word", "left")
    found = joined.select("r", "pos", F.coalesce("class", "rule").alias("class"), F.coalesce("c", F.lit(0)).alias("c"))
    heads = texts.select("r", F.lit(-1).alias("pos"), F.lit(-1).alias("class"), F.lit(0).cast("bigint").alias("c"), doc.alias("doc"))
    both = heads.unionByName(found, allowMissingColumns=True).repartition("r").sortWithinPartitions("r", "pos")
    return written(both.mapInArrow(_filled(model), f"{own}, {sums}"), "text-classes")


def _steps(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The bigrams of classes of all texts of a batch, each as before * (k + 1) + after, and the place where each text begins."""
    # A text follows the end of the one before, and the first an end.
    c = np.append(k, np.frombuffer(b"".join(batch.column("classes").to_pylist()), _code(k)[0]))
    size = batch.column("n_tokens").to_numpy()
    return c[:-1] * (k + 1) + c[1:], np.cumsum(size) - size


def _bigrams(k: int):
    """Sums of the bigrams of classes: before, after, n."""
    size = k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in slices(batches, TEXTS):
            total += np.bincount(_steps(batch, k)[0], minlength=size * size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at // size, pa.int32()), pa.array(at % size, pa.int32()), pa.array(total[at])], ["before", "after", "n"])

    return run


def joined_up(model: Model, texts: DataFrame) -> Model:
    """The model with the transitions of classified training texts."""
    k = model.rule.end
    rows = texts.select("n_tokens", "classes").mapInArrow(_bigrams(k), "before int, after int, n bigint")
    pairs = rows.groupBy("before", "after").agg(F.sum("n").alias("n")).toArrow()
    c = np.zeros((k + 1, k + 1))
    c[pairs["before"].to_numpy(), pairs["after"].to_numpy()] = pairs["n"].to_numpy()
    share = (model.class_tokens + 0.5) / (model.class_tokens.sum() + 0.5 * (k + 1))
    model.transitions = np.log10((c + BACK * share[None, :]) / (c.sum(1, keepdims=True) + BACK))
    return model


def _scorer(transitions: np.ndarray):
    """Per text: its sums, and the score from the classes of its tokens."""
    k, flat = len(transitions) - 1, transitions.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TEXTS):
            if not batch.num_rows:
                continue
            steps, starts = _steps(batch, k)
            columns = {x: batch.column(x) for x in ("doc_id", "n_tokens", "n_known", "base_score")}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(batch.column("emission").to_numpy() + np.add.reduceat(flat[steps], starts))})

    return run


def summed(texts: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of classified texts."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.drop("learns").mapInArrow(_scorer(model.transitions), f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")


def fit(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of all words: word, n, class."""
    model, words = learned(training.select("text"))
    rows = training.select(F.lit(0).alias("doc_id"), F.lit(True).alias("learns"), "text")
    return joined_up(model, classified(rows, model, words)), words


def score(docs: DataFrame, model: Model, words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of whole texts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.lit(False).alias("learns"), F.col(text).alias("text"))
    return summed(classified(rows, model, words), model)


def fit_and_score(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What `score` returns for all docs by the model that `fit` has of those where `training` holds. Texts are classified once for both."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("learns"), F.col(text).alias("text"))
    model, words = learned(rows.where("learns").select("text"))
    texts = classified(rows, model, words)
    return summed(texts, joined_up(model, texts.where("learns")))


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out(F.col("doc_id"), 5)
    return fit_and_score(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
