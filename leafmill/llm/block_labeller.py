"""Main text of web pages by a recurrent block labeller.

A page is cut into its leaves: runs of text between block-level tags, in page order. Each
leaf has a vector of its tag path (names, classes, ids and roles of its open elements, hashed,
and the cue groups among them), of its words (hashed), and of its shape (length, links, digits,
place). A bidirectional LSTM in numpy reads the whole sequence of a page and labels every leaf.

It is trained at run time on stretches of 64 leaves of a sample of whole pages (`SAMPLE_PAGES`, `STRETCHES`): their own
leaves, labelled by the cues of their paths, and pages composed from their texts with many
kinds of wrappers, with and without cues, whose labels are known by construction. Scripts, styles,
controls and hidden elements are dropped by the parser, before the labels, and so are forms, but for a form that holds
an article or main element or most of the page's text: that is a wrapper, and no form to the reader.

Defined results: null, empty and text-free pages give an empty text; broken markup is read as
far as it goes (unclosed elements end with their parent, a head at the first element that cannot be in it and a control where
a block begins, stray end tags are ignored, an unclosed comment ends the page, quotes that are never closed are no quotes; time is in proportion to the length); character references are decoded once; repeated rows are read each; an empty table gives no rows (nothing
is trained on it then but the composed pages of a fixed word list); other columns are ignored; nothing is cut off.
"""

from __future__ import annotations

import html as _html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import sampled, table, written

SAMPLE_PAGES, STRETCHES, COMPOSED_PAGES, SEED = 400, 400, 700, 11
PATH_SIZE, WORD_SIZE, HIDDEN, EPOCHS = 64, 24, 20, 14

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup, and those that hold no text of the page.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("script style textarea title noscript template iframe object svg math canvas audio video head button select option datalist dialog".split())
#: What ends where a block begins, and what a head may hold.
CONTROLS = frozenset("button select option datalist".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: A paragraph ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar banner logo branding",
    "footer": "footer foot copyright legal colophon imprint",
    "side": "aside sidebar side rail widget related recommended recommendations more trending popular also links complementary",
    "notice": "cookie cookies consent notice gdpr popup modal overlay alert notification paywall toast disclaimer message",
    "advert": "ad ads advert adverts advertisement sponsored sponsor promo promotion banner adsense teaser",
    "form": "form search subscribe newsletter signup login register subscription",
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback reviews",
    "share": "share sharing social follow author-bio tags tag byline meta rating",
    "main": "article main content post entry story text maincontent articlebody prose",
}
GROUP = {word: i for i, words in enumerate(CUES.values()) for word in words.split()}
MAIN = len(CUES) - 1
SHAPE = 10
SIZE = PATH_SIZE + len(CUES) + WORD_SIZE + SHAPE

NAMED = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag: a value in quotes stands behind an equals sign.
REST = re.compile(r"(?:[^>=]|=(?!\s*[\"'])|=\s*+\"[^\"]*+\"|=\s*+'[^']*+')*+>")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
CLOSING = {name: re.compile(f"</{name}", re.I) for name in RAW}
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Buckets(dict):
    def __init__(self, size: int):
        super().__init__()
        self.n = size

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        b = self[word] = zlib.crc32(word.encode("utf-8", "replace")) % self.n
        return b


_PATH, _WORD = _Buckets(PATH_SIZE), _Buckets(WORD_SIZE)


class _Open:
    """An open element: its name, whether its text is dropped, its innermost block and outermost form, and its share of the path's vector, parents included."""

    __slots__ = ("block", "dropped", "form", "link", "name", "path")

    def __init__(self, name: str, attributes: str, parent: _Open | None):
        self.name = name
        self.dropped = (parent is not None and parent.dropped) or name in DROPPED
        self.link = (parent is not None and parent.link) or name == "a"
        self.form = parent.form if parent else None
        self.block = parent.block if parent and name in INLINE else self
        self.path = parent.path if parent else np.zeros(PATH_SIZE + len(CUES), np.float32)
        if name == "form" and self.form is None:
            self.form = _Form()
        elif self.form is not None and name in ("article", "main"):
            self.form.wraps = True
        if name in INLINE and attributes and "hid" not in attributes and "none" not in attributes:
            return
        words = [name]
        for m in ATTRIBUTE.finditer(attributes) if attributes else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "style":
                self.dropped |= bool(HIDING.search(value))
            elif key in ("hidden", "aria-hidden"):
                self.dropped |= value.lower() != "false" if key == "hidden" else value.lower() == "true"
            else:
                words += [w.lower() for w in NAME.findall(value)]
        if name in INLINE or name == "form":  # a form that wraps the page says nothing of what it holds
            return
        bits = [_PATH[w] for w in words] + [PATH_SIZE + GROUP[w] for w in words if w in GROUP and w != "body"]  # every page has a body
        if not all(self.path[i] for i in bits):  # else it is the parent's, as in deep nesting
            self.path = self.path.copy()
            self.path[bits] = 1


class _Form:
    """A form, and whether it is a wrapper of the page."""

    __slots__ = ("size", "wraps")

    def __init__(self):
        self.size, self.wraps = 0, False


def leaves(page: str | None) -> list[tuple[str, np.ndarray, float, str]]:
    """(text, path vector, share of the text in links, name of the innermost block) for each leaf of the page."""
    page = page or ""
    out: list = []
    root = _Open("", "", None)
    stack, count = [root], Counter()  # open elements, and how many of each name
    parts: list[str] = []
    linked = total = 0
    leaf = root
    quotes = True

    def close() -> None:
        nonlocal linked, total
        if parts:
            raw = "".join(parts)
            text = " ".join((_html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append((text, leaf.path, min(1.0, linked / max(1, len(raw))), leaf.name, leaf.form))
                total += len(text)
                if leaf.form is not None:
                    leaf.form.size += len(text)
            parts.clear()
        linked = 0

    def end(name: str) -> None:
        """Close the innermost element of the name, which is open, and what is open inside it."""
        block = False
        while True:
            x = stack.pop()
            count[x.name] -= 1
            if x.name not in INLINE and not block:
                block = True
                close()
            if x.name == name:
                return

    at, size = 0, len(page)
    while at < size:
        until = page.find("<", at)
        until = size if until < 0 else until
        tag = None
        if until < size:
            if page.startswith("<!--", until):
                stop = page.find("-->", until + 4)
                after = size if stop < 0 else stop + 3
            elif page.startswith(("<!", "<?"), until):
                stop = page.find(">", until)
                after = size if stop < 0 else stop + 1
            elif tag := NAMED.match(page, until + 1):
                rest = REST.match(page, tag.end()) if quotes else None
                stop = rest.end() - 1 if rest else page.find(">", tag.end())
                quotes &= rest is not None  # a quote that is never closed: from here on, tags end at the next bracket
                if stop < 0:  # no tag ends any more
                    until, after, tag = until, size, None
                else:
                    after = stop + 1
            else:  # a bracket by itself
                until, after = until + 1, until + 1
        else:
            after = size
        if until > at and not stack[-1].dropped:
            if not parts:
                leaf = stack[-1].block
            parts.append(page[at:until])
            if stack[-1].link:
                linked += until - at
        at = after
        if not tag:
            continue
        name, attributes = tag[2].lower(), page[tag.end() : after - 1]
        if name not in INLINE:
            close()
        if tag[1]:
            if count[name]:
                end(name)
            continue
        if count["head"] and name not in IN_HEAD:
            end("head")
        if name in VOID:
            continue
        if name in ENDS_P:
            for control in CONTROLS:
                if count[control] and name != "div":
                    end(control)
            if count["p"]:
                end("p")
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].name == name:
            end(name)
        if attributes.endswith("/") and name not in RAW and name not in INLINE:
            continue
        if name in RAW:
            closing = CLOSING[name].search(page, at)
            stop = page.find(">", closing.end()) if closing else -1
            at = size if stop < 0 else stop + 1
            continue
        stack.append(_Open(name, attributes, stack[-1]))
        count[name] += 1
    close()
    return [x[:4] for x in out if x[4] is None or x[4].wraps or 2 * x[4].size > total]


def vectors(found: list) -> np.ndarray:
    x = np.zeros((len(found), SIZE), np.float32)
    n = PATH_SIZE + len(CUES)
    for i, (text, path, linked, name) in enumerate(found):
        words = text.split(" ")
        x[i, :n] = path
        # Words seldom tell a label; their hashes are scaled down to a mean.
        x[i, n : n + WORD_SIZE] = np.bincount(np.fromiter(map(_WORD.__getitem__, words), np.int64, len(words)), minlength=WORD_SIZE) / len(words)
        stops = text.count(". ") + text.count(".") + text.count("!") + text.count("?")
        x[i, n + WORD_SIZE :] = (
            np.log1p(len(words)) / 5, linked, stops / (len(words) + 1), text[-1:] in ".!?\"”", name in ("h1", "h2", "h3", "h4"),
            name in ("li", "td", "th", "dt", "dd"), name == "p", i / len(found), i == 0, "©" in text or "·" in text or "|" in text,
        )
    return x


class Labeller:
    """A bidirectional LSTM with one logistic output per step; gates in the order input, forget, output, cell."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 1 / np.sqrt(SIZE), (SIZE, 4 * HIDDEN)).astype(np.float32)
            self.w[f"h{d}"] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.w[f"b{d}"] = bias
        self.w["o"] = r.normal(0, 0.3, (2 * HIDDEN, 1)).astype(np.float32)
        self.w["s"] = np.zeros((SIZE, 1), np.float32)
        self.w["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """x: steps x pages x SIZE, already in the direction's order."""
        t, n, _ = x.shape
        a = (x.reshape(t * n, SIZE) @ self.w[f"x{d}"] + self.w[f"b{d}"]).reshape(t, n, 4 * HIDDEN)
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out = np.empty((t, n, HIDDEN), np.float32)
        for k in range(t):
            z = a[k] + h @ self.w[f"h{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            m = mask[k][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep is not None:
                keep.append((h, c, i, f, o, g, tc, m))
            c = np.where(m, new, c)
            h = np.where(m, o * tc, h)
            out[k] = h
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: tuple | None = None) -> np.ndarray:
        f = self._run(x, mask, "f", keep[0] if keep else None)
        b = self._run(x[::-1], mask[::-1], "b", keep[1] if keep else None)[::-1]
        both = np.concatenate([f, b], axis=2)
        if keep:
            keep[2].append(both)
        return (both @ self.w["o"] + x @ self.w["s"])[:, :, 0] + self.w["c"]

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict:
        """Gradients of the mean logistic loss over the leaves."""
        keep: tuple = ([], [], [])
        p = 1 / (1 + np.exp(-self.logits(x, mask, keep)))
        d = (np.where(mask, p - y, 0) / mask.sum()).astype(np.float32)
        both = keep[2][0]
        g = {"o": (both * d[:, :, None]).sum((0, 1))[:, None], "s": (x * d[:, :, None]).sum((0, 1))[:, None], "c": np.array([d.sum()], np.float32)}
        dh = d[:, :, None] * self.w["o"][:, 0]
        for k, (way, part, xs) in enumerate((("f", dh[:, :, :HIDDEN], x), ("b", dh[::-1, :, HIDDEN:], x[::-1]))):
            g[f"h{way}"] = np.zeros_like(self.w[f"h{way}"])
            n = x.shape[1]
            nh, nc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            da = np.empty((len(x), n, 4 * HIDDEN), np.float32)
            for t in range(len(x) - 1, -1, -1):
                h, c, i, f, o, gg, tc, m = keep[k][t]
                total = part[t] + nh
                dhm = np.where(m, total, 0)
                dc = np.where(m, nc, 0) + dhm * o * (1 - tc * tc)
                da[t] = np.concatenate([dc * gg * i * (1 - i), dc * c * f * (1 - f), dhm * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                g[f"h{way}"] += h.T @ da[t]
                nh = da[t] @ self.w[f"h{way}"].T + np.where(m, 0, total)
                nc = np.where(m, dc * f, nc)
            g[f"x{way}"] = xs.reshape(-1, SIZE).T @ da.reshape(-1, 4 * HIDDEN)
            g[f"b{way}"] = da.sum((0, 1))
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = SEED) -> None:
        """Adam over batches of pages; long pages are trained on in stretches of 64 leaves, and labelled whole."""
        r = np.random.default_rng(seed)
        cut = [(x[i : i + 64], y[i : i + 64]) for x, y in pages for i in range(0, len(x), 64)]
        m, v, t = {k: 0 * w for k, w in self.w.items()}, {k: 0 * w for k, w in self.w.items()}, 0
        for epoch in range(epochs):
            step = rate * (1 - epoch / epochs) + rate / 20
            order = r.permutation(len(cut))
            for start in range(0, len(cut), batch):
                some = [cut[i] for i in order[start : start + batch]]
                x, mask = padded([s[0] for s in some])
                y = np.zeros(mask.shape, np.float32)
                for i, s in enumerate(some):
                    y[: len(s[1]), i] = s[1]
                t += 1
                for k, g in self.step(x, y, mask).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - np.float32(step) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def label(self, xs: list[np.ndarray], together: int = 64) -> list[np.ndarray]:
        """Whether each leaf is main text. Pages of similar length are read together; a very long page alone."""
        out: list = [np.zeros(0, bool)] * len(xs)
        order = sorted((i for i in range(len(xs)) if len(xs[i])), key=lambda i: len(xs[i]))
        start = 0
        while start < len(order):
            n = max(1, min(together, 200_000 // len(xs[order[min(start + together, len(order)) - 1]])))
            some = order[start : start + n]
            start += n
            x, mask = padded([xs[i] for i in some])
            z = self.logits(x, mask)
            for k, i in enumerate(some):
                out[i] = z[: len(xs[i]), k] > 0
        return out


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, xs))
    x, mask = np.zeros((t, len(xs), SIZE), np.float32), np.zeros((t, len(xs)), bool)
    for i, one in enumerate(xs):
        x[: len(one), i] = one
        mask[: len(one), i] = True
    return x, mask


def by_cues(found: list) -> np.ndarray:
    """Labels of a page's leaves from the cues of their paths alone: inside a main part and outside all others."""
    paths = np.array([f[1][PATH_SIZE:] for f in found]) if found else np.zeros((0, len(CUES)))
    return ((paths[:, MAIN] > 0) & (paths[:, :MAIN].sum(1) == 0)).astype(np.float32)


def composed(texts: list[str], r: np.random.Generator) -> list[tuple[str, bool]]:
    """Markup pieces of a made-up page and whether their text is main text; a piece may have several leaves."""
    pick = lambda a: a[int(r.integers(len(a)))]

    def words(lo: int, hi: int) -> str:
        w = pick(texts).split()
        k = int(r.integers(lo, hi + 1))
        at = int(r.integers(max(1, len(w) - k)))
        some = w[at : at + k] or ["word"]
        if r.random() < 0.5:  # sentences of some length
            every = int(r.integers(2, 15))
            some = [x + "." if i % every == every - 1 else x for i, x in enumerate(some)]
        return " ".join(some) + pick(["", ".", "", "!"])

    def box(cue: str, inner: str) -> str:
        kind, name = pick(["div", "section", "div", "ul" if cue == "menu" else "div"]), pick(CUES[cue].split())
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside"}.get(cue)
        if tag and r.random() < 0.4:
            return f"<{tag}>{inner}</{tag}>"
        attribute = pick(["class", "id", "class"])
        return f'<{kind} {attribute}="{pick(["", "site-", "page-", "x-"])}{name}{pick(["", "-box", " wrap", "-list"])}">{inner}</{kind}>'

    def rest(cue: str) -> str:
        if cue in ("menu", "share"):
            return box(cue, "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(int(r.integers(2, 8)))))
        if cue == "comment":
            tag = pick(["p", "div", "li"])
            return box(cue, "".join(f"<{tag}>{words(3, 60)}</{tag}>" for _ in range(int(r.integers(1, 6)))))
        if cue == "side":
            return box(cue, f"<h3>{words(1, 4)}</h3>" + "".join(f'<p><a href="/y">{words(3, 9)}</a> {words(0, 12)}</p>' for _ in range(int(r.integers(1, 5)))))
        return box(cue, f"<p>{words(2, 18)}</p>" if r.random() < 0.6 else words(2, 22))

    paragraph = lambda: f"<p>{pick(['', '<b>'])}{words(1, 6) if r.random() < 0.2 else words(15, 160)}{pick(['.', '.', ''])}{pick(['</b>', ''])}</p>"
    if r.random() < 0.06:  # nothing but text
        return [(paragraph(), True) for _ in range(int(r.integers(1, 5)))]
    out = [(rest(pick(["menu", "header", "notice", "advert", "share"])), False) for _ in range(int(r.integers(1, 4)))]
    inside: list[tuple[str, bool]] = [(f"<h1>{words(3, 12)}</h1>", True)] if r.random() < 0.7 else []
    for _ in range(int(r.integers(1, 14))):
        tag = pick(["blockquote", "h2", "li", "pre", "div"])
        inside.append((paragraph() if r.random() < 0.85 else f"<{tag}>{words(2, 40)}</{tag}>", True))
        if r.random() < 0.08:
            inside.append((rest(pick(["advert", "side", "share", "notice"])), False))
    if r.random() < 0.25:
        inside.append((rest("comment"), False))
    how = r.random()
    if how < 0.35:
        opening, closing = "<article>", "</article>"
    elif how < 0.5:
        opening, closing = "<main>", "</main>"
    elif how < 0.85:
        opening, closing = f'<div {pick(["class", "id"])}="{pick(CUES["main"].split())}{pick(["", "-wrap", " left"])}">', "</div>"
    else:
        opening, closing = "<div>", "</div>"
    out.append((opening, True))
    out += inside
    out.append((closing, True))
    out += [(rest(pick(["footer", "comment", "side", "menu", "notice", "advert", "comment", "footer", "share"])), False) for _ in range(int(r.integers(1, 4)))]
    return out


MARK = "\u2060"


def composed_example(texts: list[str], r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and labels of a made-up page. Main text is marked with word joiners, which are taken out again."""
    pieces = composed(texts, r)
    page = "".join(re.sub(r"(>|^)([^<]+)", rf"\1{MARK}\2", p) if good else p for p, good in pieces)
    found = leaves("<html><body>" + page + "</body></html>")
    y = np.array([MARK in f[0] for f in found], np.float32)
    return vectors([(f[0].replace(MARK, "") or "x", *f[1:]) for f in found]), y


WORDS = "the of and to in a is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def train(real: list[tuple[np.ndarray, np.ndarray]], texts: list[str]) -> Labeller:
    """real: stretches of leaves and their labels; texts: words to compose pages from."""
    r = np.random.default_rng(SEED)
    texts = [*texts, *(" ".join(r.choice(WORDS, 200)) for _ in range(20))]
    model = Labeller()
    model.fit(real + [composed_example(texts, r) for _ in range(COMPOSED_PAGES)])
    return model


def _lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of whole pages: vectors, labels, and up to 200 words of the longest leaf. Pages without a main part by their cues teach nothing."""
    for batch in batches:
        for page in batch.column(0).to_pylist():
            found = leaves(page)
            y = by_cues(found)
            if not y.any():
                continue
            x = vectors(found)
            at = range(0, len(found), 64)
            longest = [max((f[0] for f in found[i : i + 64]), key=len) for i in at]
            yield pa.RecordBatch.from_pydict({
                "x": pa.array([x[i : i + 64].tobytes() for i in at], pa.binary()), "y": pa.array([y[i : i + 64].tobytes() for i in at], pa.binary()),
                "t": pa.array([" ".join(t.split(" ")[:200]) for t in longest], pa.string()),
            })


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE_PAGES, stretches: int = STRETCHES) -> Labeller:
    """Train on whole pages, some `sample` of them by hash, and at most `stretches` stretches of these."""
    key = F.xxhash64(*[F.col(f"`{f.name}`") for f in pages.schema if "map<" not in f.dataType.simpleString()])
    every = max(1, pages.count() // sample)
    some = pages.where(F.col(html).isNotNull() & (F.pmod(key, F.lit(every)) == 0)).select(F.col(html).alias("h"))
    lessons = sampled(written(some.mapInArrow(_lessons, "x binary, y binary, t string"), "lessons"), F.col("x"), stretches).collect()
    real = [(np.frombuffer(r["x"], np.float32).reshape(-1, SIZE), np.frombuffer(r["y"], np.float32)) for r in lessons]
    return train(real, [r["t"] for r in lessons if len(r["t"]) > 60])


def _extractor(model: Labeller, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [leaves(h) for h in part.column("html").to_pylist()]
                good = model.label([vectors(f) for f in found])
                texts = [" ".join(leaf[0] for leaf, y in zip(f, g) if y) for f, g in zip(found, good)]
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {"text": pa.array(texts, pa.string()), "n_leaves": pa.array([len(f) for f in found], pa.int64())})

    return run


def extract(pages: DataFrame, model: Labeller, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_leaves."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extractor(model, ["page_id", "url"]), f"page_id {kind}, url string, text string, n_leaves bigint")


def op7_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract(pages, fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_leaves")
