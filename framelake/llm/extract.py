"""Main text of web pages: a bidirectional LSTM labels every block of a page, given its tag path and words, in page context."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import table

#: Pages that the labeller is trained on at most, by the hash of their id, and the longest of them; both bound the driver.
TRAIN_PAGES = 300
TRAIN_CHARS = 60_000
EPOCHS = 8
#: Sizes of the hashed tag-path and word vectors, of the other features, and of the state per direction.
PATH, WORDS, OTHER, HIDDEN = 96, 24, 8, 16
#: Blocks that are labelled in one array at most (a longer page is labelled by itself).
CHUNK_BLOCKS = 4096

# Fixed values of HTML: elements without an end tag, whose content is no markup, that don't break a line of text, and
# which an element of the same kind ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
SELF_ENDING = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}
#: What ends an open paragraph besides the next one.
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>?", re.S)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: float
    label: int = 0


@dataclass
class _Open:
    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    anchors: int = 0

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            self.linked += len(raw) * bool(self.anchors)

    def flush(self) -> None:
        if self.parts:
            whole = "".join(self.parts)
            clean = _SPACE.sub(" ", html.unescape(whole)).strip()
            if clean:
                near = self.stack if len(self.stack) <= 32 else self.stack[:8] + self.stack[-24:]
                path = tuple(x for name, names in near for x in (name, *names))
                self.blocks.append(Block(clean, path, min(1.0, self.linked / max(1, len(whole)))))
        self.parts, self.linked = [], 0

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == name:
                self.anchors -= sum(n == "a" for n, _ in self.stack[i:])
                del self.stack[i:]
                return


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order, each with the names (tags, then their class and id words) above it.

    Character references are decoded and white space is made one space. Scripts, styles and other elements whose content
    is no text of the page give no blocks. Missing and stray end tags are tolerated.
    """
    page, at, state = page or "", 0, _Open()
    while at < len(page):
        found = page.find("<", at)
        match = _TAG.match(page, found) if found >= 0 else None
        if match is None:
            end = len(page) if found < 0 else found + 1
            state.text(page[at:end])
            at = end
            continue
        state.text(page[at:found])
        at = match.end()
        if not match[2]:
            continue
        name = match[2].lower()
        if not match[0].endswith(">"):  # a quote without its end: the tag goes to the next bracket
            close = page.find(">", found)
            at = len(page) if close < 0 else close + 1
        if name not in INLINE:
            state.flush()
        elif name == "br":
            state.text(" ")
        if match[1]:
            if name not in INLINE or name == "a":
                state.close(name)
            continue
        if name in RAW:
            done = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            at = done.end() if done else len(page)
            continue
        if name in VOID or match[3].rstrip().endswith("/") or (name in INLINE and name != "a"):
            continue
        state.anchors += name == "a"
        if name in SELF_ENDING and any(n == name for n, _ in state.stack):
            below = max((i for i, (n, _) in enumerate(state.stack) if n in ("ul", "ol", "dl", "table", "select")), default=-1)
            if any(n == name for n, _ in state.stack[below + 1 :]):
                state.close(name)
        elif name in ENDS_P and state.stack and state.stack[-1][0] == "p":
            state.close("p")
        names = tuple(w for m in _NAME.finditer(match[3]) for w in _PART.findall((m[1] or m[2] or m[3] or "").lower()))
        state.stack.append((name, tuple("." + n for n in names)))
    state.flush()
    return state.blocks


# ---- what the labeller learns from ---------------------------------------------------------------------------

#: Names by which authors mark what is not the article (weak supervision: they label the training blocks).
ASIDE_TAGS = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "figcaption"}
ASIDE_NAMES = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "form", "header",
    "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "recommended", "related", "share", "sharing", "sidebar", "signup", "social", "sponsor",
    "sponsored", "subscribe", "toolbar", "widget",
}
MAIN = {"article", "main"}
MAIN_NAMES = {"article", "content", "entry", "main", "post", "story"}


def weak_label(path: tuple[str, ...], has_main: bool) -> int:
    """1 for the article as its markup says, else 0."""
    tags, names = [p for p in path if p[0] != "."], {p[1:] for p in path if p[0] == "."}
    if ASIDE_TAGS & set(tags) or ASIDE_NAMES & names or ("header" in tags and not MAIN & set(tags)):
        return 0
    return int(bool(MAIN & set(tags) or MAIN_NAMES & names) or not has_main)


def _varied(pages: list[list[Block]], rng: np.random.Generator) -> list[list[Block]]:
    """Each page as it is, and once more in another frame, so that more markup is known than the sample uses.

    Texts of the added blocks come from the sample, so that words tell nothing about the frame.
    """
    texts = [b.text for page in pages for b in page if len(b.text) < 400] or ["x"]
    frames = [("article",), ("main",), ("div", ".content"), ("div", ".article", ".body"), ("div", ".post"), ("section", ".story"), ("div", ".entry", ".content"), ("main", "article"), ("div", ".main"), (), (), ("div",), ("div", ".container", "div", ".row", "article")]
    around = [("nav", "ul", "li"), ("header",), ("header", "h1"), ("footer",), ("footer", "p"), ("aside",), ("aside", "p"), ("form", "label"), ("form", "p"), ("form",)]
    around += [("div", "." + n) for n in sorted(ASIDE_NAMES)] + [("div", "." + n, "p") for n in sorted(ASIDE_NAMES)] + [("section", ".comments", "div", ".comment", "p"), ("ul", ".menu", "li"), ("ul", ".comments", "li")]
    out = []
    for page in pages:
        out.append(page)
        frame = frames[rng.integers(len(frames))]
        outer = ("html", "body") if rng.random() < 0.9 else ()
        kept = ("p", "h1", "h2", "h3", "li", "ul", "b", "blockquote")
        link = lambda b: b.linked if rng.random() < 0.6 else float(rng.random() * 0.6)
        body = [Block(b.text, (*outer, *frame, *(x for x in b.path if x in kept)), link(b), 1) for b in page if b.label]

        def extra(n: int, frame=frame, outer=outer) -> list[Block]:
            made = []
            for _ in range(n):
                names = around[rng.integers(len(around))]
                inside = rng.random() < 0.2 and names[0] not in ("header", "nav", "footer")
                path = (*outer, *(frame if inside else ()), *names)
                made += [Block(texts[rng.integers(len(texts))], path, float(rng.random() < 0.4), 0) for _ in range(rng.integers(1, 4))]
            return made

        cut = int(rng.integers(0, len(body) + 1))
        out.append(extra(rng.integers(0, 4)) + body[:cut] + extra(rng.integers(0, 2)) + body[cut:] + extra(rng.integers(0, 4)))
    return [p for p in out if p]


# ---- features and the network --------------------------------------------------------------------------------


class _Slots(dict):
    """Slot and sign of a name in a hashed vector."""

    def __init__(self, size: int) -> None:
        self.size = size

    def __missing__(self, name: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[name] = got = zlib.crc32(name.encode("utf-8", "replace")) % self.size
        return got


class Features:
    def __init__(self) -> None:
        self.path, self.word = _Slots(PATH), _Slots(WORDS)
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def _path(self, path: tuple[str, ...]) -> np.ndarray:
        got = self.paths.get(path)
        if got is None:
            got = np.zeros(PATH, np.float32)
            np.add.at(got, [self.path[x] for x in path], 1)
            got = np.minimum(got, 2)
            if len(self.paths) < 100_000:
                self.paths[path] = got
        return got

    def of(self, blocks: list[Block]) -> np.ndarray:
        """(blocks, PATH + WORDS + OTHER)."""
        x = np.zeros((len(blocks), PATH + WORDS + OTHER), np.float32)
        for i, b in enumerate(blocks):
            x[i, :PATH] = self._path(b.path)
            words = _WORD.findall(b.text)
            if words:
                x[i, PATH : PATH + WORDS] = np.bincount([self.word[w] for w in words], minlength=WORDS) / np.float32(len(words))
            ends = b.text.count(".") + b.text.count("!") + b.text.count("?") + b.text.count(",")
            x[i, PATH + WORDS :] = (
                np.log1p(len(b.text)) / 8, np.log1p(len(words)) / 6, b.linked, min(ends / (len(words) + 1), 1), i == 0, i == len(blocks) - 1,
                i / len(blocks), b.text[-1:] in ".!?",
            )
        return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Two LSTM layers over the blocks of a page, one from either end, and a logistic unit on both states of a block."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(rng: np.random.Generator) -> Labeller:
        n = PATH + WORDS + OTHER
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 0.15, (n, 4 * HIDDEN)).astype(np.float32)
            w["h" + d] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w["c" + d] = np.repeat(np.array([0, 1, 0, 0], np.float32), HIDDEN)
        w["o"], w["k"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32), np.zeros(1, np.float32)
        return Labeller(w)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States (steps, pages, HIDDEN) and what the backward pass needs. x: (steps, pages, features)."""
        w, h = self.weights, np.zeros((x.shape[1], HIDDEN), np.float32)
        c, states, kept = h.copy(), np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        inputs = x @ w["x" + d] + w["c" + d]
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = inputs[t] + h @ w["h" + d]
            i, f, o = np.split(_sigmoid(z[:, : 3 * HIDDEN]), 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = np.where(m, f * c + i * g, c)
            th = np.tanh(c2)
            h2 = np.where(m, o * th, h)
            kept.append((t, i, f, o, g, c, th, h, m))
            h, c = h2, c2
            states[t] = h
        return states, kept

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d)[0] for d in "fb"], axis=2)
        return _sigmoid(both @ self.weights["o"] + self.weights["k"])

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, runs = self.weights, {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        e = (_sigmoid(both @ w["o"] + w["k"]) - y) * mask / max(1, mask.sum())
        out = {"o": np.einsum("tn,tnh->h", e, both), "k": e.sum(keepdims=True).reshape(1)}
        for n, d in enumerate("fb"):
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dwh = np.zeros_like(w["h" + d])
            for t, i, f, o, g, c, th, h, m in reversed(runs[d][1]):
                dh = dh + e[t][:, None] * w["o"][n * HIDDEN : (n + 1) * HIDDEN]
                dcell = dc + np.where(m, dh * o * (1 - th**2), 0)
                dz = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f), dh * th * o * (1 - o), dcell * i * (1 - g**2)], axis=1) * m
                dz_all[t] = dz
                dwh += h.T @ dz
                dh = np.where(m, dz @ w["h" + d].T, dh)
                dc = np.where(m, dcell * f, dc)
            out["x" + d], out["h" + d], out["c" + d] = np.einsum("tnf,tnz->fz", x, dz_all), dwh, dz_all.sum(axis=(0, 1))
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32), np.zeros((steps, len(pages)), bool)
    for n, p in enumerate(pages):
        x[: len(p), n], mask[: len(p), n] = p, True
    return x, mask


def train(pages: list[str | None], epochs: int = EPOCHS, seed: int = 3) -> Labeller | None:
    """A labeller fitted on ``pages``, whose blocks are labelled by their own markup; None without any block."""
    rng = np.random.default_rng(seed)
    parsed = [b for b in map(blocks_of, pages) if b]
    for blocks in parsed:
        has_main = any(MAIN & set(b.path) or MAIN_NAMES & {p[1:] for p in b.path if p[0] == "."} for b in blocks)
        for b in blocks:
            b.label = weak_label(b.path, has_main)
    if not parsed:
        return None
    examples, features = _varied(parsed, rng), Features()
    data = sorted([(features.of(b), np.array([x.label for x in b], np.float32)) for b in examples], key=lambda p: len(p[0]))
    groups = [data[i : i + 32] for i in range(0, len(data), 32)]
    model, moments, step = Labeller.fresh(rng), {}, 0
    for epoch in range(epochs):
        for k in rng.permutation(len(groups)):
            x, mask = _padded([p for p, _ in groups[k]])
            y = np.zeros(mask.shape, np.float32)
            for n, (_, labels) in enumerate(groups[k]):
                y[: len(labels), n] = labels
            x[:, :, :PATH] *= rng.random((1, x.shape[1], 1)) > 0.05  # some pages are learnt by words and order alone
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.002
            for name, g in model.gradients(x, mask, y).items():
                m, v = moments.get(name, (np.zeros_like(g), np.zeros_like(g)))
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                moments[name] = (m, v)
                model.weights[name] = (model.weights[name] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def texts_of(pages: list[str | None], model: Labeller, features: Features) -> list[str]:
    """The main text of each page: its article blocks in page order, a line each."""
    parsed = [blocks_of(p) for p in pages]
    order = sorted((i for i, b in enumerate(parsed) if b), key=lambda i: len(parsed[i]))
    out, at = [""] * len(pages), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(parsed[order[end]]) <= CHUNK_BLOCKS:
            end += 1
        chunk = order[at:end]
        x, mask = _padded([features.of(parsed[i]) for i in chunk])
        scores = model.predict(x, mask)
        for n, i in enumerate(chunk):
            out[i] = "\n".join(b.text for b, s in zip(parsed[i], scores[:, n]) if s >= 0.5)
        at = end
    return out


# ---- on Spark ------------------------------------------------------------------------------------------------


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """(id, url, text, n_chars) per row of ``df``.

    The labeller is trained on the driver from at most ``train_pages`` pages of at most 60,000 characters and broadcast
    (some 100 KB); the rest is one pass without a shuffle, over whole pages. Null and empty pages, and pages without
    text, give an empty text; ids may be null or repeated; an empty table gives no rows.
    """
    spark = df.sparkSession
    known = df.where(F.length(html_col).between(1, TRAIN_CHARS)).select(F.col(html_col).alias("h"), F.xxhash64(html_col).alias("k"))
    # the choice is made on hashes alone, so that tasks don't send pages that are not taken; copies count once
    chosen = known.select(F.col("k").alias("c")).distinct().orderBy("c").limit(train_pages)
    sample = known.join(F.broadcast(chosen), F.col("k") == F.col("c")).groupBy("k").agg(F.min("h").alias("h")).orderBy("k")
    model = train([r["h"] for r in sample.collect()])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for pdf in batches:
            for start in range(0, len(pdf), 500):
                part = pdf.iloc[start : start + 500]
                texts = texts_of(part["h"].tolist(), shared.value, features) if shared.value else [""] * len(part)
                yield pd.DataFrame({"id": part["id"], "url": part["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    # ids travel as text: a null among integers would turn the whole batch into floats
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("h"))
    out = rows.mapInPandas(run, "id string, url string, text string, n_chars long")
    return out.withColumn("id", F.col("id").cast(df.schema[id_col].dataType))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
