"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks in page order: runs of text between block-level tags, with character references decoded and
white space made one space. Each block is a vector: its tag path (names, classes and ids) and its words, both
hashed, and a few numbers such as length and share of links. A bidirectional LSTM in numpy reads the whole
sequence, so every block is labelled in the light of all others; blocks labelled as content make the text.

The labeller is trained in place on at most ``SAMPLE`` pages. Their labels come from elements that name their role
(article and main against nav, header, footer, aside, form and the like). So that it learns context and not only those
names, each page is also shown in disguises: roles are renamed to plain containers with customary class names, and
menus, notices, forms and reader comments are added. Pages without any such element teach nothing.

Scripts, styles, templates and comments are markup, the head holds no blocks, a line break is white space. Null pages are
empty and give an empty text; so do pages without content. Elements that are never closed end with the page, stray
end tags are ignored. Repeated rows give equal rows, null ids and addresses are handed through.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm.repeats import by_bytes

SAMPLE = 240  # pages the labeller is trained on, at most
HIDDEN = 16
PATH_DIM, WORD_DIM, NUMBERS = 48, 24, 7
DIM = PATH_DIM + WORD_DIM + NUMBERS
EPOCHS = 10

# ---- pages to blocks ------------------------------------------------------------------------------

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL
)
_ROLE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_RAW = {"script", "style", "template", "noscript", "iframe", "svg", "title", "textarea", "select"}
_NEVER_EMPTY = {"script", "style", "iframe", "title", "textarea"}  # a slash at the end of their tags means nothing
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "label", "br",
    "img", "wbr", "input",
}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}}

Block = tuple[tuple[str, ...], str, int]  # tag path, text, characters inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []  # name, and name with roles
    pieces: list[str] = []
    linked = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append((tuple(s[1] for s in stack if s[0] not in _INLINE), text, linked))
            pieces.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal links
        while stack:
            top = stack.pop()[0]
            links -= top == "a"
            if top == name:
                break

    def say(text: str) -> None:
        nonlocal linked
        text = entities.unescape(text) if "&" in text else text
        pieces.append(text)
        if links:
            linked += len(text)

    at = 0
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            say(page[at:])
            break
        if tag.start() > at:
            say(page[at : tag.start()])
        at = tag.end()
        name = tag[2]
        if name is None:
            continue
        name = name.lower()
        if tag[1]:
            if any(s[0] == name for s in stack):
                if name not in _INLINE:
                    flush()
                close(name)
            continue
        if name in _RAW and (name in _NEVER_EMPTY or not tag[3].endswith("/")):
            end = _end_of(name, page, at)
            at = end
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name not in _INLINE:
            flush()
            if any(s[0] == "p" for s in stack) and name not in ("body", "html"):
                close("p")
            over = _CLOSES.get(name)
            if over:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in over:
                        del stack[depth:]
                        break
                    if stack[depth][0] in ("ul", "ol", "dl", "table", "select"):
                        break
        if name in _VOID or tag[3].endswith("/"):
            continue
        if name == "head":
            end = re.compile(r"</head\s*>|<body\b", re.IGNORECASE).search(page, at)
            if end is not None:
                at = end.start() if end[0].lower().startswith("<body") else end.end()
            continue
        roles = [next(g for g in m.groups() if g is not None) for m in _ROLE.finditer(tag[3])] if tag[3] else []
        stack.append((name, " ".join([name, *roles]).lower()))
        links += name == "a"
    flush()
    return found


@lru_cache(maxsize=64)
def _closer(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}[^>]*>", re.IGNORECASE)


def _end_of(name: str, page: str, at: int) -> int:
    end = _closer(name).search(page, at)
    return len(page) if end is None else end.end()


# ---- blocks to vectors ----------------------------------------------------------------------------


def _hash(word: str) -> int:
    return zlib.crc32(word.encode())


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    vector = np.zeros(PATH_DIM)
    for element in path:
        for word in re.findall(r"[a-z0-9]+", element):
            code = _hash(word)
            vector[code % PATH_DIM] += 1 if code >> 16 & 1 else -1
    if path:  # the innermost element once more, told apart
        code = _hash("last " + path[-1].split(" ")[0])
        vector[code % PATH_DIM] += 1 if code >> 16 & 1 else -1
    return np.clip(vector, -2, 2)


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), DIM))
    for i, (path, text, linked) in enumerate(page):
        row = out[i]
        row[:PATH_DIM] = _path_vector(path)
        words = text.split(" ")
        codes = np.fromiter(map(hash_word, words), dtype=np.int64, count=len(words))
        counts = np.bincount(codes, minlength=WORD_DIM)
        row[PATH_DIM : PATH_DIM + WORD_DIM] = np.sqrt(counts / len(words))
        size = len(text)
        row[PATH_DIM + WORD_DIM :] = (
            np.log1p(size) / 6, np.log1p(len(words)) / 4, min(1.0, linked / size), len(path) / 8,
            i / len(page), (text[-1] in ".!?…。"), np.log1p(len(page)) / 5,
        )
    return out


@lru_cache(maxsize=100_000)
def hash_word(word: str) -> int:
    return _hash(word.lower()) % WORD_DIM


# ---- the labeller ---------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 1 / np.sqrt(DIM), (DIM, 4 * HIDDEN))
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            self.p["c" + d] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        self.p["o"] = rng.normal(0, 0.3, 2 * HIDDEN)
        self.p["z"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        batch, steps = mask.shape
        given = x @ self.p["x" + d] + self.p["c" + d]
        h, c = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        out = np.zeros((batch, steps, HIDDEN))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = given[:, t] + h @ self.p["h" + d]
            g = _sigmoid(gates[:, : 3 * HIDDEN])
            i, f, o = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            n = np.tanh(gates[:, 3 * HIDDEN :])
            m = mask[:, t : t + 1]
            fresh = f * c + i * n
            tanh = np.tanh(fresh)
            if keep is not None:
                keep.append((t, h, c, i, f, o, n, tanh, m))
            c = m * fresh + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[:, t] = h
        return out

    def odds(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f", None), self._run(x, mask, "b", None)], axis=2)
        return both @ self.p["o"] + self.p["z"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        odds = both @ self.p["o"] + self.p["z"]
        p = _sigmoid(odds)
        total = max(mask.sum(), 1)
        loss = -(mask * (labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9))).sum() / total
        back = mask * (p - labels) / total
        g = {"o": np.einsum("bt,bth->h", back, both), "z": np.array([back.sum()])}
        outer = back[:, :, None] * self.p["o"]
        for k, d in enumerate("fb"):
            own = outer[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            dx = np.zeros((*mask.shape, 4 * HIDDEN))
            g["h" + d] = np.zeros_like(self.p["h" + d])
            dh, dc = np.zeros((len(mask), HIDDEN)), np.zeros((len(mask), HIDDEN))
            for t, h, c, i, f, o, n, tanh, m in reversed(kept[d]):
                dh = dh + own[:, t]
                now, rest = m * dh, (1 - m) * dh
                inner = now * o * (1 - tanh**2) + m * dc
                gates = np.concatenate(
                    [inner * n * i * (1 - i), inner * c * f * (1 - f), now * tanh * o * (1 - o), inner * i * (1 - n**2)],
                    axis=1,
                )
                dx[:, t] = gates
                g["h" + d] += h.T @ gates
                dh = rest + gates @ self.p["h" + d].T
                dc = inner * f + (1 - m) * dc
            flat = dx.reshape(-1, 4 * HIDDEN)
            g["x" + d] = x.reshape(-1, DIM).T @ flat
            g["c" + d] = flat.sum(axis=0)
        return float(loss), g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.02) -> float:
        """Adam over batches of pages of like length; the loss of the last epoch."""
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        batches = [padded(pages[i : i + 24]) for i in range(0, len(pages), 24)]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        rng, step, loss = np.random.default_rng(7), 0, 0.0
        for epoch in range(epochs):
            losses = []
            for b in rng.permutation(len(batches)):
                step += 1
                one, g = self.gradients(*batches[b])
                losses.append(one)
                norm = np.sqrt(sum((v**2).sum() for v in g.values()))
                for k, v in g.items():
                    v = v * min(1.0, 2.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    ahead = first[k] / (1 - 0.9**step)
                    self.p[k] -= rate * (1 - epoch / (epochs + 1)) * ahead / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss

    def labels(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which blocks are content."""
        done: list[np.ndarray] = [np.zeros(len(p), dtype=bool) for p in pages]
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        begin = 0
        while begin < len(order):
            end = begin + 1  # as many pages of like length as make about 8,000 padded blocks
            while end < len(order) and (end - begin + 1) * len(pages[order[end]]) <= 8_000:
                end += 1
            some = order[begin:end]
            x, mask, _ = padded([(vectors(pages[i]), np.zeros(len(pages[i]))) for i in some])
            odds = self.odds(x, mask)
            for k, i in enumerate(some):
                done[i] = odds[k, : len(pages[i])] >= 0
            begin = end
        return done


def padded(pages: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = max(len(x) for x, _ in pages)
    x, mask, y = np.zeros((len(pages), steps, DIM)), np.zeros((len(pages), steps)), np.zeros((len(pages), steps))
    for k, (rows, labels) in enumerate(pages):
        x[k, : len(rows)], mask[k, : len(rows)], y[k, : len(rows)] = rows, 1, labels
    return x, mask, y


# ---- training pages -------------------------------------------------------------------------------

_CONTENT = {"article", "main"}
_OTHER = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
# Words in classes and ids that name what is not content.
_OTHER_ROLES = re.compile(
    r"\b(?:ads?|advert\w*|banner|sponsor\w*|nav\w*|menu|sidebar|footer|header|cookie\w*|notice|comments?|related|share|form)\b"
)
_DISGUISES = {
    "article": ["main", "article", "div content", "div post", "div entry content", "div article body", "section story", "div main"],
    "main": ["main", "article", "div content", "div story"],
    "nav": ["nav", "div menu", "ul nav", "div navbar", "div topnav", "div breadcrumbs"],
    "footer": ["footer", "div footer", "div copyright", "section footer", "div bottom"],
    "header": ["header", "div header", "div masthead", "div top"],
    "aside": ["aside", "div sidebar", "div related", "div widget"],
    "div ad": ["div ad", "div advert", "div banner", "div sponsored", "aside ad"],
}
_EXTRAS = {
    "before": ["div cookie notice", "header", "div banner", "form search", "aside sidebar", "div alert notice", "div menu"],
    "after": ["div comments", "section comments", "aside sidebar", "form newsletter", "div related", "div share", "footer"],
}
_INSIDE = ["div comments", "aside related", "form subscribe", "div ad", "div notice"]


def role(path: tuple[str, ...]) -> int:
    """1 for content, 0 for anything else, -1 if no element tells; the innermost that does decides."""
    for element in reversed(path):
        name, _, roles = element.partition(" ")
        if name in _OTHER or roles and _OTHER_ROLES.search(roles.replace("-", " ").replace("_", " ")):
            return 0
        if name in _CONTENT:
            return 1
    return -1


def _renamed(path: tuple[str, ...], names: dict[str, str]) -> tuple[str, ...]:
    return tuple(names.get(e, names.get(e.split(" ")[0], e)) for e in path)


def disguised(page: list[Block], labels: list[int], spare: list[Block], rng: np.random.Generator):
    """A page with other names for its roles, and strange blocks around and inside its content."""
    names = {k: str(rng.choice(v)) for k, v in _DISGUISES.items()}
    out = [((_renamed(path, names), text, linked), y) for (path, text, linked), y in zip(page, labels, strict=True)]
    base = ("html", "body")

    def strange(container: str, where: tuple[str, ...]) -> list:
        rows = []
        for _ in range(int(rng.integers(1, 4))):
            _, text, _ = spare[int(rng.integers(len(spare)))]
            words = text.split(" ")
            words = words[: int(rng.integers(2, 30))]
            inner = str(rng.choice(["p", "li", "div", "span"]))
            path = (*where, container) if inner == "span" else (*where, container, inner)
            text = " ".join(words)
            rows.append(((path, text, len(text) if inner == "li" else 0), 0))
        return rows

    for place, at in (("before", 0), ("after", len(out))):
        if rng.random() < 0.6:
            extra = strange(str(rng.choice(_EXTRAS[place])), base)
            out[at:at] = extra if place == "before" else []
            if place == "after":
                out += extra
    content = [i for i, (_, y) in enumerate(out) if y == 1]
    if content and rng.random() < 0.3:
        i = content[int(rng.integers(len(content)))]
        out[i + 1 : i + 1] = strange(str(rng.choice(_INSIDE)), out[i][0][0][:-1])
    return [b for b, _ in out], np.array([y for _, y in out], dtype=float)


def trained(pages: list[str], disguises: int = 3) -> Labeller:
    """A labeller of some pages whose elements tell their roles."""
    rng = np.random.default_rng(17)
    cut = [blocks(p) for p in pages]
    labelled = []
    for page in cut:
        labels = [role(path) for path, _, _ in page]
        if 1 in labels:
            labelled.append((page, [max(y, 0) for y in labels]))
    spare = [b for page, _ in labelled for b in page]
    rows = []
    for page, labels in labelled:
        rows.append((vectors(page), np.array(labels, dtype=float)))
        for _ in range(disguises):
            own, y = disguised(page, labels, spare, rng)
            rows.append((vectors(own), y))
    labeller = Labeller()
    labeller.train(rows)
    return labeller


# ---- pages to texts -------------------------------------------------------------------------------


def texts_of(pages: list[str], labeller: Labeller) -> list[str]:
    cut = [blocks(p) for p in pages]
    return [
        "\n\n".join(text for (_, text, _), y in zip(page, labels.tolist(), strict=True) if y)
        for page, labels in zip(cut, labeller.labels(cut), strict=True)
    ]


def sample_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = SAMPLE) -> list[str]:
    """At most about ``most`` pages, drawn by a hash of the id."""
    share = min(1.0, most / max(pages.count(), 1))
    drawn = F.pmod(F.xxhash64(F.lit("page"), F.col(f"`{id_col}`")), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = pages.filter(drawn).select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{html_col}`").cast("string").alias("h"))
    return [r.h or "" for r in sorted(rows.limit(2 * most).collect(), key=lambda r: (str(r.i), r.h or ""))]


def main_texts(
    pages: DataFrame,
    labeller: Labeller | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Id, address, ``text`` and ``n_chars`` of every page; without a labeller one is trained on a sample."""
    own = labeller or trained(sample_pages(pages, id_col, html_col))
    shared = pages.sparkSession.sparkContext.broadcast(own)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in by_bytes(whole, 2, 1 << 21)):
            texts = texts_of([h.decode() for h in batch.column(2).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["_id", "_url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.col(f"`{url_col}`").cast("string").alias("_url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("_html"),
    )
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(extract, f"_id {kind}, _url string, text string, n_chars long").withColumnsRenamed(
        {"_id": id_col, "_url": url_col}
    )
