"""Main-text extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the runs of text between block-level tags.  A block's
features are its ancestor tags and the words of their class, id and role attributes, whether
it stands outside the page's main elements, and its text: length, link share, punctuation, place in the page, and a few word tests.  The
chain has two states, text and other; Viterbi gives the best sequence for a page.

The weights are trained here, by gradient steps on the exact likelihood, on labelled pages:
templates of many layouts (menus, headers, sidebars, notices, adverts, forms, comments,
footers, hidden parts, before, after and inside the main element; main elements with
semantic tags, with telling names or with none, tables, plain divisions and bare lines)
filled with sentences of the given pages' own words.  That sample is bounded by
``TRAINING_PAGES``.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptspark.runtime import others

#: Pages of the given table whose words fill the templates, and templates made of them, at most.
SAMPLE_PAGES = 200
TRAINING_PAGES = 500
#: Distinct words of those pages that templates are made of, at most (by smallest hash).
SAMPLE_WORDS = 20_000
#: Blocks of a page whose weights are looked up at a time.
RUN = 256
SLOTS = 1 << 13
EPOCHS = 10
RATE = 0.5
SEED = 3

# Element names of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio object canvas".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
HIDDEN_TAGS = frozenset("script style title noscript iframe template head textarea select option button xmp noembed noframes".split())
#: Tags that end an open paragraph, and tags that end an open one of their own kind.
ENDS_P = BLOCK_TAGS - {"button", "caption", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary", "noscript", "iframe", "template", "video", "audio", "object", "canvas"}
SELF_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Attributes as the tokeniser's states read them: a name, and after "=" a quoted or a bare value.
#: A quote inside a bare value or a name is part of it; one that never closes counts as a name.
ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?=>)|[^\s>"'][^\s>]*+))?+)*+"""
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)(" + ATTRIBUTES + r")(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?+""")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    """An open element.  What blocks need of its ancestors is kept here once, not in every block."""

    __slots__ = ("parent", "tag", "is_block", "inside", "scope", "inline", "marks")

    def __init__(self, parent: Node | None, tag: str, words: tuple[str, ...]):
        self.parent, self.tag = parent, tag
        self.is_block = parent is None or tag in BLOCK_TAGS
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        #: The nearest block-level element, itself included, and the inline elements open in it.
        self.scope: Node = self if self.is_block else parent.scope
        self.inline: dict[str, int] = {}
        #: Slots of the tags and attribute words of itself and all ancestors, a bit each:
        #: handed down, so that any depth costs the same and takes at most ``SLOTS`` bits.
        self.marks: int = 0
        if parent is not None:
            self.marks = parent.marks | 1 << _slot("in:" + tag)
            for w in words:
                self.marks |= 1 << _slot("mark:" + w)


@dataclass
class Block:
    """A leaf block: the element it stands in, its text, and how much of that is in links."""

    node: Node
    text: str = ""
    linked: int = 0


@dataclass
class _Open:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _attribute_words(raw: str) -> tuple[str, ...]:
    if "=" not in raw and "hidden" not in raw.lower():
        return ()
    out = []
    for m in ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "itemprop", "style"):
            continue
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            out.append("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            out += [w.lower() for w in WORDS.findall(value)]
    return tuple(dict.fromkeys(out))


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in page order.

    Character references are decoded, white space inside a block becomes one space.  Tags
    that are never closed close with their parent.  What stands in elements that are not
    shown (scripts, styles, titles, ...) makes no block.
    """
    blocks: list[Block] = []
    top = Node(None, "", ())
    opened: Counter[str] = Counter()
    now = _Open()
    hidden = links = 0

    def end_block():
        nonlocal now
        if now.parts:
            text = SPACE.sub(" ", html.unescape("".join(now.parts))).strip()
            if text:
                blocks.append(Block(top, text, min(now.linked, len(text))))
            now = _Open()

    def add(text):
        if not hidden and text:
            now.parts.append(text)
            if links:
                now.linked += len(text)

    def pop():
        nonlocal hidden, links, top
        tag = top.tag
        opened[tag] -= 1
        if not top.is_block:
            top.scope.inline[tag] -= 1
        hidden -= tag in HIDDEN_TAGS
        links -= tag == "a"
        top = top.parent

    def close(tag):
        # Every element is popped once, so closing is linear however deep elements nest.
        while top.tag != tag:
            pop()
        pop()

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                end_block()
                if opened[tag]:
                    close(tag)
            # An inline end tag does not reach out of the block it stands in.
            elif top.scope.inline.get(tag):
                close(tag)
            continue
        if tag == "br" or tag in BLOCK_TAGS:
            end_block()
        if tag in ENDS_P and top.scope.tag == "p":
            close("p")
        if tag in SELF_END:
            while not top.is_block:
                pop()
            if top.tag in SELF_END[tag]:
                pop()
        if tag in VOID_TAGS:
            continue
        if tag in RAW_TAGS:
            # Raw text ends at its own end tag alone, whatever stands between.
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[3].endswith("/") and tag not in BLOCK_TAGS:
            continue
        top = Node(top, tag, _attribute_words(m[3]))
        opened[tag] += 1
        if not top.is_block:
            top.scope.inline[tag] = top.scope.inline.get(tag, 0) + 1
        hidden += tag in HIDDEN_TAGS
        links += tag == "a"
    end_block()
    return blocks


@lru_cache(1 << 16)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


@lru_cache(256)
def _bits(marks: int) -> list[int]:
    raw = np.frombuffer(marks.to_bytes(SLOTS // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


ENDS = ".!?…。！？"
NOTICE = ("cookie", "subscribe", "sign up", "log in", "sign in", "copyright", "©", "all rights reserved", "advert", "sponsored", "privacy", "newsletter", "share", "read more", "related", "reply", "comment", "javascript")


def features(blocks: list[Block]) -> Iterator[list[int]]:
    """Slots of the features of each block of a page, one block after another."""
    n = len(blocks)
    main = any(b.node.inside for b in blocks)
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        where = "in" if b.node.inside else "out" if main else "none"
        own = [f"leaf:{b.node.scope.tag or '-'}", f"main:{where}"]
        own += [f"words:{min(9, words.bit_length())}", f"links:{min(4, 5 * b.linked // max(1, len(b.text)))}", f"stops:{min(3, sum(map(b.text.count, ENDS)))}"]
        own.append(f"place:{10 * i // n}")
        low = b.text.lower() if words < 60 else ""
        own.append("notice" if any(w in low for w in NOTICE) else "plain")
        own.append("ends" if b.text[-1] in ENDS else "open")
        yield [*_bits(b.node.marks), *map(_slot, own)]


@dataclass
class Chain:
    """Weights: per slot and state, and between states; state 1 is text."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, page: Iterable[list[int]]) -> np.ndarray:
        """Weights of each block's states; slots are held for ``RUN`` blocks at a time."""
        page, out = iter(page), [np.zeros((0, 2))]
        while run := list(islice(page, RUN)):
            sizes = [len(f) for f in run]
            out.append(np.add.reduceat(self.emit[[x for f in run for x in f]], np.cumsum([0, *sizes[:-1]]), axis=0))
        return np.concatenate(out)

    def viterbi(self, page: Iterable[list[int]]) -> list[int]:
        scores = self.scores(page).tolist()
        if not scores:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        first, *rest = scores
        (v0, v1), back = first, []
        for x0, x1 in rest:
            a0, b0, a1, b1 = v0 + m00, v1 + m10, v0 + m01, v1 + m11
            back.append((b0 > a0, b1 > a1))
            v0, v1 = max(a0, b0) + x0, max(a1, b1) + x1
        out = [int(v1 > v0)]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[list[list[int]], list[int]]], epochs=EPOCHS, rate=RATE, decay=1e-4, seed=SEED) -> Chain:
    """Maximum-likelihood weights by adaptive gradient steps, a page at a time."""
    chain = Chain(np.zeros((SLOTS, 2)), np.zeros((2, 2)))
    grown, grown_move = np.full((SLOTS, 1), 1e-2), 1e-2
    rng = np.random.default_rng(seed)
    pages = [p for p in pages if p[0]]
    for _ in range(epochs):
        for i in rng.permutation(len(pages)):
            page, gold = pages[i]
            s, n = chain.scores(page), len(page)
            a, b = np.zeros((n, 2)), np.zeros((n, 2))
            a[0] = s[0]
            for t in range(1, n):
                a[t] = s[t] + _lse(a[t - 1][:, None] + chain.move, 0)
            for t in range(n - 2, -1, -1):
                b[t] = _lse(chain.move + s[t + 1] + b[t + 1], 1)
            z = _lse(a[-1], 0)
            node = np.exp(a + b - z)
            miss = -node
            miss[np.arange(n), gold] += 1
            move = np.zeros((2, 2))
            for t in range(1, n):
                move -= np.exp(a[t - 1][:, None] + chain.move + s[t] + b[t] - z)
                move[gold[t - 1], gold[t]] += 1
            slots = np.concatenate([np.asarray(f) for f in page])
            each = np.repeat(miss, [len(f) for f in page], axis=0)
            on, where = np.unique(slots, return_inverse=True)
            g = np.stack([np.bincount(where, each[:, y], len(on)) for y in (0, 1)], axis=1)
            d = g - decay * chain.emit[on]
            grown[on] += (d * d).sum(axis=1, keepdims=True)
            chain.emit[on] += rate * d / np.sqrt(grown[on])
            grown_move += float((move * move).sum())
            chain.move += rate * move / np.sqrt(grown_move)
    return chain


# Layout words of the training templates: (state, markup); {t} is filled with text, {s} with short words.
_FRAMES = (
    '<header class="{c}"><h2>{s}</h2><p>{t}</p></header>|site-header masthead top-bar banner branding',
    '<div class="{c}"><ul><li><a href="/x">{s}</a></li><li><a href="/y">{s}</a></li><li><a href="/z">{s}</a></li></ul></div>|menu navbar main-menu breadcrumb breadcrumbs navigation nav-links tabs pager pagination',
    '<nav class="{c}"><ul><li><a href="/x">{s}</a></li><li><a href="/y">{s}</a></li></ul></nav>|nav menu top bar',
    '<aside class="{c}"><h3>{s}</h3><p>{t}</p><ul><li><a href="/a">{s}</a></li></ul></aside>|sidebar widget related-posts box teaser',
    '<div class="{c}"><h4>{s}</h4><p>{t}</p></div>|sidebar side-bar widget related recommended more-stories promo teaser rail trending popular author-bio newsletter signup',
    '<div class="{c}">{t}</div>|ad ads ad-slot ad-unit advert advertisement sponsored sponsor banner-ad promo commercial',
    '<p class="{c}">{t}</p>|ad advert advertisement sponsored promo notice disclaimer newsletter signup cookie-notice',
    '<div id="{c}"><p>{t}</p><button>{s}</button></div>|cookie-notice cookie-banner consent notice gdpr alert popup modal overlay',
    '<div class="{c}" role="dialog">{t} <a href="/ok">{s}</a></div>|cookie-consent privacy-notice notice modal message',
    '<form class="{c}" action="/s"><label>{s}</label><input name="q"><p>{t}</p><button>{s}</button></form>|search-form subscribe login contact newsletter-form comment-form',
    '<section class="{c}"><h3>{s}</h3><div class="comment"><b>{s}</b><p>{t}</p></div><div class="comment"><p>{t}</p><p>{t}</p></div></section>|comments comment-list discussion responses replies',
    '<ol id="{c}"><li class="comment"><p>{t}</p></li><li class="comment"><p>{t}</p></li></ol>|comments commentlist disqus thread',
    '<div class="{c}"><article class="comment"><p>{t}</p></article><article class="comment"><p>{t}</p></article></div>|comments responses user-comments reader-comments',
    '<div id="{c}"><h3>{s}</h3><p>{t}</p><p>{t}</p></div>|respond comments comment-area replies disqus-thread reviews responses',
    '<div class="{c}"><p class="comment-meta">{s}</p><div class="comment-body">{t}</div><div class="comment-body"><p>{t}</p></div></div>|comments comment-thread replies discussion',
    '<div class="{c}" hidden>{t}</div>|box inner panel text block',
    '<div class="{c}" style="display:none"><p>{t}</p></div>|box inner panel text block',
    '<div class="{c}"><a href="/i">{s}</a> | <a href="/c">{s}</a> | <a href="/p">{s}</a></div>|links bottom row line legal',
    '<table class="{c}"><tr><td><a href="/i">{s}</a> | <a href="/c">{s}</a></td></tr></table>|links bottom row line menu',
    '<footer class="{c}"><p>&copy; {s}</p><p>{t}</p></footer>|site-footer footer bottom legal copyright',
    '<div class="{c}"><p>{t}</p><a href="/i">{s}</a></div>|footer page-footer bottom copyright legal social share sharing share-buttons',
)
_MAINS = ("<article>{m}</article>", "<main>{m}</main>", '<main><article class="post">{m}</article></main>', '<div class="{c}">{m}</div>', '<section id="{c}"><div class="inner">{m}</div></section>', '<div id="page"><div class="{c}">{m}</div></div>')
#: Main elements whose markup tells nothing.
_BARE = ("{m}", "<div>{m}</div>", '<div class="x1"><div class="x2">{m}</div></div>', '<div id="page">{m}</div>', "<table><tr><td>{m}</td></tr></table>", "<table><tr><td>{b}</td><td>{m}</td></tr></table>", "<center><table><tbody><tr><td><div>{m}</div></td></tr></tbody></table></center>")
_MAIN_NAMES = "content article-body post-content entry-content main-content story text body article post entry story-body page-content".split()
MARK = "⁠"


def template(rng: np.random.Generator, sentences: list[str]) -> str:
    """A page whose article blocks begin with ``MARK``."""

    def text(n):
        return html.escape(" ".join(sentences[i] for i in rng.integers(0, len(sentences), n)))

    def short():
        return html.escape(" ".join(sentences[int(rng.integers(0, len(sentences)))].split()[: int(rng.integers(1, 4))]))

    def pick(of):
        return of[int(rng.integers(0, len(of)))]

    def other(telling=0.9):
        markup, names = pick(_FRAMES).rsplit("|", 1)
        name = pick(names.split()) if rng.random() < telling else "x" + str(int(rng.integers(100)))
        markup = markup.replace("{c}", name)
        if markup.startswith(("<nav", "<header", "<aside", "<footer", "<form")) and rng.random() < 0.5:
            markup = re.sub(r"^(<\w+)[^>]*", r"\1", markup)
        while "{t}" in markup or "{s}" in markup:
            notice = pick(NOTICE) + " " if rng.random() < 0.4 else ""
            markup = markup.replace("{t}", notice + text(int(rng.integers(1, 4))), 1).replace("{s}", short(), 1)
        return markup

    bare = rng.random() < 0.35
    # Paragraphs of a page: with their tag, as plain divisions, or as lines.
    style = pick(("p", "p", "div", "br")) if bare else "p"

    def paragraph(t):
        if style == "p":
            return f"<p>{MARK}{t}</p>"
        return f'<div class="x{int(rng.integers(9))}">{MARK}{t}</div>' if style == "div" else f"{MARK}{t}<br>"

    parts = []
    if rng.random() < 0.8:
        parts.append(f"<h1>{MARK}{short()}</h1>")
    for _ in range(int(rng.integers(1, 12))):
        kind = rng.random()
        if kind < 0.59:
            parts.append(paragraph(text(int(rng.integers(1, 8)))))
        elif kind < 0.65:
            # Articles use the words of notices too, and may end in a licence line.
            parts.append(paragraph(pick(NOTICE).capitalize() + "." if rng.random() < 0.5 else f"{text(1)} {pick(NOTICE)} {text(1)}"))
        elif kind < 0.73:
            parts.append(f"<p><b>{MARK}{text(1)}<br><p>{MARK}{text(2)}</p>")
        elif kind < 0.79:
            parts.append(f"<h2>{MARK}{short()}</h2>")
        elif kind < 0.85:
            parts.append("<ul>" + "".join(f"<li>{MARK}{text(1)}</li>" for _ in range(3)) + "</ul>")
        elif kind < 0.89:
            parts.append(f"<blockquote>{MARK}{text(2)}</blockquote>")
        elif kind < 0.92:
            parts.append(f'<p>{MARK}{text(1)} <a href="/r">{short()}</a> {text(1)}</p>')
        else:
            parts.append(other(1.0))
    # Unwanted parts stand at the ends of the main element as often as around it.
    inner = ["".join(other(1.0) for _ in range(int(rng.integers(0, 3)))) if rng.random() < 0.5 else "" for _ in range(2)]
    body = inner[0] * (rng.random() < 0.4) + "".join(parts) + inner[1]
    around = ["".join(other() for _ in range(int(rng.integers(0, 4)))) for _ in range(2)]
    main = pick(_BARE if bare else _MAINS).replace("{c}", pick(_MAIN_NAMES)).replace("{b}", other(1.0)).replace("{m}", body)
    return f"<html><head><title>{short()}</title></head><body>{around[0]}{main}{around[1]}</body></html>"


def labelled(page: str) -> tuple[list[list[int]], list[int]]:
    """Features and states of a template's blocks; the marks are taken out first."""
    blocks = leaf_blocks(page)
    gold = [int(b.text.startswith(MARK)) for b in blocks]
    for b in blocks:
        b.text = b.text.replace(MARK, "") or "-"
    return list(features(blocks)), gold


def fit(pages: DataFrame, column="html", sample_pages=SAMPLE_PAGES, training_pages=TRAINING_PAGES, seed=SEED) -> Chain:
    """Train on templates filled with the words of about ``sample_pages`` pages, taken by a hash.

    The pages are read whole; of their distinct words at most ``SAMPLE_WORDS`` reach the driver.
    """

    @F.pandas_udf("array<string>")
    def words_of(s: pd.Series) -> pd.Series:
        return pd.Series([sorted({w for b in leaf_blocks(p) for w in b.text.split()}) for p in s])

    hashed = pages.select(F.coalesce(F.col(column), F.lit("")).alias("t"))
    n = max(1, pages.count())
    some = hashed.where(F.shiftrightunsigned(F.xxhash64("t"), 1) <= F.lit((2**63 - 1) * min(sample_pages, n) // n))
    words = some.select(F.explode(words_of("t")).alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(SAMPLE_WORDS).collect()
    words = [r["w"] for r in words]
    rng = np.random.default_rng(seed)
    if len(words) < 50:
        words = [*words, *(f"word{i}" for i in range(50))]
    sentences = []
    for _ in range(2000):
        n = int(rng.integers(3, 20))
        sentences.append(" ".join(words[i] for i in rng.integers(0, len(words), n)) + (". " if rng.random() < 0.9 else "").strip())
    return train([labelled(template(rng, sentences)) for _ in range(training_pages)], seed=seed)


def main_text(page: str, chain: Chain) -> str:
    blocks = leaf_blocks(page)
    keep = chain.viterbi(features(blocks))
    return " ".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, chain: Chain, column="html") -> DataFrame:
    """Replace ``column`` by text and n_chars (code points).

    A null or empty page, and one without text blocks, gives an empty text; an empty table an
    empty one.  Pages are taken one by one and whole, in time linear in their length, so
    repeated rows agree.  Columns of these names are replaced.
    """

    @F.pandas_udf("text string, n_chars long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            texts = [main_text(p, chain) for p in s]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(*others(pages, column, "text", "n_chars", "__r"), of(F.coalesce(F.col(column), F.lit(""))).alias("__r"))
    return rows.select(*others(rows, "__r"), "__r.text", "__r.n_chars")


def op8_html(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, fit(pages))
