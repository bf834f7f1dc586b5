"""Main-text extraction by the maximum-scoring contiguous subsequence of a page's words and tags.

A page becomes a sequence of blocks of words, which score above zero, and tags, which score below zero.  Elements
that hold no article text by their tag or role are left out beforehand.  An element whose class and id words score
below zero together is one negative item of the scan: the best region may run over it, but its text isn't taken.
Weights of words (by element), tags and class words are log-odds of standing inside the article, estimated on
labelled pages: those with one `article` element, which label their own words and tags.  A linear scan finds the best
contiguous region, and its blocks with a score above zero are the text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_RAW = "script|style|template|noscript|textarea|svg|math|iframe|object"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements that hold no article text, and roles that say the same.
SKIP = frozenset("head title nav aside footer form menu dialog select button fieldset audio video canvas datalist".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Left out unless they stand inside an article.
SKIP_OUTSIDE = frozenset(["header"])
#: Before any page is seen, words of class and id values that mark menus, headers, footers, sidebars, notices, adverts
#: and comments score MARK, and words that mark an article score its opposite.
MARK = -3.0
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu
    breadcrumb breadcrumbs sidebar aside footer masthead banner cookie cookies consent gdpr notice notices notification
    alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended
    recommendations comment comments commentlist disqus respond reply replies pagination pager widget toolbar search
    contentinfo complementary copyright skip disclaimer paywall header topbar teaser teasers feedback trending upsell
    outbrain taboola""".split()
)
#: Marks of what readers wrote: they hold for whole articles and for elements with articles in them, too.
READERS = frozenset("comment comments commentlist disqus respond reply replies feedback".split())
#: Words of class values that say nothing of the content; an element inside an article goes for its class words only where
#: all the others are marks, or most of its words are links.
GENERIC = frozenset("area list section box container wrapper wrap block buttons button links link bar inner outer item items group row col title form the".split())
#: Running text, which no class word takes out of an article.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ol ul dl dt dd table thead tbody tr td th figure figcaption".split())
CONTENT_MARKS = frozenset("article post entry content main body story text".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp
    small span strike strong sub sup time tt u var wbr""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTENT = frozenset(["article", "main"])
#: Elements that structure running text; where no labelled page shows them they cost as little as a tag can.
TEXTUAL = frozenset(
    "p br h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tr td th figure figcaption hr div section article main".split()
)
#: Where a skipped element that is never closed ends, and before which an open paragraph ends.
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 article main section div header footer table blockquote pre figure body html".split())
_ENDS_P = _BLOCKS | frozenset("ul ol dl form aside nav hr".split())
#: Least share of a page's words that its articles must hold for the words outside them to score below zero.
ARTICLE_SHARE = 0.3
#: Bounds of what one block outside the articles, or one of links alone, costs.
OUTSIDE, OUTSIDE_MOST = -0.5, -2.0


def name_parts(attrs: str) -> set[str]:
    """The distinct words of class, id and label values, in lower case."""
    return {p.lower() for m in _ATTR.finditer(attrs) if m[1].lower() != "role" for p in _NAME_PART.findall(m[2] or m[3] or m[4] or "")}


@dataclass
class Weights:
    """Score of a word by its innermost block element, of a tag by its name, and of a class word."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    classes: dict[str, float] = field(default_factory=dict)
    word: float = 1.0
    tag: float = -2.0
    textual: float = -0.05

    def of_tag(self, name: str) -> float:
        return self.tags.get(name, self.textual if name in TEXTUAL else self.tag)

    def of_attrs(self, attrs: str) -> float:
        """Sum of the scores of the distinct words of class, id and label values."""
        if not attrs:
            return 0.0
        parts = name_parts(attrs)
        return sum(self.classes.get(p, MARK if p in MARKS else -MARK if p in CONTENT_MARKS else 0.0) for p in parts)


#: A (score, text) item; tags have no text.
Item = tuple[float, str]


@dataclass
class Token:
    """A run of text (no name), a start tag with the number of the token that ends it, or an end tag."""

    name: str
    text: str = ""
    attrs: str = ""
    closing: bool = False
    end: int = 0  # of a start tag: first token behind the element's content
    closed: bool = True
    article: bool = False  # within an article, or the main element of a page without one
    inner: bool = False  # within an article element


def parse(page: str) -> list[Token]:
    """The page's tokens with elements matched; ends that are missing are implied by the element around."""
    out: list[Token] = []
    stack: list[int] = []
    opened: dict[str, int] = {}
    at = articles = inner = 0

    def pop(k: int, closed: bool) -> None:
        nonlocal articles, inner
        token = out[stack.pop()]
        token.end, token.closed = k, closed
        opened[token.name] -= 1
        articles -= token.name in _CONTENT
        inner -= token.name == "article"

    for m in TOKEN.finditer(page):
        if m.start() > at:
            out.append(Token("", page[at : m.start()], article=articles > 0, inner=inner > 0))
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if m["close"]:
            if opened.get(name):
                while out[stack[-1]].name != name:
                    pop(len(out), False)
                pop(len(out), True)
            out.append(Token(name, closing=True, article=articles > 0, inner=inner > 0))
            continue
        if name in _ENDS_P and stack and out[stack[-1]].name == "p" or name == "li" and stack and out[stack[-1]].name == "li":
            pop(len(out), True)
        token = Token(name, attrs=m["attrs"], end=len(out) + 1, article=articles > 0, inner=inner > 0)
        out.append(token)
        if name not in VOID and not m["attrs"].endswith("/"):
            stack.append(len(out) - 1)
            opened[name] = opened.get(name, 0) + 1
            articles += name in _CONTENT
            inner += name == "article"
    if at < len(page):
        out.append(Token("", page[at:], article=articles > 0, inner=inner > 0))
    while stack:
        pop(len(out), False)
    # Where the main element holds an article that readers didn't write, what stands beside it is not the article.
    if any(t.name == "article" and not t.closing and t.article and not name_parts(t.attrs) & READERS for t in out):
        head = 0
        for k, t in enumerate(out):
            if t.name == "h1" and not t.closing:
                head = t.end
            t.article = t.inner or t.article and (k < head or t.name in _CONTENT)
    return out


def _skipped(token: Token) -> bool:
    if token.name in SKIP or token.name in SKIP_OUTSIDE and not token.article:
        return True
    if not token.attrs or token.name in ("body", "html", *_CONTENT):
        return False
    return any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").strip().lower() in SKIP_ROLES for m in _ATTR.finditer(token.attrs))


def visible(page: str) -> list[Token]:
    """The tokens without the elements that are left out by tag or role."""
    tokens = parse(page)
    out: list[Token] = []
    place = [0] * (len(tokens) + 1)  # where each token stands in what is left
    k = 0
    while k < len(tokens):
        token = tokens[k]
        place[k] = len(out)
        out.append(token)
        nxt = k + 1
        if token.name and not token.closing and token.end > k + 1 and _skipped(token):
            nxt = token.end
            if not token.closed:
                # Never closed: only what stands before the next block belongs to it, unless that is the rest of a head.
                nxt = next((j for j in range(k + 1, token.end) if tokens[j].name in _BLOCKS), token.end)
        for j in range(k + 1, nxt):
            place[j] = len(out)
        k = nxt
    place[len(tokens)] = len(out)
    for token in out:
        if token.name and not token.closing:
            token.end = place[token.end]
    return out


def _linked(tokens: list[Token], start: int, end: int) -> bool:
    """Whether more than half of the words from ``start`` to ``end`` are links; true without words."""
    links = linked = words = 0
    for t in tokens[start:end]:
        if t.name == "a":
            links = max(0, links + (-1 if t.closing else 1))
        elif not t.name:
            n = len(t.text.split())
            words, linked = words + n, linked + (n if links else 0)
    return 2 * linked >= words


def _marked(tokens: list[Token], weights: Weights) -> dict[int, float]:
    """Scores of the elements whose class words sum below zero, by start tag.

    An element that holds an article, a main element or a first-level heading is layout and has no score, unless its class
    words tell that readers wrote it and it has no such heading; neither has an article, unless they tell so or another
    article without such words stands on the page.  Inside an article, running text has no score, and other elements have
    one only if all their telling class words are marks or most of their words are links.
    """
    if not any(t.attrs for t in tokens):
        return {}
    heads, titles = [0], [0]
    for t in tokens:
        heads.append(heads[-1] + (not t.closing and (t.name in _CONTENT or t.name == "h1")))
        titles.append(titles[-1] + (not t.closing and t.name in ("main", "h1")))
    found: dict[int, float] = {}
    plain, readers = False, set()
    for k, t in enumerate(tokens):
        if t.closing or not t.name or t.name in ("body", "html", "main") or t.end <= k + 1:
            continue
        score = weights.of_attrs(t.attrs)
        told = score < 0 and bool(name_parts(t.attrs) & READERS) and titles[t.end] == titles[k + 1]
        if t.name == "article":
            plain |= score >= 0
            if score < 0:
                found[k] = score
                if told:
                    readers.add(k)
        elif score < 0 and (told or heads[t.end] == heads[k + 1]):
            if t.inner:
                telling = name_parts(t.attrs) - GENERIC
                if t.name in RUNNING or not (all(weights.classes.get(p, MARK if p in MARKS else 0.0) < 0 for p in telling) or _linked(tokens, k + 1, t.end)):
                    continue
            found[k] = score
    return found if plain else {k: v for k, v in found.items() if tokens[k].name != "article" or k in readers}


def items(page: str, weights: Weights, marks: bool = True) -> list[Item]:
    """The page as scored blocks of text and scored tags."""
    tokens = visible(page)
    marked = _marked(tokens, weights) if marks else {}
    size = [0, 0]
    k = 0
    while k < len(tokens):
        if k in marked:
            k = tokens[k].end
            continue
        if not tokens[k].name:
            size[tokens[k].article] += tokens[k].text.count(" ") + 1
        k += 1
    outside = OUTSIDE if size[1] and size[1] >= ARTICLE_SHARE * sum(size) else 0.0
    out: list[Item] = []
    run: list[str] = []
    element, links, linked, plain, within, content = "", 0, 0, 0, False, 0

    def flush() -> None:
        nonlocal linked, plain
        if run:
            words = html.unescape("".join(run)).split()
            run.clear()
            if words:
                score = len(words) * weights.words.get(element, weights.word)
                if not within and (outside or linked > 2 * plain):
                    score = max(OUTSIDE_MOST, len(words) * OUTSIDE)
                out.append((score, " ".join(words)))
        linked = plain = 0

    k = 0
    while k < len(tokens):
        t = tokens[k]
        if k in marked:
            flush()
            # Within an article, or an element that its class words say is one, the text goes on behind it.
            out.append((max(marked[k], OUTSIDE) if t.article or k < content else marked[k], ""))
            k = t.end
            continue
        k += 1
        if marks and t.attrs and t.end > content and weights.of_attrs(t.attrs) > 0:
            content = t.end
        if not t.name:
            run.append(t.text)
            within = t.article
            n = len(t.text.split())
            linked, plain = (linked + n, plain) if links else (linked, plain + n)
        elif t.name == "a":
            links = max(0, links + (-1 if t.closing else 1))
        elif t.name not in INLINE:
            flush()
            cost = weights.of_tag(t.name)
            out.append((max(cost, weights.textual) if t.article else cost, ""))
            element = t.name
    flush()
    return out


def best_region(scored: list[Item]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest sum; the first of equals, and of those the shortest."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for k, (score, _) in enumerate(scored):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, best_at = total, (start, k + 1)
    return best_at


def main_text(page: str | None, weights: Weights) -> str:
    """The page's main text; empty for a null or empty page and for one without words.

    Where class words leave nothing, the page is scanned without them.
    """
    for marks in (True, False):
        scored = items(page or "", weights, marks)
        a, b = best_region(scored)
        if a < b:
            return " ".join(text for score, text in scored[a:b] if text and score > 0)
    return ""


def learn_weights(pages: Iterable[str], least: float = 0.05, most: float = 6.0, deepest: float = 2.0) -> Weights:
    """Weights from labelled pages; those without exactly one article element are passed over.

    Word weights are held between ``least`` and ``most``, tag weights between the negatives of ``least`` and
    ``deepest``, so that words stay above zero and tags below, and class words within ``most``; what no page shows
    keeps the default.
    """
    word: dict[str, list[float]] = {}
    tag: dict[str, list[float]] = {}
    of_class: dict[str, list[float]] = {}
    plain = Weights()
    for page in pages:
        if len(re.findall(r"<article\b", page, re.I)) != 1:
            continue
        tokens, element = visible(page), ""
        marked = _marked(tokens, plain)
        hidden = 0
        for k, t in enumerate(tokens):
            if t.attrs and not t.closing and t.end > k + 1 and t.name not in ("body", "html", *_CONTENT):
                n = sum(len(x.text.split()) for x in tokens[k + 1 : t.end])
                if not any(x.name in _CONTENT for x in tokens[k + 1 : t.end]):
                    for m in _ATTR.finditer(t.attrs):
                        for p in {p.lower() for p in _NAME_PART.findall(m[2] or m[3] or m[4] or "")} if m[1].lower() != "role" else ():
                            # What a mark names is no article text where it stands inside the article either.
                            if not t.article or p not in MARKS:
                                of_class.setdefault(p, [0.0, 0.0])[not t.article] += n
            if k in marked:
                hidden = max(hidden, t.end)
            if k < hidden:
                continue
            if not t.name:
                word.setdefault(element, [0.0, 0.0])[not t.article] += len(t.text.split())
            elif t.name not in INLINE:
                tag.setdefault(t.name, [0.0, 0.0])[not t.article] += 1
                element = t.name
    odds = lambda c: math.log((c[0] + 0.5) / (c[1] + 0.5))
    bound = lambda x: min(most, max(-most, x))
    return Weights(
        {k: min(most, max(least, odds(c))) for k, c in word.items()},
        {k: -min(deepest, max(least, -odds(c))) for k, c in tag.items() if k not in TEXTUAL},
        {k: bound(odds(c)) for k, c in of_class.items() if sum(c)},
    )


#: Labelled pages that the weights are estimated on at most, and the characters of the longest of them: longer pages
#: are extracted, but not learned from.
MAX_LABELLED, MAX_LABELLED_CHARS = 400, 200_000


def fit(pages: DataFrame, html_col: str = "html", sample: int = MAX_LABELLED) -> Weights:
    """Weights from ``sample`` labelled pages at most, those whose hash is smallest."""
    labelled = pages.filter(F.col(html_col).rlike(r"(?i)<article\b") & (F.length(html_col) < MAX_LABELLED_CHARS))
    rows = labelled.select(F.col(html_col).alias("page"), F.xxhash64(html_col).alias("h")).orderBy("h", "page").limit(sample)
    return learn_weights(r["page"] for r in rows.toLocalIterator())


def extract(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of the text).

    A null or empty page, and one without article words, gives an empty text and 0; null ids and urls stay null;
    repeated rows are repeated; of equally good regions the first wins; pages of any length are read whole; an
    empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x.as_py(), weights) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
