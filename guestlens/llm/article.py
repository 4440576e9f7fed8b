"""Main text of web pages by the distribution of text over lines."""

import itertools
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

# Lines in a window; characters without links that a window of a stretch has to reach, and
# outside the article where a page marks one; share of linked text from which a window is
# a menu, and inside an article.
WINDOW = 3
SURGE = 40
SURGE_OUTSIDE = 160
LINK_SHARE = 0.6
LINK_SHARE_ARTICLE = 0.9
# Characters from which a linked line of an article is a reference, not part of a menu.
REFERENCE = 60

# Fixed values of HTML: elements that start a line, and those without an end tag.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that hold no text of a page, those that hold none of its main text, and words of
# class, id or role that say so.
_NO_TEXT = frozenset(
    "button canvas dialog form head iframe input noscript object script select style svg template textarea title video audio".split()
)
_ASIDE = _NO_TEXT | frozenset("aside footer menu nav".split())
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments "
    "commentlist complementary consent contentinfo cookie cookies disqus footer header login masthead menu modal nav "
    "navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion recommended related "
    "replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
# Words of the layout, which also stand on wrappers of whole pages, as forms do; an article
# in such an element is one.
_LAYOUT = frozenset("banner footer header login masthead menu nav navbar navigation search sidebar toolbar".split())
# Words that speak of adverts, and of what may hold articles that are not the page's.
_ADVERT = frozenset("ad ads adv advert adverts advertisement advertising promo promoted promotion sponsor sponsored".split())
_OTHERS = frozenset("comment comments commentlist disqus recommended related replies respond".split())
_READERS = frozenset("commentlist comments disqus respond".split())
# Elements that in an article are text of it, whatever their words say but for adverts.
_TEXT = frozenset("b blockquote caption dd dt em figcaption h1 h2 h3 h4 h5 h6 i label legend li p pre span strong td th".split())
# First parts of class words that tell of a layout or of something absent.
_ABOUT = frozenset("has have hide is no not show with without".split())
_ARTICLE = frozenset(("article", "main"))
_ROOTS = frozenset(("html", "body", "article", "main"))
_SPLIT = re.compile(r"[^a-z]+")
_EDGES = re.compile(r"^[^a-z]+|[^a-z]+$")
# Elements whose start ends an open paragraph or an open element of their own kind.
_SIBLINGS = frozenset(("li", "dt", "dd", "tr", "td", "th", "option", "p"))


def _aside_words(value: str) -> set[str]:
    """Words of `_ASIDE_WORDS` in a class, id or role: whole ones, or the last part of a
    compound, which says what the element is ("cookie-notice", but not "sidebar-wrap")."""
    found = set()
    for token in value.lower().split():
        parts = [p for p in _SPLIT.split(token) if p]
        if parts and (_EDGES.sub("", token) in _ASIDE_WORDS or parts[-1] in _ASIDE_WORDS and parts[0] not in _ABOUT):
            found.add(parts[-1])
    return found


class _Lines(HTMLParser):
    """Strips markup: one line per block, with its text, the part of it in links, whether
    it stands in an article, and whether in something that is no main text: _NO, _YES,
    _OPEN where an article inside is one all the same, or the numbers of the wrappers around
    it that say so by a word of the layout or as forms. Without `words` only elements that
    hold no text count as such."""

    _NO, _YES, _OPEN = (), (0,), (-1,)

    def __init__(self, words: bool = True):
        super().__init__(convert_charrefs=True)
        self.words = words
        self.open: list[tuple[str, tuple[int, ...], bool]] = []  # tag, aside, article
        self.lines: list[tuple[str, int, bool, tuple[int, ...]]] = []
        self.wrappers = 0
        self.parts: list[str] = []
        self.linked = self.links = self.quotes = 0

    def end_line(self):
        text = " ".join("".join(self.parts).split())
        if text:
            aside, article = self.open[-1][1:] if self.open else (self._NO, False)
            self.lines.append((text, self.linked, article, aside))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag in _BLOCKS:
            self.end_line()
            while self.open and self.open[-1][0] in _SIBLINGS and (self.open[-1][0] == tag or self.open[-1][0] == "p"):
                self.end_element()
        if tag in _VOID:
            return
        aside, article = self.open[-1][1:] if self.open else (self._NO, False)
        if tag in _ARTICLE:
            article = True
            aside = aside if aside == self._YES and tag == "article" else self._NO
        if tag not in _ROOTS and aside != self._YES:
            aside = self.aside_of(tag, attrs, aside, article)
        if aside != (self.open[-1][1] if self.open else self._NO):
            self.end_line()
        self.open.append((tag, aside, article))
        self.links += tag == "a"
        self.quotes += tag == "blockquote"

    def aside_of(self, tag, attrs, aside, article):
        """Whether what a tag opens is aside. In an article ids tell of readers' comments only,
        as those of headings and sections are their titles."""
        if not self.words:
            return self._YES if tag in _NO_TEXT - {"form"} else aside
        words = {w for k, v in attrs if k in ("class", "role") and v for w in _aside_words(v)}
        ids = {w for k, v in attrs if k == "id" and v for w in _aside_words(v)}
        words |= ids & _READERS if article else ids
        if article:
            words.discard("header")  # the title of the article
            if tag in _TEXT:
                words &= _ADVERT
        if any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
            return self._YES
        kept = article and (tag == "header" or tag == "footer" and self.quotes)
        if tag in _NO_TEXT - {"form"} or tag == "aside" or words & _OTHERS:
            return self._YES
        if tag in _ASIDE - {"form"} and not kept or words - _LAYOUT:
            return self._YES if article else self._OPEN
        if (words or tag == "form") and aside != self._OPEN:
            self.wrappers += 1
            return (*aside, self.wrappers)
        return aside

    def end_element(self):
        tag, aside, _ = self.open[-1]
        if tag in _BLOCKS or aside != (self.open[-2][1] if len(self.open) > 1 else self._NO):
            self.end_line()
        self.links -= tag == "a"
        self.quotes -= tag == "blockquote"
        self.open.pop()

    def handle_endtag(self, tag):
        if tag in _VOID or all(t != tag for t, _, _ in self.open):
            return
        while self.open[-1][0] != tag:
            self.end_element()
        self.end_element()

    def handle_data(self, data):
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.parts.append(data)
        self.linked += bool(self.links) and len(data.strip())


def lines_of(html: str, words: bool = True) -> list[tuple[str, int, bool, bool]]:
    """A wrapper that holds more than half of the text without links is not aside; where
    an article is marked already, only one inside of it may be such."""
    parser = _Lines(words)
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines, always = parser.lines, (parser._YES, parser._OPEN)
    marked = any(article and not aside for _, _, article, aside in lines)
    held, total = [0] * (parser.wrappers + 1), 0
    for text, linked, article, aside in lines:
        if aside not in always and (article or not marked):
            total += len(text) - linked
            for wrapper in aside:
                held[wrapper] += len(text) - linked
    return [(t, n, article, aside in always or any(2 * held[w] <= total for w in aside)) for t, n, article, aside in lines]


def _runs(open_: list[bool]) -> list[tuple[int, int]]:
    found, start = [], None
    for i, now in enumerate([*open_, False]):
        if now and start is None:
            start = i
        elif not now and start is not None:
            found.append((start, i))
            start = None
    return found


def _kept(lines: list[tuple[str, int, bool]], article: bool, surge: int, share: float, window: int = WINDOW) -> list[str]:
    """The lines between surges and dives of (text, linked, aside) lines. What is aside has
    no density: its lines take a place in the windows, but no text. A window that is mostly
    links is empty, unless its first line alone makes a surge; a stretch reaches `surge`
    characters without links in one of its windows, and holds the lines of its windows.
    Lines of links at its ends are the menus next to it, in an article only where there
    are as many as a window has."""
    reference = REFERENCE if article else float("inf")
    sizes = [0 if aside else len(text) for text, _, aside in lines]
    linked = [0 if aside or size >= reference else n for (_, n, aside), size in zip(lines, sizes)]
    dense = [n > share * size for n, size in zip(linked, sizes)]
    plain, open_, menu = [], [], [not article] * len(lines)
    for i, size in enumerate(sizes):
        length, links = sum(sizes[i : i + window]), sum(linked[i : i + window])
        open_.append(length > 0 and (links <= share * length or not dense[i] and size - linked[i] >= surge))
        plain.append(length - links)
        if all(dense[i : i + window]) and i + window <= len(lines):
            menu[i : i + window] = [True] * window
    kept = [False] * len(lines)
    for a, b in _runs(open_):
        if max(plain[a:b]) < surge:
            continue
        b = min(b + window - 1, len(lines))
        while a < b and (dense[a] and menu[a] or not sizes[a]):
            a += 1
        while a < b and (dense[b - 1] and menu[b - 1] or not sizes[b - 1]):
            b -= 1
        kept[a:b] = [True] * (b - a)
    return [text for (text, _, aside), k in zip(lines, kept) if k and not aside]


def main_text(html: str | None, words: bool = True) -> str:
    """The text of a page. Without `words` the names of elements, classes, ids and roles say
    nothing, and the windows alone decide what is aside."""
    lines = lines_of(html or "", words)
    marked = any(article and not aside for _, _, article, aside in lines)
    surge = SURGE_OUTSIDE
    if not marked:  # little text may be all there is
        plain = [0 if aside else len(t) - n for t, n, _, aside in lines]
        surge = min(SURGE, max(1, max((sum(plain[i : i + WINDOW]) for i in range(len(plain))), default=1)))
    texts = []
    for article, part in itertools.groupby(lines, key=lambda line: marked and line[2]):
        limits = (1, LINK_SHARE_ARTICLE) if article else (surge, LINK_SHARE)
        texts += _kept([(t, n, aside) for t, n, _, aside in part], article, *limits)
    return "\n\n".join(texts or [text for text, _, article, aside in lines if article and not aside])


def extract_articles(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text.

    Line-block distribution. Markup is stripped to one line per block element; character
    references are decoded and white space inside a line becomes one space. Text and linked
    text are summed over sliding windows of three lines; lines that their element or its
    class says are menus, headers, footers, side bars, notices, adverts, forms, reader
    comments and the like have no density. A window of mostly links is empty; the text between each surge and the next
    dive is kept when a window of it holds 40 characters without links, however long
    other stretches are. An article mark only moves the thresholds: inside, a window is
    empty from a share of links of 0.9 in place of 0.6, and any text without links is a
    surge, ids and headings say nothing about what is aside, and linked lines of 60
    characters are references; outside, 160 characters are a surge. Windows do not span the
    border. On a page
    that never reaches 40 the fullest window is the threshold, and an article of links
    alone is kept. Lines are joined by an empty line, in page order.

    A null or empty html gives an empty text. Unclosed tags end with what holds them; an
    article after an unclosed menu or advert is one all the same.
    Repeated rows are rows of their own. An empty table gives no rows. Other columns are
    not looked at.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page_id, url)}

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(page_id, url, html).mapInArrow(
        extract, f"page_id {kinds[page_id]}, url {kinds[url]}, text string"
    )
