"""Columns read from captured HTML pages."""

from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from guestlens.functions import page_texts
from guestlens.functions.text import null_to_empty, strip

# A tag body in which quoted values may hold '>'. A quote opens a value only after '='.
_ATTRS = r"""(?:[^>=]++|=\s*+"[^"]*"|=\s*+'[^']*'|=(?!\s*["']))*+"""

# Schema.org types that name a hotel, and the words a script must
# contain to be looked at.
HOTEL_TYPES = ["Hotel", "LodgingBusiness", "Resort", "Hostel"]
SCRIPT_WORDS = ["Hotel", "LodgingBusiness"]

# Fixed value: text removed from page titles.
TITLE_NOISE = "Updated Prices"

# Pages without any of these strings are never sent to Python.
NAME_MARKS = [v for rule in page_texts.NAME_ELEMENTS.values() for _, _, v in rule]
HEAD_MARKS = [v for rule in (page_texts.NAME_ELEMENTS | page_texts.COUNT_ELEMENTS).values() for _, _, v in rule]
REVIEW_MARKS = [v for _, _, v in page_texts.REVIEW_ITEM]
LINK_MARKS = [v for _, _, v in page_texts.HOTEL_LINKS + page_texts.HOTEL_LINK_PARENT]


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_FOUND = (
    _strings("error")
    .add("records", T.ArrayType(_strings(*page_texts.REVIEW_FIELDS)))
    .add("errors", T.ArrayType(T.StringType()))
)
_HEAD = _strings("error", *page_texts.NAME_ELEMENTS, "count_sidebar").add("count_links", T.ArrayType(T.StringType()))
_LINKS = _strings("error").add("hrefs", T.ArrayType(T.StringType()))


def _if_marked(html: Column, marks: list[str]) -> Column:
    found = F.lit(False)
    for mark in dict.fromkeys(marks):
        found = found | html.contains(mark)
    return F.when(found, html)


# Bytes of page text whose findings a worker holds as Python objects at a time.
_BLOCK = 1 << 20


def _in_blocks(pages: pa.Array, form: T.StructType, read: Callable[[str | None], tuple]) -> Iterator[pa.Array]:
    """What `read` gives for each page, a tuple in the order of `form`, as Arrow arrays. Pages
    are made Python texts one at a time, and findings become Arrow values block by block, so
    that a worker holds little more than the bytes of a batch."""
    kind, rows, held = to_arrow_type(form), [], 0
    for page in pages:
        text = page.as_py()
        rows.append(dict(zip(form.names, read(text))))
        held += page.as_buffer().size if text is not None else 0
        if held >= _BLOCK:
            yield pa.array(rows, kind)
            rows, held = [], 0
    yield pa.array(rows, kind)


@F.arrow_udf(_FOUND)
def _review_blocks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def read(page):
        try:
            return (None, *(page_texts.review_records(page) if page is not None else ([], [])))
        except Exception as e:  # a bad page becomes a reject, not a failed job
            return f"{type(e).__name__}: {e}", [], []

    for html in batches:
        yield from _in_blocks(html, _FOUND, read)


@F.arrow_udf(_HEAD)
def _head_texts(html: pa.Array) -> pa.Array:
    empty = page_texts.head_texts("")

    def read(page):
        error, found = None, empty
        try:
            found = page_texts.head_texts(page) if page is not None else empty
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
        return error, *(found[name] for name in _HEAD.names[1:])

    return pa.concat_arrays(list(_in_blocks(html, _HEAD, read)))


@F.arrow_udf(_LINKS)
def _hotel_hrefs(html: pa.Array) -> pa.Array:
    def read(page):
        try:
            return None, page_texts.hotel_hrefs(page) if page is not None else []
        except Exception as e:
            return f"{type(e).__name__}: {e}", []

    return pa.concat_arrays(list(_in_blocks(html, _LINKS, read)))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unescape(t) if t is not None else None)


def review_blocks(html: Column) -> Column:
    """struct(error, records, errors): texts of the review elements of a page in page
    order, why the page failed, and why single elements did."""
    return _review_blocks(_if_marked(html, REVIEW_MARKS))


def head_texts(html: Column) -> Column:
    return _head_texts(_if_marked(html, HEAD_MARKS))


def name_texts(html: Column) -> Column:
    """As `head_texts`, for the name alone: only pages without a name in JSON-LD or
    og:title are read, and of those only the ones with a mark of a name element."""
    undecided = json_ld_name(html).isNull() & og_title(html).isNull()
    return _head_texts(_if_marked(F.when(undecided, html), NAME_MARKS))


def hotel_hrefs(html: Column) -> Column:
    """struct(error, hrefs): link targets of the result cards, as written."""
    # Deterministic functions are pasted into the filters that Spark infers, and pages read twice.
    return _hotel_hrefs.asNondeterministic()(_if_marked(html, LINK_MARKS))


def unescape_entities(text: Column) -> Column:
    """Character references decoded; only texts with an ampersand leave the JVM."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the text of one tag, '' when absent."""
    # from the start over whole attributes, so that values that look like one are skipped
    before = r"""^<[A-Za-z][^\s>]*(?:\s+(?!""" + name + r"""\s*=)[^\s=>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?)*+"""
    quoted = rf"""(?i){before}\s+{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""
    return F.concat(*(F.regexp_extract(tag, quoted, i) for i in (1, 2, 3)))


def anchor_hrefs(html: Column, tag_pattern: str = "") -> Column:
    """Non-empty hrefs of the anchors whose tag matches `tag_pattern`, as written, in page order."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?i)<a(?=\s){_ATTRS}>"), F.lit(0))
    if tag_pattern:
        tags = F.filter(tags, lambda t: t.rlike(tag_pattern))
    hrefs = F.transform(tags, lambda t: F.trim(attribute(t, "href")))
    return F.filter(hrefs, lambda h: h != "")


def _without_dots(url: Column) -> Column:
    """Dot segments of the path resolved; only urls that have one are taken apart."""
    pattern = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)(/[^?#]*)(.*)$"
    segments = F.split(F.substring(F.regexp_extract(url, pattern, 2), F.lit(2), F.length(url)), "/")

    def step(path: Column, segment: Column) -> Column:
        up = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", path).otherwise(F.array_append(path, segment))

    none = F.array().cast("array<string>")
    path = F.array_join(F.aggregate(segments, none, step), "/")
    last = F.element_at(segments, -1)
    closed = F.when(last.isin(".", "..") & (path != ""), "/").otherwise("")  # a folder stays one
    whole = F.concat(F.regexp_extract(url, pattern, 1), F.lit("/"), path, closed, F.regexp_extract(url, pattern, 3))
    dotted = url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(?:/[^?#]*)?/\.\.?(?:[/?#]|$)")
    return F.when(dotted, whole).otherwise(url)


def resolve_href(href: Column, page_url: Column) -> Column:
    """Absolute form of a decoded link, dot segments resolved, as a browser reports it."""
    return _without_dots(_absolute(F.trim(href), F.coalesce(page_url, F.lit(""))))


def _absolute(href: Column, page_url: Column) -> Column:
    scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    origin = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_extract(page_url, r"^([^?#]*)", 1)
    no_fragment = F.regexp_extract(page_url, r"^([^#]*)", 1)
    folder = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/(?:[^?#]*/)?)", 1)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), href))
    )


def json_ld_name(html: Column) -> Column:
    """Name of the first hotel item in the JSON-LD scripts.

    Scripts are read in order; one that is no valid JSON ends the search, what came
    before it still counts. A script may hold one item or a list.
    """
    opening = rf"(?is)<script(?=\s){_ATTRS}>"
    every = F.regexp_extract_all(F.when(html.contains("ld+json"), html), F.lit(rf"{opening}.*?</script"), F.lit(0))
    typed = F.filter(every, lambda s: F.lower(attribute(s, "type")) == "application/ld+json")
    scripts = F.filter(
        F.transform(typed, lambda s: F.regexp_extract(s, rf"{opening}(.*)</script$", 1)),
        lambda s: s.contains(SCRIPT_WORDS[0]) | s.contains(SCRIPT_WORDS[1]),
    )

    def first_name(s: Column) -> Column:
        doc = F.try_parse_json(s)
        items = F.coalesce(F.try_variant_get(doc, "$", "array<variant>"), F.array(doc))
        names = F.transform(
            F.filter(items, lambda i: F.try_variant_get(i, '$["@type"]', "string").isin(HOTEL_TYPES)),
            lambda i: F.try_variant_get(i, "$.name", "string"),
        )
        named = F.filter(names, lambda n: n != "")
        return F.struct(doc.isNull().alias("bad"), F.get(named, F.lit(0)).alias("name"))

    outcome = F.filter(F.transform(scripts, first_name), lambda o: o["bad"] | o["name"].isNotNull())
    return F.get(outcome, F.lit(0))["name"]


def og_title(html: Column) -> Column:
    """Content of the first og:title tag up to the first comma.

    Null when the tag is missing or empty; '' when the content starts with a comma.
    """
    tags = F.regexp_extract_all(F.when(html.contains("og:title"), html), F.lit(rf"(?i)<meta(?=\s){_ATTRS}>"), F.lit(0))
    first = F.get(F.filter(tags, lambda t: attribute(t, "property") == "og:title"), F.lit(0))
    content = unescape_entities(attribute(first, "content"))
    return F.when(content != "", strip(F.split_part(content, F.lit(","), F.lit(1))))


def page_title(html: Column) -> Column:
    raw = F.regexp_extract(html, rf"(?is)<title(?:\s{_ATTRS})?>(.*?)</title", 1)
    return strip(F.regexp_replace(unescape_entities(raw), r"[ \t\r\n\f]+", " "))


def clean_title(title: Column, site_marker: str | None = None) -> Column:
    """Title before the marker of the site, without noise text and trailing dashes."""
    if site_marker:
        title = F.split_part(title, F.lit(site_marker), F.lit(1))
    return strip(F.regexp_replace(strip(F.replace(title, F.lit(TITLE_NOISE), F.lit(""))), "-+$", ""))


def hotel_name(html: Column, head: Column, site_marker: str | None = None) -> Column:
    """Name of the hotel of a page: JSON-LD, og:title, id, headings, then the title.

    `head` is the column made by `name_texts(html)` or `head_texts(html)`.
    """
    elements = ["name_by_id", "name_header", "name_testid", "name_class"]
    return F.coalesce(
        json_ld_name(html),
        og_title(html),
        *(F.when(head[e] != "", head[e]) for e in elements),
        clean_title(null_to_empty(page_title(html)), site_marker),
    )


def expected_count(head: Column) -> Column:
    """Number of reviews a hotel page announces; 0 when it announces none.

    First link text with a number in parentheses, else the first number of the sidebar.
    At most one separator is understood, and it is dropped: `4.5` reads 45.
    """
    in_parens = r"\((\d+[.,]?\d*)\)"
    link = F.get(F.filter(head["count_links"], lambda t: t.rlike(in_parens)), F.lit(0))
    number = F.coalesce(
        F.regexp_extract(link, in_parens, 1),
        F.regexp_extract(head["count_sidebar"], r"(\d+[.,]?\d*)", 1),
        F.lit(""),
    )
    return F.coalesce(F.regexp_replace(number, "[.,]", "").try_cast("bigint"), F.lit(0))
