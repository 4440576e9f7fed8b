"""Per-page helper: visible texts of a few fixed element patterns.

The only Python that touches page text. It answers which elements match and what
they say; everything built on the answers is DataFrame code.
"""

from html.parser import HTMLParser

# Element patterns of the captured pages, written tag, attribute, value.
# "class" means that the value is one of the class names of the element.
REVIEW_ITEM = [("*", "data-testid", "review"), ("li", "class", "review_item"), ("*", "class", "c-review-block")]
REVIEW_FIELDS = {
    "title": [("*", "data-testid", "review-title"), ("*", "class", "c-review-block__title")],
    "score": [("*", "data-testid", "review-score"), ("*", "class", "bui-review-score__badge")],
    "positive": [("*", "data-testid", "review-positive-text"), ("*", "class", "c-review__body--positive")],
    "negative": [("*", "data-testid", "review-negative-text"), ("*", "class", "c-review__body--negative")],
    "body": [("*", "class", "c-review-block__row")],
    "date": [("*", "data-testid", "review-date"), ("*", "class", "c-review-block__date")],
}
NAME_ELEMENTS = {
    "name_by_id": [("*", "id", "hp_hotel_name")],
    "name_header": [("h2", "class", "pp-header__title")],
    "name_testid": [("h2", "data-testid", "post-booking-header-title")],
    "name_class": [("*", "class", "hp__hotel-name")],
}
COUNT_ELEMENTS = {
    "count_link": [
        ("*", "data-testid", "review-score-link"),
        ("*", "class", "js-review-tab-link"),
        ("*", "data-tab-target", "htReviews"),
    ],
    "count_sidebar": [("*", "class", "bui-review-score__text"), ("*", "class", "d8eab2cf7f")],
}
HOTEL_LINKS = [
    ("a", "class", "e3859ef1a4"),
    ("a", "data-testid", "title-link"),
    ("a", "data-testid", "property-card-desktop-single-image"),
]
HOTEL_LINK_PARENT = [("*", "class", "c-property-card__title")]

# Element kinds of HTML that matter for nesting and line breaks.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = set(
    "address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6"
    " header hr li main nav ol p pre section table tr ul".split()
)
_UNSEEN = set("script style noscript template head title".split())

_SOURCE_BREAKS = "\t\r\n\f\v"


class _Element:
    def __init__(self, name, items):
        self.name, self.items = name, items
        self.parts, self.fields = [], {}

    def text(self):
        # \v stands for a line break of the layout; those of the source are spaces
        joined = "".join(self.parts)
        while "  " in joined:
            joined = joined.replace("  ", " ")
        lines = (line.strip(" ") for line in joined.split("\v"))
        return "\n".join(line for line in lines if line).strip()


class _Walker(HTMLParser):
    """Collects the elements that match `rules` in document order; those under the
    name `item` also collect the matches inside them."""

    def __init__(self, rules):
        super().__init__(convert_charrefs=True)
        self.names = list(rules)
        self.by_attribute = {}
        for name, rule in rules.items():
            for tag, attr, value in rule:
                self.by_attribute.setdefault((attr, value), []).append((tag, name))
        self.open = []  # (tag, elements started here)
        self.found = []
        self.live = []
        self.unseen = 0

    def matching(self, tag, attrs):
        hits = set()
        for attr, value in attrs.items():
            for part in (value or "").split() if attr == "class" else (value,):
                for want, name in self.by_attribute.get((attr, part), ()):
                    if want in ("*", tag):
                        hits.add(name)
        return [name for name in self.names if name in hits] if hits else hits

    def handle_starttag(self, tag, attr_list):
        if tag == "li":
            self._close_implied("li", {"ul", "ol"})
        if tag in _BLOCK:
            self._close_implied("p", {"div", "td", "button", "li"})
            self._break()
        if tag == "br":
            self._break()
        attrs = dict(reversed(attr_list))  # the first of repeated attributes counts
        items = [e for e in self.live if e.name == "item"]
        started = [_Element(name, items) for name in self.matching(tag, attrs)]
        self.found.extend(started)
        if tag in _VOID:
            return
        self.open.append((tag, started))
        self.live.extend(started)
        self.unseen += tag in _UNSEEN

    def handle_startendtag(self, tag, attrs):
        # HTML ignores the slash: only void elements end here
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        if self.live and not self.unseen:
            for blank in _SOURCE_BREAKS:
                data = data.replace(blank, " ")
            self._add(data)

    def _break(self):
        self._add("\v")

    def _add(self, text):
        for element in self.live:
            if element.name != "item":
                element.parts.append(text)

    def _pop(self):
        tag, started = self.open.pop()
        for element in started:
            self.live.remove(element)
        self.unseen -= tag in _UNSEEN
        if tag in _BLOCK:
            self._break()
        return tag

    def _close_implied(self, tag, fence):
        for open_tag, _ in reversed(self.open):
            if open_tag == tag:
                while self._pop() != tag:
                    pass
                return
            if open_tag in fence:
                return


def _walk(html, rules):
    walker = _Walker(rules)
    walker.feed(html)
    walker.close()
    return walker.found


def review_records(html):
    """One dict of texts per review element; the first match inside it counts. Also the
    errors of the elements that could not be read."""
    blocks = []
    for element in _walk(html, {"item": REVIEW_ITEM, **REVIEW_FIELDS}):
        if element.name == "item":
            blocks.append(element)
        for block in element.items:
            block.fields.setdefault(element.name, element)
    records, errors = [], []
    for block in blocks:
        try:
            texts = {name: element.text() for name, element in block.fields.items()}
        except Exception as e:  # drops this block only
            errors.append(f"{type(e).__name__}: {e}")
        else:
            records.append({name: texts.get(name, "") for name in REVIEW_FIELDS})
    return records, errors


def head_texts(html):
    """First text per name element and the sidebar count, all texts of the count links."""
    out = {name: None for name in (*NAME_ELEMENTS, "count_sidebar")}
    links = []
    for element in _walk(html, {**NAME_ELEMENTS, **COUNT_ELEMENTS}):
        if element.name == "count_link":
            links.append(element.text())
        elif out[element.name] is None:
            out[element.name] = element.text()
    return {**out, "count_links": links}


class _LinkWalker(_Walker):
    """Hrefs of anchors that match a link rule or lie inside a link parent."""

    def __init__(self):
        super().__init__({"link": HOTEL_LINKS, "parent": HOTEL_LINK_PARENT})
        self.hrefs = []

    def handle_starttag(self, tag, attr_list):
        inside = any(e.name == "parent" for e in self.live)
        before = len(self.found)
        super().handle_starttag(tag, attr_list)
        if tag == "a" and (inside or any(e.name == "link" for e in self.found[before:])):
            href = (dict(reversed(attr_list)).get("href") or "").strip()
            if href:
                self.hrefs.append(href)


def hotel_hrefs(html):
    """Link targets of the result cards as written, references decoded, in document order."""
    walker = _LinkWalker()
    walker.feed(html)
    walker.close()
    return walker.hrefs
