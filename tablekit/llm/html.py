"""Main-text extraction (operator 8) from HTML by text-to-tag ratios.

The standard library's parser streams its events into lines: a block-level tag starts a new
line. Every line has a text-to-tag ratio, the characters of its text over the number of its
tags; text that the markup itself names as something else (``nav``, ``aside``, an element of
class ``ad``, a form, ...) counts as none. A class or id is the weakest of these signs: it
does not count for an element around an ``article`` or ``main`` or, where there are none,
around most of the page's text, but for readers' comments. End tags left out are implied as the standard has it. The ratios are smoothed along the page with a
Gaussian, and a threshold between two clusters of the smoothed values tells content lines
from the rest. Where ``article`` or ``main`` elements hold half of the content lines' text or
more, the region runs from the first line of the first of them to the last line of the last
one. Else it is the innermost element that all content lines share, with the lines that stand
directly in an element around it. The result is the region's text: all its lines but those
that the markup names as something else and, outside of ``article`` and ``main`` and of the
span from the first to the last content line, menus (three or more link-only lines in a row).

Defined cases: null and empty html give the empty text; a page without content lines gives
the empty text; markup that is cut off ends with the page; other columns pass through.
"""

from __future__ import annotations

import math
from html.parser import HTMLParser

from pyspark.sql import DataFrame

ROWS_AT_ONCE = 256
#: Width of the smoothing in lines.
SIGMA = 1.0
#: Share of the page's text from which on an element is its frame, whatever its name.
FRAME_SHARE = 0.75
#: Share of the content's characters that the article and main elements must hold to be the region.
ARTICLE_SHARE = 0.5
MENU_LINES = 3

# Fixed values of HTML: element kinds by their names in the standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
    "hr", "html", "legend", "li", "main", "menu", "nav", "noscript", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "title", "tr", "ul",
}
CONTAINER = {"html", "body", "main", "article", "section", "div", "table", "tbody", "tr", "td", "center", "blockquote"}
NOT_TEXT = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "head", "title"}
HEAD = {"base", "basefont", "bgsound", "link", "meta", "noscript", "script", "style", "template", "title"}
NOT_ARTICLE = {"nav", "menu", "footer", "aside", "form", "dialog", "button", "select", "textarea", "input", "fieldset", "datalist"}
NOT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of class and id values that name something else than the article.
NOT_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "topbar",
    "header", "masthead", "footer", "sidebar", "aside", "widget", "widgets", "related", "recommended", "recommendations", "share", "sharing", "social",
    "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "login", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion",
}
#: Parts that turn a name around, or make it speak of the layout.
TURNS = {"no", "not", "non", "without", "with", "has", "free", "layout"}
#: Names of what readers write: such an element stays out however long it is.
READERS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "discussion"}
# Fixed values of HTML: which open elements a start tag ends, and which elements hide them from it.
ENDS_P = BLOCK - {"body", "caption", "dd", "dt", "frameset", "head", "html", "legend", "li", "noscript", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "tr": ({"tr", "caption"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
SCOPE = {"html", "table", "td", "th", "caption", "button", "object", "template"}


def _named(attrs: dict) -> set[str]:
    """Words by which class and id name something else than the article. Names with a part
    that turns them around (``no-sidebar``, ``has-related``, ``ad-free``) give none."""
    out = set()
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = set("".join(c.lower() if c.isalnum() else " " for c in name).split())
        if not parts & TURNS:
            out |= parts & NOT_NAMES
    return out


class Lines(HTMLParser):
    """Collects (text, tags, link characters, path, excluded) per line; a path lists the
    numbers of the containers around it. ``around`` lists for each line the numbers of the
    named elements around it; ``frames`` tells which of these leave their lines in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...], bool]] = []
        self.kind: list[str] = []  # tag of each container, by its number
        self.open: list[tuple[str, int, int, int, int]] = []  # tag; excluded, no text, containers, named elements before
        self.named: list[int] = []  # open elements whose names exclude them
        self.readers: list[bool] = []  # of every named element: written by readers
        self.holding: set[int] = set()  # named elements around an article or main element
        self.around: list[tuple[int, ...]] = []
        self.path: list[int] = []
        self.out = self.mute = self.links = 0
        self.inside = 0  # open article and main elements
        self.text: list[str] = []
        self.tags = self.linked = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            self.lines.append((text, self.tags, min(self.linked, len(text)), tuple(self.path), self.out > 0))
            self.around.append(tuple(self.named))
        self.text.clear()
        self.tags = self.linked = 0

    def _excluded(self, tag: str, attrs: dict) -> bool:
        if tag in NOT_ARTICLE or tag == "header" and not self.inside:
            return True
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True
        return tag not in ("html", "body", "main", "article") and (attrs.get("role") or "").lower() in NOT_ROLES

    def _close_head(self) -> None:
        """The body, another flow element or text ends a head whose end tag is left out."""
        self._end_line()
        self._pop(max(i for i, x in enumerate(self.open) if x[0] == "head"))

    def handle_starttag(self, tag, attrs):
        if self.open and (self.open[-1][0] == "head" and tag not in HEAD or tag == "body" and any(x[0] == "head" for x in self.open)):
            self._close_head()
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCK:
            self._end_line()
        self._imply_ends(tag)
        self.tags += 1
        if tag in VOID:
            return
        attrs = dict(attrs)
        self.open.append((tag, self.out, self.mute, len(self.path), len(self.named)))
        if tag in CONTAINER:
            self.path.append(len(self.kind))
            self.kind.append(tag)
        if tag in ("article", "main"):
            self.inside += 1
            self.holding.update(self.named)
        elif tag not in ("html", "body") and (names := _named(attrs)):
            self.named.append(len(self.readers))
            self.readers.append(bool(names & READERS))
        self.out += self._excluded(tag, attrs)
        self.mute += tag in NOT_TEXT
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _imply_ends(self, tag: str) -> None:
        """End the elements whose end tag may be left out before this start tag."""
        if tag in ENDS_P:
            self._close({"p"}, SCOPE)
        if tag in ENDS:
            self._close(*ENDS[tag])

    def _close(self, ends: set[str], scope: set[str]) -> None:
        """End the innermost open element of ``ends``, and what stands open in it, unless one
        of ``scope`` is met before."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in ends:
                self._pop(i)
                return
            if self.open[i][0] in scope:
                return

    def _pop(self, i: int) -> None:
        for tag, *_ in self.open[i:]:
            self.links -= tag == "a"
            self.inside -= tag in ("article", "main")
        _, self.out, self.mute, n, m = self.open[i]
        del self.path[n:], self.named[m:], self.open[i:]

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self._end_line()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._close_head()
        if not self.mute:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def close(self):
        super().close()
        self._end_line()
        frames = self.frames()
        self.lines = [(*x[:4], x[4] or not frames.issuperset(a)) for x, a in zip(self.lines, self.around)]

    def frames(self) -> set[int]:
        """Named elements that are the page's frame: those around an article or main element,
        or, on pages without these, those that hold ``FRAME_SHARE`` of the text that no reader
        wrote."""
        mass = dict.fromkeys(range(len(self.readers)), 0)
        total = 0
        for (text, _, linked, _, out), around in zip(self.lines, self.around):
            if not out and not any(self.readers[i] for i in around):
                total += len(text) - linked
                for i in around:
                    mass[i] += len(text) - linked
        marked = any(tag in ("article", "main") for tag in self.kind)
        return {i for i, m in mass.items() if not self.readers[i] and (i in self.holding or not marked and m > FRAME_SHARE * total)}


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; at the ends the weights that remain are scaled up."""
    reach = math.ceil(3 * sigma)
    weight = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(weight[j - i + reach], values[j]) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def threshold(values: list[float]) -> float:
    """Between two clusters of the values: the mid of their means, until it stays."""
    low, high = min(values), max(values)
    cut = (low + high) / 2
    for _ in range(50):
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not below or not above:
            break
        new = (sum(below) / len(below) + sum(above) / len(above)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def _shared(paths: list[tuple[int, ...]]) -> tuple[int, ...]:
    """The containers that all of the paths begin with."""
    low, high = min(paths), max(paths)
    n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return low[:n]


def _region(lines: list, kind: list[str], content: list[int]) -> tuple:
    """First and last line of the outermost article and main elements with content lines;
    nothing where they do not hold ``ARTICLE_SHARE`` of its text."""
    outer = [next((c for c in x[3] if kind[c] in ("article", "main")), None) for x in lines]
    mass = {i: len(lines[i][0]) - lines[i][2] for i in content}
    held = {outer[i] for i in content} - {None}
    if not held or sum(m for i, m in mass.items() if outer[i] in held) < ARTICLE_SHARE * sum(mass.values()):
        return None, None
    at = [i for i, c in enumerate(outer) if c in held]
    return at[0], at[-1]


def main_text(html: str | None) -> str:
    """The text of the content region of one page, a line per block."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines, kind = parser.lines, parser.kind
    ratio = [math.log1p(0 if out else (len(text) - linked) / max(tags, 1)) for text, tags, linked, _, out in lines]
    if not any(ratio):
        return ""
    smooth = smoothed(ratio)
    cut = threshold(smooth)
    content = [i for i, x in enumerate(lines) if ratio[i] and (smooth[i] > cut or smooth[i] == max(smooth))]
    if not content:
        content = [max(range(len(lines)), key=ratio.__getitem__)]
    first, last = _region(lines, kind, content)
    if first is None:
        shared = _shared([lines[i][3] for i in content])
        inside = [shared[: len(x[3])] == x[3] or x[3][: len(shared)] == shared for x in lines]
        first, last = content[0], content[-1]
    else:
        inside = [first <= i <= last for i in range(len(lines))]
    kept = [i for i, x in enumerate(lines) if inside[i] and not x[4] and x[0]]
    out, i = [], 0
    while i < len(kept):
        j = i
        while j < len(kept) and not first <= kept[j] <= last and lines[kept[j]][2] * 10 >= len("".join(lines[kept[j]][0].split())) * 9:
            j += 1
        if j - i < MENU_LINES:
            out += [lines[k][0] for k in kept[i : max(j, i + 1)]]
        i = max(j, i + 1)
    return "\n".join(out)


def extract(df: DataFrame, html_col: str = "html", out: str = "main_text") -> DataFrame:
    """Replace ``html_col`` by ``out``, the main text of each page."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    names = [c for c in df.columns if c not in (html_col, out)]
    schema = StructType([*(df.schema[c] for c in names), StructField(out, StringType(), False)])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                b = whole.slice(at, ROWS_AT_ONCE)
                texts = [main_text(h) for h in b.column(b.schema.get_field_index(html_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(texts, pa.string())], [*names, out])

    return df.mapInArrow(run, schema)
