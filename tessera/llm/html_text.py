"""HTML extraction: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks (cut at block-level tags). A block's
features are its word count and link density, those of the blocks before and
after it, whether it is a heading, and the place it stands in, where the markup
says so (article or main, or page furniture by element name or by a word of its
class, id or role). A decision tree, grown from the small labelled table
``LABELLED`` by Gini impurity, tells main text from the rest; where the markup
says nothing, the neighbours decide. Elements that never hold text of an article
(scripts, styles, buttons, ...) make no blocks; a form's blocks are furniture
where no article, main or long paragraph is in it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose whole content is dropped.
DROPPED = frozenset("script style noscript template head title svg math iframe object select textarea button audio video canvas dialog".split())
#: Of these, elements whose content is raw text up to their own end tag.
RAW = frozenset("script style noscript template title svg math iframe textarea".split())
FURNITURE = frozenset("nav footer aside menu".split())
BODY = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = BODY | FURNITURE | HEADING | frozenset(
    "address blockquote body center caption dd details div dl dt fieldset figcaption figure form header hgroup hr html legend "
    "li ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that the place of a block is read from; the others' place ends at the next block-level tag.
PLACES = BODY | FURNITURE | frozenset("header section div ul ol li table tr td th dl dd dt body html blockquote figure details fieldset form".split())
#: Open elements that a start tag ends, the innermost first.
_IMPLIED = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
FURNITURE_WORD = re.compile(
    r"(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|outbrain|taboola|banner|nav\w*|\w+nav|menu\w*|breadcrumb\w*|sidebar|side|footer|foot|masthead|header|"
    r"cookie\w*|consent|notices?|notification\w*|alert\w*|gdpr|paywall|popup|overlay|modal|newsletter|subscri\w*|signup|login|search|share|sharing|social|"
    r"related|recommend\w*|trending|popular|comment\w*|discussions?|disqus|reviews|repl(?:y|ies)|respond|widget|pager|pagination|\w+bar|copyright|legal|"
    r"complementary|contentinfo|tooltip)")
BODY_WORD = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body)(?:$|[\s_-])")
#: First parts of compounds that say what a page has (has-sidebar), not what an element is.
_STATE = frozenset("has no with without is show hide hidden".split())
#: Furniture words that also name the layout or a part of body text in compounds (content-sidebar, entry-header).
_LAYOUT = re.compile(r"side|sidebar\w*|header|head")
#: Last parts of compounds that say nothing (nav-wrapper).
_BOX = frozenset("wrap wrapper container inner outer box block area list links section bar slot unit item items thread".split())
#: Last parts that name the inside of what the first part names (comment-body).
_INSIDE = frozenset("content body text main".split())
#: A quoted value may hold anything if white space, / or > follows it; else its quote was never closed, and the tag ends at the next >.
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|=)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S)
_TAG = {name: re.compile(f"<(/?){name}(?=[\\s/>])", re.I) for name in DROPPED | {"a"}}
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?=\s|/|=|$)|display\s*:\s*none", re.I)
_HINT = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NO_PLACE, _BODY, _FURNITURE = 0, 1, 2
#: Furniture by a hint outside of body text, in which article and main still begin body text; dropped.
_HINTED, _DROP = 3, 4
#: Words outside links that make a paragraph of a form a long one.
LONG = 25


def _furniture_token(token: str) -> bool:
    """Whether a class, id or role names furniture as a whole: by one word, or by a
    compound that ends in one (site-footer) and does not speak of the body."""
    parts = [x for x in re.split(r"[_-]+", token) if x]
    if len(parts) < 2:
        return bool(parts) and FURNITURE_WORD.fullmatch(parts[0]) is not None
    if parts[0] in _STATE:
        return False
    if parts[-1] in _INSIDE and parts[0] not in ("head", "header") and FURNITURE_WORD.fullmatch(parts[0]):
        return True
    body = any(BODY_WORD.fullmatch(x) for x in parts)
    while not body and len(parts) > 1 and (parts[-1] in _BOX or parts[-1].isdigit()):
        parts = parts[:-1]
    return FURNITURE_WORD.fullmatch(parts[-1]) is not None and not (body and _LAYOUT.fullmatch(parts[-1]))


def _place(name: str, attributes: str, around: int) -> int:
    """The place of an element inside one of place ``around``."""
    if around == _FURNITURE or name in FURNITURE:
        return _FURNITURE
    if name in BODY and around != _BODY:
        return _BODY
    if around == _HINTED:
        return _HINTED
    if name == "header":
        return around if around == _BODY else _HINTED
    if attributes and name not in ("body", "html") and _HIDDEN.search(attributes):
        return _FURNITURE
    words = " ".join(x for m in _HINT.findall(attributes) for x in m if x).lower() if attributes else ""
    if name not in ("body", "html") and words and any(map(_furniture_token, words.split())):
        return _FURNITURE if around == _BODY else _HINTED
    if name in BODY or words and BODY_WORD.search(words):
        return _BODY
    return around


def blocks(page: str | None) -> list[tuple[str, int, int, int, int]]:
    """``(text, words, link words, place, heading)`` of the page's text blocks, in order."""
    page = page or ""
    out, parts, linked = [], [], []
    stack, open_, dropped, at, end = [("", _NO_PLACE)], Counter(), 0, 0, len(page)
    own, heading = None, 0  # place and kind of the innermost element that is not on the stack
    link = ""  # of the open link: where it ends, at its end tag or (without one) with its block
    form = None  # of the open form: its first block, and whether it holds an article or main
    endless = set()  # names without another end tag

    def close():
        nonlocal own, heading, link
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                inside = len(entities.unescape(" ".join(linked)).split()) if linked else 0
                n = text.count(" ") + 1
                out.append((text, n, min(n, inside), min(stack[-1][1] if own is None else own, _FURNITURE), heading))
            parts.clear()
            linked.clear()
        own, heading = None, 0
        if link == "block":
            link = ""

    def take(text):
        if text and not dropped:
            parts.append(text)
            if link:
                linked.append(text)

    def end_form():
        nonlocal form
        first, holds = form
        form = None
        if not holds and all(b[1] - b[2] < LONG for b in out[first:]):
            out[first:] = [(*b[:3], _FURNITURE, b[4]) for b in out[first:]]

    def enter(name, place):
        nonlocal dropped
        stack.append((name, place))
        open_[name] += 1
        dropped += place == _DROP

    def leave(name):
        """Closes the innermost open element of that name and all inside it."""
        nonlocal dropped
        while open_[name]:
            gone, place = stack.pop()
            open_[gone] -= 1
            dropped -= place == _DROP
            if gone == "form" and form:
                end_form()
            if gone == name:
                break

    while at < end:
        m = _PIECE.search(page, at)
        if not m:
            take(page[at:])
            break
        take(page[at:m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            if m.group().startswith("<![CDATA["):
                take(m.group()[9:].removesuffix("]]>"))
            continue
        opening, attributes = not m.group(1), m.group(3) or ""
        if name in RAW and opening and not attributes.endswith("/"):
            stop = name not in endless and re.compile(f"</{name}\\s*>", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif name in ("script", "style"):
                at = end
            else:  # never closed: read on
                endless.add(name)
            continue
        if name in DROPPED:
            close()
            if not opening:
                leave(name)
            elif (m := _TAG[name].search(page, at)) and m.group(1):  # else it is never closed: read on
                enter(name, _DROP)
            continue
        if name == "body" and opening:
            leave("head")
        if dropped:  # its elements are followed so that the end of one around it is seen
            if name in PLACES:
                if opening:
                    enter(name, stack[-1][1] if stack[-1][1] != _DROP else _NO_PLACE)
                else:
                    leave(name)
            continue
        if name == "a":
            link = ""
            if opening and _HREF.search(attributes):
                after = _TAG["a"].search(page, at)
                link = "tag" if after and after.group(1) else "block"
        elif name in ("br", "img", "input"):
            take(" ")
        elif name in BLOCK:
            close()
            if name not in PLACES:
                if opening:
                    heading = int(name in HEADING)
                    if attributes:
                        own = _place(name, attributes, stack[-1][1])
            elif not opening:
                leave(name)
            elif name != "form" or not form:
                while stack[-1][0] in _IMPLIED.get(name, ()):
                    leave(stack[-1][0])
                enter(name, _place(name, attributes, stack[-1][1]))
                if name == "form":
                    form = (len(out), False)
                elif form and name in BODY:
                    form = (form[0], True)
    close()
    if form:
        end_form()
    return out


FEATURES = ("place", "words", "links", "words before", "links before", "words after", "links after", "heading")


def features(found: list[tuple]) -> list[tuple[float, ...]]:
    shape = [(0.0, 0.0), *[(float(b[1]), b[2] / b[1]) for b in found], (0.0, 0.0)]
    return [(float(b[3]), *shape[i + 1], *shape[i], *shape[i + 2], float(b[4])) for i, b in enumerate(found)]


# ---------------------------------------------------------------- the tree

def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 3):
    """A decision tree with ``least`` rows a leaf: True, False or (feature, threshold, at most, above)."""
    best = None
    if depth and len(set(y.tolist())) > 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) < least:
                    continue
                impurity = sum(s.sum() * (p := y[s].mean()) * (1 - p) for s in (left, ~left))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(cut), left)
    if best is None:
        return bool(y.mean() > 0.5)
    _, f, cut, left = best
    return f, cut, grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)


def decide(tree, x: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return tree


#: Labelled pages, block by block: + main text or - not, words, /words in links, then
#: b in an article or main, f in furniture, h a heading.
LABELLED = (
    # Pages whose markup tells the places
    "-1/1f -2/2f -9f +8bh +60b +4b +25b -14f",
    "-3f +5bh +2b +120/3b +4/4b +6b -30f -40f",
    "-35f +7bh +45b +1b -3/3f -22f",
    "-1/1f -1/1f +6bh +3b +3/3b +18/9b +52b -11/11f -7f",
    "+1b -90f -5/5f",
    "-3/3f +30b +5b",
    "+3b",
    "+15/5b +6/6b +6/3b +2/2b +8/8b",
    "+9bh +12/12b +71/1b +1/1b",
    "-64f -28f +44 -50f",
    "-3/3f +4bh +65b -12f",
    "-13/1f +10/10b +14b -2/2f",
    "-5f +40b -20f +35b -2/2f",
    "-2f -4/4f +7h +48 +3 +52 -16f -3/3f",
    # Links before and after, titles, short paragraphs between long ones
    "-1/1 -2/2 -1/1 +55 +70 +18 -6/4 -6/3",
    "-1/1 -1/1 -1/1 +7h +60 +45 +3 +80 -4/4 -6/6",
    "-2/2 -4 -3/3 +82/2 +34 +2",
    "-2 -10/10 +8h +90 +3 +65 +110/4 -12/10 -5",
    "-20/18 +6h +18 +5 +25 -15/13",
    "-1/1 -1/1 +5 +47 +2 +38 -1/1 -1/1",
    "-3/3 +4 +22 +3 +31/2 -5/5",
    "-2/2 +45 -4/4 -3/3",
    "-1/1 -3/3 +36 +7/1 +41 -9/9",
    # Site names, section headings over links, lines among and below links
    "-4 -1/1 -1/1 -2/2 +9h +50 +2 +70 -2h -8/8 -7/7 -9/9 -6",
    "-3 -5/5 +6h +4 +75 +30/2 +12 -3h -6/6 -5/5 -4",
    "-5/5 +8h +5 +4 +62 +3h +44 +2h +35 -2h -7/7 -3",
    "-2 -1/1 -1/1 +7h +3 +14 +66 -4h -9/9 -12/11 -5 -8",
    "-3h -4/4 -5/5 -2h -6/6 -4/4 -20 -3/3",
    "-1/1 -5 -2/2 -8 -3/3 +64 +27 -4/4 -18 -2/2",
    "-2/2 -9 -2/2 -12/2 -3/3 +58 +4 +49 -3/3 -22 -1/1 -7",
    "-6/6 +4h +28 +3h +33 +9 -1h -10/10 -2/2 -4 -6",
    "+50 +70 -3h -5/5 -6/6",
    "-4/4 -3 -4/4 -6 -2/2",
    # One paragraph below the links, up to the end of the page
    "-1/1 -2/2 +45",
    "-3/3 +33/1",
    "-2/2 -1/1 +80 +7",
    "-4/4 +6h +52 +8",
    "-1/1 -2/2 +28",
    # Links inside and after text
    "+30 +50 -24/24 -33/30 -16/16",
    "+40 +6 +90 +8 +28 -44/40 -2/2",
    "+25 +39/6 +19",
    "+50 +6/2 +40",
    "+46 -10/10 +61 +3 +22/7 -14/14",
    "+60/4 +35/5 +12/3 +48",
    # Text without any links, however short
    "+50",
    "+2",
    "+1",
    "+9",
    "+4 +3",
    "+3h +5",
    "+2 +6 +3 +2",
    "+7 +1 +4 +5 +2",
    "+5h +3 +40 +2 +35",
    "+5h +2 +60 +4 +3 +50",
    "+30 +4 +5 +3 +40 +6",
    "+6 +2 +35 +3 +20/2 +2",
    "+4h +16 +3h +21 +2",
)
_BLOCK = re.compile(r"([+-])(\d+)(?:/(\d+))?([bf]?)(h?)")


def labelled_blocks(page: str) -> tuple[list[tuple], list[bool]]:
    """A page of the labelled table as blocks without text, and its labels."""
    rows = [_BLOCK.fullmatch(x).groups() for x in page.split()]
    return [("", int(n), int(k or 0), " bf".index(place or " "), len(h)) for _, n, k, place, h in rows], [r[0] == "+" for r in rows]


def tree_of(labelled=LABELLED):
    x, y = [], []
    for page in labelled:
        found, labels = labelled_blocks(page)
        x += features(found)
        y += labels
    return grow(np.array(x), np.array(y))


def main_text(page: str | None, tree) -> str:
    found = blocks(page)
    return "\n\n".join(b[0] for b, x in zip(found, features(found)) if decide(tree, x))


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per input row.

    Null, empty and text-free pages give the empty text; unclosed and cut-off
    markup is read as far as it goes; repeated rows each have their row and
    null ids and urls stay null. Only page_id, url and html are read.
    """
    tree = tree_of()

    def kernel(batches):
        for b in batches:
            text = [main_text(x.as_py(), tree) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        kernel, "page_id long, url string, text string, n_chars long")
