"""The main text of HTML pages from flat text blocks.

A page is cut into flat blocks at block-level tags. A block has its number of
words, its link density (linked words over words), the same two of the blocks
before and behind it, and where it stands: whether an element around it is named
as something beside the article, for sure or perhaps, within an article element, a
heading. A decision tree, grown once from the small labelled table below, keeps
or drops each block. Kept blocks stay whole and in page order.

Rows: null, empty and text-free pages give an empty text; a page that breaks
off is read to its end. Repeated rows stay. Extra columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by role.
RAW = "script|style|noscript|template|title|textarea|iframe|svg|canvas|select|datalist"
BLOCK = frozenset(
    "address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul video audio".split()
)
CONTAINER = frozenset(
    "article aside blockquote body button details dialog div dl fieldset figure footer form head header hgroup label li main menu nav ol section table td ul".split()
)
BOILER_TAG = frozenset("aside button dialog fieldset footer form head header label menu nav".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that name what is not article matter, and such as name it only alone.
BOILER_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs captcha comment comments consent contentinfo cookie cookies disqus footer gdpr"
    " login masthead nav navbar navigation newsletter pager pagination paywall popup promo promoted share sharing sidebar signup sitemap social sponsor sponsored"
    " subscribe subscription toolbar topbar widget widgets".split()
)
BOILER_ALONE = frozenset(
    "banner byline copyright disclaimer discuss feedback form header hidden menu modal notice notices notification overlay privacy promotion ratings recommended"
    " related replies reply responses search skip tags teaser tracking".split()
)
BOILER_START = ("advert", "breadcrumb", "comment", "cookie", "footer", "newsletter", "sidebar", "sponsor", "subscri")
ARTICLE_WORD = frozenset("article articlebody content entry main maintext post story text".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<empty>svg)\b[^>]*/>|<(?P<raw>{RAW})\b[^>]*(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</?[a-z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-z][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z0-9]+")
_NOT_ITS_OWN = re.compile(r"\b(?:with|without|has|no)[-_]\w+")


def _names(attributes: str) -> list[list[str]]:
    """The words of each class, id and role, without those that only say what is beside the element."""
    return [_WORDS.findall(one) for x in _NAMES.findall(attributes) for one in _NOT_ITS_OWN.sub(" ", "".join(x).lower()).split()]


def _name(names: list[list[str]], attributes: str) -> int:
    """2: named as something beside the article, or hidden. 1: one word of several might say so. 0: neither."""
    if _HIDDEN.search(attributes):
        return 2
    level = 0
    for words in names:
        sure = [w in BOILER_WORD or w.startswith(BOILER_START) for w in words]
        maybe = [w in BOILER_ALONE for w in words]
        if any(sure) or (words and all(maybe)):
            return 2
        level = max(level, int(any(maybe)))
    return level


FEATURES = ("words", "links", "words_before", "links_before", "words_behind", "links_behind", "name", "article", "heading")
_TEXT, _LINKS = ((3, 0.0), (12, 0.0), (45, 0.05)), ((2, 1.0), (6, 0.9))


def _case(label: int, words: tuple, links: tuple, before: tuple, behind: tuple, name: int, article: int, heading: int = 0) -> list[tuple]:
    """Labelled blocks: each number of words with each link density between each two neighbours."""
    return [(w, x, *a, *b, name, article, heading, label) for w in words for x in links for a in before for b in behind]


#: Labelled blocks: FEATURES, and whether the block is main text. Written for this table after common page layouts.
LABELLED = tuple(
    # in an article: paragraphs, list items and headings, of any length, at either end, and next to a link list
    _case(1, (1, 4, 15, 60), (0.0, 0.1), ((0, 0.0), *_TEXT), ((0, 0.0), *_TEXT), 0, 1)
    + _case(1, (1, 4, 15, 60), (0.0, 0.2), _LINKS, ((0, 0.0), *_TEXT), 0, 1) + _case(1, (1, 4, 15, 60), (0.0, 0.2), _TEXT, _LINKS, 0, 1)
    + _case(1, (2, 8), (0.0,), ((0, 0.0), *_TEXT, *_LINKS), _TEXT, 0, 1, 1)
    # a linked line is text where text is around it, and a list of links where links are; so is a label between links
    + _case(1, (3, 9, 30), (0.8, 1.0), _TEXT[1:], _TEXT[1:], 0, 1) + _case(1, (9, 25), (0.4,), ((0, 0.0), *_TEXT), ((0, 0.0), *_TEXT), 0, 1)
    + _case(0, (1, 4, 12, 30), (0.8, 1.0), _LINKS, (*_LINKS, *_TEXT, (0, 0.0)), 0, 1) + _case(0, (1, 4, 12, 30), (0.8, 1.0), (*_TEXT, (0, 0.0)), _LINKS, 0, 1)
    + _case(0, (1, 3), (0.0,), _LINKS, _LINKS, 0, 1) + _case(1, (14, 40), (0.0, 0.1), _LINKS, _LINKS, 0, 1) + _case(0, (2, 5), (0.9,), ((0, 0.0), (45, 0.05)), ((0, 0.0),), 0, 1)
    # in elements whose name might say so: text that reads on from the text around
    + _case(1, (14, 30, 80), (0.0, 0.1), _TEXT, ((0, 0.0), *_TEXT), 1, 1) + _case(1, (40,), (0.0,), _TEXT[1:], _TEXT[1:], 1, 0)
    + _case(0, (1, 3, 6), (0.0, 0.1), ((0, 0.0), *_TEXT), ((0, 0.0), *_TEXT), 1, 1) + _case(0, (3, 14, 30), (0.5, 0.9), _TEXT, (*_TEXT, *_LINKS), 1, 1)
    + _case(0, (3, 16, 30), (0.0, 0.1), _LINKS, _LINKS, 1, 1) + _case(0, (3, 8), (0.0, 0.5), ((0, 0.0), *_LINKS), ((0, 0.0), *_TEXT), 1, 0)
    # adverts, notices, forms, comments, footers, menus, named for sure
    + _case(0, (1, 8, 40, 150), (0.0, 0.1, 1.0), (_TEXT[2], _LINKS[0]), (_TEXT[0], _TEXT[2], _LINKS[0]), 2, 1) + _case(0, (1, 8, 40, 150), (0.0, 1.0), ((0, 0.0), _TEXT[2]), (_TEXT[1], _LINKS[1]), 2, 0)
    + _case(0, (3, 6), (0.0,), (_TEXT[2],), (_TEXT[1], (0, 0.0)), 2, 1, 1)
    # on pages without an article element: long blocks, and short ones next to long unlinked ones
    + _case(1, (20, 60, 250), (0.0, 0.2), ((0, 0.0), *_TEXT, *_LINKS), ((0, 0.0), *_TEXT, *_LINKS), 0, 0)
    + _case(1, (3, 6, 12), (0.0, 0.1), (_TEXT[2], (25, 0.0)), ((0, 0.0), *_TEXT), 0, 0) + _case(1, (2, 8), (0.0,), ((0, 0.0), *_TEXT, *_LINKS), (_TEXT[2], (30, 0.0)), 0, 0, 1)
    # and there: menus, labels, lines of a header or footer among short ones
    + _case(0, (1, 4, 12, 30), (0.8, 1.0), ((0, 0.0), *_LINKS), (*_LINKS, *_TEXT[:2], (0, 0.0)), 0, 0) + _case(0, (1, 4), (0.9,), (_TEXT[2],), (*_LINKS, (0, 0.0)), 0, 0)
    + _case(0, (2, 5, 8), (0.0, 0.3), ((0, 0.0), _TEXT[0], *_LINKS), ((0, 0.0), _TEXT[0], *_LINKS), 0, 0) + _case(0, (3,), (0.0,), (_TEXT[0], *_LINKS), (_TEXT[0], *_LINKS), 0, 0, 1)
)


def grow(rows: tuple, depth: int = 12) -> tuple:
    """A decision tree by Gini impurity: (feature, limit, tree up to the limit, tree beyond), or a label."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return (int(2 * ones >= len(rows)),)
    gini = lambda part: len(part) * (p := sum(r[-1] for r in part) / len(part)) * (1 - p)
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            limit = (a + b) / 2
            low, high = [r for r in rows if r[f] <= limit], [r for r in rows if r[f] > limit]
            score = gini(low) + gini(high)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, limit, low, high)
    if best is None:
        return (int(2 * ones >= len(rows)),)
    _, f, limit, low, high = best
    return (f, limit, grow(low, depth - 1), grow(high, depth - 1))


@cache
def tree() -> tuple:
    return grow(LABELLED)


def judge(features: tuple) -> int:
    node = tree()
    while len(node) > 1:
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node[0]


def blocks(page: str) -> list[tuple]:
    """(text, words, linked words, name, article, heading) of each flat block that has text."""
    out: list[tuple] = []
    # Open elements: tag, name, whether that is for sure, in an article, in an article's header.
    stack: list[tuple[str, int, bool, bool, bool]] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link, heading, own = False, "", 0
    level, sure, article, headed = 0, False, False, False

    def close():
        nonlocal parts, linked
        if parts:
            words = "".join(parts).split()
            if words:
                name = 2 if headed and not heading else max(level, own)
                out.append((" ".join(words), len(words), len("".join(linked).split()), name, article, bool(heading)))
            parts, linked = [], []

    def text(piece: str):
        if piece:
            if "&" in piece:
                piece = _html.unescape(piece)
            parts.append(piece)
            if in_link:
                linked.append(piece)

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["empty"] or (m["raw"] and m["raw"].lower() == "svg"):
                parts.append(" ")
            elif m["raw"]:
                close()
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m["end"]
            linked.append(" ")
            continue
        if tag in ("br", "wbr", "img", "input"):
            parts.append(" ") if tag == "br" else None
            continue
        if tag in BLOCK or tag == "label":
            close()
            in_link, own = False, 0
        if tag in HEADING:
            heading = "" if m["end"] else tag
        elif tag in BLOCK:
            heading = ""
        if tag not in CONTAINER:
            own = _name(_names(m["attr"]), m["attr"]) if tag in BLOCK and not m["end"] and m["attr"] else 0
            continue
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            names = _names(m["attr"])
            words = [w for x in names for w in x]
            if tag in ("article", "main", "body"):
                # An article within a form, or within an element whose name might say something else, is an article.
                off = 2 if _HIDDEN.search(m["attr"]) or any(w.startswith("comment") for w in words) else 0
                here, sure_here = (2, True) if sure or off else (0, False)
            else:
                mine = 2 if tag in BOILER_TAG else _name(names, m["attr"])
                head = tag == "header" and any(t in ("article", "main") for t, *_ in stack)  # only its heading is the article's
                here = level if head else max(level, mine)
                sure_here = sure or (mine == 2 and tag != "form" and not head)
            inside = article or tag in ("article", "main") or any(w in ARTICLE_WORD for w in words)
            stack.append((tag, here, sure_here, inside, headed or (tag == "header" and any(t in ("article", "main") for t, *_ in stack))))
        level, sure, article, headed = stack[-1][1:] if stack else (0, False, False, False)
    text(page[at:])
    close()
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    size = [(w, a / w) for _, w, a, *_ in found]
    edge = [(0, 0.0)]
    kept = []
    for b, here, before, behind in zip(found, size, edge + size[:-1], size[1:] + edge, strict=True):
        if judge((*here, *before, *behind, *b[3:])):
            kept.append(b[0])
    return "\n".join(kept)


def extract_main_text(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The ``keep`` columns, the main text, and its number of code points. One narrow pass."""
    fields = [f"{c} {df.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x) for x in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return df.select(*keep, F.col(html_col)).mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
