"""Main text of web pages by line-block distribution.

Markup is stripped first: comments, scripts, styles and the like go; elements that can't be main text by their name, role,
class or id (menus, headers and footers of the page, side bars, notices, adverts, forms, reader comments, hidden parts)
turn into blank lines; every block element starts a line. A class or id tells only if all its parts are such words or words
for shapes, as in ad-box: share-price-table doesn't. Each line has the length of its text outside links, 0 if that
holds no letter or digit. A line of links alone counts as one line a link, so a menu on one line is like one on many. Sums
over WINDOW lines give the distribution. A dive is WINDOW such lines with the sum 0, all blank or all of links; the lines in
it go. Text between two dives is a stretch, which is kept if its sums surge to SURGE; lines of fewer links that touch it
stay. If no stretch does, the densest one with text outside links is kept (the first of equal ones).

Inside an article or main element, if the page has one with text other than headings, any line that is not blank counts
as a surge, so short paragraphs stay, while dives are cut out as elsewhere (unless nothing else is there); lines outside it
don't count.

Null and empty pages give an empty text. Broken markup is read as browsers do: end tags without a start are skipped, open
elements end with their parent, a tag with an open quote ends at the next > if no quote follows. Time grows with the page's
length, also for deep or unclosed elements. Repeated rows and null page_ids keep a row each. Other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE = 3, 80
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SOLID = re.compile(r"[^\W_]")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "object", "svg", "math", "canvas", "video", "audio", "title", "head", "xmp"}
_BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "label", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer masthead topbar header comment comments respond disqus discussion replies share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar copyright skip".split()
)
_SHAPES = set("area bar block bottom box btn button buttons col column container content group head holder icons inner item items left link links list main outer page panel post posts right row section site slot space tag title top unit wrap wrapper zone".split())
_CLOSES_P = _BLOCK - {"br"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An end tag of an INLINE element doesn't reach out of a SCOPE.
_SCOPE = {"article", "main", "nav", "aside", "footer", "section", "div"}
_INLINE = {"b", "i", "em", "strong", "span", "a", "p", "li"}


def _boiler(name: str, attrs: str, inside: bool) -> bool:
    if name in _NEVER or name == "header" and not inside:
        return True
    for key, *vals in _ATTR.findall(attrs) if attrs.strip(" /") else ():
        key, value = key.lower(), next((v for v in vals if v), "").lower()
        if key == "role" and value.strip() in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            for token in value.split():
                parts = [x for x in re.split(r"[-_\d]+", token) if x]
                if _WORDS.intersection(parts) and _WORDS.union(_SHAPES).issuperset(parts) and not (inside and "header" in parts and not (_WORDS - {"header"}).intersection(parts)):
                    return True
    return False


def lines(page: str) -> list[tuple[str, int, bool, int, bool]]:
    """(text, characters outside links, inside an article or main element, links, heading) per line; blank lines where something went."""
    out: list = []
    text: list = []
    state = {"link": 0, "plain": 0, "links": 0, "heading": 0}
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, boilerplate, article or main
    places: dict[str, list[int]] = {}  # of the open elements of each name, those of scopes and of blocks as well
    skip = main = 0

    def flush(blank: int = 0):
        s = re.sub(r"\s+", " ", "".join(text)).strip()
        if s:
            out.append((s, state["plain"], main > 0, state["links"], state["heading"] > 0))
        out.extend([("", 0, main > 0, 0, False)] * blank)
        text.clear()
        state["plain"] = state["links"] = 0

    def add(raw: str):
        if not skip:
            s = html.unescape(raw)
            text.append(s)
            if not state["link"] and _SOLID.search(s):
                state["plain"] += len(s.strip())

    def kinds(name: str):
        return [name, *(["<scope>"] if name in _SCOPE else []), *(["<block>"] if name in _BLOCK else [])]

    def last(kind: str) -> int:
        at = places.get(kind)
        return at[-1] if at else -1

    def close(upto: int):
        nonlocal skip, main
        while len(stack) > upto:
            name, bad, art = stack.pop()
            for kind in kinds(name):
                places[kind].pop()
            if name in _BLOCK:
                flush()
            if bad:
                skip -= 1
                if not skip:
                    flush(WINDOW)
            if art:
                main -= 1
            if name == "a":
                state["link"] -= 1
            state["heading"] -= name in _HEADINGS

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        name, attrs = m[2].lower(), m[3]
        if m[1]:
            k = last(name)
            if k >= 0 and not (name in _INLINE and last("<scope>") > k):
                close(k)
            if name in _BLOCK:
                flush()
            continue
        if name in _RAW:
            if not attrs.rstrip().endswith("/"):
                if name == "head":
                    stop = re.compile(r"</head\s*>|<body\b", re.I).search(page, at)
                    at = end if not stop else stop.end() if stop[0].startswith("</") else stop.start()
                else:
                    stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                    at = stop.end() if stop else end
            continue
        if name in _BLOCK:
            if name in _CLOSES_P and last("p") >= 0 and last("p") == last("<block>"):
                close(last("p"))
            flush()
        if name in _VOID or attrs.rstrip().endswith("/"):
            continue
        bad, art = _boiler(name, attrs, main > 0), name in ("article", "main")
        if bad:
            if not skip:
                flush(WINDOW)
            skip += 1
        if art and not bad:
            main += 1
        if name == "a":
            state["link"] += 1
            state["links"] += not skip
        state["heading"] += name in _HEADINGS
        for kind in kinds(name):
            places.setdefault(kind, []).append(len(stack))
        stack.append((name, bad, art and not bad))
    close(0)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    rows = lines(page)
    held = any(r[0] and r[2] and not r[4] for r in rows)
    if held:
        rows = [r if r[2] else ("", 0, False, 0, False) for r in rows]
    found = stretches(rows)
    if held:
        keep = found or [(rows, 0)]
    else:
        keep = [x for x in found if x[1] >= SURGE]
        if not keep:
            keep = [x for x in [max(found, key=lambda x: x[1], default=([], 0))] if x[1]]
    return "\n".join(r[0] for part, _ in keep for r in part if r[0])


def stretches(rows: list) -> list[tuple[list, int]]:
    """The lines between dives, and the highest sum over WINDOW lines of each."""
    out, part, k = [], [], 0

    def end():
        if any(r[0] for r in part):
            size = [r[1] for r in part]
            out.append((part.copy(), max(sum(size[i : i + WINDOW]) for i in range(len(size)))))
        part.clear()

    while k < len(rows):
        j, zeros = k, 0
        while j < len(rows) and not rows[j][1] and bool(rows[j][0]) == bool(rows[k][0]):
            zeros += max(1, rows[j][3])
            j += 1
        if zeros >= WINDOW:
            end()
        else:
            j = max(j, k + 1)
            part += rows[k:j]
        k = j
    end()
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
