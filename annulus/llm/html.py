"""Main text of HTML pages by two-pass block rules."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
#: What can end a tag, or open a quoted value in it.
INSIDE = re.compile(r">|=\s*[\"']")
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

# Element names of HTML.
RAW = frozenset("script style noscript template textarea title iframe object svg math select".split())
#: Of these, elements that a closing slash in the tag does not end.
WHOLE = frozenset("title select textarea iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AWAY = frozenset("nav footer header aside form head menu button dialog".split())
MAIN = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of boilerplate in a class, id or role, and words that may stand beside them in a compound such as `cookie-banner-inner`.
NAMES = re.compile(r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notice|pager|pagination|popup|promo\w*|related|search|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget")
BESIDE = re.compile(r"\d*|area|articles|bar|block|body|bottom|box|buttons?|cell|col|column|container|content|form|frame|global|group|icons?|inner|item|items|left|line|links?|list|main|outer|page|panel|posts?|primary|right|row|secondary|section|site|slot|text|top|unit|wrap|wrapper|zone")


def boilerplate(names: str) -> bool:
    """Whether a whole word of a class, id or role is a name of boilerplate, or a compound of such with words that tell nothing."""
    for word in names.strip("\"'").lower().split():
        parts = re.split("[_-]+", word)
        if any(NAMES.fullmatch(p) for p in parts) and all(NAMES.fullmatch(p) or BESIDE.fullmatch(p) for p in parts):
            return True
    return False


# Frequent words of English, German, French and Spanish.
STOP = frozenset(
    "a an and are as at be by for from had has have he her his i in is it not of on or she that the their they this to was were which with you "
    "aber als am an auf aus bei das dem den der des die durch ein eine einen einer er es für im in ist mit nach nicht oder sich sie sind so und von vor war wie wird zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il ils la le les leur mais ne ou par pas plus pour qui que sa se ses son sont sur un une "
    "al como con de del el ella en es esta la las lo los más no o para pero por que se ser si sin son su sus un una y".split()
)

GOOD, BAD, SHORT = 1, -1, 0


def tokens(html: str):
    """(text, name, closing, attributes) of each run of text and each tag, in one pass that never looks at a character more than a few times.

    Comments, declarations, instructions and what `RAW` elements hold are left out. A `<` that begins none of these is text. A tag ends at the first `>` outside quoted values; a quote that never closes
    quotes nothing. A comment that never ends takes the rest of the page, and so does a tag, declaration or instruction.
    """
    at, end, open_quotes = 0, len(html), {}
    while at < end:
        lt = html.find("<", at)
        if lt != at:
            yield html[at : lt if lt >= 0 else end], "", False, ""
            if lt < 0:
                return
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if html.startswith(("<!", "<?"), lt):
            stop = html.find(">", lt)
            at = stop + 1 if stop >= 0 else end
            continue
        m = NAME.match(html, lt + 1)
        if m is None:
            yield "<", "", False, ""
            at = lt + 1
            continue
        k = m.end()
        while True:
            stop = INSIDE.search(html, k)
            if stop is None:
                return
            if stop[0] == ">":
                break
            k = stop.end()
            if not open_quotes.get(stop[0][-1]):
                close = html.find(stop[0][-1], k)
                open_quotes[stop[0][-1]] = close < 0
                k = close + 1 if close >= 0 else k
        at = stop.end()
        name, attributes = m[0].lstrip("/").lower(), html[m.end() : stop.start()]
        yield "", name, m[0][0] == "/", attributes
        if name in RAW and m[0][0] != "/" and (name in WHOLE or not attributes.rstrip().endswith("/")):
            stop = after(name).search(html, at)
            at = stop.end() if stop else end


@lru_cache(maxsize=64)
def after(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def blocks(html: str) -> list[tuple[str, int, int, int]]:
    """(text, characters inside links, place, heading) of each block in page order; place is 1 in an article, -1 in boilerplate, else 0."""
    out, text, links = [], [], 0
    stack: list[tuple[str, int]] = []  # open block elements and links, with the place inside them
    in_link = heading = 0
    opened: Counter[str] = Counter()

    def close():
        nonlocal text, links
        line = " ".join(unescape("".join(text)).split())
        if line:
            out.append((line, min(links, len(line)), stack[-1][1] if stack else 0, heading))
        text, links = [], 0

    for run, name, closing, attributes in tokens(html):
        if not name:
            text.append(run)
            if in_link:
                links += len(run)
            continue
        if name in RAW and not closing:
            text.append(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in BLOCK and name not in AWAY:
            continue
        close()
        if closing:
            while opened[name]:
                opened[stack[-1][0]] -= 1
                if stack.pop()[0] == name:
                    break
            heading = 0
        elif name not in VOID:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option", *HEADING) and stack and stack[-1][0] in ("p", name):
                opened[stack.pop()[0]] -= 1
            place = stack[-1][1] if stack else 0
            if name in AWAY and not (name == "header" and place == GOOD) or any(map(boilerplate, ATTRIBUTE.findall(attributes))):
                place = BAD
            elif name in MAIN and place != BAD:
                place = GOOD
            stack.append((name, place))
            opened[name] += 1
            heading = int(name in HEADING)
    close()
    return out


def first_pass(text: str, link_chars: int, place: int, *, long: int = 140, short: int = 60, dense: float = 0.3, sparse: float = 0.15, most_links: float = 0.33) -> int:
    """A block's own class: good, bad, or short and so far undecided."""
    if place:
        return place
    if link_chars > most_links * len(text):
        return BAD
    words = [w.strip(".,;:!?()\"'«»").lower() for w in text.split()]
    density = sum(w in STOP for w in words) / len(words)
    if len(text) < short or density < dense and len(text) < long:
        return SHORT
    return GOOD if density >= sparse else BAD


def main_text(html: str | None) -> str:
    """The main text of a page: good blocks, each on a line.

    The first pass decides a block by the elements around it, its share of link text, its length and its
    share of stop words. The second gives each short block the class of the nearest decided ones: good if both
    neighbours are, and where they differ that of the nearer one by characters between; headings
    look ahead only. A page without decided blocks has no main text, and a null page none.
    """
    found = blocks(html or "")
    kinds = [first_pass(t, n, p) for t, n, p, _ in found]
    size = [len(t) for t, *_ in found]
    ahead, last, far = [(BAD, 0)] * len(found), BAD, 0
    for k in range(len(found) - 1, -1, -1):
        ahead[k] = (last, far)
        if kinds[k] == SHORT:
            far += size[k]
        else:
            last, far = kinds[k], 0
    keep, last, far = [], BAD, 0
    for k, (t, _, _, heading) in enumerate(found):
        if kinds[k] == SHORT:
            after, distance = ahead[k]
            kind = after if heading or distance <= far else last
            far += size[k]
        else:
            kind = last = kinds[k]
            far = 0
        if kind == GOOD:
            keep.append(t)
    return "\n".join(keep)


def extract(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """`pages` without `html` and with text and n_chars of its main text.

    Each row is read whole and by itself: null or empty pages have an empty text, repeated rows the same one,
    columns of `pages` called text or n_chars are replaced, and an empty table stays empty.
    """
    kept = [f for f in pages.schema if f.name not in (html, "text", "n_chars")]

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(html)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*(f.name for f in kept), "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return pages.select(*[f.name for f in kept], html).mapInArrow(run, fields + "text string, n_chars long")


def op4_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"), "n_chars")
