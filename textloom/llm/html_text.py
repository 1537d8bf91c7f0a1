"""Main text of HTML pages by two passes of block rules.

Pass one cuts a page into blocks (runs of inline content between block-level
tags) and decides each from its link density, its length, its stop-word
density and the container it stands in: navigation, page headers and footers,
asides, forms, adverts, notices and reader comments are never content. Pass
two gives each ambiguous short block the label of its nearest decided
neighbours, looking inside its own content container first.

Character references are decoded, white space inside a block becomes one
space, blocks are joined by an empty line. A null or empty page, or one with
no content block, gives an empty text. Unclosed tags, comments, scripts and
attributes close at the end of the page at the latest; after a quote that
never ends tags are read without quoting, so a page takes linear time. Rows repeat as they
come in, empty tables give empty results, other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import map_text_blocks

#: Frequent function words of the languages that pages come in.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their if do will each how "
    "der die das und ist von den mit zu ein eine nicht auf für im des sich dem auch als es an er so dass aus bei wird sind noch nach am wie einem über einen um "
    "le la les de des et un une du en est que qui dans pour pas sur au avec il par ce plus ne se son sont ou mais comme nous vous leur "
    "el los las y que del se con por para una no su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre".split()
)
#: Inline tags, containers of content, containers that never hold it, words of class, id and role that mark the latter.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    # a formula is part of its line
    "math maction annotation annotation-xml menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup "
    "mtable mtd mtext mtr munder munderover none semantics".split()
)
CONTENT = frozenset(["article", "main"])
NEVER = frozenset("nav footer aside form menu dialog button select option fieldset figcaption iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer masthead topbar "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget "
    "comment comments disqus reply replies respondlist search pagination pager toolbar complementary contentinfo dialog".split()
)
#: Words of class, id and role of an article that is a reader's comment.
COMMENT = frozenset("comment comments disqus reply replies respondlist".split())
#: Share of a block's characters inside links from which it isn't content, outside article and main.
LINK_SHARE = 0.5
#: Characters below which a block is ambiguous, and from which few stop words suffice; stop-word shares.
SHORT, LONG, STOP_LOW, STOP_HIGH = 70, 200, 0.08, 0.2



def _token(attributes: str) -> re.Pattern[str]:
    """A comment, a raw element as a whole, a tag, or text. No part gives back what it took, and none but quotes passes a <."""
    return re.compile(
        rf"<!--(?:.*?-->|.*+)|<(script|style|template|textarea|title)\b{attributes}*+>(?:.*?</\1\s*+>|.*+)"
        rf"|<(/?)([a-zA-Z][^\s<>/]*+)({attributes}*+)>|<[!?/][^<>]*+>|[^<]++|<",
        re.S | re.I,
    )


_TOKEN = _token(r"(?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])")
#: The same after a quote that never ends: quotes are characters like others.
_UNQUOTED = _token(r"[^<>]")
_HEAD = re.compile(r"</?[a-zA-Z](?:\"[^\"]*+\"|'[^']*+'|[^'\"<>])*+")
_SVG_END = re.compile(r"</svg\s*>", re.I)
#: Tags that no drawing has: a drawing without an end tag ends there.
_NOT_SVG = re.compile(
    r"<(?:/(?:a|button)|/?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|img|li|main|nav|ol|p|pre|section|span|table|tbody|td|th|tr|ul))\b",
    re.I,
)
_ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def _marked(attributes: str, marks: frozenset = MARKS) -> bool:
    """Whether class, id or role name a container that never holds content."""
    for m in _ATTRIBUTE.finditer(attributes):
        for value in m.groups():
            if value and any(w in marks for w in re.split(r"[^a-z]+", value.lower())):
                return True
    return False


def _open_quote(page: str, at: int) -> bool:
    """Whether what starts at a < would be a tag but for a quote without an end."""
    head = _HEAD.match(page, at)
    return head is not None and head.end() < len(page) and page[head.end()] in "\"'"


def blocks_of(page: str) -> list[tuple[str, int, int, bool]]:
    """(text, characters inside links, content container or -1, stands in a container that is never content)."""
    out: list[tuple[str, int, int, bool, int]] = []
    # open containers: tag, never content by a tag, content container, innermost marked container or 0
    stack: list[tuple[str, bool, int, int]] = []
    marked, around = 0, [0]  # around: the next marked container outside each
    holders = {0}  # marked containers that hold an article or main; those around them hold it too
    parts: list[str] = []
    linked: list[str] = []
    link, never, inside, containers = False, False, -1, 0
    open_tags: Counter = Counter()
    token = _TOKEN
    at, svg_ends = 0, True

    def close() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append((text, len(" ".join(html_lib.unescape("".join(linked)).split())), inside, never, marked))
            parts.clear()
            linked.clear()

    while at < len(page):
        m = token.match(page, at)
        if m[0] == "<" and token is _TOKEN and _open_quote(page, at):
            token = _UNQUOTED
            m = token.match(page, at)
        at = m.end()
        whole = m[0]
        tag = m[3]
        if tag is None:
            if m[1] is not None:
                if m[1].lower() in ("script", "style", "template"):
                    continue
                close()  # title, textarea: no part of the page's text
            elif not whole.startswith("<!") and not whole.startswith("<?") and not whole.startswith("</"):
                parts.append(whole)
                if link:
                    linked.append(whole)
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            link = not m[2]
        elif tag in INLINE:
            continue
        elif tag == "svg":
            if not m[2] and not m[4].endswith("/"):
                end = _SVG_END.search(page, at) if svg_ends else None
                svg_ends = end is not None
                rest = None if end else _NOT_SVG.search(page, at)
                at = end.end() if end else rest.start() if rest else len(page)
        else:
            close()
            link = False
            if tag in VOID:
                continue
            if m[2]:
                while open_tags[tag]:
                    last = stack.pop()[0]
                    open_tags[last] -= 1
                    if last == tag:
                        break
            elif not m[4].endswith("/"):
                if tag in CONTENT:
                    containers += 1
                    if inside < 0 and not _marked(m[4], COMMENT):
                        # wrappers of the content: their marks say what stands beside it
                        while marked not in holders:
                            holders.add(marked)
                            marked = around[marked]
                        marked = 0
                    stack.append((tag, never, inside if inside >= 0 else containers, marked))
                    open_tags[tag] += 1
                elif tag not in ("html", "body"):
                    item = tag in ("p", "li", "tr", "td", "th", "dt", "dd")
                    own = _marked(m[4])
                    if own:
                        around.append(marked)
                    if own or not item:
                        bad = not item and (tag in NEVER or (tag == "header" and inside < 0))
                        stack.append((tag, never or bad, inside, len(around) - 1 if own else marked))
                        open_tags[tag] += 1
            never = stack[-1][1] if stack else False
            inside = stack[-1][2] if stack else -1
            marked = stack[-1][3] if stack else 0
    close()
    return [(text, n, inside, never or marked not in holders) for text, n, inside, never, marked in out]


def classify(block: tuple[str, int, int, bool]) -> bool | None:
    """True: content, False: not, None: ambiguous."""
    text, linked, inside, never = block
    if never or (inside < 0 and linked > LINK_SHARE * len(text)):
        return False
    if len(text) < SHORT:
        return None
    if inside >= 0:
        return True
    words = _WORD.findall(text.lower())
    share = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if share >= STOP_HIGH or (share >= STOP_LOW and len(text) >= LONG):
        return True
    return None if share >= STOP_LOW else False


def extract(page: str | None) -> str:
    """The main text of one page."""
    found = blocks_of(page or "")
    labels = [classify(b) for b in found]
    n = len(found)
    # nearest decided neighbour on either side, as (label, distance, same container)
    left: list[int] = []
    last = -1
    for i in range(n):
        left.append(last)
        if labels[i] is not None:
            last = i
    right = [-1] * n
    last = -1
    for i in range(n - 1, -1, -1):
        right[i] = last
        if labels[i] is not None:
            last = i
    final = list(labels)
    for i, (_, _, inside, _) in enumerate(found):
        if labels[i] is not None:
            continue
        near = [j for j in (left[i], right[i]) if j >= 0]
        own = [j for j in near if found[j][2] == inside and not found[j][3]] if inside >= 0 else near
        if inside >= 0:
            final[i] = any(labels[j] for j in own) or not own
        else:
            final[i] = len(near) > 0 and (all(labels[j] for j in near) if len(near) == 2 and left[i] != i - 1 and right[i] != i + 1 else bool(labels[min(near, key=lambda j: abs(j - i))]))
    return "\n\n".join(b[0] for b, keep in zip(found, final) if keep)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""

    def kernel(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(p) for p in block.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([block.column("page_id"), block.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return map_text_blocks(rows, kernel, "page_id long, url string, text string, n_chars long", column="html")
