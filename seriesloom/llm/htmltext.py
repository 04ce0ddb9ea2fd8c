"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page.  Text lengths (link text doesn't count)
are summed over windows of neighbouring lines; where sums rise from nothing to those of running text
the text surges, where they fall to nothing again it dives, and stretches between the two are kept.
This decides on every page; what the markup says is evidence that changes lengths before they are summed:

* lines in menus, headers, footers, sidebars, adverts, forms, scripts, styles or reader comments count as
  empty, by tag or by a class, id or role that names such a thing.  html, body, main and article are never
  judged by such names, and a name that other things bear too (share, notice, related ...) counts only
  for blocks of less than NAMED_TEXT characters of plain text;
* the borders of an article part it from what stands before and after it, and in the article of most
  text a short line counts like a line of running text.

Of several stretches those of much less text than the largest are left out (see `main_text`).

* Character references are decoded, white space inside a block becomes one space, blocks are trimmed,
  empty ones left out, and the rest joined by line ends.  A line break tag is white space.
* null or empty html: empty text; null ids and urls and repeated rows are kept row by row; empty
  table: no rows; other columns are left out, whatever their names.  Ties between stretches: all of them,
  or the first where none surges.  Nothing is cut off, however long a page or line.
* Cut-off tags and comments run to the end of the page; unclosed elements close with their parent.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

WINDOW = 3
SURGE = 80
NAMED_TEXT = 200
#: Least share of the largest stretch's text that another has: where no article is the largest, where
#: one is, and for an article beside a larger stretch.
SHARE, BESIDE, SMALL = 0.1, 0.5, 0.2

PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
HOLDERS = set("article aside blockquote body details dialog div dl fieldset figure footer form head header html main menu nav ol section table ul".split())
BOILER = set("nav footer aside form head menu dialog".split())
NEVER = set("html body main article".split())
QUIET = set("button label".split())
NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Parts of names that mean boilerplate, those that other things bear too, and first parts of names that
#: only tell what state a page is in or how a text is filed.
SURE = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent disqus footer gdpr masthead menu nav navbar navigation newsletter popup promo sidebar sponsor sponsored".split())
MAYBE = set("complementary modal notice related replies share sharing social subscribe toolbar widget".split())
STATES = set("has is no with without category tag type format postid single page".split())
BLANK = re.compile(r"\s+")


def named(attributes: str) -> str:
    """What class, id and role say: "sure", "maybe" or nothing."""
    out = ""
    for found in NAMED.findall(attributes):
        for name in next(filter(None, found), "").lower().split():
            parts = re.split(r"[-_]+", name)
            if len(parts) > 1 and parts[0] in STATES:
                continue
            if SURE & set((parts[0], parts[-1])):
                return "sure"
            if parts[-1] in MAYBE:
                out = "maybe"
    return out


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, length without link text, number of the article it is in, 0 for none) of each block;
    boilerplate between blocks and an article's borders leave empty lines."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, str, int]] = []  # open holders, what they are, and where their lines begin
    skip = links = inside = article = 0
    held: list[str] = []
    linked = 0
    quiet = ""

    def close_block() -> None:
        nonlocal linked, quiet
        text = BLANK.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append((text, max(0, len(text) - linked), article if inside else 0))
        linked, quiet = 0, ""

    def push(text: str) -> None:
        nonlocal linked
        if not skip and not quiet:
            held.append(text)
            if links:
                linked += len(text.strip())

    def pop() -> str:
        nonlocal skip, inside
        name, kind, begin = stack.pop()
        skip -= kind == "sure"
        if kind == "maybe" and sum(n for _, n, _ in out[begin:]) < NAMED_TEXT:
            out[begin:] = [("", 0, 0)]
        if kind == "article":
            inside -= 1
            if not inside:
                out.extend([("", 0, 0)] * WINDOW)
        return name

    at = 0
    for m in PIECE.finditer(page):
        if m.start() > at:
            push(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name in ("br", "td", "th"):
            push(" ")
        elif name == "a":
            links = 0 if m[2] else 1
        if name not in BLOCKS:
            if m[2]:
                quiet = "" if quiet == name else quiet
            elif name and not quiet and (name in QUIET or named(m[4])) and not m[4].endswith("/"):
                quiet = name
            continue
        close_block()
        if name not in HOLDERS:
            quiet = "" if m[2] or not named(m[4]) else name
            continue
        if m[2]:
            while any(n == name for n, _, _ in stack):
                if pop() == name:
                    break
        elif not m[4].endswith("/"):
            kind = "" if name in NEVER else "sure" if name in BOILER or name == "header" and not inside else named(m[4])
            if name in ("article", "main") and skip and not any(n in ("article", "main") for n, _, _ in stack):
                while stack:  # an unclosed menu or advert ends where the article begins
                    pop()
            if name == "article" and not skip:
                kind = "article"
                if not inside:
                    article += 1
                    out.extend([("", 0, 0)] * WINDOW)
                inside += 1
            if kind == "sure" and not skip:
                out.append(("", 0, 0))
            stack.append((name, kind, len(out)))
            skip += kind == "sure"
    if at < len(page):
        push(page[at:])
    close_block()
    while stack:
        pop()
    return out


def between(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Stretches of lines from a surge of the window sums to their dive.

    A stretch is a run of lines whose windows are not empty; it counts if one of its windows reaches
    the surge.  Without any such run the one of the largest window is taken."""
    n = len(lengths)
    before = [0, *itertools.accumulate(lengths)]
    sums = [before[min(i + window, n)] - before[i] for i in range(n)]
    runs, begin = [], None
    for i in range(n + 1):
        full = i < n and lengths[i] > 0
        if full and begin is None:
            begin = i
        if not full and begin is not None and (i == n or sums[i] == 0):
            runs.append((begin, i))
            begin = None
    best = [r for r in runs if max(sums[r[0] : r[1]]) >= surge]
    return best or sorted(runs, key=lambda r: -max(sums[r[0] : r[1]]))[:1]


def main_text(page: str | None) -> str:
    """The main text of one page.

    A stretch weighs as much as its plain text, one of the main article as much as all of that.  If the
    main article is heaviest, others need BESIDE of its weight; else it needs SMALL of the heaviest, and
    others SHARE."""
    lines = lines_of(page or "")
    texts: dict[int, int] = {}
    for _, n, article in lines:
        texts[article] = texts.get(article, 0) + n
    main = max((a for a in texts if a), key=lambda a: texts[a], default=-1)
    runs = between([max(n, SURGE) if n and article == main else n for _, n, article in lines])
    weighed = [(texts[main], True, r) if lines[r[0]][2] == main else (sum(n for _, n, _ in lines[r[0] : r[1]]), False, r) for r in runs]
    top, marked, _ = max(weighed, default=(0, False, ()), key=lambda x: x[:2])
    kept = [r for n, own, r in weighed if n >= top * (SMALL if own else BESIDE if marked else SHARE)]
    return "\n".join(text for a, b in kept for text, _, _ in lines[a:b] if text)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of `pages`: page_id, url, text, n_chars."""

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(x) for x in part], dtype=object)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(text_of(html_col)).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
