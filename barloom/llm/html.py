"""Main text of web pages by the best-scoring run of tokens.

A page is a row of words and tags. Words score one; tags score minus ``TAG_COST`` times the share of their kind that lies
outside the content of labelled pages (pages that mark their content with an article or main element). A linear scan
finds the run with the largest sum.

Parts that surely are no content (scripts, menus, footers, forms in an article, and elements whose whole class, id or role
says so) are left out before the scan. A name that only hints at it (a part of it is such a word, as in ``content-with-nav``)
drops nothing: words below it score ``DOUBT``, and the scan decides. An article or main element ends doubt, and the drop of
a part that merely has such a name or is never closed. Pages that mark their content are scanned inside the mark.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import python_batches

TAG_COST = 2.0
WORD_SCORE = 1.0
#: Score of a word below a doubtful name.
DOUBT = 0.25
#: Kinds of tags with a weight of their own; all others share one.
KINDS = frozenset(
    "a abbr article aside b blockquote body br button caption cite code dd del div dl dt em fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr i img input ins label li main mark nav ol option p pre q s section "
    "select small span strong sub sup table tbody td tfoot th thead time tr u ul".split()
)
OTHER = "*"
#: Tags that end no block.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog fieldset".split())
CONTENT = frozenset(("article", "main"))
NEVER_DROPPED = frozenset(("html", "body"))
#: Words in class, id or role that name a part that is no content; some only do so outside the content.
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs pagination pager "
    "sidebar aside footer comment comments reply replies respond disqus share sharing social related recommended "
    "newsletter subscribe subscription signup login search toolbar widget masthead skip complementary contentinfo form".split()
)
OUTER_NAMES = frozenset("header topbar".split())
COMMENT_NAMES = frozenset("comment comments reply replies respond".split())
#: A name made of such words and names for no content is one itself (``cookie-bar``, ``comment-list``) ...
NEUTRAL = frozenset("area bar block box btn button buttons container content group holder inner item items label link links list outer panel post posts row section site slot text top unit wrap wrapper".split())
#: ... one that begins so tells of the layout.
LAYOUT = frozenset("has is no not with without hide show".split())
#: Beside a name of content, one for no content is doubtful.
MAIN_NAMES = frozenset("article content main story entry".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>[^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+|[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PART = re.compile(r"[^a-z0-9]+")

KEPT, DOUBTFUL, NAMED_NO_CONTENT, NO_CONTENT = range(4)


def _hint(names: str, wanted: frozenset[str]) -> int:
    """What the names of an element say of it."""
    found, main = KEPT, False
    for name in names.split():
        parts = [p for p in PART.split(name) if p]
        if not wanted.intersection(parts):
            main |= not MAIN_NAMES.isdisjoint(parts)
        elif parts[0] not in LAYOUT:
            sure = parts[0] in wanted and wanted.issuperset(set(parts) - NEUTRAL) or parts[-1] in wanted and NEUTRAL.issuperset(parts[:-1])
            found = max(found, NAMED_NO_CONTENT if sure else DOUBTFUL)
    return min(found, DOUBTFUL) if main else found


def _standing(name: str, rest: str, inside: bool) -> int:
    """What becomes of an element: kept, doubtful, or dropped for its names or its kind."""
    if name in NEVER_DROPPED:
        return KEPT
    names = " ".join(m[1] or m[2] or m[3] or "" for m in NAMED.finditer(rest)).lower() if "=" in rest else ""
    if name in CONTENT:
        return NO_CONTENT if _hint(names, COMMENT_NAMES) == NAMED_NO_CONTENT else KEPT
    if name == "form":
        return NO_CONTENT if inside else DOUBTFUL
    if name in DROPPED or (name == "header" and not inside):
        return NO_CONTENT
    if rest and HIDDEN.search(rest):
        return NO_CONTENT
    if not names:
        return KEPT
    if _hint(names, COMMENT_NAMES) == NAMED_NO_CONTENT:
        return NO_CONTENT
    return _hint(names, NAMES if inside else NAMES | OUTER_NAMES)


def tokens(page: str) -> Iterator[tuple[str, str, bool, int]]:
    """(kind, text, inside, standing) for every piece of text (kind empty) and tag, scripts and the like left out.

    ``inside`` tells whether it lies in an article or main element. A part that is no content ends with its element. An
    article or main element ends it too if it began outside of one and is so by its name, or is never closed.
    """
    at, inside = 0, 0
    drop, drop_depth, stays, drop_named = "", 0, False, False
    doubt, doubt_depth = "", 0
    last_close: dict[str, int] = {}

    def closed_later(name: str, after: int) -> bool:
        if name not in last_close:
            found = [m.start() for m in re.finditer(rf"</{re.escape(name)}[\s>/]", page, re.I)]
            last_close[name] = found[-1] if found else -1
        return last_close[name] >= after

    def now() -> tuple[bool, int]:
        return inside > 0, NO_CONTENT if drop else DOUBTFUL if doubt else KEPT

    while True:
        m = TOKEN.search(page, at)
        if m is None:
            yield "", page[at:], *now()
            return
        if m.start() > at:
            yield "", page[at : m.start()], *now()
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        closing, rest = bool(m["close"]), m["rest"] or ""
        if not closing and name in RAW and not rest.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(page, at)
            at = end.start() if end else len(page)
            continue
        opens = not closing and name not in VOID and not rest.endswith("/")
        if opens and name in CONTENT and not inside and not (drop and (stays or drop in CONTENT)):
            if not drop or drop_named or not closed_later(drop, at):
                drop = doubt = ""
        if drop:
            if name == drop and name not in VOID:
                drop_depth += -1 if closing else not rest.endswith("/")
                if drop_depth == 0:
                    drop = ""
                    yield name, "", inside > 0, NO_CONTENT
                    continue
        elif opens:
            standing = _standing(name, rest, inside > 0)
            if standing >= NAMED_NO_CONTENT:
                drop, drop_depth, stays, drop_named = name, 1, inside > 0, standing == NAMED_NO_CONTENT
            elif doubt:
                doubt_depth += name == doubt
            elif standing == DOUBTFUL:
                doubt, doubt_depth = name, 1
        elif closing and name == doubt:
            doubt_depth -= 1
            if doubt_depth == 0:
                doubt = ""
        if not drop and name in CONTENT:
            inside = max(0, inside + (-1 if closing else 1))
        yield name, "", *now()


def tag_counts(page: str) -> Counter[tuple[str, bool]]:
    """(kind, inside content) of each tag of a labelled page; nothing for other pages."""
    found: Counter[tuple[str, bool]] = Counter()
    words_inside = 0
    for name, text, inside, standing in tokens(page):
        content = inside and standing == KEPT
        if name:
            found[name if name in KINDS else OTHER, content] += 1
        elif content:
            words_inside += len(text.split())
    return found if words_inside else Counter()


def weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """The score of each kind of tag (at most 0), from tag counts inside and outside the content of all labelled pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, bool]] = Counter()
        for batch in python_batches(batches):
            for page in batch.column(0).to_pylist():
                found.update(tag_counts(page or ""))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in found], pa.string()), pa.array([i for _, i in found], pa.bool_()), pa.array(list(found.values()), pa.int64())],
            ["kind", "inside", "n"],
        )

    sums = pages.select(html_col).mapInArrow(run, "kind string, inside boolean, n bigint").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    inside, outside = Counter(), Counter()
    for row in sums.collect():  # two rows for each kind at most
        (inside if row["inside"] else outside)[row["kind"]] = row["n"]
    return {k: -TAG_COST * (outside[k] + 1) / (inside[k] + outside[k] + 2) for k in (*KINDS, OTHER)}


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the run with the largest sum, the longest of equals; (0, 0) where no sum is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += x
        if total > best or (total == best > 0 and i + 1 - start > found[1] - found[0]):
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """The text of the best run, blocks joined by a space; empty if the page has none."""
    if not page:
        return ""
    seen = [x for x in tokens(page) if x[3] < NAMED_NO_CONTENT]
    if any(inside and not name and text.strip() for name, text, inside, _ in seen):
        seen = [x for x in seen if x[2]]
    pieces = [html.unescape(text) if "&" in text else text for _, text, _, _ in seen]
    scores = [
        weight[name if name in KINDS else OTHER] if name else (DOUBT if standing else WORD_SCORE) * len(piece.split())
        for (name, _, _, standing), piece in zip(seen, pieces)
    ]
    start, end = best_run(scores)
    run = (("" if name in INLINE else " ") if name else piece for (name, *_), piece in zip(seen[start:end], pieces[start:end]))
    return " ".join("".join(run).split())


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) for each row of ``pages``.

    * A null, empty or tag-only page has the empty text. Character references are decoded once; white space becomes one
      space; unclosed tags, comments and quotes end with the page.
    * A page of any length is read whole, in time linear in its length; one page must fit into a task.
    * Of runs with equal sums the earliest of the longest is taken. Repeated rows give equal answers, null ids pass
      through, an empty table gives no rows. Other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights(pages, html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in python_batches(batches):
            found = [main_text(p, weight) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )

    return pages.select(id_col, url_col, F.col(html_col)).mapInArrow(
        run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars bigint"
    )
