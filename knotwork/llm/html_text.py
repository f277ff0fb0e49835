"""Main text of web pages by site style trees.

All pages of a host are merged into one style tree: a node is a path of tags with their classes.  For each
node the tree counts over different pages (copies count once) which styles, i.e. sequences of children, and
which contents it has.  A node whose contents are spread over many pages (high entropy of the content over
pages) says nothing about a page; a node whose presentation varies does.  Both give a node's importance:

    GAMMA * (1 - mean entropy of its contents over pages) + (1 - GAMMA) * entropy of its styles

Branches of low importance are removed, and so are single blocks that stand on most pages of their host,
within article and main too.  What the markup says moves the least importance: article and main need less,
and branches within them whose class or id has a doubtful word (share, legal, notice) need more.  Branches
such as nav, footer, form or class="ad" are always out: what they say may differ on every page, so that
their importance can be that of an article.  Hosts with fewer than MIN_PAGES different pages have no tree to
learn from: there the markup decides alone, doubtful branches are out and all others stay.

What is to be removed is a table of nodes and blocks of hosts.  It is broadcast if its measured size allows;
otherwise every page sends the few entries that would concern it, and gets back those that are in the table,
so that no page, host or task ever holds more than a page's own entries.

Elements without text of their own (script, svg, iframe and the like) are left out with what is in them.  One
that closes itself, or is never closed, has nothing in it; a script or style that is never closed goes on to
the end of the element around it.

Defined results: null html gives an empty text; a null or odd url is a host of its own without a tree; a
page whose undecided branches would all go keeps them; broken markup is read as far as it goes; repeated
rows give repeated results; other columns are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, rows_by_bytes, use_checkpoints

GAMMA, LEAST, MIN_PAGES, COMMON = 0.9, 0.3, 5, 0.5
#: Least importance of branches that the markup calls main text, and of doubtful ones within these.
LEAST_IN, LEAST_DOUBTFUL = 0.15, 0.6
#: Rows of the removal list that may be broadcast.
BROADCAST_ROWS = 200_000

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_set = lambda s: frozenset(s.split())
_VOID = _set("area base br col embed hr img input link meta param source track wbr")
_RAW = _set("script style noscript template iframe textarea title xmp noembed noframes svg math canvas object audio video select")
_CODE = _set("script style")
_INLINE = _set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img br")
_CLOSES = {"p": _set("p"), "li": _set("li p"), "dt": _set("dt dd p"), "dd": _set("dt dd p"), "tr": _set("tr td th p"), "td": _set("td th p"), "th": _set("td th p")}
_NO_P = _set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul figure figcaption details")
_SCOPE = _set("article aside body div footer form header main nav section table ul ol dl td th blockquote html")
_OUT_TAGS = _set("head nav header footer aside form menu dialog button")
_OUT_WORDS = _set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation header masthead footer comment comments disqus reply replies "
    "respond cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "breadcrumb breadcrumbs pagination pager toolbar form"
)
#: Words that name parts of articles as well.
_DOUBTFUL_WORDS = _set("notice notices alert share sharing social related recommended recommendations widget search copyright legal disclaimer")
_OUT_ROLES = _set("navigation banner contentinfo complementary search form alert dialog menu menubar")
_IN_TAGS = _set("article main")
_IN_WORDS = _set("article post story entry")


@lru_cache(maxsize=4096)
def _element(tag: str, attrs: str) -> tuple[str, int]:
    """Name of an element in the style tree, and what its markup says: -2 out, -1 doubtful, 1 in, 0 nothing."""
    found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(attrs)} if attrs.strip() else {}
    classes = sorted(re.sub(r"\d+", "#", c) for c in found.get("class", "").split())
    words = {w.lower() for part in (found.get("class", ""), found.get("id", "")) for w in _WORD.findall(part)}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    whole = tag in ("body", "html")  # their classes describe the page
    if tag in _OUT_TAGS or hidden or found.get("role", "").lower() in _OUT_ROLES or (not whole and words & _OUT_WORDS):
        says = -2
    elif not whole and words & _DOUBTFUL_WORDS:
        says = -1
    else:
        says = int(tag in _IN_TAGS or found.get("role", "").lower() == "main" or (not whole and bool(words & _IN_WORDS)))
    return ".".join([tag, *classes]), says


class _Open:
    """An open element: the hash of its path, what the markup says of it, what the inline elements up to it say at least, and its block."""

    __slots__ = ("tag", "path", "says", "children", "inline", "block")

    def __init__(self, tag: str, path: int, says: int, up: _Open | None):
        self.tag, self.path, self.says, self.children = tag, path, says, []
        own = tag in _INLINE and up is not None
        self.inline = min(up.inline, says) if own else up.inline if up else 0
        self.block: _Open = up.block if own else self


def parse(page: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, str]]]:
    """Blocks of a page, each (hash of its path, what the markup says, text), and its elements, each (hash of its path, children).

    Time and memory grow with the page, however deep its elements are and however many of them are never closed."""
    stack = [_Open("", 0, 0, None)]
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()  # raw elements of which no end follows
    blocks: list[tuple[int, int, str]] = []
    styles: list[tuple[int, str]] = []
    text: list[str] = []
    owner = stack[0]
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                blocks.append((owner.path, owner.says, block))
            text.clear()

    def close(depth: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            opened[e.tag] -= 1
            if e.tag not in _INLINE:
                flush()
                styles.append((e.path, ",".join(dict.fromkeys(e.children))))

    while at < n:
        m = _TAG.search(page, at)
        if (end := m.start() if m else n) > at:
            if stack[-1].inline >= 0:  # an inline element can only be out as a whole
                if not text:
                    owner = stack[-1].block
                text.append(page[at:end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        closes = _CLOSES.get(tag) or (_CLOSES["p"] if tag in _NO_P else None)
        if closes and any(opened[c] for c in closes):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    close(k)
                    break
                if stack[k].tag in _SCOPE:
                    break
        stack[-1].children.append(tag)
        if tag in _VOID:
            continue
        attrs = m[3] or m[6] or ""
        if tag in _RAW:
            end = None if attrs.rstrip().endswith("/") or tag in unclosed else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if end is None and not attrs.rstrip().endswith("/"):
                unclosed.add(tag)
            if end:
                at = end.end()
            elif tag in _CODE and not attrs.rstrip().endswith("/"):
                around = "|".join(sorted(re.escape(t) for t, n in opened.items() if n))
                end = re.compile(rf"</(?:{around})\b", re.I).search(page, at) if around else None
                at = end.start() if end else n
            continue
        name, says = _element(tag, attrs)
        up = stack[-1]
        if -2 in (up.says, says) or says < 0 == up.says:
            says = -2  # only what is within main text can be doubtful
        else:
            says = min(up.says, says) if -1 in (up.says, says) else max(up.says, says)
        if attrs.endswith("/") and tag in ("path", "use", "circle"):
            continue
        stack.append(_Open(tag, _h(f"{up.path}/{name}") if tag not in _INLINE else up.path, says, up))
        opened[tag] += 1
    flush()
    close(1)
    return blocks, styles


def host(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode()) - (1 << 63)


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages, importance) of the nodes of all hosts, with the entropies behind it; aggregation only."""
    return _importance(_counts(pages, url_col, html_col))


def _counts(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, path, kind, feature, n): in how many different pages of the host a node has a content (0), a style (1), is there (2), or is doubtful (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_by_bytes(batches, html_col):
            out: set[tuple] = set()
            for url, page in rows:
                if page and (site := host(url)):
                    blocks, styles = parse(page)
                    blocks = [b for b in blocks if b[1] > -2]
                    own = _h("\n".join(t for _, _, t in blocks))
                    out |= {(site, p, 3, own, own) for p, says, _ in blocks if says < 0}
                    out |= {(site, p, 0, _h(t), own) for p, _, t in blocks}
                    out |= {(site, p, 2, own, own) for p, _, _ in blocks}
                    seen = {p for p, _, _ in blocks}
                    out |= {(site, p, 1, _h(c), own) for p, c in styles if p in seen}
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield arrow_batch(dict(zip(("host", "path", "kind", "feature", "page"), zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True), strict=True)))

    rows = pages.select(url_col, html_col).mapInArrow(run, "host string, path long, kind int, feature long, page long")
    return rows.distinct().groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"))


def _importance(counts: DataFrame) -> DataFrame:
    total = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0.0))
    n, n_log = F.col("n"), F.col("n") * F.log("n")
    sums = counts.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).alias("pages"), F.max(F.col("kind") == 3).alias("doubtful"),
        total(0, n).alias("n0"), total(0, n_log).alias("l0"), total(1, n).alias("n1"), total(1, n_log).alias("l1"),
    )
    log_m = F.log(F.greatest(F.lit(2), "pages"))
    content = F.when(F.col("n0") > 0, 1 - F.col("l0") / F.col("n0") / log_m).otherwise(1.0)
    style = F.when(F.col("n1") > 0, (F.log("n1") - F.col("l1") / F.col("n1")) / log_m).otherwise(0.0)
    return sums.select("host", "path", "pages", content.alias("content"), style.alias("style"), (GAMMA * content + (1 - GAMMA) * style).alias("importance"), "doubtful")


def removals(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, what): hashes of nodes of low importance (with `in` if too low for main text), of blocks at a node that
    most pages have, and with a + of doubtful nodes that stay."""
    use_checkpoints(pages.sparkSession)
    counts = _counts(pages, url_col, html_col).checkpoint()
    nodes = _importance(counts).where(F.col("pages") >= MIN_PAGES)
    node = lambda mark, rule: nodes.where(rule).select("host", F.concat(F.lit(mark), F.col("path").cast("string")).alias("what"))
    low = node("", F.col("importance") < LEAST).union(node("in", F.col("importance") < LEAST_IN)).union(node("+", F.col("doubtful") & (F.col("importance") >= LEAST_DOUBTFUL)))
    # no block of fewer pages can be common; this leaves out almost all blocks before they are dealt by node
    shared = counts.where((F.col("kind") == 0) & (F.col("n") >= COMMON * MIN_PAGES)).join(nodes.select("host", "path", "pages"), ["host", "path"]).where(F.col("n") >= COMMON * F.col("pages"))
    return low.union(shared.select("host", F.concat_ws(" ", "path", "feature").alias("what")))


def _entries(path: int, says: int, text: str) -> tuple[str, ...]:
    """What may be said in the table of a block: that it goes by its node, or by itself; of a doubtful one, that it stays."""
    return (f"in{path}" if says > 0 else str(path), f"{path} {_h(text)}", *([f"+{path}"] if says < 0 else []))


def main_text(page: str | None, said: frozenset[str] | set[str]) -> str:
    """The blocks of a page that stay, joined by newlines; `said` are the table's entries of its host, or those of the page."""
    every = parse(page)[0] if page else []
    blocks = [b for b in every if b[1] >= 0]
    if said:

        def stays(path: int, says: int, text: str) -> bool:
            node, own, *kept = _entries(path, says, text)
            return node not in said and own not in said and all(k in said for k in kept)

        blocks = [b for b in every if b[1] > -2 and stays(*b)] or blocks
    return "\n".join(t for _, _, t in blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every whole page."""
    table = removals(pages, url_col, html_col).checkpoint()
    schema = f"{id_col} long, {url_col} string, text string, n_chars long"

    def made(rows: list[tuple], said: list) -> pa.RecordBatch:
        texts = [main_text(r[2], x) for r, x in zip(rows, said, strict=True)]
        return arrow_batch({
            id_col: ([r[0] for r in rows], pa.int64()), url_col: ([r[1] for r in rows], pa.string()),
            "text": (texts, pa.string()), "n_chars": (list(map(len, texts)), pa.int64()),
        })

    pages = pages.select(id_col, url_col, html_col)
    if table.count() <= BROADCAST_ROWS:
        by_host: dict[str, set[str]] = {}
        for r in table.collect():
            by_host.setdefault(r["host"], set()).add(r["what"])
        known = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in rows_by_bytes(batches, html_col):
                yield made(rows, [known.value.get(host(r[1]), ()) for r in rows])

        return pages.mapInArrow(run, schema)

    pages = pages.withColumn("_key", F.monotonically_increasing_id())  # of a scan: the same when a task runs again

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_by_bytes(batches, html_col):
            asked = [(key, site, x) for _, url, page, key in rows if page and (site := host(url)) for x in {x for b in parse(page)[0] if b[1] > -2 for x in _entries(*b)}]
            columns = list(zip(*asked, strict=True)) or [[]] * 3
            yield arrow_batch({"_key": (columns[0], pa.int64()), "host": (columns[1], pa.string()), "what": (columns[2], pa.string())})

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_by_bytes(batches, html_col):
            yield made(rows, [frozenset(r[3] or ()) for r in rows])

    said = pages.mapInArrow(ask, "_key long, host string, what string").join(table, ["host", "what"]).groupBy("_key").agg(F.collect_set("what").alias("_said"))
    return pages.join(said, "_key", "left").select(id_col, url_col, html_col, "_said").mapInArrow(run_joined, schema)
