"""Main text of web pages, with nearest-URL page differencing for what markup leaves open.

A page is read tag by tag with a stack of its open block elements; elements whose end tag is left
out (p, li, td, option, ...) end where the next one or their parent does. Scripts, styles, comments
and elements that are never the article (menus, footers, sidebars, forms, and block elements with
a class, id or role that is a word for advert, notice, reader comments and the like, an article of
that kind too) are left out; such a word inside a longer name (no-sidebar) says nothing, nor does
it on an element inside a line. An element left out that turns out to hold the page's article is
taken back. If the page has an article or main element, its blocks are the text: markup decides,
and differencing is the fallback for pages without one. There every block outside those elements is open: the page is paired
with the page of its host whose list of blocks differs and whose URL path is nearest in order (of
the one before and the one after, that with the longer common start), the two lists of blocks are
aligned by a longest common subsequence, and the shared blocks are deleted.

Differencing alone cannot give right results here: menus, adverts and footers differ from page
to page, and copies of an article on one host would be deleted; so it decides only where the
markup does not (README has figures).

Neighbours are found by sorting (host, path) over ranges, not hosts, so a host with a third of
all pages is spread over many tasks; the rows at the ends of the ranges are paired in a table
of two stretches of equal pages per range.

Null html is empty; null URLs share the empty host. Repeated rows are pages of their own; a
page's copies are never its neighbour, and where a host has nothing else all blocks stay. An empty table gives no rows. Other columns are
left out.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm import common
from pairloom.llm.line_dedup import host_of

#: Elements whose content is never text, elements that are never part of an article, elements
#: that hold one, elements that stay in a line (fixed lists of the markup language).
RAW = "script style template noscript iframe object svg math textarea select title head".split()
NEVER = "nav footer aside form menu dialog button".split()
MAIN = ("article", "main")
INLINE = ("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark "
          "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr").split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()

#: Block elements that end where one of these begins, up to the nearest of the second list (fixed
#: lists of the markup language). A p also ends where any block begins.
ENDED_BY = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option optgroup", "select datalist"),
    "optgroup": ("option optgroup", "select"), "td": ("td th", "table"), "th": ("td th", "table"), "tr": ("tr td th", "table"),
    "thead": ("tr td th tbody tfoot thead caption colgroup", "table"), "tbody": ("tr td th tbody tfoot thead caption colgroup", "table"),
    "tfoot": ("tr td th tbody tfoot thead caption colgroup", "table"),
}
ENDED_BY = {name: (frozenset(ends.split()), frozenset(till.split())) for name, (ends, till) in ENDED_BY.items()}
#: A p is not looked for beyond these.
HOLDS = frozenset("td th caption table object button".split())

#: Classes, ids and roles that mark a block as something else than the article.
OTHER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar footer masthead cookie cookies cookie-banner cookie-notice consent notice notices alert popup modal "
    "newsletter subscribe signup login search share sharing social social-share share-buttons related related-posts "
    "related-articles recommended comment comments comment-list commentlist comments-area comment-form respond reply replies "
    "disqus disqus_thread contentinfo complementary sidebar-left sidebar-right ad-container ad-slot site-footer site-nav".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*)(?:>|\Z)", re.S)
MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def _says_other(rest: str) -> bool:
    """Is a whole word of the element's class, id or role one of ``OTHER``?"""
    return any(word in OTHER for t in MARKED.findall(rest) for x in t if x for word in x.lower().split())


def blocks(page: str) -> tuple[bool, list[str], list[str]]:
    """Has the page a main element, the blocks inside it, the open blocks outside."""
    inside: list[str] = []
    outside: list[str] = []
    held: list[str] = []
    # Open block elements: name and what they are (1 left out, 2 the article, 0 neither).
    names: list[str] = []
    kinds: list[int] = []
    skips = mains = 0
    found = False

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                (inside if mains else outside).append(text)

    def pop(size: int) -> None:
        nonlocal skips, mains
        for kind in kinds[size:]:
            skips -= kind == 1
            mains -= kind == 2
        del names[size:], kinds[size:]

    def end_open(ends, till) -> None:
        """End the innermost open elements of ``ends``, as far as the nearest of ``till``."""
        size = len(names)
        for k in range(len(names) - 1, -1, -1):
            if names[k] in till or kinds[k] == 2:
                break
            if names[k] in ends:
                size = k
        pop(size)

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        cut = m.start() if m else len(page)
        if cut > at and not skips:
            held.append(page[at:cut])
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        ending = bool(m["end"] or m["end2"])
        rest = m["rest"] or m["rest2"] or ""
        if name in RAW and not ending and not rest.endswith("/"):
            stop = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if stop:
                at = stop.end()
            elif name != "head":
                at = len(page)
            continue
        if name in INLINE:
            continue
        if not skips:
            close()
        if ending:
            for k in range(len(names) - 1, -1, -1):
                if names[k] == name:
                    pop(k)
                    break
                if kinds[k] == 2 and name not in ("body", "html"):
                    break  # a stray end does not leave the article
            continue
        if name in VOID or rest.endswith("/"):
            continue
        if name in ENDED_BY:
            end_open(*ENDED_BY[name])
        end_open(("p",), HOLDS)
        other = name != "body" and _says_other(rest)
        kind = 0
        if name in MAIN and not other and not mains:
            if skips and not found:  # what was left out holds the article, or was never ended
                kinds[:] = [0] * len(kinds)
                skips = 0
            if not skips:
                kind, found = 2, True
        elif name in NEVER or other or name == "header" and not mains:
            kind = 1
        names.append(name)
        kinds.append(kind)
        skips += kind == 1
        mains += kind == 2
    if not skips:
        close()
    return found, inside, outside


def shared(mine: list[str], other: list[str]) -> set[int]:
    """Places in ``mine`` of one longest common subsequence, by its chains of matching places."""
    top = 0
    while top < min(len(mine), len(other)) and mine[top] == other[top]:
        top += 1
    tail = 0
    while tail < min(len(mine), len(other)) - top and mine[-1 - tail] == other[-1 - tail]:
        tail += 1
    places: dict[str, list[int]] = {}
    for j in range(top, len(other) - tail):
        places.setdefault(other[j], []).append(j)
    ends: list[int] = []  # the smallest end of a chain of each length
    links: list[tuple] = []
    for i in range(top, len(mine) - tail):
        for j in reversed(places.get(mine[i], ())):
            k = bisect_left(ends, j)
            node = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(node)
            else:
                ends[k], links[k] = j, node
    out = {*range(top), *range(len(mine) - tail, len(mine))}
    node = links[-1] if links else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


PARSED = ("page_id long, url string, _host string, _path string, _uid long, _main boolean, text string, "
          "_lines array<string>")


def parse(pages: DataFrame) -> DataFrame:
    def run(batches):
        base, n = TaskContext.get().partitionId() << 33, 0
        for batch in common.slices(batches, "html"):
            rows = [blocks(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("page_id", "url", "_host", "_path")),
                pa.array(range(base + n, base + n + len(rows)), pa.int64()), pa.array([r[0] for r in rows]),
                pa.array(["\n".join(r[1]) for r in rows]),
                pa.array([[] if r[0] and not r[2] else r[2] for r in rows], pa.list_(pa.string()))],
                ["page_id", "url", "_host", "_path", "_uid", "_main", "text", "_lines"])
            n += len(rows)

    common.small_batches(pages.sparkSession)
    path = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        host_of(F.col("url")).alias("_host"), path.alias("_path"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(run, PARSED)


def nearest(keys: DataFrame) -> DataFrame:
    """For rows (_host, _path, _uid, _mark): _uid and _partner, the row of the host with the nearest
    path and another mark; without _mark all rows differ.

    Rows in order with one mark are a stretch. What lies beside a stretch is seen where it ends
    inside a range; the first and the last stretch of each range are completed in a small table.
    """
    def run(batches):
        part = TaskContext.get().partitionId()
        held, key, before, first = [], None, None, True

        def rows_of(after, last):
            """The held stretch; before and after are (host, path, uid) or None."""
            b = before if before and before[0] == key[0] else (None,) * 3
            a = after if after and after[0] == key[0] else (None,) * 3
            n, edge = len(held), first or last
            kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(),
                     pa.int64())
            columns = ([key[0]] * n, [r[0] for r in held], [r[1] for r in held], [key[1]] * n, [b[2]] * n, [b[1]] * n,
                       [a[2]] * n, [a[1]] * n, [part * 2 + (not first) if edge else None] * n)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for host, path, uid, mark in zip(*(batch.column(c).to_pylist() for c in ("_host", "_path", "_uid", "_mark"))):
                if key != (host, mark):
                    if held:
                        yield rows_of((host, path, uid), False)
                        before, first = (key[0], *held[-1]), False
                    held, key = [], (host, mark)
                held.append((path, uid))
        if held:
            yield rows_of(None, True)

    names = ["_host", "_path", "_uid", "_mark", "_b", "_bp", "_a", "_ap", "_stretch"]
    if "_mark" not in keys.columns:
        keys = keys.withColumn("_mark", F.col("_uid").cast("string"))
    order = ("_host", "_path", "_uid")
    sides = common.stage(keys.select(*order, "_mark").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        run, "_host string, _path string, _uid long, _mark string, _b long, _bp string, _a long, _ap string, "
             "_stretch long"), "page-neighbours")
    # At most two stretches a range, in order: a missing side is the stretch beside it, or what
    # lies beside that one where it has the same mark.
    ends = sides.filter("_stretch IS NOT NULL").groupBy("_stretch", "_host", "_mark").agg(
        F.min(F.struct("_path", "_uid")).alias("_first"), F.max(F.struct("_path", "_uid")).alias("_last"),
        F.max(F.when(F.col("_b").isNotNull(), F.struct(F.col("_bp").alias("_path"), F.col("_b").alias("_uid")))).alias("_x"),
        F.max(F.when(F.col("_a").isNotNull(), F.struct(F.col("_ap").alias("_path"), F.col("_a").alias("_uid")))).alias("_y"))
    beside = Window.partitionBy("_host").orderBy("_first")
    same = F.lag("_mark").over(beside).eqNullSafe(F.col("_mark"))
    ends = (ends.withColumn("_run", F.when(same, 0).otherwise(1))
            .withColumn("_x", F.coalesce("_x", F.when(~same, F.lag("_last").over(beside))))
            .withColumn("_y", F.coalesce("_y", F.when(~F.lead("_mark").over(beside).eqNullSafe(F.col("_mark")),
                                                      F.lead("_first").over(beside))))
            .withColumn("_run", F.sum("_run").over(beside)))
    run_of = Window.partitionBy("_host", "_run").orderBy("_first")
    ends = ends.select(
        "_stretch", F.last("_x", True).over(run_of.rowsBetween(Window.unboundedPreceding, 0)).alias("_x"),
        F.first("_y", True).over(run_of.rowsBetween(0, Window.unboundedFollowing)).alias("_y"))

    def common_start(path):
        pairs = F.arrays_zip(F.split("_path", "").alias("x"), F.split(path, "").alias("y"))
        differ = F.array_position(F.transform(pairs, lambda p: p["x"].eqNullSafe(p["y"])), F.lit(False))
        return F.when(differ == 0, F.lit(1 << 40)).otherwise(differ)

    both = sides.join(F.broadcast(ends), "_stretch", "left").select(
        "_uid", "_path", F.coalesce("_b", "_x._uid").alias("_b"), F.coalesce("_bp", "_x._path").alias("_bp"),
        F.coalesce("_a", "_y._uid").alias("_a"), F.coalesce("_ap", "_y._path").alias("_ap"))
    near = F.when(F.col("_a").isNull() | (common_start(F.col("_bp")) >= common_start(F.col("_ap"))),
                  F.col("_b")).otherwise(F.col("_a"))
    return both.select("_uid", F.coalesce(near, "_a").alias("_partner"))


def without_shared(pairs: DataFrame) -> DataFrame:
    """Rows (page_id, url, _lines, _other) to texts of the blocks that the other page lacks."""
    def run(batches):
        for batch in batches:
            texts = []
            for mine, other in zip(batch.column("_lines").to_pylist(), batch.column("_other").to_pylist()):
                gone = shared(mine, other or [])
                texts.append("\n".join(x for i, x in enumerate(mine) if i not in gone))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    return pairs.select("page_id", "url", "_lines", "_other").mapInArrow(
        run, "page_id long, url string, text string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    parsed = common.stage(parse(pages), "pages-parsed")
    told = parsed.filter("_main").select("page_id", "url", "text")
    open_pages = parsed.filter("NOT _main")
    hosts = open_pages.select("_host").distinct()
    mark = F.md5(F.concat_ws("\n", "_lines").cast("binary"))  # blocks have no line feed
    pairs = nearest(parsed.join(hosts, "_host", "left_semi").withColumn("_mark", mark))
    lines = parsed.select(F.col("_uid").alias("_partner"), F.col("_lines").alias("_other"))
    paired = open_pages.join(pairs, "_uid").join(lines, "_partner", "left")
    return told.unionByName(without_shared(paired))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(common.read_table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
