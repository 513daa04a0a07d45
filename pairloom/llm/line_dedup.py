"""Boilerplate lines by their frequency within a site.

Lines are the text of a page between tags and line feeds, trimmed, without scripts, styles and
comments. Within a host (of the URL, lower case), a line's pages are divided by the host's
pages; a line above ``ratio`` is boilerplate there and is dropped wherever the host has it. A line
on one page only repeats nothing and stays: on hosts of up to three pages it too is above 0.3.

A page counts a line once. Counts combine before the shuffle, so a very common line or a host
with a third of all pages is a row per task. A host has at most (lines per page) / ratio such
lines, so they travel as one list of hashes per host, and the join back is dealt over several
keys for a hot host.

Null html has no lines. Null or unparsable URLs share the empty host. Repeated rows count as
pages of their own. Other columns of ``pages`` are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm import common
from pairloom.llm.exact import join_salted
from pairloom.llm.quality import BLANKS

RATIO = 0.3
MIN_PAGES = 2
MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def lines_of(html: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), MARKUP, "\n")
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")


def boilerplate(rows: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host with dropped lines: _host, _drop (hashes). ``rows`` has _host and _lines."""
    hashes = F.array_distinct(F.transform("_lines", lambda x: F.xxhash64(x)))
    counts = (rows.select("_host", F.explode(hashes).alias("_line"))
              .groupBy("_host", "_line").agg(F.count("*").alias("_with")).filter(F.col("_with") >= min_pages))
    pages = rows.groupBy("_host").agg(F.count("*").alias("_pages"))
    high = counts.join(pages, "_host").filter(F.col("_with") > F.col("_pages") * F.lit(ratio))
    return high.groupBy("_host").agg(F.collect_list("_line").alias("_drop"))


def clean_pages(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per page: page_id, n_lines, n_dropped, text (the lines that stay, joined by line feeds)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("_host"), lines_of(F.col("html")).alias("_lines"))
    drops = boilerplate(rows, ratio, min_pages)
    joined = join_salted(rows, drops, ["_host"], F.xxhash64("page_id", F.size("_lines")), how="left")
    stay = F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~F.array_contains("_drop", F.xxhash64(x))))
    out = joined.select("page_id", F.size("_lines").alias("_n"), stay.alias("_stay"))
    return out.select("page_id", F.col("_n").cast("long").alias("n_lines"),
                      (F.col("_n") - F.size("_stay")).cast("long").alias("n_dropped"),
                      F.array_join("_stay", "\n").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    return clean_pages(common.read_table(spark, sf_dir, "pages"))


SQL = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS k,
         lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host,
         list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''),
           '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>', chr(10), 'g'), chr(10)),
           lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines
  FROM pages),
l AS (SELECT host, unnest(list_distinct(lines)) AS line FROM p),
n AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT l.host, line FROM l JOIN n ON l.host = n.host GROUP BY l.host, line, pages
      HAVING count(*) >= 2 AND count(*) > pages * 0.3),
e AS (SELECT k, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM p),
s AS (SELECT e.k, string_agg(e.line, chr(10) ORDER BY place) AS text, count(*) AS n FROM e JOIN p ON e.k = p.k
      WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.host = p.host AND b.line = e.line) GROUP BY e.k)
SELECT page_id, len(lines) AS n_lines, len(lines) - coalesce(s.n, 0) AS n_dropped, coalesce(s.text, '') AS text
FROM p LEFT JOIN s ON p.k = s.k
"""
