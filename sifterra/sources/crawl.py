"""A crawl over a table of fetched pages: levels of links from seeds to a fixpoint.

Each round joins the last level's pages with their links and takes away what was seen;
levels are written, so a round's plan does not grow with the rounds before.  Links are
resolved by expressions (RFC 3986), so nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifterra.storage import discard, materialize

#: Tables of levels that a round's plan may read.
KEPT = 12
_HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are carried out; one at the end leaves its slash."""
    segments = F.split(path, "/")
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.when((F.size(done) > 1), F.slice(done, 1, F.size(done) - 1)).otherwise(done)).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    open_ = F.element_at(segments, -1).isin(".", "..")
    return F.concat(F.array_join(walked, "/"), F.when(open_, "/").otherwise(""))


def resolved(base: Column, link: Column) -> Column:
    """Absolute URL of a link on the page ``base``, without its fragment; null for null.

    A link with a host of its own keeps its path as it is."""
    scheme, host, path, query = (_part(link, i) for i in range(1, 5))
    base_path = _part(base, 3)
    folder = F.when(base_path == "", "/").otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    merged = F.when(path == "", base_path).when(path.startswith("/"), without_dots(path)).otherwise(without_dots(F.concat(folder, path)))
    same = F.concat(_part(base, 1), F.lit("://"), _part(base, 2), merged, F.when((path == "") & (query == ""), _part(base, 4)).otherwise(query))
    other = F.concat(_part(base, 1), F.lit("://"), host, path, query)
    return F.when(F.lower(scheme).isin("http", "https"), F.regexp_replace(link, "#.*$", "")).when(scheme != "", link).when(link.startswith("//"), other).otherwise(same)


def page_links(pages: DataFrame) -> DataFrame:
    """(url, pos, link): the links of each page, resolved, each at its first place.

    ``pages`` has url and html.  Null pages have no link; of rows that repeat a url, all count.
    """
    each = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("pos", "raw"))
    full = each.select("url", "pos", resolved(F.col("url"), F.trim("raw")).alias("link")).where("link is not null")
    return full.groupBy("url", "link").agg(F.min("pos").cast("long").alias("pos")).select("url", "pos", "link")


def crawl(links: DataFrame, seeds: DataFrame, follow: Column, max_levels: int = 1000) -> DataFrame:
    """(url, level, parent): all pages that links reach from ``seeds`` (url; level 0).

    ``links`` is ``page_links``; links for which ``follow`` (over url, pos and link) is not
    true are not followed.  A page has the level of its shortest way and, of the pages of
    the level before that link to it, the smallest url as its parent.  Pages that were
    never fetched are reached, but lead nowhere.  Cycles end, as a page is taken once.
    """
    spark = links.sparkSession
    edges = materialize(links.where(follow).select("url", "link").distinct(), "links")
    level = materialize(seeds.select("url").where("url is not null").distinct().select("url", F.lit(0).alias("level"), F.lit(None).cast("string").alias("parent")), "level")
    seen = [level]
    for k in range(1, max_levels + 1):
        if len(seen) > KEPT:  # one table again, so that plans stay short however deep the crawl
            parts, seen = seen, [materialize(reduce(DataFrame.unionAll, seen), "seen")]
            for old in parts:
                if old is not level:
                    discard(old)
        known = reduce(DataFrame.unionAll, seen).select("url")
        reached = edges.join(level.select("url"), "url").groupBy(F.col("link").alias("to")).agg(F.min("url").alias("parent"))
        before, level = level, materialize(reached.select(F.col("to").alias("url"), F.lit(k).alias("level"), "parent").join(known, "url", "left_anti"), "level")
        if all(before is not old for old in seen):
            discard(before)
        if level.isEmpty():
            break
        seen.append(level)
    else:
        raise RuntimeError(f"the crawl goes on after {max_levels} levels")
    out = materialize(reduce(DataFrame.unionAll, seen), "reached")
    for old in (*seen, level, edges):
        discard(old)
    return out


def files_of(links: DataFrame, reached: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(link, name, url): files that reached pages link to, each on its first page by level,
    url and place; ``suffix`` is compared with the path in lower case."""
    path = F.lower(_part(F.col("link"), 3))
    found = links.where(path.endswith(suffix)).join(reached.select("url", "level"), "url")
    first = found.groupBy("link").agg(F.min(F.struct("level", "url", "pos")).alias("first"))
    return first.select("link", F.regexp_extract("link", r"([^/]*?)(?:\?.*)?$", 1).alias("name"), "first.url")
