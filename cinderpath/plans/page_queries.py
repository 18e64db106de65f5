"""Registered queries over raw pages, and their SQL: crawl, links, page tree, manifest, athletes' pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import crawl as crawling
from ..sources import page_tree
from ..sources.bindings import table

SITE = "http://site.example"


def _site(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages as a site: a page's address is the first word of its title, so its links lead to pages. Some links are frames or name a year."""
    word = F.lower(F.regexp_extract("html", r"<title>([^\s<.,]*)", 1))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit(f"{SITE}/"), word).alias("url"), "html")
    links = crawling.page_links(pages).withColumn("link", F.lower("link"))
    n = F.length("link")
    return pages, links.select("page", F.when(n % 5 == 0, F.concat("link", F.lit("/results.htm"))).otherwise(F.col("link")).alias("link"), F.when(n % 3 == 0, F.concat(F.lit("20"), (n % 10 + 20).cast("string"))).otherwise(F.col("text")).alias("text"), (n % 2 == 0).alias("is_frame"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2: every link of every page."""
    return crawling.page_links(table(spark, d, "pages"))


def crawl(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4: what a crawl reaches, with years."""
    pages, links = _site(spark, d)
    start = pages.groupBy().agg(F.min("url").alias("url")).where("url IS NOT NULL").select("url", F.lit("2020").alias("year"))
    return crawling.crawl(start, links)


def crawl_files(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4, 3: the files that a crawl archives, by year."""
    pages, links = _site(spark, d)
    start = pages.groupBy().agg(F.min("url").alias("url")).where("url IS NOT NULL").select("url", F.lit("2020").alias("year"))
    return crawling.archived(crawling.crawl(start, links), links)


def meet_links(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2: the result pages of every page and of the frames below it."""
    pages, links = _site(spark, d)
    return crawling.meet_links(pages.select("url"), links)


def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """SRC-7, 8: the lines of every page."""
    rows = page_tree.tree_lines(table(spark, d, "pages"), "html", "page_id")
    return rows.select("page_id", F.posexplode("lines").alias("pos", "text")).select("page_id", F.col("pos").cast("long").alias("pos"), "text")


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (page_links, crawl, crawl_files, meet_links, html_paragraphs)

_A = r"""(?:[^>"'']|"[^"]*"|''[^'']*'')*"""
_TOKEN = rf"(?is)<!--.*?-->|<[!?][^>]*>|<(?:script|style)\b{_A}>.*?</(?:script|style)\s*>|</?[a-z]{_A}>|[^<]+|<"
_LINKS = rf"""found AS (SELECT {{page}} AS page, unnest(regexp_extract_all(html, '(?is)<a\b{_A}>[^<]*</a\s*>')) AS tag FROM pages),
plain AS (SELECT page, regexp_extract(tag, 'href="([^"]*)"', 1) AS href, trim(regexp_extract(tag, '(?s)>([^<]*)<', 1)) AS text FROM found)"""
_SITE = f"""WITH RECURSIVE {_LINKS.format(page=f"'{SITE}/' || lower(regexp_extract(html, '<title>([^[:space:]<.,]*)', 1))")},
low AS (SELECT page, lower('{SITE}' || href) AS link, text FROM plain WHERE href <> ''),
links AS (SELECT page, CASE WHEN length(link) % 5 = 0 THEN link || '/results.htm' ELSE link END AS link, CASE WHEN length(link) % 3 = 0 THEN '20' || (length(link) % 10 + 20) ELSE text END AS text, length(link) % 2 = 0 AS is_frame FROM low)"""
_CRAWL = f"""{_SITE},
reached(url, depth, year, round) USING KEY (url) AS (
  SELECT min(page), 0::BIGINT, '2020', 0::BIGINT FROM links
  UNION
  SELECT link, min(t).depth, min(t).year, min(t).round FROM (
    SELECT link, {{'depth': CASE WHEN is_frame THEN depth + 1 ELSE 0 END, 'year': CASE WHEN is_frame THEN year ELSE text END, 'round': round + 1}} AS t
    FROM reached JOIN links ON page = url
    WHERE (is_frame OR (depth = 0 AND regexp_matches(text, '^20[0-9][0-9]$') AND text <> year)) AND NOT EXISTS (SELECT 1 FROM recurring.reached r WHERE r.url = link)
  ) GROUP BY link
)"""
_ENTITIES = "t"
for _code, _char in page_tree.ENTITIES:
    _ENTITIES = f"replace({_ENTITIES}, '{_code}', '{_char.replace(chr(39), chr(39) * 2)}')"

SQL = {
    "page_links": f"WITH {_LINKS.format(page='url')} SELECT page, regexp_extract(page, '^([a-z]+://[^/?#]*)', 1) || href AS link, text, false AS is_frame FROM plain WHERE href <> ''",
    "crawl": f"{_CRAWL} SELECT url, depth, year, round FROM reached",
    "crawl_files": f"""{_CRAWL} SELECT url, f.year AS year FROM (SELECT link AS url, min({{'round': round, 'year': year}}) AS f FROM reached JOIN links ON page = url
WHERE NOT is_frame AND regexp_matches(lower(link), '[.](?:htm|html|pdf|txt|csv)$') AND (regexp_matches(lower(link), 'wp-content|results|scores') OR depth > 0) GROUP BY 1)""",
    "meet_links": f"""{_SITE},
reached AS (SELECT DISTINCT page AS index, page AS url FROM links UNION SELECT index, link FROM reached JOIN links ON page = url AND is_frame)
SELECT DISTINCT index, link FROM reached JOIN links ON page = url AND NOT is_frame WHERE regexp_matches(link, '[.]html?$') AND regexp_matches(lower(link), 'results|emitl|pvc')""",
    "html_paragraphs": f"""WITH RECURSIVE tok AS (SELECT page_id, regexp_extract_all(html, '{_TOKEN}') AS toks FROM pages),
tag AS (SELECT page_id, toks, list_filter(list_transform(toks, lambda x, i: {{'pos': i, 'name': CASE WHEN regexp_matches(x, '^(?i:<script|<style)') THEN '' ELSE lower(regexp_extract(x, '^</?([a-zA-Z][^[:space:]/>]*)', 1)) END, 'close': x[1:2] = '</'}}), lambda x: x.name <> '') AS tags FROM tok),
fold AS (
  SELECT page_id, 1 AS i, []::STRUCT(name VARCHAR, pos BIGINT)[] AS stack, []::STRUCT(name VARCHAR, pos BIGINT, till BIGINT)[] AS done FROM tag
  UNION ALL
  SELECT page_id, i + 1,
    CASE WHEN void THEN stack WHEN NOT t.close THEN list_append(stack, {{'name': t.name, 'pos': t.pos}}) WHEN place = 0 THEN stack ELSE stack[1:len(stack) - place] END,
    CASE WHEN void THEN CASE WHEN t.name = 'br' AND NOT t.close THEN list_append(done, {{'name': 'br', 'pos': t.pos, 'till': t.pos + 1}}) ELSE done END WHEN NOT t.close OR place = 0 THEN done
         ELSE list_concat(done, list_transform(stack[len(stack) - place + 1:], lambda e: {{'name': e.name, 'pos': e.pos, 'till': t.pos}})) END
  FROM (SELECT *, list_contains({list(page_tree.VOID)}, t.name) AS void, coalesce(list_position(list_transform(list_reverse(stack), lambda e: e.name), t.name), 0) AS place
        FROM (SELECT fold.*, tags[i] AS t FROM fold JOIN tag USING (page_id) WHERE i <= len(tags)))
), ended AS (SELECT page_id, toks, list_concat(done, list_transform(stack, lambda e: {{'name': e.name, 'pos': e.pos, 'till': len(toks) + 1}})) AS els FROM fold JOIN tag USING (page_id) WHERE i = len(tags) + 1),
el AS (SELECT page_id, toks, unnest(els) AS e FROM ended),
block AS (SELECT page_id, e.pos AS place, array_to_string(list_filter(toks[e.pos + 1:e.till - 1], lambda x: x[1:1] <> '<' OR x = '<'), '') AS t FROM el WHERE e.name IN ('p', 'div', 'br'))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS pos, {_ENTITIES} AS text FROM block""",
}
