"""Following links over stored pages: frames, years, and everything that can be reached, each page once (SRC-2, SRC-4).

A round joins the pages found last with the links that leave them, drops those that an earlier round has, and writes the rest as a table.
So a link is followed once however many ways lead to its page and however often links lead back; the number of rounds is the number of
steps to the page furthest off. Nothing but the emptiness of a round comes to the driver.
"""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import shared_dir, stored
from .pages import ARCHIVED, RESULT_LINK, absolute

#: What the address of an archived file holds, and the text of a link to another year.
FILED = r"(?i)wp-content|results|scores"
YEAR_TEXT = r"^20\d{2}$"
NEWEST, NEWEST_LINK = "2026", "indoor-results"
_TAG = r"""(?is)<(a|frame|iframe)\b((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>(?:((?:(?!</?a\b).)*+)</a\s*>)?"""


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """SRC-2: page, link (absolute), text, is_frame: every link and frame of every page, as often as it stands there."""
    part = lambda i: F.regexp_extract_all(html, F.lit(_TAG), i)
    found = pages.select(F.col(url).alias("page"), F.explode(F.arrays_zip(part(1).alias("tag"), part(2).alias("attributes"), part(3).alias("text"))).alias("l")).select("page", "l.*")
    is_frame = F.lower("tag") != "a"
    value = lambda name: F.regexp_extract("attributes", rf"(?is)(?:^|\s){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    raw = F.when(is_frame, value("src")).otherwise(value("href"))
    href = F.regexp_replace(F.regexp_replace(raw, r"(?s)^\s*\w+\s*=\s*", ""), "^[\"']|[\"']$", "")
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "<[^>]*>", ""))
    return found.where(raw != "").select("page", absolute(F.col("page"), F.replace(F.trim(href), F.lit("&amp;"), F.lit("&"))).alias("link"), text.alias("text"), is_frame.alias("is_frame"))


def reach(seeds: DataFrame, links: DataFrame, key: list[str], carry: dict[str, Column]) -> DataFrame:
    """What can be reached from ``seeds`` (``key``, url, and what is carried along) over ``links`` (page, link …), with the ``round`` that found it.

    ``carry`` gives what a row hands on over a link, by name; a null hands nothing on. Of several ways of one round the least values
    win. With another key, the same page is reached once for each value of it.
    """
    spark = seeds.sparkSession
    names = [c for c in seeds.columns if c not in (*key, "url")]
    path = f"{shared_dir(spark)}/cinderpath/reached-{uuid.uuid4().hex}"
    least = F.min(F.struct(*names)).alias("_told") if names else F.lit(None).alias("_told")
    told = [F.col(f"_told.{c}").alias(c) for c in names]
    found, number = seeds.groupBy(*key, "url").agg(least).select(*key, "url", *told), 0
    schema = seeds.select(*key, "url", *names).schema
    links = stored(links.distinct(), "links")  # pages that are linked often would multiply each way to them
    while True:
        found.write.parquet(f"{path}/round={number}")
        last = spark.read.schema(schema).parquet(f"{path}/round={number}")
        if last.isEmpty():
            return spark.read.schema(schema.add("round", "long")).parquet(path)
        before = spark.read.schema(schema).parquet(*[f"{path}/round={n}" for n in range(number + 1)]).select(*key, "url")
        ways = last.join(links, last["url"] == links["page"])
        ways = ways.select(*key, F.col("link").alias("_url"), *[carry[n].alias(f"_{n}") for n in names])
        ways = ways.where(" AND ".join(["_url IS NOT NULL", *[f"_{n} IS NOT NULL" for n in names]])).select(*key, F.col("_url").alias("url"), *[F.col(f"_{n}").alias(n) for n in names])
        found = ways.groupBy(*key, "url").agg(least).select(*key, "url", *told).join(before, [*key, "url"], "left_anti")
        number += 1


def crawl(start: DataFrame, links: DataFrame) -> DataFrame:
    """SRC-4: url, year, depth, round of every page reached from ``start`` (url, year), once.

    Frames are followed in the year of their page, one deeper; links whose text is a year only from a page that is no frame, into that
    year. In the newest year, links to its kind of results count too if their text has a year.
    """
    told = F.regexp_extract("text", r"(20\d{2})", 1)
    named = F.col("text").rlike(YEAR_TEXT) | ((F.col("year") == NEWEST) & F.lower("link").contains(NEWEST_LINK) & (told != ""))
    other_year = (F.col("depth") == 0) & ~F.col("is_frame") & named & (told != F.col("year"))
    carry = {
        "depth": F.when(F.col("is_frame"), F.col("depth") + 1).when(other_year, F.lit(0).cast("long")),
        "year": F.when(F.col("is_frame"), F.col("year")).when(other_year, told),
    }
    return reach(start.select("url", F.lit(0).cast("long").alias("depth"), "year"), links, [], carry)


def archived(reached: DataFrame, links: DataFrame) -> DataFrame:
    """SRC-4: url, year: the files that the pages of a crawl link to, each filed under the least of the years that name it in the earliest round."""
    rows = reached.join(links.where("NOT is_frame").select("page", "link").distinct(), F.col("url") == F.col("page"))
    named = F.lower("link").rlike(ARCHIVED) & (F.col("link").rlike(FILED) | (F.col("depth") > 0))
    return rows.where(named).groupBy(F.col("link").alias("url")).agg(F.min(F.struct("round", "year")).alias("f")).select("url", "f.year")


def meet_links(indexes: DataFrame, links: DataFrame) -> DataFrame:
    """SRC-2: index, link: the result pages that index pages (url) link to, themselves or in frames at any depth.

    Result pages are handed up from the pages that link to them over the frames that show these, so a round holds pairs of the result
    only. Handed down, every index would be followed over all frames below it, which many pages share.
    """
    named = links.where("NOT is_frame").where(F.col("link").rlike(r"\.html?$") & F.col("link").rlike(RESULT_LINK))
    seeds = named.select(F.col("link").alias("target"), F.col("page").alias("url")).distinct()
    upwards = links.where("is_frame").select(F.col("link").alias("page"), F.col("page").alias("link"))
    found = reach(seeds, upwards, ["target"], {})
    return found.join(indexes.select("url").distinct(), "url", "left_semi").select(F.col("url").alias("index"), F.col("target").alias("link"))
