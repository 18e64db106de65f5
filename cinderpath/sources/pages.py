"""Raw pages to lines, links and rows (SRC-2 to 10, PAR-23, SNK-6). Fetching is an ingest step outside; these read stored pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the address of a result page holds, and what is archived.
RESULT_LINK = r"(?i)^.*(?:results|emitl|pvc).*$"
ARCHIVED = r"(?i)\.(?:htm|html|pdf|txt|csv)$"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file, text: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def links(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """SRC-2: the distinct addresses of links and frames of each page."""
    found = F.expr(rf"regexp_extract_all({html}, '(?i)<(?:a|frame|iframe)\\b[^>]*?(?:href|src)=\"([^\"]+)\"', 1)")
    return pages.select(*keep, F.explode(found).alias("href")).distinct()


def absolute(base: Column, href: Column) -> Column:
    """An address as a page at ``base`` means it: other schemes as they are, the rest resolved with its dots."""
    page = F.regexp_replace(base, r"[?#].*$", "")
    root = F.regexp_extract(page, r"^(\w+://[^/]*)", 1)
    folder = F.when(page.rlike(r"^\w+://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    own = href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    joined = (
        F.when(href == "", base).when(own, href).when(href.startswith("//"), F.concat(F.regexp_extract(page, r"^(\w+:)", 1), href)).when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(page, href)).when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href)).otherwise(F.concat(folder, href))
    )
    path = F.regexp_extract(joined, r"^\w+://[^/]*/([^?#]*)", 1)
    steps = F.split(path, "/")
    walked = F.aggregate(steps, F.slice(steps, 1, 0), lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    folded = F.concat(F.array_join(walked, "/"), F.when(path.rlike(r"(?:^|/)\.\.?$") & (F.size(walked) > 0), "/").otherwise(""))
    dotted = ~own & joined.rlike(r"^\w+://[^/]*/(?:[^?#]*/)?\.\.?(?:[/?#]|$)")
    return F.when(dotted, F.concat(F.regexp_extract(joined, r"^(\w+://[^/]*/)", 1), folded, F.regexp_extract(joined, r"([?#].*)$", 1))).otherwise(joined)


def year_from_url(url: Column, text: Column | None = None) -> Column:
    """SRC-6: the year in the address, else in the text, else ``unknown``."""
    year = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.coalesce(year(url, r"/(20\d{2})"), *([year(text, r"(20\d{2})")] if text is not None else []), F.lit("unknown"))


def new_files(candidates: DataFrame, manifest: DataFrame, synced: DataFrame) -> DataFrame:
    """SRC-3, 5: candidate addresses that neither the manifest nor the loaded meets have; query strings cut, .htm as the usual ending."""
    url = F.regexp_replace("href", r"\?.*$", "")
    named = candidates.withColumn("url", url).withColumn("stem", F.regexp_extract("url", r"([^/]+?)(?:\.[^./]+)?$", 1))
    return named.join(manifest.select("url"), "url", "left_anti").join(synced.select("stem"), "stem", "left_anti").withColumn("file", F.concat("stem", F.lit(".htm")))


def link_dates(pages: DataFrame, html: str = "html", key: str = "page") -> DataFrame:
    """SRC-10, SNK-6, DDP-2: filename, date_text: the date last seen in a table at or above a link's row; later links overwrite."""
    from pyspark.sql import Window

    tables = pages.select(key, F.posexplode(F.expr(rf"regexp_extract_all({html}, '(?is)<table[^>]*>(.*?)</table>', 1)")).alias("t", "table"))
    rows = tables.select(key, "t", F.posexplode(F.expr(r"regexp_extract_all(table, '(?is)<tr[^>]*>(.*?)</tr>', 1)")).alias("r", "row"))
    date = F.nullif(F.regexp_extract(F.regexp_replace("row", "<[^>]*>", ""), r"([A-Z][a-z]+ \d{1,2}(?:-\d{1,2})?, \d{4})", 1), F.lit(""))
    carried = rows.withColumn("date_text", F.last(date, ignorenulls=True).over(Window.partitionBy(key, "t").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))).where("date_text IS NOT NULL")
    found = carried.select(key, "t", "r", "date_text", F.posexplode(F.expr("regexp_extract_all(row, '(?i)<a[^>]*href=\"([^\"]+)\"', 1)")).alias("i", "href")).withColumn("filename", F.substring_index("href", "/", -1)).where("filename RLIKE '[.]html?$'")
    return found.groupBy("filename").agg(F.max_by("date_text", F.struct(key, "t", "r", "i")).alias("date_text"))


class _Bio(HTMLParser):
    """Collects the result rows of one athlete's page (SRC-9, PAR-23)."""

    def __init__(self) -> None:
        super().__init__()
        self.name = self.title = self.season = self.event = self.header = self.text = ""
        self.rows: list[list[str]] = []
        self.cells: list[str] | None = None
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and a.get("name") == "favTitle":
            self.name = a.get("content", "").replace("TF - ", "").strip()
        elif tag in ("title", "h5") or (tag == "div" and "card-header" in a.get("class", "")):
            self.inside.append("header" if tag == "div" else tag)
            self.text = ""
        elif tag == "tr":
            self.cells = []
        elif tag == "td" and self.cells is not None:
            self.cells.append("")

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.text += data
        elif self.cells:
            self.cells[-1] += data

    def handle_endtag(self, tag: str) -> None:
        if self.inside and tag == {"header": "div"}.get(self.inside[-1], self.inside[-1]):
            kind, text = self.inside.pop(), " ".join(self.text.split())
            if kind == "title":
                self.title = text.split("-")[0].strip()
            elif kind == "header" or (self.inside and self.inside[-1] == "header"):
                self.season = text
            else:
                self.event, self.cells = text, None
        elif tag == "tr" and self.cells is not None:
            if len(self.cells) >= 5:
                self.rows.append([self.season, self.event, *(" ".join(c.split()) for c in self.cells[:5])])
            self.cells = None


class BioRows:
    """The table function behind ``bio_results``: a page's result rows."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        bio = _Bio()
        bio.feed(html or "")
        for ord_, row in enumerate(bio.rows):
            yield bio.name or bio.title, ord_, *row


BIO_ROWS = "athlete_name string, ord long, season_text string, event string, place string, dash string, mark_text string, date string, meet_name string"


def register_bio_rows(spark: SparkSession, name: str = "bio_rows") -> None:
    """Makes the rows of an athlete's page a table function of SQL: ``SELECT p.file, r.* FROM pages p, LATERAL bio_rows(p.html) r``."""
    spark.udtf.register(name, F.udtf(BioRows, returnType=BIO_ROWS))


def bio_results(pages: DataFrame) -> DataFrame:
    """SRC-9, PAR-23: athlete_name, season, event, mark, place, date, meet_name, is_pr, is_sb of athletes' pages (file, html): a lateral join with ``bio_rows``."""
    spark = pages.sparkSession
    register_bio_rows(spark)
    raw = spark.sql("SELECT p.file, r.* FROM {pages} p, LATERAL bio_rows(p.html) r", pages=pages.select("file", "html"))
    season = F.coalesce(F.nullif(F.regexp_extract("season_text", r"^(\d{4}\s+(?:Indoor|Outdoor|XC))", 1), F.lit("")), F.col("season_text"))
    mark = F.trim(F.regexp_replace("mark_text", r"\b(?:PR|SR)\b", ""))
    return raw.where("athlete_name <> ''").select("file", "ord", "athlete_name", season.alias("season"), "event", mark.alias("mark"), "place", "date", "meet_name", F.contains("mark_text", F.lit("PR")).alias("is_pr"), F.contains("mark_text", F.lit("SR")).alias("is_sb"))
