"""Raw pages as trees: elements with the interval of the page that each one spans, and their texts (SRC-7, SRC-8).

A page is cut into tags and text once, by one pattern. A fold over its tags keeps the stack of open elements: a closing tag ends the
nearest open element of its name and all that opened inside it, and is ignored where none is open; what is still open ends with the
page. So an element is an interval of tokens, and its text is the text in the interval. All of it is native and inside the page's row:
no shuffle, work in proportion to a page's tags times its depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE_END

#: Elements that have no content, and elements whose content is no text.
VOID = (
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source",
    "spacer", "track", "wbr",
)
#: The blocks that give lines, and the entities that are resolved.
BLOCKS = ("p", "div", "br")
ENTITIES = (("&nbsp;", chr(160)), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"))
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = rf"(?is)<!--.*?-->|<[!?][^>]*+>|<(script|style)\b{_ATTRIBUTES}>.*?</\1\s*>|</?[a-z]{_ATTRIBUTES}>|[^<]++|<"


def resolved(text: Column) -> Column:
    """Text with its entities and numbered characters as characters."""
    numbered = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(\d{1,7});"), 1))
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    text = F.aggregate(F.coalesce(numbered, F.array().cast("array<string>")), text, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), char(n)))
    for code, to in ENTITIES:
        text = F.replace(text, F.lit(code), F.lit(to))
    return text


def _elements(tokens: Column, names: tuple[str, ...]) -> Column:
    """array of (tag, start, end): the elements of these names; the tokens between start and end, both from 0 and not included, are inside."""
    state = "struct<stack:array<struct<tag:string,start:int>>,done:array<struct<tag:string,start:int,end:int>>>"
    start = F.struct(F.array().cast("array<struct<tag:string,start:int>>").alias("stack"), F.array().cast("array<struct<tag:string,start:int,end:int>>").alias("done")).cast(state)
    wanted = lambda some: F.filter(some, lambda e: e["tag"].isin(*names))

    def step(s: Column, t: Column) -> Column:
        tag, at = t["tag"], t["at"]
        alone = tag.isin(*VOID) | t["selfclosed"]
        opened = F.struct(F.concat(s["stack"], F.array(F.struct(tag.alias("tag"), at.alias("start")))).alias("stack"), s["done"].alias("done"))
        empty = F.struct(s["stack"].alias("stack"), F.concat(s["done"], wanted(F.array(F.struct(tag.alias("tag"), at.alias("start"), (at + 1).alias("end"))))).alias("done"))
        # the place of the last open element of the name, from the end
        back = F.array_position(F.transform(F.reverse(s["stack"]), lambda e: e["tag"]), tag).cast("int")
        popped = F.slice(s["stack"], F.size(s["stack"]) - back + 1, back)
        ended = F.transform(wanted(popped), lambda e: F.struct(e["tag"].alias("tag"), e["start"].alias("start"), at.alias("end")))
        closed = F.struct(F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - back).alias("stack"), F.concat(s["done"], ended).alias("done"))
        return F.when(~t["closing"] & alone, empty).when(~t["closing"], opened).when(tag.isin(*VOID) | (back == 0), s).otherwise(closed)

    tags = F.filter(tokens, lambda t: t["tag"] != "")
    rest = lambda s: F.concat(s["done"], F.transform(wanted(s["stack"]), lambda e: F.struct(e["tag"].alias("tag"), e["start"].alias("start"), F.size(tokens).alias("end"))))
    return F.array_sort(F.aggregate(tags, start, step, rest), lambda a, b: a["start"] - b["start"])


def _tokens(html: Column) -> Column:
    """array of (at, tag, closing, selfclosed, text): the tags of a page and the texts between them; scripts, styles and comments are neither."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_TOKEN), 0)

    def told(token: Column, at: Column) -> Column:
        tag = F.when(token.rlike(r"(?i)^<(?:script|style)\b"), "").otherwise(F.lower(F.regexp_extract(token, r"(?i)^</?([a-z][^\s/>]*)", 1)))
        text = F.when(token.startswith("<") & (token != "<"), "").when(token.contains("&"), resolved(token)).otherwise(token)
        return F.struct(at.alias("at"), tag.alias("tag"), token.startswith("</").alias("closing"), token.endswith("/>").alias("selfclosed"), text.alias("text"))

    return F.transform(found, told)


def elements(pages: DataFrame, names: tuple[str, ...], html: str = "html", *keep: str) -> DataFrame:
    """keep…, ord, tag, start, end, text: the elements of these names in the order of their beginnings, each with all text inside it."""
    cut = pages.select(*keep, _tokens(F.col(html)).alias("_tokens"))
    spans = cut.select(*keep, "_tokens", F.posexplode(_elements(F.col("_tokens"), names)).alias("ord", "e"))
    inside = F.slice("_tokens", F.col("e.start") + 2, F.greatest(F.col("e.end") - F.col("e.start") - 1, F.lit(0)))
    return spans.select(*keep, "ord", "e.tag", "e.start", "e.end", F.array_join(F.transform(inside, lambda t: t["text"]), "").alias("text"))


def tree_lines(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """SRC-7, 8: keep…, lines: of the first ``pre`` its lines; else the text of each p and div, outer ones with all that they hold, and an empty line for each br; of a page without any, its text's lines."""
    cut = pages.select(*keep, _tokens(F.col(html)).alias("_tokens"))
    spans = cut.withColumn("_spans", _elements(F.col("_tokens"), (*BLOCKS, "pre")))
    text = lambda e: F.array_join(F.transform(F.slice("_tokens", e["start"] + 2, F.greatest(e["end"] - e["start"] - 1, F.lit(0))), lambda t: t["text"]), "")
    pre = F.get(F.filter("_spans", lambda e: e["tag"] == "pre"), F.lit(0))
    # a last line without text is none
    lines = lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, f"(?:{LINE_END})$", ""), LINE_END))
    blocks = F.filter("_spans", lambda e: e["tag"] != "pre")
    whole = F.array_join(F.filter(F.transform("_tokens", lambda t: t["text"]), lambda t: t != ""), "\n")
    found = F.when(pre.isNotNull(), lines(text(pre))).when(F.size(blocks) > 0, F.transform(blocks, text)).otherwise(lines(whole))
    return spans.select(*keep, found.alias("lines"))


def page_text(pages: DataFrame, html: str = "html", *keep: str) -> DataFrame:
    """keep…, text: all text of each page."""
    return pages.select(*keep, F.array_join(F.transform(_tokens(F.col(html)), lambda t: t["text"]), "").alias("text"))
