"""Scan of texts for short licence notices, exact and with errors.

The text is lower-cased (A-Z only) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Exact phrases are looked for where their
words stand consecutively. Notices with errors are found by the pigeonhole rule: a notice that stands in the text with at most k
edits, cut into k + 1 parts, has at least one part unchanged. These parts are exact seeds, searched as bytes; only where a seed
occurs does the ``regex`` library's bounded-error matching look at the window around the place that the seed gives the notice, and
reports span and number of edits. Each place has a window of its own, which has no room for a second notice, so none is hidden.

A few edits turn one notice into another, so each notice has distinguishing words, which must stand in the span unchanged; and of
notices that overlap, the one with the fewest edits gets the span (then the longer one, then the earlier place).

One pass over whole texts, no shuffle, in a time of n log n for the longest texts (word numbers come from a sorted list of the
spaces); a text is held once per task. The lists below are a few dozen entries in the closure.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; null ids are returned as they are; repeated
rows are each scanned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text

#: Phrases that count wherever their words stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words that name a licence of their own, and its label.
NAMED = {"mit": "mit", "apache": "apache-2.0", "bsd": "bsd", "isc": "isc", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl"}
#: Notices that are also recognised with errors: words, label, and the words that must stand unchanged.
NOTICES = [
    *((f"{verb} under the {word} license", label, (word,)) for verb in ("licensed", "released") for word, label in NAMED.items()),
    ("licensed under the apache license version 2 0", "apache-2.0", ("apache",)),
    ("this work is licensed under the gnu general public license", "gpl", ("gnu", "general")),
    ("licensed under the gnu lesser general public license", "lgpl", ("gnu", "lesser")),
    ("licensed under the gnu affero general public license", "agpl", ("gnu", "affero")),
    ("licensed under cc by 4 0", "cc-by", ("cc", "by")),
    ("licensed under cc by nc 4 0", "cc-by-nc", ("cc", "by", "nc")),
    ("licensed under cc by sa 4 0", "cc-by-sa", ("cc", "by", "sa")),
    ("licensed under cc by nd 4 0", "cc-by-nd", ("cc", "by", "nd")),
    ("licensed under cc by nc sa 4 0", "cc-by-nc-sa", ("cc", "by", "nc", "sa")),
    ("licensed under a creative commons attribution license", "cc-by", ("creative", "commons")),
    ("licensed under the mozilla public license", "mpl", ("mozilla",)),
    ("redistribution and use in source and binary forms", "bsd", ("source", "binary")),
    ("permission is hereby granted free of charge", "mit", ("hereby", "granted")),
    ("dedicated to the public domain", "public-domain", ("public", "domain")),
    ("all rights reserved", "reserved", ("rights",)),
]
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 8

MATCHES = "array<struct<label:string,start_word:int,end_word:int,edits:int,exact:boolean>>"
_FOLD = bytes(ord(chr(b).lower()) if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b >= 0x80 or chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 0x20 for b in range(256))


def seeds_of(notice: str, edits: int) -> list[tuple[bytes, int]]:
    """The notice cut into ``edits`` + 1 parts, each with its offset."""
    data, n = notice.encode(), edits + 1
    cuts = [len(data) * i // n for i in range(n + 1)]
    return [(data[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _places(text: bytes, part: bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str, tuple[str, ...]]], chars_per_edit: int):
        import regex

        self.phrases = [(f" {p} ".encode(), label, p.count(" ") + 1) for p, label in phrases.items()]
        self.notices = []
        for notice, label, fixed in notices:
            edits = max(1, len(notice) // chars_per_edit)
            pattern = regex.compile(b"(?be)(?:%b){e<=%d}" % (regex.escape(notice.encode(), literal_spaces=True), edits))
            self.notices.append((notice, label, edits, pattern, seeds_of(notice, edits), [f" {w} ".encode() for w in fixed]))

    def near(self, text: bytes) -> list[tuple[int, int, int, str]]:
        """Edits, first byte, end and label of all places of all notices, each widened to whole words."""
        found = set()
        for notice, label, edits, pattern, parts, fixed in self.notices:
            if not all(w in text for w in fixed):
                continue
            for start in sorted({at - offset for part, offset in parts for at in _places(text, part)}):
                a, b = max(0, start - edits), min(len(text), start + len(notice) + 2 * edits)
                if any(text.find(w, max(0, a - 1), b + 1) < 0 for w in fixed) or not (m := pattern.search(text, a, b)):
                    continue
                first, end = m.span()
                while first < end and text[first] == 32:
                    first += 1
                first, end = text.rfind(b" ", 0, first) + 1, text.find(b" ", max(end - 1, first))
                if all(w in text[first - 1 : end + 1] for w in fixed):
                    found.add((sum(m.fuzzy_counts), first, end, label))
        return sorted(found, key=lambda x: (x[0], x[1] - x[2], x[1], x[3]))

    def scan(self, raw: bytes) -> tuple[int, list[dict]]:
        """The number of words and the matches in one text."""
        words = raw.translate(_FOLD).split()
        text = b" %b " % b" ".join(words)
        exact = [(at + 1, label, n) for phrase, label, n in self.phrases for at in _places(text, phrase)]
        taken: list[tuple[int, int, int, str]] = []
        for edits, first, end, label in self.near(text):
            k = bisect(taken, (first,))
            if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or taken[k][0] >= end):
                taken.insert(k, (first, end, edits, label))
        if not exact and not taken:
            return len(words), []
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        number = lambda at: int(np.searchsorted(spaces, at)) - 1  # noqa: E731  the text begins with a space
        found = [{"label": label, "start_word": (w := number(at)), "end_word": w + n, "edits": 0, "exact": True} for at, label, n in exact]
        return len(words), found + [{"label": label, "start_word": number(first), "end_word": number(end - 1) + 1, "edits": edits, "exact": False} for first, end, edits, label in taken]


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, tuple[str, ...]]] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, n_words, matches (label, first word, word after the last, edits, exact); one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, chars_per_edit)
        kind = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("edits", pa.int32()), ("exact", pa.bool_())]))
        for batch in batches:
            seen = [scanner.scan(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in seen], pa.int64()), pa.array([m for _, m in seen], kind)], ["doc_id", "n_words", "matches"])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, n_words long, matches {MATCHES}")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan(documents(spark, sf_dir)).withColumn("base", F.expr("filter(matches, m -> m.exact)"))
    labels = lambda column: F.array_join(F.sort_array(F.array_distinct(F.transform(column, lambda m: m["label"]))), ",")
    starts = F.transform("base", lambda m: m["start_word"].cast("long"))
    score = F.array_max(F.transform("matches", lambda m: F.when(m["exact"], F.lit(1.0)).otherwise(1.0 - m["edits"] / 20.0)))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("matches").alias("labels"), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0))).alias("score"),
    )
