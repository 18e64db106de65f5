"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates how reliable each is, and
the posteriors train a final span classifier.

1. One pass over whole texts finds candidates: matches of the strict formats (always kept: ``base``), matches that fail their format's
   test, and looser look-alikes beside these, such as a mail address with "(at)", a phone number without "+", an address of eight groups. Five labelers
   vote on each: format, shape, gazetteer, context words, boundary. A candidate carries its votes and what the classifier sees besides -
   size, separators, what stands before and after it, the distance of a context word - as a short key. A key has 4 kinds, 3^5 votes, 3
   sizes, 5 separators, 3 neighbours on each side and 3 distances: the keys are bounded, whatever the corpus.
2. The keys are counted over all documents. For each kind, expectation-maximisation on these counts estimates the other labelers'
   reliabilities and the posteriors of look-alikes. The format anchors it: what passes is personal, what fails its test (checksum,
   octets, number of digits) isn't, and neither posterior moves.
3. A logistic classifier over the votes without the format's and the rest of the key is fitted on the posteriors, both classes of equal
   weight. It decides on look-alikes; a failed match is never accepted, nor is a card without its checksum. The accepted keys are few.
4. Accepted look-alikes are added in the row, in one sweep from left to right.

The strict formats are matched leftmost and non-overlapping per kind; a match that fails its test is dropped without another try.
Every search is linear in the length of the text. Offsets are code points, ends exclusive.

Defined cases: a null or empty text has no spans; null ids are returned as they are; repeated rows are each scanned; an empty table
gives an empty result; look-alikes that overlap a base span or an earlier accepted look-alike are left out; failed matches outside 7 to 24
characters aren't counted, as they could only be negatives; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("format", "shape", "gazetteer", "context", "boundary")
SPAN = "struct<kind:int,start:int,end:int,base:boolean,key:string>"

#: The strict formats.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Look-alikes.
LOOSE = {
    0: re.compile(r"(?<![\w.%+-])[A-Za-z0-9][\w.%+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]{1,63}){1,4}"),
    1: re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    2: re.compile(r"(?<![0-9])[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    3: re.compile(r"(?<![0-9+(])(?:00[1-9][0-9]{0,2}[ -])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
#: Gazetteers.
ENDINGS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "us", "ca", "au", "jp", "ch", "at"}
COUNTRY_CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91"}
#: Context words in the 32 characters before a span.
CUES = {
    0: ("mail", "contact", "write", "reach", "correo", "courriel"),
    1: ("ip", "host", "server", "address", "login", "adresse"),
    2: ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    3: ("phone", "tel", "call", "mobile", "fax", "cell", "telefon"),
}
#: What comes before a candidate counts as near in so many characters.
NEAR = 12
ANTI_CUES = ("version", "isbn", "order", "invoice", "section", "serial", "build", "chapter")
_DIGITS = re.compile(r"[0-9]")
_ALNUM = re.compile(r"[^\W_]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the strict format: each @ with the run of local characters before it and the domain after it."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        floor = max(end, text.rfind("@", end, at) + 1)
        start = floor + len(text[floor:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            end = at = m.end()
        else:
            at += 1


def strict(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """kind, start, end and whether the match passes its test."""
    if "@" in text:
        yield from ((0, a, b, True) for a, b in emails(text))
    if "." in text:
        yield from ((1, *m.span(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))) for m in IP.finditer(text))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield 2, *m.span(), 13 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        yield from ((3, *m.span(), 9 <= sum(map(m[0].count, "0123456789")) <= 15) for m in PHONE.finditer(text))


def vote(text: str, kind: int, start: int, end: int, base: bool, failed: bool) -> str:
    """The labelers' votes on a candidate - 1, 0 or - each - and what else the classifier sees: size, separators, neighbours, how near a context word is."""
    span = text[start:end]
    digits = re.sub(r"[^0-9]", "", span)
    ending = re.split(r"[ .)\]}]", span)[-1].lower()
    known: bool | None
    if kind == 0:
        shape, known = 2 <= len(ending) <= 10 and ending.isalpha(), ending in ENDINGS
    elif kind == 1:
        shape = all(p == "0" or not p.startswith("0") for p in re.split("[.:]", span))
        known = ":" in span or 1 <= int(span.split(".")[0][:9]) <= 223
    elif kind == 2:
        shape, known = len(digits) in (15, 16) and bool(re.fullmatch(r"[0-9]+|[0-9]{4}(?:[ .-][0-9]{4}){3}", span)), digits[:1] in ("3", "4", "5", "6")
    else:
        shape = bool(re.search(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-]?[0-9]{4}$|(?:[0-9]{2}[ .-]){3,}[0-9]{2}$", span))
        known = any(digits.lstrip("0").startswith(c) for c in COUNTRY_CODES) if span[:1] == "+" or span.startswith("00") else None
    before = text[max(0, start - 32) : start].lower()
    context = 1 if any(c in before for c in CUES[kind]) else 0 if any(c in before for c in ANTI_CUES) else None
    free = not (start and _ALNUM.match(text[start - 1])) and not (end < len(text) and _ALNUM.match(text[end]))
    votes = (1 if base else 0 if failed else None, int(shape), None if known is None else int(known), context, int(free))
    separators = {c for c in span if c in " .-"}
    kind_of = lambda c: "e" if not c or c.isspace() else "w" if _ALNUM.match(c) else "p"
    near = 0 if context is None else 2 if any(c in before[-NEAR:] for c in (*CUES[kind], *ANTI_CUES)) else 1
    rest = (min(2, len(span) // 16), "0" if not separators else "m" if len(separators) > 1 else {" ": "s", ".": "d", "-": "h"}[min(separators)], kind_of(text[start - 1 : start]), kind_of(text[end : end + 1]), near)
    return "".join("-" if v is None else str(v) for v in votes) + "".join(map(str, rest))


def _outside(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span overlaps none of ``spans``."""
    ordered = sorted(spans)
    starts, reach = [a for a, _ in ordered], [*accumulate((b for _, b in ordered), max)]
    return lambda a, b: not (i := bisect_left(starts, b)) or reach[i - 1] <= a


def candidates(text: str) -> list[tuple[int, int, int, bool, str]]:
    """(kind, start, end, base, key), base spans first."""
    if "(at" not in text and "[at" not in text and "{at" not in text and "@" not in text and not _DIGITS.search(text):
        return []
    matched = list(strict(text))
    base = [(k, a, b, True, f"{k}{vote(text, k, a, b, True, False)}") for k, a, b, passed in matched if passed]
    loose = {(k, a, b): True for k, a, b, passed in matched if not passed and 7 <= b - a <= 24}
    free = _outside([(a, b) for _, a, b, _, _ in base])
    for kind, pattern in LOOSE.items():
        for m in pattern.finditer(text):
            # a card without its checksum fails, however it is written
            if free(*m.span()):
                loose.setdefault((kind, *m.span()), kind == 2 and not luhn(re.sub("[^0-9]", "", m[0])))
    return base + [(k, a, b, False, f"{k}{vote(text, k, a, b, False, failed)}") for (k, a, b), failed in loose.items()]


def candidate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: all candidates of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("key", pa.string())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base", "key"), c, strict=True)) for c in candidates(t.as_py().decode())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def posteriors(counts: dict[str, int], steps: int = 60, prior: float = 0.5, accuracy: float = 0.8, trust: int = 20) -> dict[str, float]:
    """P(personal) of each key of votes, by expectation-maximisation over the keys' counts; counts of one kind only.

    Keys that the format decides are fixed at 1 and 0 and teach the other labelers' reliabilities: how often each votes yes, where it
    votes, on what is personal and on what isn't, begun as ``trust`` votes of ``accuracy``; a yes never speaks against. Abstaining says
    nothing. ``prior`` is of look-alikes, and stays: what there is of them isn't what they should be.
    """
    fixed = {k: float(k[1]) for k in counts if k[1] != "-"}
    labelers = range(1, len(LABELERS))
    good, bad = dict.fromkeys(labelers, accuracy), dict.fromkeys(labelers, 1 - accuracy)
    p = dict(fixed)
    for _ in range(steps):
        for key in counts.keys() - fixed.keys():
            odds = prior / (1 - prior)
            for i in labelers:
                if (v := key[1 + i]) != "-":
                    odds *= good[i] / bad[i] if v == "1" else (1 - good[i]) / (1 - bad[i])
            p[key] = odds / (1 + odds)
        for i in labelers:
            votes = [(n * p[k], n * (1 - p[k]), k[1 + i] == "1") for k, n in counts.items() if k[1 + i] != "-"]
            good[i] = (sum(y for y, _, one in votes if one) + trust * accuracy) / (sum(y for y, _, _ in votes) + trust)
            bad[i] = min(good[i], (sum(x for _, x, one in votes if one) + trust * (1 - accuracy)) / (sum(x for _, x, _ in votes) + trust))
    return p


def classifier(counts: dict[str, int], target: dict[str, float], steps: int = 300, rate: float = 0.5, penalty: float = 1e-3) -> dict[str, float]:
    """P(personal) of each key by a logistic model over what stands at each place of the key but the format's vote, fitted on the posteriors; both classes weigh the same."""
    weights: dict = defaultdict(float)
    features = {k: [*((i, v) for i, v in enumerate(k) if i != 1), "bias"] for k in counts}
    predict = lambda k: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[f] for f in features[k])))))
    yes, no = sum(n * target[k] for k, n in counts.items()) or 1.0, sum(n * (1 - target[k]) for k, n in counts.items()) or 1.0
    for _ in range(steps):
        slope: dict = defaultdict(float)
        for k, n in counts.items():
            q = predict(k)
            for f in features[k]:
                slope[f] += n * (target[k] / yes * (1 - q) - (1 - target[k]) / no * q) / 2
        for f, x in slope.items():
            weights[f] += rate * (x - penalty * weights[f])
    return {k: predict(k) for k in counts}


def accepted_of(counts: dict[str, int], threshold: float = 0.8) -> list[str]:
    """The keys of look-alikes, none of them failed, that both the posterior and the classifier accept."""
    out = []
    for kind in range(len(KINDS)):
        if own := {k: n for k, n in counts.items() if k.startswith(str(kind))}:
            told = posteriors(own)
            out += [k for k, p in classifier(own, told).items() if k[1] == "-" and min(p, told[k]) >= threshold]
    return sorted(out)


def accepted_keys(found: DataFrame, threshold: float = 0.8) -> list[str]:
    """The keys of look-alikes that are accepted; learned from all candidates of all documents."""
    return accepted_of({r["key"]: r["n"] for r in found.select(F.explode("spans.key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}, threshold)


def chosen(spans: list[dict], keys: frozenset[str]) -> list[dict]:
    """Base spans and, where they overlap nothing, accepted look-alikes, the longer of those that begin together; by kind, then start. One sweep over each."""
    base = [s for s in spans if s["base"]]
    kept, last, free = [], 0, _outside([(s["start"], s["end"]) for s in base])
    for s in sorted((s for s in spans if not s["base"] and s["key"] in keys), key=lambda s: (s["start"], -s["end"], s["kind"])):
        if s["start"] >= last and free(s["start"], s["end"]):
            kept.append(s)
            last = s["end"]
    return sorted([*base, *kept], key=lambda s: (s["kind"], s["start"], s["end"]))


def pii_spans(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, spans (array of kind number, start, end, base, key); one row per row of ``docs``."""
    found = written(candidate_spans(docs), "pii-candidates")
    keys = frozenset(accepted_keys(found, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([chosen(x, keys) for x in spans.to_pylist()], spans.type)], ["doc_id", "spans"])

    return found.mapInArrow(run, found.schema)


def redact(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; the other columns as they are, n_chars recounted.

    The decisions are learned from one pass over ``docs``; a second pass applies them in the row, so no join is needed.
    """
    keys = frozenset(accepted_keys(written(candidate_spans(docs), "pii-candidates"), threshold))
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else replaced(t, keys) for t in batch.column(at).to_pylist()]
            columns = [pa.array(texts, batch.schema.field(i).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in names else out


def replaced(text: str, keys: frozenset[str]) -> str:
    """A text with its spans replaced: base spans, then accepted look-alikes; what overlaps an earlier span is covered by it."""
    spans = candidates(text)
    covered: list[tuple[int, int, int]] = []
    for k, a, b, base, key in sorted(spans, key=lambda s: (s[1], -s[2])):
        if not base and key not in keys:
            continue
        if covered and a < covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]), covered[-1][2])
        else:
            covered.append((a, b, k))
    out, last = [], 0
    for a, b, k in covered:
        out += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = b
    return "".join([*out, text[last:]])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii_spans(documents(spark, sf_dir)).withColumn("base", F.filter("spans", lambda s: s["base"]))
    names = F.array(*map(F.lit, KINDS))
    listing = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(listing("base"), 256).alias("base_sha256"), listing("spans").alias("spans"))
