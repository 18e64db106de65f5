"""Quality by weak supervision, native to Spark SQL: rules vote or abstain, expectation-maximisation estimates how reliable each is.

1. ``features`` counts, in one pass over whole texts, what the rules look at. Nothing is exploded: words, lines and windows are
   arrays inside the row, so this pass has no shuffle whatever the length of a text.
2. ``votes`` turns the counts into votes: 1 good, 0 bad, null abstains.
3. ``reliabilities`` aggregates the votes into counts of patterns - at most 3^9 = 19,683 rows, whatever the size of the corpus - and
   runs expectation-maximisation on those counts. Only documents that the base rule (too short, or mostly repeated) leaves open are
   counted: it decides the others by itself, and would else be what the two classes settle on. The rules look at other grounds.
4. ``judge`` computes each document's posterior probability of being good. This posterior replaces "all rules must pass".

Words in 3-word windows found twice or more (``n_repeat_words``) are found by sorting (64-bit window hash, position) pairs in the row
and comparing neighbours: n log n for the longest texts. Equal hashes count as equal windows without a check: two different windows of a text
of n words have one hash with a probability of about n^2 / 2^65, 10^-9 for a million words.

Defined cases: a null text counts as empty; an empty text has no words and fails the base rule; a null id is returned as it is;
rows that repeat are judged alike, each counted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty, words_of, written

#: Symbols that prose rarely has.
SYMBOLS = "[#*$%&|<>]"
#: rule: (good, bad) as SQL conditions on the counts; neither means that the rule abstains.
RULES: dict[str, tuple[str, str]] = {
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "word_length": ("2 * word_chars BETWEEN 6 * n_words AND 13 * n_words", "2 * word_chars < 5 * n_words OR word_chars > 7 * n_words"),
    "plain_words": ("100 * n_plain >= 80 * n_words", "100 * n_plain < 60 * n_words"),
    "lone_marks": ("100 * n_marks <= 2 * n_words", "10 * n_marks > n_words"),
    "line_ends": ("100 * n_ended >= 70 * n_lines", "100 * n_ended < 50 * n_lines"),
    "duplicate_lines": ("n_dup_lines = 0 AND n_lines > 1", "10 * n_dup_lines > 3 * n_lines"),
    "capitals": ("5 * n_capitals <= word_chars", "2 * n_capitals > word_chars"),
    "variety": ("10 * n_distinct >= 3 * n_words", "10 * n_distinct < n_words"),
    "shouts": ("100 * n_shouts <= n_words", "4 * n_shouts > n_words"),
}
#: What the base rule refuses, whatever the votes.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: Words of letters only, with punctuation after them; words without a letter or digit; line ends after a sentence.
PLAIN = r"""(?<![^\x20\x09-\x0D])[("'«„“]?[\p{L}\p{M}'’-]+[.,;:!?…)"'»”]*(?![^\x20\x09-\x0D])"""
MARKS = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"
ENDED = r"""[.!?…。！？]["'»”)]?[\x20\x09\x0B-\x0D]*(?=\n|\z)"""


@dataclass(frozen=True)
class Reliabilities:
    """P(good), and for each rule P(vote | good) and P(vote | bad) for the votes 1, 0 and abstain."""

    prior: float
    good: dict[str, tuple[float, float, float]]
    bad: dict[str, tuple[float, float, float]]

    def posterior(self) -> Column:
        """P(good | votes) over the vote columns, as one native expression."""
        score = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule in RULES:
            yes, no, none = (math.log(g / b) for g, b in zip(self.good[rule], self.bad[rule], strict=True))
            vote = F.col(f"vote_{rule}")
            score = score + F.when(vote == 1, yes).when(vote == 0, no).otherwise(none)
        return 1 / (1 + F.exp(-score))


def repeated_window_words(words: str = "words") -> list[tuple[str, Column]]:
    """Three successive projections that end in ``n_repeat_words``; each uses the column that the one before it made."""
    hashes = F.when(F.size(words) >= 3, F.expr(f"transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))")).otherwise(F.array().cast("array<bigint>"))
    pairs = F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(None)).otherwise(F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    # a position belongs to a repeated window if a sorted neighbour has the same hash
    repeated = F.expr("transform(filter(transform(pairs, (p, k) -> IF((k > 0 AND get(pairs, k - 1).h = p.h) OR get(pairs, k + 1).h = p.h, p.i, -1)), i -> i >= 0), i -> array(i, i + 1, i + 2))")
    return [("windows", hashes), ("pairs", pairs), ("n_repeat_words", F.coalesce(F.size(F.array_distinct(F.flatten(repeated))).cast("long"), F.lit(0).cast("long")))]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at, all long."""
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        words_of(text).alias("words"),
        F.expr(r"filter(split(coalesce(text, ''), '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("!+")).cast("long").alias("n_shouts"),
        *(F.regexp_count(text, F.lit(pattern)).cast("long").alias(name) for name, pattern in (("n_plain", PLAIN), ("n_marks", MARKS), ("n_ended", ENDED))),
    )
    counted = rows.select(
        "doc_id", "n_symbols", "n_capitals", "n_shouts", "n_plain", "n_marks", "n_ended", "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    for name, column in repeated_window_words():
        counted = counted.withColumn(name, column)
    return counted.drop("words", "windows", "pairs")


def votes(counted: DataFrame) -> DataFrame:
    return counted.withColumns({f"vote_{rule}": F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 END") for rule, (good, bad) in RULES.items()})


def reliabilities(voted: DataFrame, steps: int = 50, prior: float = 0.85, start: tuple = ((0.7, 0.03, 0.27), (0.45, 0.35, 0.2)), smoothing: float = 1.0) -> Reliabilities:
    """Estimated over all rows that the base rule leaves open. Without any, the starting values stay.

    The starting values (of good and of bad documents: shares of the votes good, bad and none) say that a rule seldom finds a defect in
    a good document, that a bad one has few of all defects, and that most documents are good. This also fixes which of the two classes
    is called good. ``smoothing`` is added to each count, so no probability becomes 0. What reaches the
    driver is one row for each pattern of votes, 3^9 at most.
    """
    patterns = [(row[:-1], row[-1]) for row in voted.where(f"NOT ({BASE_FAILED})").groupBy(*[f"vote_{rule}" for rule in RULES]).agg(F.count(F.lit(1))).collect()]
    now = Reliabilities(prior, *(dict.fromkeys(RULES, shares) for shares in start))
    kinds = {1: 0, 0: 1, None: 2}
    for _ in range(steps if patterns else 0):
        mass = {True: 0.0, False: 0.0}
        sums = {good: {rule: [0.0, 0.0, 0.0] for rule in RULES} for good in mass}
        for pattern, n in patterns:
            odds = now.prior / (1 - now.prior)
            for rule, vote in zip(RULES, pattern, strict=True):
                odds *= now.good[rule][kinds[vote]] / now.bad[rule][kinds[vote]]
            for good, share in ((True, n * odds / (1 + odds)), (False, n / (1 + odds))):
                mass[good] += share
                for rule, vote in zip(RULES, pattern, strict=True):
                    sums[good][rule][kinds[vote]] += share
        smooth = {good: {rule: tuple((x + smoothing) / (mass[good] + 3 * smoothing) for x in v) for rule, v in rules.items()} for good, rules in sums.items()}
        before, now = now, Reliabilities((mass[True] + smoothing) / (sum(mass.values()) + 2 * smoothing), smooth[True], smooth[False])
        if abs(before.prior - now.prior) < 1e-7:
            break
    return now


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, posterior, kept; one row per row of ``docs``."""
    voted = votes(written(features(docs), "quality-features"))
    posterior = reliabilities(voted).posterior()
    failed = F.expr(BASE_FAILED)
    return voted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), posterior.alias("posterior")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
