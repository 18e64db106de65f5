"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

Kernel: two fragments are as alike as the subsequences of three characters that they share, each weighted by ``DECAY`` to the power
of the span it takes in either fragment (the gap-weighted subsequence kernel), normalised to 1 for equal fragments. Inserted
characters stretch a span and lower the weight, but don't lose the match.

Fragments: a text is folded - lower case, usual digit and sign substitutes read as letters, other signs as one class, each byte of a
letter outside ASCII as another - and cut into words; three or more single characters in a row also make a fragment together, and so
do two words side by side of which no clean training text has either. A fragment with signs is also read without them, and one of more than
``WINDOW`` characters is looked at in overlapping windows, so whole texts are scored.

Training: labels are for texts, so each labelled text is a bag of fragments. A clean text's fragments are all clean, weighted by the
texts that have them; a toxic text's witnesses are its fragments that many toxic texts and hardly a clean one have (``LEAST_ODDS``), and the
one besides that the machine itself finds most toxic (multi-instance learning). Witnesses with an inserted character are examples
too. At most ``max_toxic`` + ``max_clean`` labelled texts are used, the first by a hash of their id: this bound is what lets the
machine be fitted on the driver. Everything else covers all rows.

Scoring: with landmarks l_j the decision is a sum of a_j * K(fragment, l_j), which is linear in the subsequences. Summing the landmarks
beforehand gives one weight for each of the 29^3 subsequences; so a fragment costs its own subsequences and not one kernel for each
landmark. Fragments that clean training texts have as often as chance would have it are neutral, whatever they look like. Each worker
scores a distinct fragment once. A text's score is a logistic function of its two highest fragment decisions, fitted on the same
labelled texts; each toxic one also counts as a text with its highest fragment alone, plain and (half) with an inserted character, so
that a single insult is enough.

Defined cases: null and empty texts score as a text whose fragments are all neutral; a row with a null id counts as held out (the
remainder of an empty text's checksum is 0), as no label is its own, and is scored; without labels of both kinds the score of every
text is the share of toxic labels; repeated rows are each scored; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text

DECAY, WINDOW, SYMBOLS = 0.6, 16, 29
CACHE = 400_000
#: Least log odds of a witness among the training texts, and most of a neutral fragment; texts that must have a witness.
LEAST_ODDS, NEUTRAL_ODDS, LEAST_TEXTS = 3.5, 2.0, 3
#: Two words are looked at together if they have so many characters; their decision counts if it beats each other's by the margin.
JOINED, MARGIN = (4, 11), 0.15
_SUBSTITUTES = dict(zip("0134578@$!", "oieastbasi", strict=True))
_FOLD = bytearray(range(256))
for _b in range(256):
    _c = chr(_b).lower() if _b < 128 else ""
    _FOLD[_b] = 32 if _b in (9, 10, 11, 12, 13, 32) else 123 if _b >= 128 else ord(_c) if "a" <= _c <= "z" else ord(_SUBSTITUTES.get(_c, "}"))
_FOLD = bytes(_FOLD)
#: Signs at the end of a word are punctuation, not letters.
_MARKS = b".,;:!?()[]\"'`*#%&$|<>-_/\\{}~^+=@"


def fragments(text: bytes) -> list[bytes]:
    """The folded fragments of a text, in order, as symbols a-z, { and }."""
    out, run = [], []
    for raw in text.split():
        if len(raw) == 1:
            run.append(raw)
            continue
        if len(run) > 2:
            out.append(b"".join(run))
        run = run and []
        out.append(raw)
    if len(run) > 2:
        out.append(b"".join(run))
    return out


def fold(raw: bytes) -> bytes:
    return raw.strip(_MARKS).translate(_FOLD)


def _subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of all subsequences of three in a fragment of length n, and their weights."""
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1.0)


_TABLE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def encoded(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of equal length at a time: their places in ``words``, the codes of their subsequences, normalised weights."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= 3:
            by.setdefault(len(w), []).append(i)
    for n, places in by.items():
        at, weight = _TABLE.setdefault(n, _subsequences(n))
        for k in range(0, len(places), 1024):
            some = places[k : k + 1024]
            chars = np.frombuffer(b"".join(words[i] for i in some), np.uint8).reshape(len(some), n).astype(np.int64) - 97
            codes = (chars[:, at[:, 0]] * SYMBOLS + chars[:, at[:, 1]]) * SYMBOLS + chars[:, at[:, 2]]
            order = np.argsort(codes, axis=1)
            sorted_codes, sorted_weight = np.take_along_axis(codes, order, 1), weight[order]
            new = np.ones_like(sorted_codes, bool)
            new[:, 1:] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
            sums = np.add.reduceat(sorted_weight.ravel(), np.flatnonzero(new.ravel()))
            norm = np.sqrt(np.bincount(np.nonzero(new)[0], sums**2, len(some)))
            yield np.array(some), codes, weight / norm[:, None]


def windows(word: bytes) -> list[bytes]:
    return [word] if len(word) <= WINDOW else [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def readings(word: bytes) -> list[bytes]:
    """The windows of a folded fragment, and of what is left of it without signs."""
    return windows(word) + (windows(bare) if (bare := word.replace(b"}", b"")) != word else [])


@dataclass
class Machine:
    weights: np.ndarray  # of each subsequence
    bias: float
    calibration: tuple[float, float, float]  # of the highest decision, the second highest, constant
    constant: float | None = None  # the score of every text, if nothing could be learned
    neutral: frozenset[bytes] = frozenset()  # windows that say nothing
    clean: frozenset[bytes] = frozenset()  # folded fragments of clean training texts

    def decisions(self, words: list[bytes]) -> np.ndarray:
        parts = [readings(fold(w)) for w in words]
        flat = [p for ps in parts for p in ps]
        out = np.full(len(flat), self.bias)
        told = [i for i, p in enumerate(flat) if len(p) >= 3 and p not in self.neutral]
        at = np.array(told, np.int64)
        for places, codes, weight in encoded([flat[i] for i in told]):
            out[at[places]] += np.einsum("ij,ij->i", self.weights[codes], weight)
        return np.maximum.reduceat(out, np.cumsum([0, *map(len, parts[:-1])])) if parts else out

    def joined(self, words: list[bytes]) -> list[bytes]:
        """Neighbours that may be one word in two parts."""
        new = [fold(w) not in self.clean for w in words]
        return [a + b for a, b, x, y in zip(words, words[1:], new, new[1:], strict=False) if x and y and JOINED[0] <= len(a) + len(b) <= JOINED[1]]

    def score(self, highest: np.ndarray, second: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(highest), self.constant)
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * highest + b * second + c, -30, 30)))


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 25) -> np.ndarray:
    """Weights, bias last, of the squared-hinge linear machine, by Newton steps on the active rows."""
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(steps):
        active = y * (z @ w) < 1
        za = z[active] * cost[active][:, None]
        new = np.linalg.solve(ridge + za.T @ z[active], za.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.5 * w + 0.5 * new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 0.02 * np.eye(len(w)), x.T @ (weight * (y - p)) - 0.02 * w)
    return w


def _landmark_columns(words: list[bytes]) -> np.ndarray:
    out = np.zeros((SYMBOLS**3, len(words)), np.float32)
    for places, codes, weight in encoded(words):
        for i, c, w in zip(places, codes, weight, strict=True):
            np.add.at(out[:, i], c, w)
    return out


def inserted(word: bytes, rng: np.random.Generator) -> bytes:
    at = 1 + int(rng.integers(max(1, len(word) - 1)))
    return word[:at] + bytes([97 + int(rng.integers(26))]) + word[at:]


def train(bags: list[tuple[bool, list[bytes]]], landmarks: int = 320, negatives: int = 8000, hard: int = 3000, rounds: int = 3, variants: int = 2) -> Machine:
    """bags: (toxic, fragments) of each labelled text."""
    distinct, once = {w for _, words in bags for w in words}, {}
    folds = {w: once.setdefault(f := fold(w), f) for w in distinct}
    folded = [(t, sorted({folds[w] for w in words})) for t, words in bags]
    del distinct, folds
    bags = [(t, sorted({p for w in words for p in windows(w) if len(p) >= 3})) for t, words in folded]
    n_toxic, n_clean = sum(t for t, _ in bags), sum(not t for t, _ in bags)
    blank = np.zeros(SYMBOLS**3, np.float32)
    if not n_toxic or not n_clean:
        return Machine(blank, 0.0, (0.0, 0.0, 0.0), n_toxic / max(1, len(bags)))
    toxic, clean = Counter(w for t, ws in bags if t for w in ws), Counter(w for t, ws in bags if not t for w in ws)
    odds = {w: np.log((n + 0.5) / (n_toxic + 1)) - np.log((clean[w] + 0.5) / (n_clean + 1)) for w, n in toxic.items()}
    rng = np.random.default_rng(7)
    others = sorted(clean, key=lambda w: (-clean[w], w))
    sample = others[: negatives // 2] + [others[i] for i in rng.permutation(len(others))[: negatives // 2]]
    # in few texts no odds can be that high: then the best ones do
    least_odds, least_texts = min(LEAST_ODDS, max(odds.values(), default=0.0) - 0.1), min(LEAST_TEXTS, n_toxic)
    told = Counter({w: n for w, n in toxic.items() if n >= least_texts and odds[w] > least_odds})
    witnesses, known = Counter(told), sorted(set(toxic) | set(clean))
    machine, at = Machine(blank, 0.0, (1.0, 0.0, 0.0)), dict.fromkeys(known, 0.0)
    for _ in range(rounds):
        examples = Counter(witnesses)
        for w in sorted(witnesses):
            if witnesses[w] >= LEAST_TEXTS and 4 <= len(w) < WINDOW:
                for _ in range(variants):
                    examples[inserted(w, rng)] += max(1, witnesses[w] // 2)
        positive, negative = sorted(examples), list(dict.fromkeys(w for w in sample if w not in examples))
        if not positive or not negative:
            break
        marks = sorted(witnesses, key=lambda w: (-witnesses[w], w))[: landmarks // 2] + negative[: landmarks // 4] + [negative[i] for i in rng.permutation(len(negative))[: landmarks // 4]]
        columns = _landmark_columns(list(dict.fromkeys(marks)))
        values, vectors = np.linalg.eigh((columns.T @ columns).astype(float))
        keep = values > 1e-4
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        words = positive + negative
        kernel = np.zeros((len(words), columns.shape[1]))
        for places, codes, weight in encoded(words):
            for k in range(0, len(places), 16):
                kernel[places[k : k + 16]] = np.einsum("ijm,ij->im", columns[codes[k : k + 16]], weight[k : k + 16])
        y = np.array([1.0] * len(positive) + [-1.0] * len(negative))
        cost = np.array([float(examples[w]) for w in positive] + [float(min(clean[w], 30)) for w in negative])
        cost[y > 0] *= cost[y < 0].sum() / cost[y > 0].sum()
        w = _svm(kernel @ whiten, y, 0.2 * cost / cost.mean())
        machine = Machine((columns @ (whiten @ w[:-1])).astype(np.float32), float(w[-1]), (1.0, 0.0, 0.0))
        at = dict(zip(known, machine.decisions(known).tolist(), strict=True))
        # the machine's own witnesses, and the clean fragments that it takes for toxic
        witnesses = Counter(told)
        for t, ws in bags:
            if t and (own := [w for w in ws if not clean[w] and w not in told and at[w] > 0.3]):
                witnesses[max(own, key=lambda w: (at[w], w))] += 1
        sample = list(dict.fromkeys(sorted(clean, key=lambda w: (-at[w], w))[:hard] + sample))[: negatives + hard]
    # what a clean text says is judged as of a text that training hasn't seen: its own words alone make nothing neutral
    machine.neutral = frozenset(w for w in clean if clean[w] > 1 and odds.get(w, -1.0) < NEUTRAL_ODDS)
    fragments_of = sorted({w for _, ws in folded for w in ws})
    unseen = dict(zip(fragments_of, machine.decisions(fragments_of).tolist(), strict=True))
    machine.neutral |= {w for w in clean if odds.get(w, -1.0) < NEUTRAL_ODDS}
    machine.clean = frozenset(w for t, ws in folded if not t for w in ws)
    seen = dict(zip(fragments_of, machine.decisions(fragments_of).tolist(), strict=True))
    tops = [sorted((((seen if t else unseen)[w], w) for w in ws), reverse=True)[:2] for t, ws in folded]
    x = np.array([([v for v, _ in top] + [machine.bias] * 2)[:2] for top in tops])
    y = np.array([float(t) for t, _ in folded])
    usual = float(np.median(x[y == 0, 1]))
    alone = [(v, top[0][1].replace(b"}", b"")) for (v, _), top, t in zip(x, tops, y, strict=True) if t and v > 0]
    changed = machine.decisions([inserted(w, rng) for _, w in alone]) if alone else np.zeros(0)
    extra = np.array([[v, usual] for v in (*[v for v, _ in alone], *changed)]).reshape(-1, 2)
    weight = np.concatenate([np.ones(len(x) + len(alone)), np.full(len(alone), 0.5)])
    machine.calibration = tuple(_logistic(np.vstack([x, extra]), np.concatenate([y, np.ones(len(extra))]), weight).tolist())
    return machine


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id's."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def labelled_bags(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> list[tuple[bool, list[bytes]]]:
    """The bounded sample of labelled texts, as distinct fragments. A text with both labels counts as toxic."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(remainder(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"))
    first = lambda t, n: marks.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = F.broadcast(first(True, max_toxic).unionByName(first(False, max_clean)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(fragments(t.as_py()))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.list_(pa.binary()))], ["toxic", "words"])

    rows = id_and_text(docs).join(sample, "doc_id").select("toxic", "text").mapInArrow(run, "toxic boolean, words array<binary>")
    # in one order, whatever order the tasks end in; each distinct fragment is held once
    found, once = rows.toArrow(), {}
    return sorted((t.as_py(), [once.setdefault(w, w) for w in ws.as_py()]) for t, ws in zip(found["toxic"], found["words"], strict=True))


def toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 2500, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``docs``."""
    spark = docs.sparkSession
    machine = spark.sparkContext.broadcast(train(labelled_bags(docs, labels, max_toxic, max_clean)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = machine.value, {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            highest, second = np.full(len(texts), model.bias), np.full(len(texts), model.bias)
            for k in range(0, len(texts), 256):
                words = [fragments(t) for t in texts[k : k + 256]]
                pairs = [model.joined(ws) for ws in words]
                if len(known) > CACHE:
                    known.clear()
                new = list({w for some in (words, pairs) for ws in some for w in ws if w not in known})
                known.update(zip(new, model.decisions(new).tolist(), strict=True))
                for i, (ws, two) in enumerate(zip(words, pairs, strict=True), k):
                    if ws:
                        found = list(map(known.__getitem__, ws))
                        top = max(found)
                        found.remove(top)
                        highest[i], second[i] = top, max(found, default=model.bias)
                        joined = max(map(known.__getitem__, two), default=top)
                        if joined > top + MARGIN:
                            highest[i], second[i] = joined, top
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(highest, second))], ["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
