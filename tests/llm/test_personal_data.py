"""Personal data: base columns against the plain patterns, planted look-alikes and decoys, the sweep against brute force."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cinderpath.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def test_base_columns(spark, tmp_path):
    random.seed(4)
    texts = [None, "", "a.b@c.de x@y.zz@w.vv +1 (555) 123-4567 4111 1111 1111 1111 10.0.0.1 10.0.0.256 1.2.3.4.5"]
    texts += ["".join(random.choice("ab@..12 +-()4é") for _ in range(random.randint(0, 60))) for _ in range(1500)] + [f"{random.randint(0, 300)}.{i % 290}.3.4 é {4 * 10**15 + i}" for i in range(300)]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op6_pii(spark, str(tmp_path)).collect():
        want, counts = [], []
        for kind, pattern in PLAIN.items():
            own = [m.span() for m in re.finditer(pattern, texts[r.doc_id] or "") if passes(kind, m[0])]
            counts.append(len(own))
            want += [f"{kind}:{a}:{b}" for a, b in own]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(filter(None, want)) <= set(r.spans.split(","))


def number(n):
    return "".join(random.choice("0123456789") for _ in range(n))


def card(good):
    while True:
        digits = random.choice("456") + number(15)
        if pii.luhn(digits) == good:
            return ".".join(digits[i : i + 4] for i in range(0, 16, 4))


def planted(n):
    """Texts with written-around data behind context words, and decoys of the same looks behind others."""
    random.seed(2)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(3, 8)))
    out = []
    for _ in range(n):
        parts = [
            ("contact ", f"{word()} (at) {word()} (dot) com", "email"), ("write to ", f"{word()}[at]{word()}.org", "email"), ("card ", card(True), "card"), ("call ", f"0049 {random.randint(100, 999)} {number(3)} {number(4)}", "phone"),
            ("tel ", f"({random.randint(200, 999)}) {number(3)}-{number(4)}", "phone"), ("server ", ":".join(f"{random.randint(4096, 65535):x}" for _ in range(8)), "ip"), ("order ", card(False), None), ("meet ", f"noon (at) home.{word()}{word()}", None),
            ("section ", f"{number(3)}.{number(3)}.{number(4)}", None), ("serial ", f"{number(3)}-{number(3)}-{number(4)}", None), ("version ", "300.1.2.999", None),
        ]
        parts = [p for p in parts if random.random() < 0.5]
        random.shuffle(parts)
        text, truth = "", set()
        for cue, found, kind in parts:
            text += f"{word()} {cue}"
            if kind:
                truth.add((kind, len(text), len(text) + len(found)))
            text += f"{found} {word()} . "
        out.append((text, truth))
    return out


def test_planted(spark):
    """Beside a corpus with plain data, additions are right, nearly all found, and none fails its format's test."""
    rows = [(i, f"so wrote al.{i}@mail.example.com or +1 ({200 + i % 700}) 555-{1000 + i} from 10.0.{i % 250}.7 {4 * 10**15 + 7 * i} then") for i in range(300)]
    plants = planted(150)
    docs = spark.createDataFrame(rows + [(1000 + i, t) for i, (t, _) in enumerate(plants)], "doc_id long, text string")
    right = wrong = missed = 0
    for r in pii.pii_spans(docs).collect():
        added = {(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r.spans if not s["base"]}
        base = {(pii.KINDS[s["kind"]], s["start"], s["end"]) for s in r.spans if s["base"]}
        truth = plants[r.doc_id - 1000][1] if r.doc_id >= 1000 else set()
        right, wrong, missed = right + len(added & truth), wrong + len(added - truth), missed + len(truth - added - base)
    assert right > 300 and wrong <= 0.02 * right and missed <= 0.05 * right, (right, wrong, missed)


def test_failed_matches_are_never_accepted():
    counts = Counter()
    for i in range(500):
        for _, _, _, _, key in pii.candidates(f"card {5 * 10**15 + 13 * i} and {4 * 10**15 + i} visa"):
            counts[key] += 1
    assert all(k[1] == "-" for k in pii.accepted_of(counts))


def test_sweep():
    random.seed(6)
    for _ in range(300):
        spans = [{"kind": random.randint(0, 3), "start": a, "end": a + random.randint(1, 9), "base": random.random() < 0.4, "key": random.choice("xy")} for a in random.sample(range(60), 12)]
        kept = [s for s in spans if s["base"]]
        for s in sorted((s for s in spans if not s["base"] and s["key"] == "x"), key=lambda s: (s["start"], -s["end"])):
            if not any(o["start"] < s["end"] and s["start"] < o["end"] for o in kept):
                kept.append(s)
        assert pii.chosen(spans, frozenset("x")) == sorted(kept, key=lambda s: (s["kind"], s["start"], s["end"]))


def test_many_spans_are_linear(spark):
    import time

    took = []
    for n in (2000, 8000):
        text = " ".join(f"tel ({200 + i % 700}) 555-{1000 + i % 9000}" for i in range(n))
        start = time.perf_counter()
        spans = [dict(zip(("kind", "start", "end", "base", "key"), c, strict=True)) for c in pii.candidates(text)]
        assert len(pii.chosen(spans, frozenset(s["key"] for s in spans))) == n
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.2
    assert pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.length("text")).first()[0] > 0
