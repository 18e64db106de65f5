"""The string-kernel machine: the kernel against a direct one, single and gapped insults, words that only look toxic, null ids."""

import random
from itertools import combinations

import numpy as np
import pytest

from cinderpath.llm import toxicity

INSULTS = ("trash", "pathetic", "worthless", "idiot", "disgusting", "loser")
SYLLABLES = ("the", "er", "ing", "on", "and", "re", "ha", "tion", "ed", "in", "sh", "of", "ou", "es", "th")


def direct(a, b):
    """The gap-weighted kernel of subsequences of three, by all of them."""

    def features(word):
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            key = word[i], word[j], word[k]
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
        return out

    x, y = features(a), features(b)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5


def test_kernel_is_the_direct_one():
    words = [b"trash", b"traxsh", b"abcabcab", b"zzz", b"banana", b"a}b{c", b"idiot"]
    columns = toxicity._landmark_columns(words)
    assert columns.T @ columns == pytest.approx(np.array([[direct(a, b) for b in words] for a in words]), abs=1e-5)


def texts(n):
    random.seed(11)
    word = lambda: "".join(random.choice(SYLLABLES) for _ in range(random.randint(1, 3)))
    out = []
    for i in range(n):
        words = [word() for _ in range(random.randint(8, 40))]
        if i % 4 == 0:
            for _ in range(random.randint(2, 4)):
                words.insert(random.randint(0, len(words)), random.choice(INSULTS))
        out.append((i, " ".join(words)))
    return out


@pytest.fixture(scope="module")
def machine():
    return toxicity.train([(i % 4 == 0, toxicity.fragments(t.encode())) for i, t in texts(800)])


def score(machine, text):
    words = toxicity.fragments(text.encode())
    found = sorted([*machine.decisions(words), machine.bias, machine.bias], reverse=True)
    joined = max([*machine.decisions(machine.joined(words)), -9.0])
    highest, second = (joined, found[0]) if joined > found[0] + toxicity.MARGIN else found[:2]
    return float(machine.score(np.array([highest]), np.array([second]))[0])


def test_one_insult_is_enough(machine):
    forms = [lambda w: w, lambda w: f"{w[:2]}-{w[2:]}", lambda w: w[0] + w, lambda w: f"{w[:3]}.{w[3:]}", lambda w: f"{w[:2]}x{w[2:]}", lambda w: f"{w[:3]} {w[3:]}", lambda w: " ".join(w), str.upper]
    found = [[score(machine, f"theon haed {form(w)} ering") >= 0.5 for w in INSULTS] for form in forms]
    assert all(found[0]) and all(found[7]) and sum(map(sum, found)) >= 0.9 * len(forms) * len(INSULTS), found


def test_clean_texts_stay(machine):
    random.seed(12)
    clean = [" ".join("".join(random.choice(SYLLABLES) for _ in range(random.randint(1, 3))) for _ in range(30)) for _ in range(300)]
    assert sum(score(machine, t) >= 0.5 for t in clean) <= 6
    assert max(score(machine, t) for t in ("", "the and of", "das ist ein schöner tag", "a b")) < 0.5


def test_words_that_clean_texts_have_are_neutral():
    """``trasher`` is as near to an insult as can be, but clean texts have it."""
    bags = [(t, words + ([b"trasher"] if not t and i % 5 == 0 else [])) for i, (t, words) in enumerate((i % 4 == 0, toxicity.fragments(x.encode())) for i, x in texts(400))]
    machine = toxicity.train(bags)
    assert score(machine, "theon trasher eding") < 0.5 <= score(machine, "theon trash eding")


def test_null_ids_and_query(spark, tmp_path):
    rows = texts(300)
    docs = spark.createDataFrame([*rows, (None, "you trash"), (None, None), (5, "")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = toxicity.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(found) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    import zlib

    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and r.doc_id is not None]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
