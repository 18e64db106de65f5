"""Manifest, conversation trie and piece encoding against brute force and the library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderpath.llm import merkle, merging, piece_spans, prefix_trie

EMPTY = hashlib.sha256(b"").hexdigest()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def crc(n):
    return zlib.crc32(str(n).encode())


# manifest


def leaf(row, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])


def climb(nodes):
    """The top of a list of digests, and for each the path of (before, after)."""
    paths, owners, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], nodes
    while len(level) > 1:
        runs = [range(i, min(i + 16, len(level))) for i in range(0, len(level), 16)]
        for run in runs:
            for i in run:
                for o in owners[i]:
                    paths[o].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
        owners = [[o for i in run for o in owners[i]] for run in runs]
        level = [sha(*[level[i] for i in run]) for run in runs]
    return level[0], paths


def manifest_by_hand(rows):
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append((row[0] is not None, row[0] or 0, leaf(row, row[4]), row))
    groups = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = [climb([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in groups]
    root, above = climb([t[0] for t in tops])
    out = []
    for g, (subroot, paths), over in zip(groups, tops, above, strict=True):
        for (_, _, digest, row), path in zip(sorted(by[g], key=lambda x: x[:3]), paths, strict=True):
            path = path + over
            bad = row[0] is not None and crc(row[0]) % 5 == 0
            at = leaf(row, row[4] and row[4].translate({c: c + 32 for c in range(65, 91)})) if bad else digest
            for before, after in path:
                at = sha(before, at, after)
            out.append((row[0], digest, subroot, root, sha(*[a + b for a, b in path]), at, at == root))
    return Counter(out)


def test_manifest(spark, tmp_path):
    rows = [(i, f"s{i % 3}" if i % 50 else None, "en", i, f"Text {i} É") for i in range(700)]
    rows += [(1000 + i, f"t{i}", None, None, None if i % 4 == 0 else "") for i in range(20)]
    rows += [(5, "s2", "en", 5, "Text 5 É"), (None, "s1", "en", 1, "Ab"), (None, None, None, None, None), (2000, "alone", "en", 9, "A" * 50_000), (2005, "", "x", 1, "lower")] + [(3000 + i, "sixteen", "d", 1, "B") for i in range(16)]
    schema = "doc_id long, source string, lang string, n_chars long, text string, grp string, idx long, leaf string, path string, digest string, parent int"
    docs = spark.createDataFrame([(*r, "g", 1, "l", "p", "d", 2) for r in rows], schema).repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op12_merkle_manifest(spark, str(tmp_path))
    assert Counter(map(tuple, found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())) == manifest_by_hand(rows)
    assert merkle.audit(docs.limit(0), F.lit(True)).count() == 0
    one = merkle.audit(docs.where("doc_id = 2000"), F.lit(False)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == EMPTY and one.verified


# trie


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    turns = {c: [t[3] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in own.items()}
    made = {c: tuple(turns.get(c - c % 100, [])[: crc(c) % 6] + turns[c][crc(c) % 6 :]) for c in turns}
    members = defaultdict(list)
    for c, path in sorted(made.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, saved, leaves = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    ends = {p: sha(",".join(str(c) for c in m if len(made[c]) == len(p))) for p, m in members.items()}
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], ends[p]) for p, m in members.items())


def test_trie(spark, tmp_path):
    random.seed(3)
    rows = []
    for c in [*range(0, 30), *range(100, 130), 205, 206, 207, *range(300, 340)]:
        base = random.randint(1, 9)
        rows += [(c, t, random.choice(["user", "bot", None]), random.choice(["a", "bb", "é", "", None]) if t < 4 else f"{c % 3} {t}") for t in range(base)]
    rows += [(400, t, "user", f"t{t}") for t in range(60)] + [(401, t, "user", f"t{t}") for t in range(60)]  # long and equal
    rows += [(c, 0, "user", "only") for c in range(500, 520)] + [(None, 1, "user", "x"), (0, None, "user", "first"), (1, 0, "user", "tie"), (1, 0, "bot", "tie"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    table = spark.createDataFrame([(*r, 1, 2, "k", 3) for r in rows], "conv_id long, turn long, role string, text string, depth int, k1 long, pos string, n_convs int").repartition(7)
    expected = trie_by_hand(rows)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    seen = lambda df: Counter(map(tuple, df.select(columns).collect()))
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    assert seen(prefix_trie.op13_prefix_trie(spark, str(tmp_path))) == expected
    assert seen(prefix_trie.shared_openings(table, block=4, fan_in=2)) == expected
    assert prefix_trie.shared_openings(table.limit(0)).count() == 0


def test_end_lists_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    columns = [[1] * 8 + [2], [1] * 9, [1] * 9, [*range(8), 4]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["k1", "k2", "depth", "conv_id"])
    pieces = pa.Table.from_batches(prefix_trie._pieces(iter([batch])))
    assert pieces["ids"].to_pylist() == ["0,1,2", "3,4,5", "6,7", "4"]
    hashed = pa.Table.from_batches(prefix_trie._hashes(iter(pieces.to_batches())))
    assert hashed["ends_sha256"].to_pylist() == [sha("0,1,2,3,4,5,6,7"), sha("4")]


def test_keys_that_meet(spark):
    """Two turns of one key end the query."""
    rows = [(1, 1, 5, 5, 0, 0, 7, 7, 1), (2, 1, 5, 5, 0, 0, 8, 7, 1)]
    paths = spark.createDataFrame(rows, "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, t1 long, t2 long, chars long")
    with pytest.raises(Exception, match="one key"):
        prefix_trie.merged(paths)


# pieces

TEXTS = [
    None, "", "a", " a", "  a  b  ", "Hé 漢𠀀 x", "\n\nA\n b\t", "▁x ▁▁y", "a\x00b", "don't stop...  now!?) \"x\" 'y'", "word" * 100, "漢" * 100, "<s> </s> <unk> <0x41>", " ", "   ", "\n", "ﬁ ½  Ａｂ①",
    "éà Å x y　z", "​hi﻿", "²³ ﷺ x", "12345 67 3.14", "𝒳𝒴 ℌ", "long " * 5000,
]


def some_texts(n):
    random.seed(7)
    return ["".join(random.choice("ab cé漢 ▁\n.,é😀ﬁ́   Ａ") for _ in range(random.randint(0, 80))) for _ in range(n)]


def byte_spans(text, spans):
    at = np.cumsum([0, *[len(c.encode()) for c in text]])
    return [(int(at[a]), int(at[b])) for a, b in spans]


def test_pieces(spark, tmp_path):
    import sentencepiece

    texts = TEXTS + some_texts(100)
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "i", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, cuts int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=piece_spans.default_path())
    expected, digests = Counter(), Counter()
    for i, text in enumerate(texts):
        told = library.encode_as_offset_mapping(text or "")
        ids = [library.bos_id(), *told["ids"], library.eos_id()]
        size = len((text or "").encode())
        spans = byte_spans(text or "", told["offsets"])
        cuts = [0, 0, *[b for _, b in spans], size if spans else 0]
        doc, raw, decoded = None if i == 3 else i // 2, np.array(ids, "<u4").tobytes(), library.decode(ids).encode()
        expected[doc, raw, np.array(cuts, "<u4").tobytes(), decoded] += 1
        digests[doc, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest()] += 1
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.cuts), bytes(r.decoded)) for r in piece_spans.encode_pieces(docs).collect()) == expected
    assert Counter(map(tuple, piece_spans.op11_piece_spans(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == digests
    assert piece_spans.encode_pieces(docs.limit(0)).count() == 0


@pytest.mark.parametrize("mapped", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
@pytest.mark.parametrize("single_spaces", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
def test_other_models(mapped, prefix, single_spaces, fallback):
    """The same vocabulary with other rules of normalisation, with and without bytes for unknown characters."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec, rule = pb.ModelProto(), pb.NormalizerSpec()
    with open(piece_spans.default_path(), "rb") as f:
        spec.ParseFromString(f.read())
    if mapped:
        rule.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
        spec.normalizer_spec.precompiled_charsmap = rule.precompiled_charsmap
    spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces, spec.trainer_spec.byte_fallback = prefix, single_spaces, fallback
    if not fallback:
        kept = [p for p in spec.pieces if p.type != piece_spans.BYTE]
        del spec.pieces[:]
        spec.pieces.extend(kept)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString()), piece_spans.Model(spec.SerializeToString())
    texts = [t or "" for t in TEXTS] + some_texts(150)
    for text, (ids, cuts, decoded) in zip(texts, own.encode_batch(texts), strict=True):
        told = library.encode_as_offset_mapping(text)
        ids, cuts = np.frombuffer(ids, "<u4").tolist(), np.frombuffer(cuts, "<u4").tolist()
        assert ids == told["ids"], text
        assert [*zip(cuts, cuts[1:], strict=False)] == byte_spans(text, told["offsets"]), text
        assert decoded.decode() == library.decode(ids) == own.decode(ids), text


def test_merging_ways_agree():
    random.seed(5)
    pairs = {(a, b): (random.randint(0, 40), random.randint(0, 19)) for a in range(20) for b in range(20) if random.random() < 0.5}
    table = merging.PairTable(pairs, 20)
    words = [[random.randint(0, 19) for _ in range(random.randint(1, 30))] for _ in range(300)]
    ids, places, counts = table.merge_rows(np.concatenate(words), np.array([*map(len, words)]))
    ends, begins = np.cumsum(counts), np.cumsum([0, *map(len, words)])
    for i, word in enumerate(words):
        some = slice(ends[i] - counts[i], ends[i])
        assert (ids[some].tolist(), (places[some] - begins[i]).tolist()) == table.merge_one(word)


def test_small_cache(monkeypatch):
    """A full cache is emptied, results stay."""
    texts = some_texts(60)
    with open(piece_spans.default_path(), "rb") as f:
        raw = f.read()
    full = [*piece_spans.Model(raw).encode_batch(texts)]
    monkeypatch.setattr(piece_spans, "CACHE", 5)
    own = piece_spans.Model(raw)
    assert [x for t in texts for x in own.encode_batch([t])] == full
