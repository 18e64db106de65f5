import struct

from cinderpath.llm import best_fit

PARTS = [f"{a}{b}{c}".encode() for a in ("über", "x", "ÉCOLE", "straße", "t", "s") for b in ("", "thing", "ll", "ñandú") for c in ("", "ve", "zzqx")] + [b".", b",;", b"!?!"]


def _single(encoder, part):
    return struct.pack(f"<{len(ids := encoder.tokenizer.encode(part.decode(), add_special_tokens=False).ids)}I", *ids)


def test_parts_are_encoded_as_one_text(monkeypatch):
    """Parts of words are joined for the library and cut again; a vocabulary without ends of words, or a part that is two words, encodes each by itself."""
    encoder = best_fit.WordEncoder(best_fit.default_path())
    handed, encoded = [], encoder.encoded
    monkeypatch.setattr(encoder, "encoded", lambda texts: handed.append(len(texts)) or encoded(texts))
    want = [_single(encoder, p) for p in PARTS]
    encoder.learn({b"thing.", b"other,", b"more"})
    assert handed == [0, 1] and encoder.known[b"thing."] == _single(encoder, b"thing") + _single(encoder, b".")
    assert list(encoder.encoded_parts(PARTS * 9)) == want * 9 and list(encoder.encoded_parts([])) == []
    assert list(encoder.encoded_parts([b"a-b", *PARTS])) == [_single(encoder, b"a-b"), *want]
    encoder.ends[:] = False
    assert list(encoder.encoded_parts(PARTS)) == want
