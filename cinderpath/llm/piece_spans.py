"""Encoding to pieces with the place that each piece has in the original text, and decoding.

1. Normalisation: at each place of the text the longest key of the model's compiled character map (a double array) is replaced; what
   no key begins at stays. For each character of the normalised text the byte of the original at which it began is recorded.
2. Pieces: no piece has a space mark behind another character (checked when a model is loaded), so the text is cut before runs of
   marks, and each word is merged by itself: the best-scored pair first, the leftmost of equal ones. Words are merged many at a time and
   kept in a bounded cache with their ids, the lengths of their pieces and their surfaces. Characters without a piece become bytes.
3. The lengths add up to places in the normalised text, and these are projected through the record to the original's bytes. A piece
   begins where the one before it ends; of the bytes of one character, the last has its span.

Rows are independent: there is no shuffle, and a task holds one batch of texts and its cache.

Defined cases: null and empty texts have the begin and end ids only; null and repeated ids are returned as they are, each row by itself;
bytes that aren't UTF-8 count as U+FFFD; the string of a control piece in a text is text; an empty table gives an empty result; other
columns are ignored. Models with user-defined or unused pieces, with marks behind words or of another kind than BPE are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_and_text
from .merging import ROWS, PairTable

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words kept by a worker; longer words are merged by a heap.
CACHE, LONG = 250_000, 48
_ENDS = ".,;:!?)\"'"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """A compiled character map: a double array of keys, each with the place of its replacement in a list of texts."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units, self.texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
        # ASCII characters that are no key, and begin only keys that go on outside ASCII
        alone = "".join(chr(c) for c in range(1, 128) if not self._goes_on(c))
        self.plain = re.compile(f"[{re.escape(alone)}]+(?![^\x00-\x7f])") if alone else None

    def _step(self, node: int, byte: int) -> int | None:
        """From a node's place to the place of the child by ``byte``."""
        at = node ^ byte
        if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
            return None
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _root(self) -> int:
        unit = self.units[0]
        return (unit >> 10) << ((unit & 512) >> 6)

    def _goes_on(self, byte: int) -> bool:
        """Whether ``byte`` is a key or begins one that goes on within ASCII."""
        node = self._step(self._root(), byte)
        if node is None:
            return False
        return bool(self.units[self._root() ^ byte] & 256) or any(self._step(node, b) is not None for b in range(1, 128))

    def longest(self, text: bytes, start: int) -> tuple[int, str] | None:
        """The length in bytes of the longest key at ``start``, and its replacement."""
        node, found = self._root(), None
        for i in range(start, len(text)):
            at = node ^ text[i]
            node = self._step(node, text[i])
            if node is None:
                break
            if self.units[at] & 256:
                found = i + 1 - start, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\x00", found[1])].decode()

    def mapped(self, text: str) -> Iterator[tuple[str, int]]:
        """(normalised, bytes of the original that it stands for), piece by piece."""
        raw, at, byte = text.encode(), 0, 0
        while at < len(text):
            run = self.plain.match(text, at) if self.plain else None
            if run:
                yield from ((c, 1) for c in run[0])
                at, byte = run.end(), byte + len(run[0])
                continue
            length, new = self.longest(raw, byte) or (len(text[at].encode()), text[at])
            yield new, length
            at += len(raw[byte : byte + length].decode())
            byte += length


class Model:
    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(proto)
        rule, trained = spec.normalizer_spec, spec.trainer_spec
        kinds = {p.type for p in spec.pieces}
        if trained.model_type != 2 or trained.treat_whitespace_as_suffix or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models without user-defined or unused pieces and with marks before words are supported")
        self.map = CharacterMap(rule.precompiled_charsmap) if rule.precompiled_charsmap else None
        self.prefix, self.single_spaces, self.space = rule.add_dummy_prefix, rule.remove_extra_whitespaces, MARK if rule.escape_whitespaces else " "
        self.begin, self.end, self.unknown = trained.bos_id, trained.eos_id, trained.unk_id
        pieces = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE} if trained.byte_fallback else {}
        #: what a piece says, by id
        self.surfaces = [p.piece.replace(MARK, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else trained.unk_surface.encode() if p.type == UNKNOWN else b"" for p in spec.pieces]
        self.kinds = [p.type for p in spec.pieces]
        self.count = len(spec.pieces)
        symbols = dict(pieces)
        for piece in pieces:
            for c in piece:
                symbols.setdefault(c, len(symbols) + self.count)
        self.other = len(symbols) + self.count  # a character in no piece
        self.codes = np.full(0x110000, self.other, np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.codes[ord(c)] = i
        scores = sorted({-spec.pieces[i].score for i in pieces.values()})
        pairs = {}
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                if piece[:cut] in symbols and piece[cut:] in symbols:
                    pairs[symbols[piece[:cut]], symbols[piece[cut:]]] = bisect_left(scores, -spec.pieces[i].score), i
        self.pairs = PairTable(pairs, self.other + 1)
        #: characters that stand beside each other in some piece: between all others a cut is safe
        self.beside = {two for piece in pieces for two in zip(piece, piece[1:], strict=False)}
        self.cut_words = all(b != MARK or a == MARK for a, b in self.beside) and self.space == MARK
        self.words: dict[str, tuple[bytes, bytes, bytes]] = {}  # ids and lengths as little-endian uint32, surface
        self.parts: dict[str, tuple[bytes, bytes, bytes]] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, and for each of its characters, and its end, the byte of the original where it begins; None stands for one byte a character behind a prefix."""
        if not text:
            return "", np.zeros(1, np.int64)
        if self.map is None and not self.single_spaces:
            norm = text if self.space == " " else text.replace(" ", self.space)
            norm = self.space + norm if self.prefix else norm
            if self.prefix and text.isascii():
                return norm, None
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            widths = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            return norm, np.concatenate([np.zeros(1 + self.prefix, np.int64), np.cumsum(widths)])
        mapped = self.map.mapped(text) if self.map else ((c, len(c.encode())) for c in text)
        out, starts, at, blank = [], [], 0, self.single_spaces
        for new, length in mapped:
            if not starts:
                if self.single_spaces and new == " ":
                    at += length
                    continue
                if self.prefix:
                    out.append(self.space)
                    starts.append(at)
                first = True
            else:
                first = False
            while blank and new.startswith(" "):
                new = new[1:]
            if new:
                out.append(new.replace(" ", self.space))
                starts += [at] * len(new)
                blank = self.single_spaces and new.endswith(" ")
            elif first and not self.prefix:
                starts = []
            at += length
        norm = "".join(out)
        while self.single_spaces and norm.endswith(self.space):
            norm = norm[:-1]
            at = starts[len(norm)]
            starts.pop()
        return norm, np.array([*starts, at], np.int64)

    def cut(self, norm: str) -> list[str]:
        """The words of a normalised text."""
        if not norm:
            return []
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", norm) if self.cut_words else [norm]

    def _told(self, ids: list[int], places: list[int], word: str) -> tuple[bytes, bytes, bytes]:
        """Ids, lengths and surface of a word from its symbols and the places where they begin."""
        out, lengths = [], []
        for i, start, end in zip(ids, places, [*places[1:], len(word)], strict=True):
            if i < self.count:
                out.append(i)
                lengths.append(end - start)
            elif self.bytes:
                raw = word[start].encode()
                out += map(self.bytes.__getitem__, raw)
                lengths += [0] * (len(raw) - 1) + [1]
            elif out and out[-1] == self.unknown:  # neighbours without pieces are one unknown
                lengths[-1] += 1
            else:
                out.append(self.unknown)
                lengths.append(1)
        return np.array(out, "<u4").tobytes(), np.array(lengths, "<u4").tobytes(), b"".join(map(self.surfaces.__getitem__, out))

    def _merge(self, words: list[str]) -> Iterator[tuple[str, tuple[bytes, bytes, bytes]]]:
        words.sort(key=len)
        short = bisect_left(words, LONG + 1, key=len)
        for word in words[short:]:
            yield word, self._told(*self.pairs.merge_one(self.codes[[*map(ord, word)]].tolist()), word)
        for at in range(0, short, ROWS):
            some = words[at : min(at + ROWS, short)]
            lengths = np.array([*map(len, some)], np.int64)
            symbols = self.codes[np.frombuffer("".join(some).encode("utf-32-le"), "<u4")]
            ids, places, counts = self.pairs.merge_rows(symbols, lengths)
            begins, ends = np.cumsum(lengths) - lengths, np.cumsum(counts)
            sizes = np.diff(np.append(places, len(symbols)))
            odd = np.zeros(len(some), bool)
            odd[np.repeat(np.arange(len(some)), counts)[ids >= self.count]] = True
            flat, widths, listed = ids.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), ids.tolist()
            for word, a, b, begin, other in zip(some, (ends - counts).tolist(), ends.tolist(), begins.tolist(), odd.tolist(), strict=True):
                if other:
                    yield word, self._told(listed[a:b], (places[a:b] - begin).tolist(), word)
                else:
                    yield word, (flat[4 * a : 4 * b], widths[4 * a : 4 * b], b"".join(map(self.surfaces.__getitem__, listed[a:b])))

    def learn(self, words: set[str]) -> None:
        """Makes ready all of ``words``. Marks at a word's end are apart where no piece joins them to the rest."""
        new = words.difference(self.words)
        if len(self.words) + len(new) > CACHE:
            self.words.clear()
            self.parts.clear()
            new = words
        cut = {}
        for word in new:
            core = word.rstrip(_ENDS)
            apart = core and len(core) < len(word) and (core[-1], word[len(core)]) not in self.beside and self.bytes
            cut[word] = (core, word[len(core) :]) if apart else (word,)
        self.parts.update(self._merge([*{p for parts in cut.values() for p in parts if p not in self.parts}]))
        for word, parts in cut.items():
            made = [self.parts[p] for p in parts]
            self.words[word] = made[0] if len(made) == 1 else tuple(map(b"".join, zip(*made, strict=True)))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes, bytes]]:
        """For each text its ids and the cuts between their spans in the original's bytes (both little-endian uint32; n ids, n + 1 cuts), and its decoded bytes."""
        for start in range(0, len(texts), 256):
            normal = [self.normalise(text) for text in texts[start : start + 256]]
            words = [self.cut(norm) for norm, _ in normal]
            self.learn({word for some in words for word in some})
            for some, (_, record) in zip(words, normal, strict=True):
                ids, lengths, surfaces = (b"".join(x) for x in zip(*map(self.words.__getitem__, some), strict=True)) if some else (b"", b"", b"")
                if not self.bytes:
                    ids, lengths, surfaces = self._one_unknown(ids, lengths)
                ends = np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64)
                cuts = np.maximum(np.append(0, ends) - 1, 0) if record is None else record[np.append(0, ends)]
                yield ids, cuts.astype("<u4").tobytes(), self.without_prefix(surfaces, map(int, np.frombuffer(ids, "<u4")))

    def _one_unknown(self, ids: bytes, lengths: bytes) -> tuple[bytes, bytes, bytes]:
        """Unknown pieces beside each other become one, also over the border of two words."""
        out, widths = [], []
        for i, n in zip(np.frombuffer(ids, "<u4").tolist(), np.frombuffer(lengths, "<u4").tolist(), strict=True):
            if out and i == out[-1] == self.unknown:
                widths[-1] += n
            else:
                out.append(i)
                widths.append(n)
        return np.array(out, "<u4").tobytes(), np.array(widths, "<u4").tobytes(), b"".join(map(self.surfaces.__getitem__, out))

    def without_prefix(self, surface: bytes, ids: Iterable[int]) -> bytes:
        """A surface without the mark that encoding puts before a text (of each piece, until one says more, where it allows single ones only); its bytes as UTF-8."""
        lead = 0
        for i in ids if self.prefix or self.single_spaces else ():
            mark = self.kinds[i] == NORMAL and self.surfaces[i].startswith(b" ")
            lead += mark
            if self.kinds[i] != CONTROL and (not self.single_spaces or self.surfaces[i][mark:]):
                break
        return surface[lead:].decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        return self.without_prefix(b"".join(map(self.surfaces.__getitem__, ids)), ids).decode()


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One model for all tasks of a worker."""
    with open(path, "rb") as f:
        return Model(f.read())


def _encoded(docs: DataFrame, path: str | None, schema: str, of: Callable[[Model, bytes, bytes, bytes], tuple], kinds: tuple) -> DataFrame:
    path = path or default_path()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            made = [of(coder, *told) for told in coder.encode_batch(texts)]
            columns = zip(*made, strict=True) if made else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return id_and_text(docs).mapInArrow(run, schema)


def _with_ends(coder: Model, ids: bytes, cuts: bytes) -> tuple[bytes, bytes]:
    """Ids between the begin and the end id; both have empty spans."""
    return struct.pack("<I", coder.begin) + ids + struct.pack("<I", coder.end), cuts[:4] + cuts + cuts[-4:]


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, cuts (binary: little-endian uint32), decoded (binary: UTF-8): piece i stands for the bytes cuts[i] to cuts[i + 1] of the text."""
    return _encoded(docs, path, "doc_id long, ids binary, cuts binary, decoded binary", lambda coder, ids, cuts, text: (*_with_ends(coder, ids, cuts), text), (pa.binary(), pa.binary(), pa.binary()))


def piece_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, cuts_sha256: what ``encode_pieces`` gives, hashed where it is made."""
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def of(coder: Model, ids: bytes, cuts: bytes, text: bytes) -> tuple:
        ids, cuts = _with_ends(coder, ids, cuts)
        return len(ids) // 4, sha(ids), sha(text), sha(cuts)

    return _encoded(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, cuts_sha256 string", of, (pa.int64(), pa.string(), pa.string(), pa.string()))


def op11_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(documents(spark, sf_dir))
