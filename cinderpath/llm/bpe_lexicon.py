"""Byte-level BPE encoding and decoding with a minimal acyclic transducer for frequent words.

A word is what stands between safe cuts of the text: before a space that stands between two other characters, and around a line
feed that does. No pre-token of the vocabulary's pattern crosses such a cut, so words can be encoded one by one. Texts with other
white space are cut by the pattern itself.

1. The words of all texts that allow safe cuts are counted, but the first one of each line, which has no space before it (a shuffle of
   distinct words with their counts). Words seen once are left out.
2. Words with at least ``min_share`` of all occurrences - 1 / ``min_share`` words at most, whatever the corpus - are encoded by
   their merges and compiled into a minimal acyclic automaton: equal suffixes share their states. Each state knows how many words
   end below it, so walking a word gives its rank, and the rank its ids: the output. The compiled bytes, of proven size, are
   broadcast, and each Python worker maps them into memory; its index of steps (state and byte, target, words before) is an array in memory.
3. Each text is encoded from its words: the automaton for frequent ones, exact merges by rank for unseen ones. A worker keeps
   what it has encoded in a bounded cache. Texts that allow no safe cuts - other white space than single spaces and line feeds, or the
   bytes e2 80 of typographic quotes and dashes - don't meet the automaton: they are merged from the pattern's pieces.

Defined cases: null and empty texts have no ids; null ids of documents are returned as they are; repeated rows are each encoded; an
empty table gives an empty result (and an empty lexicon); the string of a special token in a text is that token, as in the library;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import sys
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text

#: Fixed value: the public pattern by which byte-level BPE cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space other than space and line feed: single bytes, and UTF-8 sequences or prefixes of them.
_ODD_BYTES = bytes([9, 11, 12, 13, 28, 29, 30, 31])
_ODD = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_DOUBLE = (b"  ", b"\n\n", b" \n", b"\n ")
CACHE = 500_000
_MARKS = b".,;:!?"
#: Latin letters up to U+024F, as UTF-8.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+").fullmatch
#: Longer pre-tokens are merged one by one.
LONG, NONE = 48, 1 << 30


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian uint32."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Merges:
    """A vocabulary file's merges: exact encoding of words that no lexicon has."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], _byte_chars()
        self.bytes_of = {i: bytes(map(chars.__getitem__, token)) for token, i in vocab.items()}
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: token for token, i in self.special.items()}
        self.single = {b: vocab[c] for c, b in chars.items()}
        self.ranks, self.merged = {}, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = rank
            self.merged[rank] = vocab[a + b]
        self.known: dict[bytes, list[int]] = {}  # pre-tokens merged before, kept while there is room
        # the same for many pre-tokens at once: pairs as sorted numbers with their ranks, and the ranks of pairs of bytes
        self.span = max(vocab.values()) + 1
        keys = np.array([a * self.span + b for a, b in self.ranks], np.int64)
        order = keys.argsort()
        self.pairs, self.pair_ranks = keys[order], np.array([*self.ranks.values()], np.int32)[order]
        self.merged_ids = np.array([self.merged[r] for r in self.ranks.values()], np.int32)
        self.single_ids = np.array([self.single[b] for b in range(256)], np.int32)
        self.byte_ranks = self.ranks_of(np.repeat(self.single_ids, 256), np.tile(self.single_ids, 256))
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile(b"(" + b"|".join(map(regex.escape, self.special)) + b")")

    def merge(self, token: bytes) -> list[int]:
        """Merges the pair of the best rank, the leftmost of equal ones, until no pair has a rank."""
        ids = self.known.get(token)
        if ids is not None:
            return ids
        ids, rank_of, none = [*map(self.single.__getitem__, token)], self.ranks.get, 1 << 30
        ranks = [rank_of(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at : at + 2] = [self.merged[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank_of((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank_of((ids[at], ids[at + 1]), none)
        if len(self.known) >= CACHE // 2:
            self.known.clear()
        self.known[token] = ids
        return ids

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.span + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where((self.pairs[at] == wanted) & (right >= 0), self.pair_ranks[at], NONE)

    def merge_many(self, tokens: list[bytes]) -> list[bytes]:
        """``merge`` of many pre-tokens, as little-endian uint32. Each round merges the best pair of every pre-token that has one.

        A row holds a pre-token's ids between two empty columns; what a merge takes away becomes empty, and neighbours are linked.
        """
        out = [b""] * len(tokens)
        order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
        while order and len(tokens[order[-1]]) > LONG:
            i = order.pop()
            out[i] = packed(self.merge(tokens[i]))
        for at in range(0, len(order), 2048):
            some = order[at : at + 2048]
            lengths = np.array([len(tokens[i]) for i in some])
            raw = np.frombuffer(b"".join([tokens[i] for i in some]), np.uint8).astype(np.int32)
            n, width = len(some), int(lengths[-1]) + 2
            column = np.arange(width, dtype=np.int32)
            ids = np.full((n, width), -1, np.int32)
            ids[(column >= 1) & (column <= lengths[:, None])] = self.single_ids[raw]
            ranks = np.full((n, width), NONE, np.int32)
            inner = np.ones(max(len(raw) - 1, 0), bool)
            inner[np.cumsum(lengths)[:-1] - 1] = False  # pairs of two pre-tokens
            ranks[(column >= 1) & (column < lengths[:, None])] = self.byte_ranks[(raw[:-1] * 256 + raw[1:])[inner]]
            after, before = np.tile(column + 1, (n, 1)), np.tile(column - 1, (n, 1))
            live = np.arange(n)
            while True:
                best_at = ranks[live].argmin(axis=1)
                best = ranks[live, best_at]
                found = best < NONE
                live, a, best = live[found], best_at[found], best[found]
                if not len(live):
                    break
                made = ids[live, a] = self.merged_ids[best]
                gone = after[live, a]
                c, z = after[live, gone], before[live, a]
                ids[live, gone], ranks[live, gone] = -1, NONE
                after[live, a], before[live, c] = c, a
                ranks[live, a] = self.ranks_of(made, ids[live, c])
                ranks[live, z] = self.ranks_of(ids[live, z], made)
            kept = ids >= 0
            flat, ends = ids[kept].astype("<u4").tobytes(), 4 * np.cumsum(kept.sum(axis=1))
            for i, start, end in zip(some, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = flat[start:end]
        return out

    def encode(self, text: bytes) -> list[int]:
        out: list[int] = []
        for piece in self.cut.split(text) if any(map(text.__contains__, self.special)) else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            else:
                for token in self.pretokens(piece.decode("utf-8", "replace")):
                    out += self.merge(token.encode())
        return out

    def pretokens(self, text: str) -> list[str]:
        """The pieces of the pattern."""
        return self.pattern.findall(text)


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def lines_of(text: bytes) -> list[list[bytes]] | None:
    """The words of each line; None for a text whose white space doesn't allow safe cuts."""
    if text[:1] in (b" ", b"\n") or text[-1:] in (b" ", b"\n") or any(d in text for d in _DOUBLE) or any(o in text for o in _ODD) or len(text.translate(None, _ODD_BYTES)) != len(text):
        return None
    return [line.split(b" ") for line in text.split(b"\n")]


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Compiles words with their ids into the bytes of a minimal acyclic transducer.

    Words come sorted; as soon as no later word can pass through a state, the state is replaced by an equal one if there is one.
    Layout: numbers of states, edges, words and ids; for each state its first edge and whether a word ends there; for each edge its
    target and the number of words that come before it in its state; for each word where its ids begin; the ids: all uint32. Then
    the byte of each edge.
    """
    root: list = [{}, False]  # edges by byte, final
    known: dict[tuple, list] = {}
    path: list[tuple[list, int, list]] = []
    offsets, ids, last = [0], [], b""

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            key = (child[1], tuple((b, id(t)) for b, t in child[0].items()))
            parent[0][byte] = known.setdefault(key, child)

    for word, out in sorted(entries):
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        settle(common)
        state = path[-1][2] if path else root
        for byte in word[common:]:
            child: list = [{}, False]
            state[0][byte] = child
            path.append((state, byte, child))
            state = child
        state[1] = True
        last = word
        ids += out
        offsets.append(len(ids))
    settle(0)
    order, number, below = [], {}, {}
    stack = [(root, False)]
    while stack:
        state, done = stack.pop()
        if done:
            below[id(state)] = state[1] + sum(below[id(t)] for t in state[0].values())
        elif id(state) not in number:
            number[id(state)] = len(order)
            order.append(state)
            stack.append((state, True))
            stack += [(t, False) for t in state[0].values() if id(t) not in number]
    first, final, edges, labels = [], [], [], []
    for state in order:
        first.append(len(labels))
        final.append(int(state[1]))
        skip = int(state[1])
        for byte, target in sorted(state[0].items()):
            edges += [number[id(target)], skip]
            labels.append(byte)
            skip += below[id(target)]
    first.append(len(labels))
    flat = [len(order), len(labels), len(offsets) - 1, len(ids), *first, *final, *edges, *offsets, *ids]
    return struct.pack(f"<{len(flat)}I", *flat) + bytes(labels) + bytes(-len(labels) % 4)


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, edges, words, n = np.frombuffer(self.map, "<u4", 4).tolist()
        view = np.frombuffer(self.map, "<u4", 4 + 2 * states + 1 + 2 * edges + words + 1 + n)
        first, self.final, pairs, self.offsets, self.ids = np.split(view[4:], np.cumsum([states + 1, states, 2 * edges, words + 1]))
        self.targets, self.skips = pairs[::2].astype(np.int64), pairs[1::2].astype(np.int64)
        labels = np.frombuffer(self.map, np.uint8, edges, 4 * len(view))
        #: each edge as its state and byte, ascending
        self.steps = np.repeat(np.arange(states), np.diff(first.astype(np.int64))) * 256 + labels

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def ids_of(self, word: bytes) -> list[int] | None:
        """The ids of a word that the lexicon has, else None."""
        found = self.ids_of_many([word])[0]
        return None if found is None else np.frombuffer(found, "<u4").tolist()

    def ids_of_many(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word that the lexicon has, as little-endian uint32, else None. All words of a block walk one byte a step."""
        out: list[bytes | None] = [None] * len(words)
        for start in range(0, len(words) if len(self.steps) else 0, 8192):
            some = words[start : start + 8192]
            raw = np.frombuffer(b"".join(some), np.uint8)
            lengths = np.array([*map(len, some)], np.int64)
            begins = np.cumsum(lengths) - lengths
            row, state, rank, depth = np.arange(len(some)), np.zeros(len(some), np.int64), np.zeros(len(some), np.int64), 0
            while len(row):
                done = lengths[row] == depth
                for i, r in zip(row[done & (self.final[state] > 0)].tolist(), rank[done & (self.final[state] > 0)].tolist(), strict=True):
                    out[start + i] = self.ids[self.offsets[r] : self.offsets[r + 1]].tobytes()
                row, state, rank = row[~done], state[~done], rank[~done]
                wanted = state * 256 + raw[begins[row] + depth]
                at = np.minimum(np.searchsorted(self.steps, wanted), len(self.steps) - 1)
                on = self.steps[at] == wanted
                row, at = row[on], at[on]
                state, rank, depth = self.targets[at], rank[on] + self.skips[at], depth + 1
        return out


class Words(dict):
    """word -> (ids as little-endian uint32, their bytes): the lexicon's or merged, kept while there is room."""

    def __init__(self, lexicon: Lexicon | None, coder: Merges, prefix: bytes):
        super().__init__()
        self.lexicon, self.coder, self.prefix = lexicon, coder, prefix
        self.cores: dict[bytes, bytes] = {}  # pre-tokens -> ids

    def pretokens(self, word: bytes) -> list[bytes]:
        """The pre-tokens of a word with its prefix. A Latin word and the marks behind it need no pattern."""
        core = word.rstrip(_MARKS)
        if core and _LATIN(core):
            return [self.prefix + core, word[len(core) :]] if len(core) < len(word) else [self.prefix + core]
        return [x.encode() for x in self.coder.pretokens((self.prefix + word).decode())]

    def learn(self, words: set[bytes]) -> None:
        """Makes ready all of ``words``, which hold no special token."""
        new = words.difference(self)
        if len(self) + len(new) > CACHE:
            self.clear()
            self.cores.clear()
            new = words
        unseen, cores, bytes_of = {}, self.cores, self.coder.bytes_of.__getitem__
        new = [*new]
        for word, ids in zip(new, self.lexicon.ids_of_many([self.prefix + word for word in new]) if self.lexicon else [None] * len(new), strict=True):
            if ids is None:
                unseen[word] = self.pretokens(word)
            else:
                self[word] = ids, b"".join(map(bytes_of, np.frombuffer(ids, "<u4").tolist()))
        missing = [*{x for parts in unseen.values() for x in parts if x not in cores}]
        cores.update(zip(missing, self.coder.merge_many(missing), strict=True))
        for word, parts in unseen.items():
            ids = b"".join([cores[x] for x in parts])
            self[word] = ids, b"".join(map(bytes_of, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def shared_encoder(path: str, lexicon: bytes) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path, lexicon)


class Encoder:
    def __init__(self, path: str, lexicon: bytes | None = None):
        self.coder = merges(path)
        made = Lexicon(lexicon) if lexicon else None
        self.bare, self.led = Words(made, self.coder, b""), Words(made, self.coder, b" ")
        self.line_feed = packed(self.coder.encode(b"\n")), b"\n"

    def encode(self, text: bytes) -> tuple[bytes, bytes]:
        """A text's ids as little-endian uint32, and the bytes that they stand for."""
        return next(self.encode_batch([text]))

    def encode_batch(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        for at in range(0, len(texts), 256):
            some = texts[at : at + 256]
            cut = [None if any(map(text.__contains__, self.coder.special)) else lines_of(text) for text in some]
            lines = [line for found in cut for line in found or ()]
            self.bare.learn({line[0] for line in lines})
            self.led.learn({word for line in lines for word in line[1:]})
            for text, found in zip(some, cut, strict=True):
                yield self.joined(found) if found else self.whole(text)

    def whole(self, text: bytes) -> tuple[bytes, bytes]:
        ids = self.coder.encode(text)
        return packed(ids), b"".join(map(self.coder.bytes_of.__getitem__, ids))

    def joined(self, lines: list[list[bytes]]) -> tuple[bytes, bytes]:
        parts = []
        bare, led = self.bare.__getitem__, self.led.__getitem__
        for i, line in enumerate(lines):
            if i:
                parts.append(self.line_feed)
            parts.append(bare(line[0]))
            parts.extend(map(led, line[1:]))
        ids, raw = zip(*parts, strict=True)
        return b"".join(ids), b"".join(raw)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (with its leading space, if any), n: over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for line in lines_of(text) or []:
                    counts.update(line[1:])
            if len(counts) > 400_000:
                yield out()
                counts.clear()
        yield out()

    return id_and_text(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, min_share: float = 5e-6) -> bytes:
    """The compiled frequent words of a corpus; b"" for a corpus without words."""
    counts = word_counts(docs)
    # the threshold needs the total: both come from one pass
    from .common import written

    counts = written(counts.where("n > 1"), "word-counts")
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return b""
    coder = merges(path)
    frequent = counts.where(F.col("n") >= total * min_share).select("word").toLocalIterator()
    return compile_lexicon((b" " + row.word, coder.encode(b" " + row.word)) for row in frequent)


def encode_documents(docs: DataFrame, path: str | None = None, min_share: float = 5e-6) -> DataFrame:
    """doc_id, ids (binary: little-endian uint32), decoded (binary: the UTF-8 bytes of the decoded text); one row per row of ``docs``."""
    path = path or default_path()
    return _encoded(docs, path, min_share, "doc_id long, ids binary, decoded binary", lambda ids, text: (ids, text), (pa.binary(), pa.binary()))


def _encoded(docs: DataFrame, path: str, min_share: float, schema: str, of, kinds: tuple) -> DataFrame:
    lexicon = docs.sparkSession.sparkContext.broadcast(build_lexicon(docs, path, min_share))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path, lexicon.value)
        for batch in batches:
            made = []
            for ids, raw in encoder.encode_batch(batch.column("text").to_pylist()):
                # as the library's decoder: bytes that aren't UTF-8 become U+FFFD
                made.append(of(ids, raw.decode("utf-8", "replace").encode()))
            columns = zip(*made, strict=True) if made else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return id_and_text(docs).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None, min_share: float = 5e-6) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode_documents`` gives, hashed where it is made."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return _encoded(
        docs, path or default_path(), min_share, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, text: (len(ids) // 4, sha(ids), sha(text)), (pa.int64(), pa.string(), pa.string()),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
