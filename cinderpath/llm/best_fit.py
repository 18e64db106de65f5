"""Packing of documents into sequences by vector best fit.

1. Every document is encoded, gets an end id, and only what is longer than a sequence is cut. Texts are cut at ASCII white space,
   which no token of the vocabulary contains, and each distinct word of a batch is encoded once by the tokenizers library.
2. The pieces (no ids, about 40 bytes each) are dealt by a hash into groups of about ``group_pieces``; the number of groups follows
   the number of pieces, so no task holds more than a fixed number of them. With thousands of pieces in a group, what the last
   bins of each group leave empty is far below one percent.
3. Each group is packed by best fit over pieces in descending length. A bin's residual capacity is a vector - tokens, documents,
   attention cost (sum of squared lengths) - and a piece goes to the bin that can take it under every constraint and whose
   weighted residual norm after taking it is smallest; if none can, it opens a bin.

Defined cases: a null or empty text is one piece of its end id; null ids are packed like others; rows that repeat are packed each;
ties in length are broken by doc_id and piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_and_text, written

CACHE = 600_000
#: Parts of words that are encoded as one text.
JOINED = 256
_MARKS = b".,;:!?"
#: Letters of ASCII and Latin-1, as UTF-8.
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts, as little-endian uint32, by a tokenizers file in which no token crosses ASCII white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        """The words of a text; A-Z lower-cased beforehand, as the tokenizer does, unless a special token or a combining mark may be there."""
        return (text if b"<|" in text or b"\xcc" in text else text.lower()).split()

    def learn(self, new: set[bytes]) -> None:
        """Encodes words not met before. A Latin word and the marks behind it are encoded apart, as the tokenizer cuts them."""
        cores, known = self.cores, self.known
        split, whole, parts = [], [], set()
        for w in new:
            core = w.rstrip(_MARKS)
            if core in cores or _LATIN(core):
                marks = w[len(core) :]
                split.append((w, core, marks))
                if core not in cores:
                    parts.add(core)
                if marks and marks not in cores:
                    parts.add(marks)
            else:
                whole.append(w)
        for w, got in zip(whole, self.encoded(whole), strict=True):
            known[w] = struct.pack(f"<{len(got.ids)}I", *got.ids)
        fresh = [*parts]
        cores.update(zip(fresh, self.encoded_parts(fresh), strict=True))
        known.update((w, cores[core] + cores[marks] if marks else cores[core]) for w, core, marks in split)

    def encoded(self, texts: list[bytes]) -> list:
        return self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)

    def encoded_parts(self, parts: list[bytes]) -> Iterator[bytes]:
        """The ids of parts that are one word each. Many are encoded as one text and cut behind the ids that end a word; where these are not one
        for each part, as in a vocabulary that doesn't mark them, each part is encoded by itself."""
        for at in range(0, len(parts), JOINED):
            some = parts[at : at + JOINED]
            ids = np.array(self.encoded([b" ".join(some)])[0].ids if self.ends.any() else [], "<u4")
            cuts, raw = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            if len(cuts) == len(some) and cuts[-1] == len(raw):
                yield from (raw[a:z] for a, z in zip((0, *cuts), cuts))
            else:
                yield from (struct.pack(f"<{len(got.ids)}I", *got.ids) for got in self.encoded(some))

    def encode_batch(self, texts: list[bytes]) -> Iterator[bytes]:
        known = self.known
        for at in range(0, len(texts), 256):
            some = [self.words(text) for text in texts[at : at + 256]]
            distinct = set(chain.from_iterable(some))
            new = distinct.difference(known)
            if len(known) + len(new) > CACHE:
                known.clear()
                self.cores.clear()
                new = distinct
            self.learn(new)
            for words in some:
                yield b"".join(map(known.__getitem__, words))


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece of every document."""
    path = path or default_path()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_batch(batch.column("text").to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(run, PIECE)


def vector_best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece; lengths come in descending order.

    capacity: tokens, documents, attention cost of a bin. A piece that no empty bin can take by its cost gets a bin of its own.
    """
    limit, weight = np.array(capacity, float), np.array(weights, float) / np.square(np.array(capacity, float))
    room = np.empty((len(lengths), 3))  # of open bins
    of = np.empty(len(lengths), np.int64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    smallest, n, made = lengths[-1] if len(lengths) else 0, 0, 0
    for i, length in enumerate(lengths):
        need = np.array((length, 1.0, float(length) * length))
        left = room[:n] - need
        cost = left * left @ weight
        cost[(left < 0).any(axis=1)] = np.inf
        at = int(cost.argmin()) if n else -1
        if at < 0 or cost[at] == np.inf:
            at, of[n], room[n] = n, made, limit
            n, made = n + 1, made + 1
        bins[i], offsets[i] = of[at], limit[0] - room[at, 0]
        room[at] -= need
        if room[at, 0] < smallest or room[at, 1] < 1:  # takes nothing any more
            n -= 1
            room[at], of[at] = room[n], of[n]
    return bins, offsets


def pack(found: DataFrame, capacity: int = 4096, max_docs: int | None = None, max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), group_pieces: int = 8192) -> DataFrame:
    """The pieces with sequence_id and offset. ``max_docs`` and ``max_cost`` bind only where given."""
    limits = (capacity, max_docs or capacity, max_cost or float(capacity) ** 2)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = vector_best_fit(group["length"].to_numpy(), limits, weights)
        return group.assign(sequence_id=group["slot"] * (1 << 32) + bins, offset=offsets).drop(columns="slot")

    groups = max(1, -(-found.count() // group_pieces))
    slot = F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32"), F.lit(groups))
    return found.withColumn("slot", slot).groupBy("slot").applyInPandas(run, f"{PIECE}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, **limits) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    return pack(written(pieces(docs, path, capacity, end_id), "pieces"), capacity, **limits)


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))
