"""Byte-level BPE: encoding by a priority queue of merge ranks over a linked symbol list, decoding by concatenation.

A pre-token's symbols form a doubly linked list. Each adjacent pair that has a rank is queued as (rank, position); the least is
merged, its neighbours are relinked and the two new pairs are queued. An entry whose symbols have changed since is stale and is
skipped when it comes up. The encoded words are cached per worker, within a bound. Vocabulary files are read on the executors by
path, which is a parameter, and are not shipped with the code.

Defined results: a null text counts as empty and has no ids; repeated rows give repeated rows; texts are encoded whole at any
length; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import batches_of, give_back, short_batches, texts

#: The byte-level pre-tokenizer's pattern (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept with their ids in each worker; the cache is emptied when it is full.
CACHE_WORDS = 200_000


def byte_letters() -> dict[int, str]:
    """The byte-level format's letter for each byte: printable bytes stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairCodec:
    """Encoder and decoder of one tokenizer file with a byte-level BPE model."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.first = [vocab[letters[b]] for b in range(256)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.strings: dict[int, bytes] = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings.update({i: s.encode() for s, i in self.added.items()})
        self.split = regex.compile(PATTERN).findall
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.cache: dict[str, array] = {}

    def word(self, word: str) -> array:
        """Ids of one pre-token."""
        ids = [self.first[b] for b in word.encode("utf-8")]
        n, pairs = len(ids), self.pairs
        if n > 1:
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            queue = [(*found, i) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
            heapq.heapify(queue)
            while queue:
                _, made, i = heapq.heappop(queue)
                j = after[i]
                if ids[i] < 0 or j >= n or (found := pairs.get((ids[i], ids[j]))) is None or found[1] != made:
                    continue  # stale: one of the two symbols has changed or gone
                ids[i], ids[j] = made, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if found := pairs.get((made, ids[k])):
                        heapq.heappush(queue, (*found, i))
                h = before[i]
                if h >= 0 and (found := pairs.get((ids[h], made))):
                    heapq.heappush(queue, (*found, h))
            ids = [x for x in ids if x >= 0]
        return array("I", ids)

    def _plain(self, text: str, out: array) -> None:
        cache, extend = self.cache, out.extend
        for w in self.split(text):
            ids = cache.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[w] = ids
            extend(ids)

    def encode(self, text: str) -> array:
        """Ids of a whole text; strings of added tokens become their ids."""
        out = array("I")
        if self.marks is None or not any(m in text for m in self.added):
            self._plain(text, out)
            return out
        for piece in self.marks.split(text):
            if piece in self.added:
                out.append(self.added[piece])
            elif piece:
                self._plain(piece, out)
        return out

    def decode(self, ids) -> str:
        """Concatenated vocabulary strings, special ones included, bytes that are no UTF-8 replaced."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=4)
def codec(path: str) -> BytePairCodec:
    """One codec for each file and worker."""
    return BytePairCodec(path)


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each whole text as an array of ints. Narrow: no shuffle, one batch of texts in memory."""
    import pyarrow as pa

    short_batches(df.sparkSession)
    out = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        import numpy as np

        c = codec(path)
        for batch in batches:
            yield from batches_of(((k, np.frombuffer(c.encode(t), "u4").astype("i4")) for k, t in zip(batch.column(0).to_pylist(), texts(batch, "t"))), out)

    return df.select(df[key].cast("long").alias(key), df[text].alias("t")).mapInArrow(run, f"`{key}` long, ids array<int>")


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from (key, ids); null ids give the empty text."""
    import pyarrow as pa

    out = pa.schema([(key, pa.int64()), ("text", pa.string())])

    def run(batches):
        c = codec(path)
        for batch in batches:
            yield from batches_of(((k, c.decode(x or ())) for k, x in zip(*(batch.column(i).to_pylist() for i in (0, 1)))), out)

    return df.select(df[key].cast("long").alias(key), df[ids].alias("i")).mapInArrow(run, f"`{key}` long, text string")


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """Encode and decode each text once and return counts and digests: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    import pyarrow as pa

    short_batches(df.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def rows(batches):
        c = codec(path)
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                ids = c.encode(t)
                yield k, len(ids), hashlib.sha256(little_endian(ids)).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()

    def run(batches):
        yield from batches_of(rows(batches), out)
        codec(path).cache.clear()  # the worker goes on to other stages
        give_back()

    return df.select(df["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenised(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of documents (doc_id, text): each whole text encoded, and decoded again from its ids. Narrow."""
    import pyarrow as pa

    short_batches(df.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def rows(batches):
        import numpy as np

        c = codec(path)
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                ids = c.encode(t)
                yield k, len(ids), np.frombuffer(ids, "u4").astype("i4"), c.decode(ids)

    def run(batches):
        yield from batches_of(rows(batches), out, 256)
        codec(path).cache.clear()  # the worker goes on to other stages
        give_back()

    return df.select(df["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, text string")
