"""Byte-level BPE by dynamic programming over prefixes: encoding, decoding, exact appends and edits.

For each byte prefix of a pre-token the table keeps one token: the last one of that prefix's encoding. A token that ends at a place
is that last token if, and only if, BPE leaves it standing beside the last token of the prefix before it, and exactly one token is. So
a table grows by one entry a byte, an entry depends on the bytes and entries of one token length before it and on nothing after it, and
the ids of any prefix are read by stepping back from its end. An append continues the table; an edit fills it from the edit on, until as
many entries as the longest token has bytes agree with those before the edit: from there on they are the old ones.

Candidates that end at a byte come from an automaton over all tokens, longest first. Whether two tokens stand side by side is found by
undoing their merges, the later one first. Vocabularies are rank files read on the executors by path, which is a parameter. A file
whose tokens are not all made from two tokens of lower rank is refused, since prefixes need not have one last token then.

Defined results: a null text counts as empty and has no ids; repeated rows give repeated rows; texts are encoded whole at any length;
an empty table gives no rows; further columns are ignored. Ties don't occur: an encoding is unique.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import batches_of, give_back, short_batches, texts

#: Pre-tokens, and pairs of tokens, that a worker keeps; either store is emptied when it is full.
KEPT_WORDS, KEPT_PAIRS = 200_000, 1_000_000
#: Pre-tokens before an edit that are split again: a run of white space may end by what comes two pre-tokens later.
SPLIT_AGAIN = 3


class _Words(dict):
    """Ids of pre-tokens as bytes, worked out when first asked for."""

    def __init__(self, codec: PrefixCodec) -> None:
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        ids = little_endian(self.codec.read(self.codec.fill(data)))
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class PrefixCodec:
    """Encoder and decoder of one rank file and one pattern of pre-tokens."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.strings = [b""] * (max(ranks.values()) + 1)
        for s, i in ranks.items():
            self.strings[i] = s
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{path}: no token for the bytes {missing[:5]}")
        self.lengths = list(map(len, self.strings))
        self.longest = max(self.lengths)
        self.halves: list[tuple[int, int] | None] = [None] * len(self.strings)
        self.pairs: dict[tuple[int, int], int] = {}
        for i in sorted(ranks.values()):
            if self.lengths[i] > 1:
                parts = _merged(self.strings[i], ranks, i)
                if len(parts) != 2:
                    raise ValueError(f"{path}: token {i} isn't made from two tokens of lower rank")
                self.halves[i] = (ranks[parts[0]], ranks[parts[1]])
                self.pairs[self.halves[i]] = i
        self._automaton(ranks)
        self.side: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(pattern).findall
        self.finder = regex.compile(pattern)
        self.words = _Words(self)

    def _automaton(self, ranks: dict[bytes, int]) -> None:
        """States are the tokens' prefixes; each knows its longest suffix that is a state, and the longest token that ends it."""
        self.next: dict[int, int] = {}
        self.ends, fail, depth = [-1], [0], [b""]
        for s, i in ranks.items():
            at = 0
            for k, b in enumerate(s):
                to = self.next.get(at << 8 | b)
                if to is None:
                    to = self.next[at << 8 | b] = len(depth)
                    depth.append(s[: k + 1])
                    self.ends.append(-1)
                    fail.append(0)
                at = to
            self.ends[at] = i
        self.shorter = [-1] * len(self.strings)
        own = {s: n for n, s in enumerate(depth)}
        for s in sorted(depth[1:], key=len):
            at, back = own[s], 0
            if len(s) > 1:
                up = fail[own[s[:-1]]]
                while (to := self.next.get(up << 8 | s[-1])) is None and up:
                    up = fail[up]
                back = to or 0
            fail[at] = back
            if self.ends[at] >= 0:
                self.shorter[self.ends[at]] = self.ends[back]
            else:
                self.ends[at] = self.ends[back]
        self.fail = fail

    def stand(self, left: int, right: int) -> bool:
        """Whether BPE leaves two tokens side by side, i.e. whether the encoding of their bytes is these two."""
        known = self.side.get((left, right))
        if known is None:
            if len(self.side) >= KEPT_PAIRS:
                self.side.clear()
            known = self.side[left, right] = self._stand(left, right)
        return known

    def _stand(self, left: int, right: int) -> bool:
        halves, pairs, limit = self.halves, self.pairs, len(self.strings)
        while True:
            made = pairs.get((left, right))
            if made is not None and made < limit:  # merged across the border before what has been undone so far
                return False
            a, b = halves[left], halves[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                limit, left = left, a[1]
            else:  # of equal merges the left one comes first, so that a merge of the same rank across the border would, too
                limit, right = right + 1, b[0]

    def fill(self, data: bytes, kept: list[int] | None = None, old: list[int] | None = None, same: int = 0) -> list[int]:
        """The table of a pre-token: the last token of each of its prefixes.

        kept: its first entries, where they are known. old: the table before an edit, whose last `same` bytes are those of data."""
        table = kept if kept is not None else []
        n, i = len(data), len(table)
        follow, fail, ends, shorter, lengths, stand = self.next, self.fail, self.ends, self.shorter, self.lengths, self.stand
        at, agree = 0, 0
        for b in data[max(0, i - self.longest) : i]:
            while (to := follow.get(at << 8 | b)) is None and at:
                at = fail[at]
            at = to or 0
        shift = len(old) - n if old is not None else 0
        while i < n:
            b = data[i]
            while (to := follow.get(at << 8 | b)) is None and at:
                at = fail[at]
            at = to or 0
            i += 1
            token = ends[at]
            while (begin := i - lengths[token]) and not stand(table[begin - 1], token):
                token = shorter[token]
            table.append(token)
            if old is not None and i > n - same:
                agree = agree + 1 if old[i - 1 + shift] == token else 0
                if agree >= self.longest:
                    table.extend(old[i + shift :])
                    break
        return table

    def read(self, table: list[int]) -> array:
        """Ids from the table of a pre-token, from its end back."""
        out, i, lengths = [], len(table), self.lengths
        while i:
            token = table[i - 1]
            out.append(token)
            i -= lengths[token]
        return array("I", out[::-1])

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def decode_bytes(self, ids) -> bytes:
        """Concatenated vocabulary strings."""
        return b"".join(map(self.strings.__getitem__, ids))

    def table(self, text: str) -> array:
        """The tables of a text's pre-tokens end to end, one entry a byte of its UTF-8; a pre-token's first entry is stored as ~token."""
        out = array("i")
        for word in self.split(text):
            out.extend(_marked(self.fill(word.encode())))
        return out

    def ids(self, table) -> array:
        """Ids of a text from its table."""
        out, i, lengths = [], len(table), self.lengths
        while i:
            token = table[i - 1]
            token = ~token if token < 0 else token
            out.append(token)
            i -= lengths[token]
        return array("I", out[::-1])

    def edited(self, text: str, table: array, start: int, end: int, put: str) -> tuple[str, array]:
        """The text with its characters start to end replaced by `put`, and its table. Only what an edit can change is split and filled:
        pre-tokens from a few before it up to the first border behind it that is an old one, and in the last of them the entries up to
        the place where they agree with the old ones again. An append is an edit at the end."""
        start, end = max(0, min(start, len(text))), max(0, min(max(start, end), len(text)))
        first = len(text[:start].encode())
        gone, new = len(text[start:end].encode()), len(put.encode())
        now = text[:start] + put + text[end:]
        # Back to the border of a pre-token far enough before the edit.
        at, borders = first, 0
        while at > 0 and borders <= SPLIT_AGAIN:
            at -= 1
            borders += at < len(table) and table[at] < 0
        out = table[:at]
        pos = len(text.encode()[:at].decode())
        for found in self.finder.finditer(now, pos):
            data = found.group().encode()
            behind = at - new + gone
            if at >= first + new and behind < len(table) and table[behind] < 0:  # an old border behind the edit: the rest is as it was
                out.extend(table[behind:])
                break
            out.extend(_marked(self._refilled(data, at, table, first, gone, new)))
            at += len(data)
        return now, out

    def _refilled(self, data: bytes, at: int, table: array, first: int, gone: int, new: int) -> list[int]:
        """The table of the pre-token of the edited text that begins at byte `at`, from what the old table has of it."""
        kept, old, same = None, None, 0
        if at < first and table[at] < 0:  # an old pre-token begins here, too: entries before the edit, or before either one's end, stay
            stop = at + 1
            while stop < min(len(table), first, at + len(data)) and table[stop] >= 0:
                stop += 1
            kept = [~table[at], *table[at + 1 : stop]]
        behind = at + len(data) - new + gone  # the same end in the old text
        same = min(len(data), behind - first - gone)
        if same > 0 and (behind == len(table) or table[behind] < 0):
            begin = behind - 1
            while begin > 0 and table[begin] >= 0:
                begin -= 1
            old = [~table[begin], *table[begin + 1 : behind]]
            same = min(same, len(old))
        return self.fill(data, kept, old, same)


def _marked(table: list[int]) -> list[int]:
    return [~table[0], *table[1:]]


def _merged(data: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """A token's bytes after all merges of lower rank, least rank first and leftmost of equal ones."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> PrefixCodec:
    """One codec for each file, pattern and worker."""
    return PrefixCodec(path, pattern)


def _narrow(df: DataFrame, path: str, pattern: str, columns: list, schema, ddl: str, row, size: int = 2000) -> DataFrame:
    """row(codec, *cells) for each row of the columns, whose null strings are empty. No shuffle; one batch of texts in memory."""
    short_batches(df.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            cells = [texts(batch, f.name) if str(f.type) == "string" else batch.column(f.name).to_pylist() for f in batch.schema]
            yield from batches_of((row(c, *x) for x in zip(*cells)), schema, size)
        c.words.clear()  # the worker goes on to other stages
        give_back()

    return df.select(columns).mapInArrow(run, ddl)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each whole text as an array of ints."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([(key, pa.int64()), ("ids", pa.list_(pa.int32()))])
    columns = [df[key].cast("long").alias("k"), df[text].alias("t")]
    return _narrow(df, path, pattern, columns, schema, f"`{key}` long, ids array<int>", lambda c, k, t: (k, np.frombuffer(c.encode(t), "<u4").astype("i4")), 256)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from (key, ids): the vocabulary's bytes as UTF-8, what is no UTF-8 replaced; null ids give the empty text."""
    import pyarrow as pa

    schema = pa.schema([(key, pa.int64()), ("text", pa.string())])
    columns = [df[key].cast("long").alias("k"), df[ids].alias("i")]
    return _narrow(df, path, pattern, columns, schema, f"`{key}` long, text string", lambda c, k, i: (k, c.decode_bytes(i or ()).decode("utf-8", "replace")), 256)


def tables(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, prefixes): each text with the last token of each of its byte prefixes, for revised()."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([(key, pa.int64()), ("text", pa.string()), ("prefixes", pa.list_(pa.int32()))])
    columns = [df[key].cast("long").alias("k"), df[text].alias("t")]
    return _narrow(df, path, pattern, columns, schema, f"`{key}` long, text string, prefixes array<int>", lambda c, k, t: (k, t, np.asarray(c.table(t), "i4")), 256)


def revised(df: DataFrame, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """(key, text, prefixes, ids) of (key, text, prefixes, start, end, put): each text with its characters from start to end replaced by
    put, encoded from the stored prefixes near the edit only. A null start or end is the text's end, so that put is appended; null
    prefixes are those of an empty text and are worked out anew."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([(key, pa.int64()), ("text", pa.string()), ("prefixes", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])
    columns = [df[key].cast("long").alias("k"), df["text"].alias("t"), df["prefixes"].alias("p"), df["start"].cast("long").alias("a"), df["end"].cast("long").alias("b"), df["put"].cast("string").alias("put")]

    def row(c, k, t, p, a, b, put):
        n = len(t)
        now, table = c.edited(t, c.table(t) if p is None else array("i", p), n if a is None else a, n if b is None else b, put)
        return k, now, np.asarray(table, "i4"), np.frombuffer(c.ids(table), "u4").astype("i4")

    return _narrow(df, path, pattern, columns, schema, f"`{key}` long, text string, prefixes array<int>, ids array<int>", row, 256)


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each text once and return counts and digests: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def row(c, k, t):
        ids = c.encode(t)
        own = array("I", ids)
        if sys.byteorder == "big":
            own.byteswap()
        return k, len(own), hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode_bytes(own)).hexdigest()

    columns = [df["doc_id"].cast("long").alias("doc_id"), df["text"].alias("t")]
    return _narrow(df, path, pattern, columns, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row)
