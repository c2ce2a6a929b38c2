"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, verified by banded alignment.

Texts and benchmark items are compared as streams of lower-case letters and digits (UTF-8 bytes; white space, punctuation and other
ASCII signs are left out, so that layout and added signs don't hide a passage). An item of m bytes occurs in a text if some stretch
of the text is within k = EDITS * m edits of it. By the q-gram lemma such a stretch shares at least m - q + 1 - k q of the item's
q-grams, all on diagonals (place in text less place in item) that lie within k of each other. So

1. windows of the text with too few positions whose q-gram occurs in any item are left out,
2. shared q-grams are counted by item and band of diagonals; bands are 2 (k + 1) wide and start every k + 1, so that any k + 1
   neighbouring diagonals lie within one band; bands below the lemma's count are left out. A q-gram that an item repeats within k + 1
   places counts there as one stretch of diagonals, once for each place in the text that it may belong to, which can only raise a
   count: so a letter that is repeated without end costs no more than any other. Counts are worked out in slices of bounded size,
3. what is left is aligned within its band and kept if the edits fit the budget.

The filter loses nothing: every occurrence within the budget is found. Items go to the workers in blocks of MOST_BYTES at most (an
item that is larger is a block of its own); a larger benchmark takes further passes over the documents. The budget is EDITS of the
letters, rounded down, and (m - Q) // Q at most: items of 30 or 31 letters get two edits.

Defined results: null and empty texts hold no item; null, empty and short items (under LEAST_BYTES letters) match nothing; an item
that is there twice is found under each item_id; of occurrences of one item that overlap the one of fewest edits counts, of equal ones
the first; repeated documents are judged alike; empty tables give no matches; long texts are read whole, in overlapping pieces;
further columns are ignored (matches) or kept (decontaminate).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, short_batches, texts

Q = 8
EDITS = 0.1
LEAST_BYTES = 24
#: Bytes of item text in a block that is sent to every worker.
MOST_BYTES = 8_000_000
#: Letters handled at once.
PIECE = 1 << 21
#: Pairs of item and band that are counted at once.
SLICE = 1 << 21
#: Bits of the table that tells whether a q-gram may be an item's.
BITS = 22


@lru_cache(maxsize=1)
def _letters():
    import numpy as np

    keep = np.zeros(256, "u1")
    for b in (*range(48, 58), *range(97, 123), *range(128, 256)):
        keep[b] = b
    return keep


def lowered(text: str) -> str:
    """Lower case, with as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def stream(data: bytes):
    """(letters, their offsets in data)"""
    import numpy as np

    x = _letters()[np.frombuffer(data, "u1")]
    at = np.flatnonzero(x)
    return x[at], at


def packed(x):
    """Each Q letters as one number."""
    import numpy as np

    w = x.astype("u8")
    w = w[:-1] | w[1:] << np.uint64(8)
    w = w[:-2] | w[2:] << np.uint64(16)
    return w[:-4] | w[4:] << np.uint64(32)


def slot(grams):
    import numpy as np

    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class Items:
    """A block of benchmark items with their q-gram index."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        import numpy as np

        self.ids, self.letters = [], []
        for i, text in items:
            x = stream(lowered(text).encode())[0]
            if len(x) >= LEAST_BYTES:
                self.ids.append(i)
                self.letters.append(x)
        m = np.array([len(x) for x in self.letters], "i8")
        self.edits = np.minimum((EDITS * m).astype("i8"), (m - Q) // Q)
        self.least = m - Q + 1 - self.edits * Q
        self.length = m
        self.longest = int(m.max()) if len(m) else 0
        grams = [packed(x) for x in self.letters]
        every = np.concatenate(grams) if grams else np.zeros(0, "u8")
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, "i8")
        # A q-gram's places in an item, those no more than edits + 1 apart taken together as (first, last).
        order = np.lexsort((place, item, every))
        every, item, place = every[order], item[order], place[order]
        opens = np.ones(len(every), "?")
        if len(every):
            opens[1:] = (every[1:] != every[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > self.edits[item[1:]] + 1)
        at = np.flatnonzero(opens)
        self.item, self.first, self.last = item[at], place[at], place[np.concatenate([at[1:] - 1, [len(every) - 1]])] if len(at) else place
        self.grams, self.starts, self.counts = np.unique(every[at], return_index=True, return_counts=True)
        self.table = np.zeros(1 << BITS, "?")
        self.table[slot(self.grams)] = True
        # Classes of items by length: the window that an occurrence fits in, and the least count in it.
        self.classes = []
        for low in (1.35**e for e in range(8, 200)):
            own = (m >= low) & (m < low * 1.35)
            if own.any():
                self.classes.append((int((m + self.edits)[own].max()), int(self.least[own].min())))
            if low > self.longest:
                break

    def bands(self, x):
        """(item, band) pairs of a stream whose counts reach the lemma's bound."""
        import numpy as np

        if len(x) < LEAST_BYTES or not self.longest:
            return []
        g = packed(x)
        seen = self.table[slot(g)]
        at = np.flatnonzero(seen)
        if not len(at):
            return []
        # A window that starts at one hit and has the least count in it ends at the hit that many places on.
        near = np.zeros(len(at) + 1, "i8")
        for window, least in self.classes:
            if len(at) >= least:
                dense = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < window)
                if len(dense):
                    ends = np.searchsorted(at, at[dense] + window)
                    np.add.at(near, dense, 1)
                    np.add.at(near, ends, -1)
        at = at[np.cumsum(near[:-1]) > 0]
        if not len(at):
            return []
        found = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        same = self.grams[found] == g[at]
        at, found = at[same], found[same]
        n = self.counts[found]
        span = (len(x) + 2 * self.longest) + 2
        keys, counts = np.zeros(0, "i8"), np.zeros(0, "i8")
        sums = np.cumsum(n)
        begin = 0
        while begin < len(at):  # in slices, and each of those by bands
            end = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + SLICE, "right")))
            own = n[begin:end]
            rows = np.repeat(self.starts[found[begin:end]] - np.cumsum(own) + own, own) + np.arange(own.sum())
            item = self.item[rows]
            width = self.edits[item] + 1
            places = np.repeat(at[begin:end], own) + self.longest
            low = np.maximum((places - self.last[rows]) // width - 1, 0)
            many = (places - self.first[rows]) // width - low + 1  # each band, and the one before, that one of its diagonals is in
            key = item * span + low
            done, total = 0, np.cumsum(many)
            parts = [(keys, counts)]
            while done < len(key):
                upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + SLICE, "right")))
                m = many[done:upto]
                parts.append(np.unique(np.repeat(key[done:upto] - np.cumsum(m) + m, m) + np.arange(m.sum()), return_counts=True))
                done = upto
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([c for _, c in parts]), minlength=len(keys)).astype("i8")
            begin = end
        ok = counts >= self.least[keys // span]
        return [(int(k // span), int(k % span)) for k in keys[ok]]

    def aligned(self, x, item: int, band: int):
        """(start, end, edits) of the best occurrence of the item on the band's diagonals of stream x, or None."""
        import numpy as np

        y, k = self.letters[item], int(self.edits[item])
        low = band * (k + 1) - self.longest - k  # the first diagonal of the band, with room for the alignment's own gaps
        high = low + 2 * (k + 1) + 2 * k
        lo, hi = max(0, low), min(len(x), high + len(y) + 1)
        if hi - lo < len(y) - k:
            return None
        where = x[lo:hi].tobytes().find(y.tobytes())
        if where >= 0:
            return lo + where, lo + where + len(y), 0
        # cost[d]: edits of the item's first i letters ending at text place i + low + d; free start and end in the text.
        width = high - low + 1
        d = np.arange(width)
        big = len(y) + width
        ends = low + d
        cost = np.where((ends >= 0) & (ends <= len(x)), 0, big)
        start = ends.copy()
        for i, c in enumerate(y, 1):
            ends = i + low + d
            inside = (ends >= 0) & (ends <= len(x))
            letter = x[np.clip(ends - 1, 0, len(x) - 1)]
            match = cost + ((letter != c) | (ends < 1))
            drop = np.concatenate([cost[1:], [big]]) + 1  # a letter of the item is missing in the text
            take = drop < match
            now = np.where(take, drop, match)
            source = np.where(take, np.concatenate([start[1:], [0]]), start)
            now = np.where(inside, now, big)
            run = np.minimum.accumulate(now - d)  # further letters in the text
            best = run + d
            moved = best < now
            if moved.any():
                origin = np.maximum.accumulate(np.where(now - d == run, d, 0))
                source = np.where(moved, source[origin], source)
            cost, start = np.where(inside, best, big), source
        at = int(cost.argmin())
        if cost[at] > k:
            return None
        return int(start[at]), len(y) + low + at, int(cost[at])

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) of items in a whole text, places in characters; the best of those that overlap."""
        data = lowered(text).encode()
        x, at = stream(data)
        reach = 2 * self.longest + Q
        best: dict[int, list[tuple[int, int, int]]] = {}
        for begin in range(0, max(1, len(x)), PIECE):
            part = x[max(0, begin - reach) : begin + PIECE]
            for item, band in self.bands(part):
                hit = self.aligned(part, item, band)
                if hit:
                    move = max(0, begin - reach)
                    best.setdefault(item, []).append((hit[2], hit[0] + move, hit[1] + move))
        if not best:
            return []
        import numpy as np

        heads = np.frombuffer(data, "u1") & 0xC0 != 0x80  # a character's first byte
        chars = np.cumsum(heads, dtype="i8")
        out = []
        for item, hits in best.items():
            taken: list[tuple[int, int]] = []
            for edits, s, e in sorted(set(hits)):
                i = bisect.bisect(taken, (s, e))
                if (i == 0 or taken[i - 1][1] <= s) and (i == len(taken) or e <= taken[i][0]):
                    taken.insert(i, (s, e))
                    out.append((self.ids[item], int(chars[at[s]]) - 1, int(chars[at[e - 1]]), edits))
        return sorted(out)

    def hits(self, found: list[str]) -> Iterator[int]:
        """The places of texts that may hold an item: texts are searched together, a gap between each two."""
        import numpy as np

        if not self.longest:
            return
        held: list[int] = []
        pieces, total = [], 0
        for n, text in enumerate(found):
            x = stream(lowered(text).encode())[0]
            if len(x) >= LEAST_BYTES:
                held.append(n)
                pieces += [x, np.zeros(self.longest + Q, "u1")]
                total += len(x) + self.longest + Q
            if pieces and (total >= PIECE or n == len(found) - 1):
                ends = np.cumsum([len(a) + len(b) for a, b in zip(pieces[::2], pieces[1::2])])
                starts = np.concatenate([[0], ends[:-1]])
                places = set()
                for item, band in self.bands(np.concatenate(pieces)):
                    k = int(self.edits[item])
                    low = band * (k + 1) - self.longest
                    a, b = np.searchsorted(ends, max(low, 0), "right"), np.searchsorted(starts, low + 2 * (k + 1) + self.length[item], "right")
                    places.update(range(int(a), min(int(b), len(held))))
                yield from (held[i] for i in sorted(places))
                held, pieces, total = [], [], 0


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of MOST_BYTES of text at most, so that neither driver nor workers hold more at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // (MOST_BYTES // 2)) or 1
    for b in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]


_READY: dict = {}


def _index(shared) -> Items:
    """The worker's index of a broadcast block."""
    if _READY.get("id") != shared.value[0]:
        _READY.update(id=shared.value[0], index=Items(shared.value[1]))
    return _READY["index"]


def _shared(df: DataFrame, items: list[tuple[int, str]]):
    import uuid

    return df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, items))


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits): benchmark items in documents (doc_id, text), places in characters. Narrow."""
    import pyarrow as pa

    short_batches(documents.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])
    own = documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text")
    found = None
    for items in blocks(benchmark):
        shared = _shared(documents, items)

        def run(batches, shared=shared):
            index = _index(shared)
            for batch in batches:
                ids, all_texts = batch.column(0).to_pylist(), texts(batch, "text")
                yield from batches_of(((ids[n], *hit) for n in index.hits(all_texts) for hit in index.find(all_texts[n])), out)

        one = own.mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")
        found = one if found is None else found.unionByName(one)
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they are. Narrow."""
    import pyarrow as pa

    short_batches(documents.sparkSession)
    for items in blocks(benchmark):
        shared = _shared(documents, items)

        def run(batches, shared=shared):
            index = _index(shared)
            for batch in batches:
                all_texts = texts(batch, "text")
                bad = {n for n in index.hits(all_texts) if index.find(all_texts[n])}
                yield batch.filter(pa.array([n not in bad for n in range(len(all_texts))])) if bad else batch

        documents = documents.mapInArrow(run, documents.schema)
    return documents
