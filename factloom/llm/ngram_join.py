"""N-gram Jaccard join: a count-vector R-tree over groups of hashed shingles, with exact verification.

A document's set is that of its distinct word shingles. Documents with the same set form a class; one of each class, its least
doc_id, goes on. Each class is routed by keys of its set, of which two sets that link share one:

* band signatures (minima under ROWS hash functions each; the number of bands is set by the threshold, so that a pair at the threshold
  shares none with probability MISS at most, and a closer pair less), or
* with exact=True, the set's prefix: its n - ceil(t n) + 1 least hashes, of which two sets of similarity t have one in common, always.

Classes that share a key are chained, and the chains' connected components are joined independently:

* shingles are hashed into groups; a set's point is the vector of its group counts,
* points are packed into an R-tree, whose nodes hold the maxima of their points' coordinates and their least set size,
* the overlap of two sets is at most the sum of the coordinate minima of their points, or of a point and a node: a branch below
  the overlap that the threshold asks for is left out,
* pairs that survive are verified on the sets themselves, unless links that were found already join the two.

So every link is found or implied by others, and a component yields fewer links than it has members. A component of more than
MOST_SHINGLES shingles is no task of its own. Its chained neighbours are verified first: where those links join it, as in a large group
of copies with few edits, it is done. Else its members are dealt to groups by the shingles of their prefixes, the rarest of the component
first: sets that differ in more than the threshold allows do so in their rare shingles, so that a large family of texts that are only
alike falls apart. Each group has an R-tree of its own, in cells of MOST_POINTS points at most; pairs whose points survive and that are
not joined yet are verified on the sets. No pair is lost: two sets that link share a shingle of their prefixes in any common order.

Defined results: null and empty texts, and texts without words, have no shingles and link with nothing; rows with a null doc_id link
with nothing and get a null component; repeated rows and equal texts are one class; of different
texts under one doc_id each has its own row and set size, and one of them stands for the id in links; ties in size or signature are all kept; texts are
read whole at any length; an empty table gives no rows; further columns are ignored (join_components) or kept (one_of_each).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, components, discard, give_back, mixed, neighbours, short_batches, shingle_hashes, skew_join, texts, written

ROWS = 4
MISS = 1e-8
#: Shingles of a component that is one task at most (a single document may have more).
MOST_SHINGLES = 1 << 19
#: Points of a group's cell.
MOST_POINTS = 1 << 13
#: Groups of hashed shingles: the dimensions of the points.
GROUPS = 128
#: Points in a leaf and leaves in a node.
FANOUT = 32


def bands_for(threshold: float) -> int:
    """The least number of bands that misses a pair at the threshold with probability MISS or less."""
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**ROWS)))


def shingle_set(text: str, k: int):
    """The sorted distinct shingle hashes of a whole text."""
    import numpy as np

    return np.unique(shingle_hashes(text, k))


def band_keys(own, bands: int):
    """One key for each band: the set's minima under ROWS hash functions, mixed with the band's number."""
    import numpy as np

    draws = mixed(np.arange(1, bands * ROWS + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    step = max(1, (1 << 19) // len(own))  # functions at once: bounded memory for a long text
    low = np.concatenate([(own * draws[i : i + step, None]).min(axis=1) for i in range(0, len(draws), step)]).reshape(bands, ROWS)
    keys = np.arange(bands, dtype="u8")
    for i in range(ROWS):
        keys = mixed(keys + low[:, i])
    return keys.view("i8")


def prefix_keys(own, num: int, den: int):
    """The least hashes of a set, as many as a set that links with it must share one of: its size less the least overlap, and one."""
    import numpy as np

    n = len(own)
    return np.sort(mixed(own))[: n + (-n * num) // den + 1].view("i8")


def profiles(documents: DataFrame, k: int, num: int, den: int, exact: bool = False) -> DataFrame:
    """(doc_id, n, d1, d2, keys): set size, digest of the set in two halves, and the keys that route it."""
    import pyarrow as pa

    bands = bands_for(num / den)
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def rows(batches):
        import numpy as np
        import xxhash

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                own = shingle_set(t, k)
                if not len(own):
                    yield i, 0, None, None, None
                    continue
                d1, d2 = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "i8")
                yield i, len(own), int(d1), int(d2), prefix_keys(own, num, den) if exact else band_keys(own, bands)

    def run(batches):
        yield from batches_of(rows(batches), out, 500)
        give_back()

    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, keys array<long>")


class Tree:
    """An R-tree over count vectors, packed in order of set size: two levels of nodes over the points."""

    def __init__(self, points, sizes) -> None:
        import numpy as np

        self.order = np.argsort(sizes, kind="stable")
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        at, least, most = self.points, self.sizes, self.sizes
        while len(at) > FANOUT:
            starts = np.arange(0, len(at), FANOUT)
            at = np.maximum.reduceat(at, starts)
            least, most = np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)
            self.levels.append((at, least, most))

    def search(self, point, size: int, num: int, den: int):
        """Points (their places) whose overlap bound with the query reaches the threshold num/den, best bound first."""
        import numpy as np

        own = None  # nodes of the level above that survive
        for vectors, least, most in [*reversed(self.levels), (self.points, self.sizes, self.sizes)]:
            if own is None:
                at = np.arange(len(vectors))
            else:
                at = (own[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(vectors)]
            # Set sizes within the threshold of each other, and overlap >= num / (num + den) of the sizes' sum.
            at = at[(den * least[at] * num <= den * den * size) & (den * most[at] >= num * size)]
            if not len(at):
                return at
            bound = np.minimum(vectors[at], point).sum(axis=1, dtype="i8")
            fits = (num + den) * bound >= num * (size + least[at])
            at, bound = at[fits], bound[fits]
            own = at
        return self.order[at[np.argsort(-bound, kind="stable")]]


def overlaps(a, b, num: int, den: int) -> bool:
    """Whether two sorted sets link."""
    import numpy as np

    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    shared = int((large[at] == small).sum())
    return den * shared >= num * (len(a) + len(b) - shared)


def points_of(sets: list):
    """The count vectors of sets, in as few bytes as their counts need."""
    import numpy as np

    points = np.zeros((len(sets), GROUPS), "u4")
    for i, s in enumerate(sets):
        points[i] = np.bincount((s >> np.uint64(40)) % np.uint64(GROUPS), minlength=GROUPS)
    return _narrow(points)


def _narrow(points):
    most = points.max(initial=0)
    return points.astype("u1" if most < 256 else "u2" if most < 65536 else "u4")


def linked(sets: list, ids: list[int], num: int, den: int):
    """Links (a, b) that join all that the threshold joins among sets; fewer than sets."""
    import numpy as np

    n = len(sets)
    points = points_of(sets)
    sizes = np.array([len(s) for s in sets], "i8")
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree = Tree(points, sizes)
    for i in np.argsort(sizes, kind="stable"):
        for p in tree.search(points[i], int(sizes[i]), num, den):
            j = int(p)
            if j == i or (sizes[j], j) > (sizes[i], i):
                continue
            a, b = root(int(i)), root(j)
            if a != b and overlaps(sets[i], sets[j], num, den):
                parent[a] = b
                yield ids[i], ids[j]


def surviving(points, sizes, ids, parts, sides, num: int, den: int):
    """Pairs (a, b) of different parts whose points may link: among all, or between side 0 and side 1."""
    import numpy as np

    whole = sides[0] < 0
    indexed = np.arange(len(ids)) if whole else np.flatnonzero(sides == 0)
    asked = np.arange(len(ids)) if whole else np.flatnonzero(sides == 1)
    if not len(indexed) or len(np.unique(parts)) < 2:
        return
    tree = Tree(points[indexed], sizes[indexed])
    for i in asked:
        found = indexed[tree.search(points[i], int(sizes[i]), num, den)]
        for j in found[(parts[found] != parts[i]) & ((found < i) if whole else (ids[found] != ids[i]))]:
            yield (int(ids[i]), int(ids[j])) if ids[i] < ids[j] else (int(ids[j]), int(ids[i]))


def _all(left, right):
    return slice(None), []


def set_rows(documents: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(doc_id, own): the sorted shingle hashes of the documents among members, each document once."""
    import pyarrow as pa

    out = pa.schema([("doc_id", pa.int64()), ("own", pa.list_(pa.int64()))])

    def rows(batches):
        last = None
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                if i != last:  # rows come in order of doc_id from the join
                    last = i
                    yield i, shingle_set(t, k).view("i8")

    def run(batches):
        yield from batches_of(rows(batches), out, 200)

    # Texts meet their members by merge at every size: few members would be broadcast, and the plan would change as the input grows.
    known = documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text")
    return known.hint("merge").join(members.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(run, "doc_id long, own array<long>")


def _sets(batch, name: str):
    """A column of hash arrays as unsigned arrays."""
    column = batch.column(name)
    values, at = column.values.to_numpy(zero_copy_only=False).view("u8"), column.offsets.to_pylist()
    return [values[a:b] for a, b in zip(at, at[1:])]


def links(sets: DataFrame, tasks: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links (a, b) within each task (doc_id, task). A worker holds the sets of one task at a time."""
    import pyarrow as pa

    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows(batches):
        at, ids, held = None, [], []
        for batch in batches:
            for task, i, own in zip(batch.column("task").to_pylist(), batch.column("doc_id").to_pylist(), _sets(batch, "own")):
                if task != at:
                    if len(ids) > 1:
                        yield from linked(held, ids, num, den)
                    at, ids, held = task, [], []
                ids.append(i)
                held.append(own)
        if len(ids) > 1:
            yield from linked(held, ids, num, den)

    def run(batches):
        yield from batches_of(rows(batches), out)

    return tasks.join(sets.hint("merge"), "doc_id").repartition("task").sortWithinPartitions("task", "doc_id").mapInArrow(run, "a long, b long")


def verified(sets: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b) that are links, those that join what a task's earlier ones have not: fewer than documents for each task, however
    many links a family has."""
    import pyarrow as pa

    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        parent: dict[int, int] = {}

        def root(i):
            while parent.setdefault(i, i) != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for batch in batches:
            keep = []
            for a, b, x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), _sets(batch, "x"), _sets(batch, "y")):
                u, v = root(a), root(b)
                keep.append(u != v and overlaps(x, y, num, den))
                if keep[-1]:
                    parent[u] = v
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], schema=out)

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("own").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _best(chained: DataFrame) -> DataFrame:
    """For each row that follows another in some chain, the one (a) that it follows most often."""
    met = chained.groupBy("a", "b").agg(F.count("*").alias("n"))
    return met.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")


def prefix_groups(sets: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(key, doc_id): for each of members (doc_id, n, component) the shingles of its prefix that another member's has, too. Shingles are in
    order of the number of members of the component that have them; a prefix is as long as two linked sets need to share one."""
    key = F.xxhash64("component", "token")
    rows = written(members.select("doc_id", "component").join(sets, "doc_id").select("doc_id", "component", F.explode("own").alias("token")).select(key.alias("key"), "doc_id"), "tokens", 64)
    often = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = skew_join(rows, often.withColumn("df", F.col("n")), "key", rows.count())
    own = Window.partitionBy("doc_id")
    sized = shared.join(members.select("doc_id", "n"), "doc_id").withColumn("place", F.row_number().over(own.orderBy("df", "key"))).withColumn("held", F.count("*").over(own))
    # Shingles that no other member has come first in the order; they fill the prefix without a partner.
    room = F.col("n") - F.ceil(F.col("n") * num / den) + 1 - (F.col("n") - F.col("held"))
    kept = written(sized.where(F.col("place") <= room).select("key", "doc_id"), "prefixes", 4096)
    discard(rows)
    return kept


def candidates(sets: DataFrame, members: DataFrame, kept: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of different parts that share a prefix shingle and whose points survive: an R-tree for each shingle's group, cut
    into cells of MOST_POINTS points, each pair of which is a task."""
    import pyarrow as pa

    made = pa.schema([("doc_id", pa.int64()), ("point", pa.binary())])
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def points(batches):
        for batch in batches:
            held = _sets(batch, "own")
            rows = [points_of([x])[0].astype("u4").tobytes() for x in held]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], schema=made)

    def pairs(batches):
        import numpy as np

        def joined(held):
            ids, sizes, parts, sides, raw = zip(*held)
            vectors = _narrow(np.frombuffer(b"".join(raw), "u4").reshape(len(raw), GROUPS))
            yield from surviving(vectors, np.array(sizes, "i8"), np.array(ids, "i8"), np.array(parts, "i8"), np.array(sides, "i4"), num, den)

        at, held = None, []
        for batch in batches:
            for task, *row in zip(*(batch.column(c).to_pylist() for c in ("task", "doc_id", "n", "part", "side", "point"))):
                if task != at:
                    if len(held) > 1:
                        yield from joined(held)
                    at, held = task, []
                held.append(row)
        if len(held) > 1:
            yield from joined(held)

    def run(batches):
        yield from batches_of(pairs(batches), out)

    sizes = kept.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = skew_join(kept, sizes.withColumn("k", F.ceil(F.col("n") / MOST_POINTS).cast("int")), "key", kept.count())
    cell = F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int")
    task = lambda s, o: F.struct(F.concat_ws(":", "key", F.least(s, o), F.greatest(s, o)).alias("task"), F.when(s == o, -1).when(s < o, 0).otherwise(1).alias("side"))
    tasks = dealt.withColumn("s", cell).select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda o: task(F.col("s"), o))).alias("t")).select("doc_id", "t.task", "t.side")
    vectors = sets.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(points, "doc_id long, point binary")
    met = tasks.join(members.select("doc_id", "n", "part").join(vectors, "doc_id"), "doc_id")
    return met.repartition("task").sortWithinPartitions("task", "doc_id").mapInArrow(run, "a long, b long").distinct()


def large_links(sets: DataFrame, members: DataFrame, chained: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Tables of links that join what the threshold joins within components (doc_id, n, component) that are too large for a task."""
    own = written(sets.join(members.select("doc_id"), "doc_id", "left_semi"), "sets", 64)
    first = written(verified(own, _best(chained.join(members.select(F.col("doc_id").alias("b")), "b", "left_semi")), num, den), "links")
    reached = components(first)
    parts = members.join(reached.select(F.col("id").alias("doc_id"), F.col("component").alias("part")), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    open_ = parts.groupBy("component").agg(F.countDistinct("part").alias("parts")).where("parts > 1")
    rest = written(parts.join(open_, "component", "left_semi").select("doc_id", "n", "component", "part"), "parts")
    found = [first]
    if not rest.isEmpty():
        kept = prefix_groups(own, rest, num, den)
        pairs = written(candidates(own, rest, kept, num, den), "candidates", 64)
        found.append(written(verified(own, pairs, num, den), "links", 64))
        discard(kept, pairs)
    discard(own, reached, rest)
    return found


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def join_components(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for each row of documents (doc_id, text).

    Two documents link when den * intersection >= num * union of their k-word shingle sets. class_id: the least doc_id with the same
    set; component_id: the least doc_id that links reach, its own included. exact: route by prefixes, which miss no pair at all, in
    place of signatures, which miss one with probability MISS; each costs keys in proportion to the set.
    """
    short_batches(documents.sparkSession)
    seen = written(profiles(documents, k, num, den, exact), "profiles")
    known = seen.where("n > 0 and doc_id is not null")
    classes = written(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.min("n").alias("size")), "classes")
    signed = known.join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key"))
    chained = neighbours(signed, [], [], _all, "chains")
    joined = components(chained.select("a", "b"))
    members = joined.select(F.col("id").alias("doc_id"), "component").join(classes.select(F.col("class_id").alias("doc_id"), F.col("size").alias("n")), "doc_id")
    members = written(members.select("doc_id", "n", "component"), "members")
    sets = written(set_rows(documents, members, k), "sets", 64)
    whole = members.groupBy("component").agg(F.sum("n").alias("all"))
    small = members.join(whole.where(F.col("all") <= MOST_SHINGLES), "component", "left_semi")
    large = members.join(whole.where(F.col("all") > MOST_SHINGLES), "component", "left_semi")
    found = [written(links(sets, small.select("doc_id", F.col("component").alias("task")), num, den), "links", 64)]
    if not large.isEmpty():
        large = written(large, "large")
        found += large_links(sets, large, chained, num, den)
        discard(large)
    reached = components(_union(found))
    discard(chained, joined, members, sets, *found)
    to = classes.join(reached.withColumnRenamed("id", "class_id"), "class_id", "left").select("d1", "d2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    linked_rows = known.select("doc_id", "n", "d1", "d2").join(to, ["d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    rest = seen.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(rest)


def one_of_each(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that link, directly or through others, to one with a smaller doc_id; all columns kept."""
    gone = join_components(documents, k, num, den).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, documents["doc_id"].cast("long") == gone["_gone"], "left_anti")
