"""Hard negatives by a two-dimensional block matrix product: partial score tiles by dimension chunk, added by shuffle, reduced by window.

Rows and anchors are numbered in order of (label, id) and packed into blocks, each cut into chunks of dimensions. The product of anchors
and rows is dealt as a grid of cells (group of row blocks, group of anchor blocks). A cell holds its anchors and streams its rows, and
yields for each pair of blocks and chunk a tile of partial scores. Tiles of a pair are added over the chunks in 64-bit integers where they
arise, so that blocks are shuffled and tiles never are; each leaves only the best entries of its anchors behind, which a ranking within
the anchor merges. The first product, over blocks that share a label, gives each anchor its positives; the second, over the others, the
negatives inside the window of each positive's score. Scores are inner products of integers, exact: doubles multiply where they hold them
exactly, longs elsewhere.

No block, cell, tile or list of candidates grows with a label: a hot one has more blocks. Anchors are a stated query set; the number of
tiles is that of anchors times rows by contract, that of shuffled blocks the rows once for each HELD bytes of anchors, and the anchors once
for each group of rows.

Defined results: rows without id, label or vector, or with an entry that is null or not finite, take no part. Rows that repeat an id are
rows of their own, and "other rows" are all but the row itself; ties go by id, and by place in the input where ids are equal. Shorter
vectors count as filled with zeros. An empty table, or one without anchors, gives no rows. Scores that 64 bits can't hold raise an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written
from .vectors import EXACT_DOUBLE, EXACT_LONG, is_finite, largest, matrix, scaled, widest

#: Rows and anchors in a block, dimensions in a chunk. A tile has ROWS * ANCHORS scores.
ROWS, ANCHORS, CHUNK = 1024, 256, 32
#: Blocks of either in a cell at most; bytes of anchors that a cell holds, as 64-bit integers; groups of rows, if there are as many blocks.
ROW_BLOCKS, ANCHOR_BLOCKS, HELD, GROUPS = 64, 128, 16 << 20, 48
#: Blocks and tiles are large rows, so that few of them are one Arrow batch.
BATCH = 8
#: Stands for no score.
NONE = -EXACT_LONG


def _numbered(df: DataFrame, name: str, *order: str, number: str = "place") -> DataFrame:
    """The table, written in order, with each row's number among all rows. The driver gets one count for each task."""
    out = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name, 4096)
    part, offset, offsets = F.shiftright("_at", 33), 0, []
    for r in out.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], offset))
        offset += r["count"]
    starts = out.sparkSession.createDataFrame(offsets, "_part long, _start long")
    kept = out.join(F.broadcast(starts), part == F.col("_part")).withColumn(number, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start")
    kept._factloom_path = out._factloom_path
    return kept


def _narrow(x):
    """Integers as they travel: in 16 or 32 bits where these hold them."""
    most = largest(x)
    return x.astype("i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "i8")


def _wide(x: bytes, n: int, columns: int):
    """The rows of a block's chunk, as _narrow has left them."""
    import numpy as np

    return np.frombuffer(x, f"i{len(x) // (n * columns) if columns else 8}").reshape(n, columns).astype("i8")


def _packed(df: DataFrame, size: int, width: int, name: str) -> DataFrame:
    """Blocks of `size` rows (vec_id, label, x, place, number), numbered by `number`: a row for each block and chunk. A block's rows lie in
    order of (vec_id, place). The first chunk carries the ids, labels and places."""
    import pyarrow as pa

    schema = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), *((c, pa.binary()) for c in ("ids", "labels", "places", "x"))])

    def run(batches):
        import numpy as np

        held: list = []

        def blocks(last: bool):
            """Whole blocks of what is held, with the last one at the end."""
            nonlocal held
            own = [np.concatenate(x) for x in zip(*held)]
            cuts = np.flatnonzero(np.diff(own[0])) + 1
            stops = [*cuts, len(own[0])] if last else [*cuts]
            begin = 0
            for stop in stops:
                block, ids, labels, places, x = (y[begin:stop] for y in own)
                begin = stop
                for c in range(max(1, -(-width // CHUNK))):
                    meta = [y.tobytes() for y in (ids, labels, places)] if c == 0 else [None] * 3
                    part = _narrow(x[:, c * CHUNK : (c + 1) * CHUNK]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((block[0], c, labels.min(), labels.max(), *meta, part), schema)], schema=schema)
            held = [] if last else [[y[begin:] for y in own]]

        for batch in batches:
            if batch.num_rows:
                held.append([*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "vec_id", "label", "place")), matrix(batch.column("x"), width)])
                yield from blocks(False)
        if held:
            yield from blocks(True)

    rows = df.select(F.floor(F.col("number") / size).alias("block"), "vec_id", "label", "place", "x").repartition("block").sortWithinPartitions("block", "vec_id", "place")
    return written(rows.mapInArrow(run, "block long, chunk int, low long, high long, ids binary, labels binary, places binary, x binary"), name, ROWS)


#: What a cell reads of either side.
_SIDE = ["block", "chunk", "low", "high", "ids", "labels", "places", "x", "targets", "i", "j"]
_KINDS = {"long": "int64", "int": "int32", "binary": "binary"}


def _schema(ddl: str):
    import pyarrow as pa

    return pa.schema([(name, getattr(pa, _KINDS[kind])()) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _row(schema, cells):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(cells, schema)], schema=schema)


def _best(scores, ids, places, take: int):
    """The `take` best entries of each row, by score, then by id and place: arrays of the three."""
    import numpy as np

    order = np.lexsort((places, ids, -scores), axis=-1)[:, :take]
    return tuple(np.take_along_axis(x, order, 1) for x in (scores, ids, places))


def _reduced(rows: DataFrame, anchors: DataFrame, width: int, cells: int, take: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """Scores of the blocks with their cells (i, j), added over their chunks and reduced to the best entries of each anchor, merged within
    a task: (anchor, anchor_id, target, target_id, target_score, id, place, score). Without low and high: other rows of the anchor's label,
    one target, itself. With them: rows of another label, for each target of the anchor, between low and high hundredths of the target's
    score."""
    ddl = "anchor long, anchor_id long, target int, target_id long, target_score long, id long, place long, score long"
    chunk = CHUNK

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = _schema(ddl)
        names = [f.name for f in schema]

        def longs(x):
            return np.frombuffer(x or b"", "i8")

        class Block:
            """A block of either side: what its first chunk carries, and (chunk, largest entry) of all chunks."""

            def __init__(self, r) -> None:
                self.block, self.low, self.high, self.parts, self.best = r["block"], r["low"], r["high"], [], None
                self.ids, self.labels, self.places = (longs(r[c]) for c in ("ids", "labels", "places"))
                if low is None:
                    self.t_ids, self.t_scores = self.ids[:, None], np.zeros((len(self.ids), 1), "i8")
                elif r["side"] == 0:
                    self.t_ids, self.t_scores = longs(r["targets"]).reshape(2, len(self.ids), -1)

            def add(self, r) -> None:
                x = _wide(r["x"], r["n"], min(chunk, width - r["chunk"] * chunk))
                self.parts.append((x, largest(x)))

        def product(a, r):
            """The scores of two blocks: the tiles of their chunks, added."""
            total = np.zeros((len(a.ids), len(r.ids)), "i8")
            for (y, other), (x, most) in zip(a.parts, r.parts):
                bound = most * other * max(1, width)
                if bound >= EXACT_LONG:
                    raise ArithmeticError("scores of these vectors exceed 64 bits")
                total += (y.astype("f8") @ x.T.astype("f8")).astype("i8") if bound < EXACT_DOUBLE else y @ x.T
            return total

        def reduce(a, r) -> None:
            """Merge the scores of two blocks into the best entries of the anchors."""
            if (a.low > r.high or a.high < r.low) if low is None else a.low == a.high == r.low == r.high:
                return
            total = product(a, r)
            same = a.labels[:, None] == r.labels[None, :]
            if low is None:
                masks = [same & (a.places[:, None] != r.places[None, :])]
            else:
                least = lambda p: p // 100 * low - (-(p % 100 * low) // 100)
                most = lambda p: p // 100 * high + p % 100 * high // 100
                masks = [~same & (total >= least(p)) & (total <= most(p)) & (p > NONE) for p in (a.t_scores[:, k : k + 1] for k in range(a.t_scores.shape[1]))]
            if a.best is None:
                empty = lambda: np.zeros((len(a.ids), take), "i8")
                a.best = [(empty() + NONE, empty(), empty()) for _ in masks]
            for k, mask in enumerate(masks):
                hit = np.flatnonzero(mask.any(1))
                if not len(hit):
                    continue
                left, found = np.where(mask[hit], total[hit], NONE), []
                lines = np.arange(len(hit))
                for _ in range(min(take, left.shape[1])):  # the first of equal ones is that of least id and place
                    col = left.argmax(1)
                    found.append((left[lines, col], r.ids[col], r.places[col]))
                    left[lines, col] = NONE
                merged = [np.concatenate([b[hit], np.stack(f, 1)], 1) for b, f in zip(a.best[k], zip(*found))]
                for b, m in zip(a.best[k], _best(*merged, take)):
                    b[hit] = m

        def out(a):
            """The best entries of an anchor block's anchors."""
            for k, found in enumerate(a.best or ()):
                at, col = np.nonzero(found[0] > NONE)
                if len(at):
                    kept = [x[at, col] for x in found]
                    columns = {"anchor": a.places[at], "anchor_id": a.ids[at], "target": np.full(len(at), k, "i4"), "target_id": a.t_ids[at, k], "target_score": a.t_scores[at, k], "score": kept[0], "id": kept[1], "place": kept[2]}
                    yield pa.RecordBatch.from_arrays([pa.array(columns[c], f.type) for c, f in zip(names, schema)], schema=schema)

        cell, held, row = None, {}, None

        def met() -> None:
            """The row block that is whole meets the cell's anchors."""
            nonlocal row
            if row is not None:
                for a in held.values():
                    reduce(a, row)
            row = None

        for batch in batches:
            for r in batch.to_pylist():
                if (r["j"], r["i"]) != cell:
                    met()
                    if cell is None or r["j"] != cell[0]:  # cells of the same anchors follow one another, and add to the same best entries
                        for a in held.values():
                            yield from out(a)
                        held = {}
                    cell, fresh = (r["j"], r["i"]), not held
                if r["side"] == 0:
                    if not fresh:
                        continue
                    if r["chunk"] == 0:
                        held[r["block"]] = Block(r)
                    held[r["block"]].add(r)
                    continue
                if r["chunk"] == 0:
                    met()
                    row = Block(r)
                row.add(r)
        met()
        for a in held.values():
            yield from out(a)

    both = anchors.select(*_SIDE, "n", F.lit(0).alias("side")).unionByName(rows.select(*_SIDE, "n", F.lit(1).alias("side")))
    dealt = both.repartition(_tasks(rows.sparkSession, cells), "i", "j").sortWithinPartitions("j", "i", "side", "block", "chunk")
    ranked = dealt.mapInArrow(run, ddl).withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "target").orderBy(F.desc("score"), "id", "place")))
    return ranked.where(F.col("rank") <= take)


def _tasks(spark, most: int) -> int:
    return max(1, min(most, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _with_targets(anchors: DataFrame, positives: DataFrame, most: int) -> DataFrame:
    """Anchor blocks whose first chunk carries the anchors' positives: ids, then scores, `most` for each anchor. A block has ANCHORS of them."""
    columns = [c for c in _SIDE if c not in ("targets", "i")] + ["n"]
    own = positives.groupBy("block").agg(F.collect_list(F.struct("anchor", "rank", "id", "score")).alias("own"))
    joined = anchors.where("chunk = 0").join(own, "block", "left").select(*columns, "own")
    kinds = {"block": "long", "chunk": "int", "low": "long", "high": "long", "j": "long", "n": "int"}
    ddl = ", ".join(f"{c} {kinds.get(c, 'binary')}" for c in [*columns, "targets"])

    def run(batches):
        import numpy as np

        schema = _schema(ddl)
        for batch in batches:
            for r in batch.to_pylist():
                at = {p: k for k, p in enumerate(np.frombuffer(r["places"], "i8").tolist())}
                targets = np.full((2, r["n"], most), NONE, "i8")
                for x in r["own"] or ():
                    targets[:, at[x["anchor"]], x["rank"] - 1] = x["id"], x["score"]
                yield _row(schema, [*(r[c] for c in columns), targets.tobytes()])

    return joined.mapInArrow(run, ddl).unionByName(anchors.where("chunk > 0").select(*columns, F.lit(None).cast("binary").alias("targets")))


def mine(df: DataFrame, anchor: Column, low: int = 50, high: int = 95, positives: int = 5, negatives: int = 3, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (vec_id, embedding, label).

    anchor: which rows are anchors. Each has as positives its `positives` best other rows of its label; each anchor and positive gets the
    `negatives` best rows of other labels whose score is between low and high hundredths of the positive's."""
    vector, given = df["embedding"], F.coalesce(anchor, F.lit(False))
    rows = df.where(df["vec_id"].isNotNull() & df["label"].isNotNull() & is_finite(vector))
    rows = rows.select(df["vec_id"].cast("long").alias("vec_id"), df["label"].cast("long").alias("label"), given.alias("anchor"), scaled(vector, scale).alias("x")).withColumn("row", F.monotonically_increasing_id())
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    held = _numbered(rows, "rows", "label", "vec_id", "row")
    chosen = _numbered(held.where("anchor").select("vec_id", "label", "x", "place"), "anchors", "label", "vec_id", "place", number="number")
    held = held.withColumn("number", F.col("place"))
    n, m, width = held.count(), chosen.count(), widest(held, "x")
    if not m:
        discard(held, chosen)
        return df.sparkSession.createDataFrame([], out)
    all_rows, all_anchors = _packed(held, ROWS, width, "row-blocks"), _packed(chosen, ANCHORS, width, "anchor-blocks")
    size = (F.octet_length("ids") / 8).cast("int")
    counts = lambda b: b.where("chunk = 0").select("block", size.alias("n"))
    row_blocks, anchor_blocks = -(-n // ROWS), -(-m // ANCHORS)
    by_row, by_anchor = min(ROW_BLOCKS, max(1, row_blocks // GROUPS)), min(ANCHOR_BLOCKS, max(1, HELD // (8 * ANCHORS * max(1, width))))
    row_cells, anchor_cells = -(-row_blocks // by_row), -(-anchor_blocks // by_anchor)
    row_side = all_rows.join(counts(all_rows), "block").withColumn("i", F.floor(F.col("block") / by_row)).withColumn("targets", F.lit(None).cast("binary"))
    anchor_side = all_anchors.join(counts(all_anchors), "block").withColumn("j", F.floor(F.col("block") / by_anchor))

    # Positives: cells whose groups have a label in common.
    of = lambda t, group, name: t.select(F.floor(F.col("number") / group).alias(name), "label").distinct()
    cells = of(held, ROWS * by_row, "i").join(of(chosen, ANCHORS * by_anchor, "j"), "label").select("i", "j").distinct()
    cells = written(cells, "cells", 4096)
    no_targets = anchor_side.withColumn("targets", F.lit(None).cast("binary"))
    near = _reduced(row_side.join(cells, "i"), no_targets.join(cells, "j"), width, row_cells * anchor_cells, positives)
    near = near.join(chosen.select(F.col("place").alias("anchor"), F.floor(F.col("number") / ANCHORS).alias("block")), "anchor")
    with_targets = written(_with_targets(anchor_side, near, positives), "targets", BATCH)

    # Negatives: all cells.
    spread_rows = row_side.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(anchor_cells - 1).cast("long"))))
    spread_anchors = with_targets.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_cells - 1).cast("long"))))
    far = _reduced(spread_rows, spread_anchors, width, row_cells * anchor_cells, negatives, low, high)
    found = far.select("anchor_id", F.col("target_id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("target_score").alias("positive_score"), F.col("score").alias("negative_score"))
    result = written(found, "negatives", BATCH)
    discard(held, chosen, all_rows, all_anchors, cells, with_targets)
    return result
