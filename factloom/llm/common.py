"""Shared plumbing of the subpackage: reading tables, cutting lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python; texts may be long, so batches stay short.
BATCH_ROWS = 256

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Lower-cases A-Z only.
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """A column name like the given one that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, so that a Python worker holds few long texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (local tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and lost executors cost no recomputation.

    batch_rows: rows in the Arrow batches of this step; steps over short rows take more."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    path = f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_factloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: A key with more than this many rows, and more than a 500th of all, is hot.
HOT_ROWS = 1000


def skew_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of table, which has each key once with the number n of its rows; n goes. total: the sum of n, or more.

    Hot keys, 500 at most by their definition, are broadcast, so that their rows stay where they are; all others meet by shuffle."""
    hot, own = F.col("n") > max(HOT_ROWS, total // 500), table.drop("n")
    if total <= HOT_ROWS or table.where(hot).isEmpty():  # a plan of one join, where it does
        return rows.join(own.hint("merge"), key)
    few = F.broadcast(table.where(hot).drop("n"))
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(rest.join(table.where(~hot).select(own.columns).hint("merge"), key))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components: edges (a, b) of longs to (id, component), component being the least id that can be reached.

    Alternating large-star and small-star steps, so that rounds grow with the logarithm of the component size. A step needs only the
    minimum of a vertex's neighbours and one output row for each edge; the edges of vertices with very many are not dealt by vertex.
    Each round is written to the shared folder. Self-links, repeated and mirrored edges are allowed; no edges give no rows. Raises
    after `most_rounds` rounds without a fixed point.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    total = now.count()
    for _ in range(most_rounds):
        # Large star: each neighbour above u goes to the least of u and its neighbours.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = written(skew_join(both, least, "a", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        # Small star: u's neighbours below it, and u itself, go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = skew_join(large, low, "a", total).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        after = written(small.where("a <> b").distinct(), "edges")
        discard(now, large)
        now, total = after, after.count()
        # Stars are the fixed point: each vertex is under one other, which is under none.
        ends = now.select("a", F.lit(1).alias("under"), F.lit(0).alias("over")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).alias("under"), F.lit(1).alias("over")))
        if ends.groupBy("a").agg(F.sum("under").alias("under"), F.max("over").alias("over")).where("under > 1 or under = 1 and over = 1").isEmpty():
            break
    else:
        raise RuntimeError("components: no fixed point")
    out = now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
    out._factloom_path = now._factloom_path
    return out


def texts(batch, column: str) -> list[str]:
    """A string column of an Arrow batch as Python strings, null as the empty string."""
    return [x or "" for x in batch.column(column).to_pylist()]


def batches_of(rows: Iterator[tuple], schema, size: int = 2000):
    """Pack row tuples into Arrow batches of a schema."""
    import pyarrow as pa

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def give_back() -> None:
    """Return what a finished task's batches held to the system: workers live on, and their memory counts with the executor's."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()


#: Bytes that are hashed at once, and powers that a worker keeps.
BLOCK = 1 << 16
_KEPT: dict = {}


def powers(n: int):
    """The first n powers of an odd base and of its inverse modulo 2^64. Those up to BLOCK are kept, longer runs are not."""
    import numpy as np

    if n > BLOCK + 1 or "up" not in _KEPT:
        base = 0x9E3779B97F4A7C15
        made = []
        for x in (base, pow(base, -1, 1 << 64)):
            run = np.full(max(n, BLOCK + 1), x, "u8")
            run[0] = 1
            made.append(np.multiply.accumulate(run))
        if n > BLOCK + 1:
            return made
        _KEPT["up"], _KEPT["down"] = made
    return _KEPT["up"], _KEPT["down"]


def _bytes():
    """Whether a byte is white space, and a random number for each byte, those of A-Z being those of a-z."""
    import numpy as np

    if "space" not in _KEPT:
        space = np.zeros(256, "?")
        space[[9, 10, 11, 12, 13, 32]] = True
        code = mixed(np.arange(1, 257, dtype="u8") * np.uint64(0xD1B54A32D192ED03))
        code[65:91] = code[97:123]
        _KEPT["code"] = code
        _KEPT["space"] = space
    return _KEPT["space"], _KEPT["code"]


def word_hashes(text: str):
    """A 64-bit hash of each word of a text, A-Z lower-cased, the same on all machines.

    A polynomial over the word's bytes modulo 2^64, taken from prefix sums, so that a text costs a few passes over its bytes. Long texts
    are taken in blocks that end at white space, so that memory is a few times the text and no more."""
    import numpy as np

    return _hashes_in_blocks(np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1"))


def _hashes_in_blocks(data):
    import numpy as np

    if len(data) <= BLOCK:
        return _word_hashes(data)
    space, _ = _bytes()
    out, begin = [], 0
    while begin < len(data):
        end = begin + BLOCK
        if end < len(data):
            gaps = np.flatnonzero(space[data[begin:end]])
            if len(gaps):
                end = begin + int(gaps[-1]) + 1
            else:  # a word longer than a block is a block
                while end < len(data) and not space[data[end]]:
                    end += 1
        out.append(_word_hashes(data[begin:end]))
        begin = end
    return np.concatenate(out)


def _word_hashes(data, at=None):
    """The hashes of the words in some bytes; with the places at which texts begin and end, also how many words come before each."""
    import numpy as np

    n = len(data)
    (space, code), (up, down) = _bytes(), powers(n + 1)
    inside = np.zeros(n + 2, "?")
    np.logical_not(space[data], out=inside[1:-1])
    if at is None:
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
    else:  # a word ends with its text, whatever the next one begins with
        first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        some = at[:-1] < at[1:]
        first[at[:-1][some]], last[at[1:][some] - 1] = inside[1:-1][at[:-1][some]], inside[1:-1][at[1:][some] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, "u8")
    np.cumsum(code[data] * up[:n], out=sums[1:])
    h = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype("u8"))
    return h if at is None else (h, np.searchsorted(starts, at))


def runs_of_shingles(column, k: int):
    """The hashes of shingle_hashes for a string column of an Arrow batch, read from its bytes: (first row, hashes, bounds) for runs of rows,
    the hashes of a run's row i being those from bounds[i] to bounds[i + 1]. Texts of fewer than k words have none here. A run has
    BLOCK bytes at most, or one text, so that short texts cost a few calls together."""
    import numpy as np
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    at = np.frombuffer(at, "i8")[column.offset :][: len(column) + 1] if len(column) else np.zeros(1, "i8")
    data = np.frombuffer(data, "u1") if data is not None and data.size else np.zeros(0, "u1")
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + BLOCK, "right")) - 1)
        own = data[at[begin] : at[end]]
        if end == begin + 1:
            h = _hashes_in_blocks(own)
            bounds = np.array([0, len(h)])
        else:
            h, bounds = _word_hashes(own, at[begin : end + 1] - at[begin])
        yield begin, *_shingles_within(h, bounds, k)
        begin = end


def _shingles_within(h, bounds, k: int):
    """The hashes of k-word shingles that lie within one of the texts, and their bounds."""
    import numpy as np

    if len(h) < k:
        return h[:0], np.zeros_like(bounds)
    out = _shingled(h, k)
    many = np.maximum(np.diff(bounds) - k + 1, 0)
    if len(many) > 1:
        inside = np.ones(len(h), "?")
        for back in range(1, k):
            inside[bounds[1:][bounds[1:] >= back] - back] = False
        out = out[inside[: len(out)]]
    return out, np.concatenate([[0], np.cumsum(many)])


def mixed(x):
    """A bijective mix of 64-bit numbers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str, k: int):
    """Hashes of a text's k-word shingles in order; with fewer words, of the whole sequence as one; none without words."""
    h = word_hashes(text)
    return _shingled(h, min(k, len(h))) if len(h) else h


def _shingled(h, own: int):
    import numpy as np

    # By doubling: hashes of the first 1, 2, 4 ... words of each shingle, then those of the rest of them.
    done, out, runs = 1, h, {1: h}
    while 2 * done <= own:
        out = _paired(out[:-done], out[done:])
        done *= 2
        runs[done] = out
    while done < own:
        step = max(r for r in runs if r <= own - done)
        out = _paired(out[: len(out) - step], runs[step][done:])
        done += step
    return mixed(out + np.uint64(own))


def _paired(left, right):
    import numpy as np

    return (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + right[: len(left)]


def neighbours(df: DataFrame, payload: list[str], emits: list[str], emit, name: str, lags: int = 1) -> DataFrame:
    """Join rows that share `key` into chains: dealt by range of (key, payload, doc_id), each row meets the `lags` rows before it that
    have its key and another doc_id. A key with any number of rows is spread over many tasks, and yields `lags` pairs for a row.

    df: (key long, doc_id long, payload longs). emit gets the earlier and the later rows' (doc_id, payload...) arrays and returns a
    mask of the pairs to keep and arrays for the columns `emits`. Returns (a, b, emits) with a < b in order of the chain; rows that
    are split by the border of two tasks meet from the tasks' last and first rows. With lags = 0 each row meets the first one of its
    key in its task instead, so that a key's rows are few links apart.
    """
    import pyarrow as pa

    columns = ["key", *payload, "doc_id"]
    held_names, made_names = columns, ["a", "b", *emits]
    out = pa.schema([("part", pa.int32()), ("end", pa.int32()), *((c, pa.int64()) for c in (*held_names, *made_names))])
    final = pa.schema([(c, pa.int64()) for c in made_names])

    def pairs(left, right, fresh=None):
        import numpy as np

        same = (left[0] == right[0]) & (left[-1] != right[-1])
        if fresh is not None:
            same &= fresh
        left, right = [x[same] for x in (left[-1], *left[1:-1])], [x[same] for x in (right[-1], *right[1:-1])]
        keep, made = emit(left, right)
        return [np.asarray(x)[keep] for x in (left[0], right[0], *made)]

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None

        def rows(end, held=None, made=None):
            n = len((held or made)[0])
            gaps = lambda names: [pa.nulls(n, pa.int64()) for _ in names]
            cells = [*map(pa.array, held)] if held else gaps(held_names)
            cells += [*map(pa.array, made)] if made else gaps(made_names)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, "i4")), pa.array(np.full(n, end, "i4")), *cells], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            held = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            begin = 0
            if last is None:
                yield rows(0, held=[x[:1] for x in held])
            else:
                begin = len(last[0])
                held = [np.concatenate([a, b]) for a, b in zip(last, held)]
            if not lags:
                new = np.ones(len(held[0]), "?")
                np.not_equal(held[0][1:], held[0][:-1], out=new[1:])
                first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
                made = pairs([x[first] for x in held], held)
                if len(made[0]):
                    yield rows(2, made=made)
                end, last = [x[-1:] for x in held], [x[first[-1:]] for x in held]
                continue
            for lag in range(1, lags + 1):
                if len(held[0]) <= lag:
                    continue
                fresh = np.arange(len(held[0]) - lag) >= begin - lag  # the others met in the batch before
                made = pairs([x[:-lag] for x in held], [x[lag:] for x in held], fresh)
                if len(made[0]):
                    yield rows(2, made=made)
            end, last = [x[-1:] for x in held], [x[-lags:] for x in held]
        if last is not None:
            yield rows(1, held=end)

    def across(batches):
        import numpy as np

        held = None
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", *columns)]
            held = own if held is None else [np.concatenate([a, b]) for a, b in zip(held, own)]
        if held is not None and len(held[0]) > 1:
            made = pairs([x[:-1] for x in held[1:]], [x[1:] for x in held[1:]], held[0][1:] != held[0][:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], schema=final)

    longs = lambda names: ", ".join(f"{c} long" for c in names)
    dealt = df.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns)
    made = written(dealt.mapInArrow(run, f"part int, end int, {longs(held_names)}, {longs(made_names)}"), name, 16_384)
    ends = made.where("end < 2").select("part", "end", *columns).coalesce(1).sortWithinPartitions("part", "end")  # two rows for each task
    out_pairs = made.where("end = 2").select(made_names).unionByName(ends.select("part", *columns).mapInArrow(across, longs(made_names)))
    out_pairs._factloom_path = made._factloom_path
    return out_pairs
