"""Real files: listings without content, include and exclude patterns, the newest, the ends of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.functions.records import TAIL_BYTES

from . import store


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, size, modified) of all files below a folder. Spark lists folders in parallel tasks where there are many, and reads no
    content, since no column of it is asked for. Files and folders whose names begin with a dot or an underscore are not listed, nor are
    empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    top = len(store.qualified(spark, root)) + 2
    return files.select("path", F.expr(f"substring(path, {top})").alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def included(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files (rel) that a pattern includes, each once, with the place of the first that does. A star stays within a folder, two stars
    stand for any folders. In order of (pattern, rel) the files are those of each pattern in turn."""
    hit = F.coalesce(*(F.when(F.col("rel").rlike(paths.tree_pattern(p)), i) for i, p in enumerate(patterns)), F.lit(None).cast("int"))
    return files.withColumn("pattern", hit).where("pattern is not null")


def exclusions(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """A table of exclude patterns as files meet them: (whole, top, anchored, below). whole: an expression for the path or the base name.
    top: the folder that a pattern names; anchored where it has a slash or a wildcard, and then below is an expression for what lies in it."""
    rows = []
    for p in filter(None, map(str.strip, patterns)):
        top = next((p[: -len(s)] for s in ("/**", "/*", "/") if p.endswith(s)), p)
        anchored = "/" in top or any(c in top for c in "*?[")
        rows.append(("(?s)" + paths.pattern(p), top, anchored, "(?s)" + paths.pattern(top + "/*")))
    return spark.createDataFrame(rows, "whole string, top string, anchored boolean, below string")


def tagged(files: DataFrame, excludes: DataFrame) -> DataFrame:
    """Files (rel) with whether a pattern of the table excludes them. The patterns are a configuration: they are broadcast."""
    parts = F.split("rel", "/")
    rows = files.withColumn("_name", F.element_at(parts, -1)).withColumn("_above", F.slice(parts, 1, F.size(parts) - 1))
    p = excludes.alias("p")
    at = F.expr("rel = p.top or startswith(rel, concat(p.top, '/')) or rel rlike p.below")
    hit = F.expr("rel rlike p.whole or _name rlike p.whole") | (F.col("p.top") != "") & F.when(F.col("p.anchored"), at).otherwise(F.expr("array_contains(_above, p.top)"))
    found = rows.join(F.broadcast(p), hit, "left_semi").select("rel")
    return files.join(found.distinct().withColumn("_hit", F.lit(True)), "rel", "left").withColumn("excluded", F.coalesce("_hit", F.lit(False))).drop("_hit")


def newest(files: DataFrame, most: int) -> DataFrame:
    """The files that were changed last, the latest first; ties by path."""
    return files.orderBy(F.desc("modified"), "rel").limit(most)


def find(files: DataFrame, hint: Column | None = None) -> DataFrame:
    """One file: the first whose path has the hint as a folder or as its name without an ending, where there is one; else the newest."""
    parts = F.transform(F.split("rel", "/"), lambda x: F.regexp_replace(x, r"\.\w+$", ""))
    hinted = F.lit(False) if hint is None else F.coalesce(F.array_contains(parts, hint), F.lit(False))
    return files.withColumn("hinted", hinted).orderBy(F.desc("hinted"), F.when(~F.col("hinted"), F.col("modified")).desc(), "rel").limit(1)


def _reads(path: str) -> bool:
    """Whether tasks can open files of this store themselves."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
        return True
    except Exception:  # noqa: BLE001 any failure means that Spark's own reader is the way
        return False


def tails(root: str, files: DataFrame, most: int = TAIL_BYTES) -> DataFrame:
    """(rel, content, cut, read): the last bytes of each file of a listing (path, rel, size) below a folder, whether something was cut off before them, and
    how many bytes were read. Tasks open a file, go to the place and read from there. In a store that only Spark reads, its reader reads the
    whole file and the end is taken: the same rows. A file that is gone when it is opened gives no row."""
    import pyarrow as pa

    spark = files.sparkSession
    if not _reads(store.qualified(spark, root)):
        cut = F.col("size") > most
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
        rows = files.join(whole, "path")
        return rows.select("rel", F.when(cut, F.substring("content", -most, most)).otherwise(F.col("content")).alias("content"), cut.alias("cut"), F.octet_length("content").cast("long").alias("read"))
    schema = pa.schema([("rel", pa.string()), ("content", pa.binary()), ("cut", pa.bool_()), ("read", pa.int64())])

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, rel in zip(batch.column("path").to_pylist(), batch.column("rel").to_pylist()):
                store_, at = fs.FileSystem.from_uri(path)
                try:
                    with store_.open_input_file(at) as f:
                        size = f.size()
                        f.seek(max(0, size - most))
                        data = f.read(most)
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([x], c.type) for x, c in zip((rel, data, size > most, len(data)), schema)], schema=schema)

    dealt = files.select("path", "rel").repartition(spark.sparkContext.defaultParallelism, "rel")
    return dealt.mapInArrow(run, "rel string, content binary, cut boolean, read long")
