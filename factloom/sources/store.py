"""The index as written tables: rebuilt as a whole beside the one that is read, then swapped in; read back; state."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Written into the index; an index of another version is rebuilt, not read.
VERSION = 4
#: A table of files smaller than this is dealt to all cores.
SMALL_BYTES = 64 << 20


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def put(at: str, name: str, df: DataFrame) -> DataFrame:
    """Write a table of an index that is being built, and read it back."""
    df.write.parquet(f"{at}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def qualified(spark: SparkSession, path: str) -> str:
    """A folder's full name, as listings have it."""
    at, fs = _fs(spark, path)
    return fs.makeQualified(at).toString()


def unique() -> str:
    return uuid.uuid4().hex


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Folders directly below a path whose names begin with a prefix."""
    at, fs = _fs(spark, path)
    return [f"{path}/{f.getPath().getName()}" for f in fs.listStatus(at) if f.isDirectory() and f.getPath().getName().startswith(prefix)]


def new_version(path: str) -> str:
    """A folder for the next version of an index; nothing reads it before publish()."""
    return f"{path}/v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, at: str, names: list[str]) -> None:
    """Make a written version the one that is read, in one step: the pointer file is replaced by a rename, so that a reader, or a crash
    at any time, meets the version before or this one and never a mix. The version before is kept for those that read it still; older
    ones go."""
    before = current(spark, path)
    pointer = f"{path}/.pointer-{uuid.uuid4().hex}"
    tmp, fs = _fs(spark, pointer)
    out = fs.create(tmp)
    out.write(json.dumps({"version": VERSION, "at": at, "tables": names, "before": before and before["at"]}).encode())
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    overwrite = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    overwrite[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(tmp, _fs(spark, f"{path}/current")[0], overwrite)
    if before and before.get("before"):
        old, fs = _fs(spark, before["before"])
        fs.delete(old, True)


def current(spark: SparkSession, path: str) -> dict | None:
    """What the pointer of an index says: the version that is read, its folder and tables; None without one."""
    if not exists(spark, f"{path}/current"):
        return None
    return json.loads(spark.read.text(f"{path}/current", wholetext=True).first()[0])


def write_index(path: str, **tables: DataFrame) -> None:
    """Rebuild an index from whole tables."""
    at = new_version(path)
    for name, df in tables.items():
        put(at, name, df)
    publish(next(iter(tables.values())).sparkSession, path, at, list(tables))


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than there are cores, dealt to all of them: a file of one row group would keep one core busy. Tables of
    SMALL_BYTES or more stay as they are read, so that what this shuffles never grows with the data."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < SMALL_BYTES and len(df.inputFiles()) < cores else df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (spark.checkpoint.dir; a temporary one in local runs without it)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Names, sizes and times of the files below some paths: another one means that what was built from them is stale."""
    parts = []
    for path in paths:
        at, fs = _fs(spark, path)
        files = fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            parts.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(parts))


def state(spark: SparkSession, path: str) -> str:
    """missing, old-schema, empty or ok. A read never creates an index."""
    now = current(spark, path)
    if now is None:
        return "missing"
    if now["version"] != VERSION:
        return "old-schema"
    return "empty" if "claims" in now["tables"] and spark.read.parquet(f"{now['at']}/claims").isEmpty() else "ok"


def read_index(spark: SparkSession, path: str, fresh: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of an index; a missing, old or stale one is refused. fresh: (key, state) rows of sources that have changed since."""
    how = state(spark, path)
    if how == "ok" and fresh is not None and not fresh.isEmpty():
        how = "stale"
    if how not in ("ok", "empty"):
        raise ValueError(f"the index at {path} is {how}: rebuild it")
    now = current(spark, path)
    return {n: spark.read.parquet(f"{now['at']}/{n}") for n in now["tables"]}
