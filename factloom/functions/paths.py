"""Paths, profiles, routing and model windows as Columns."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import col

# Extensions by kind.
CODE = "py ts tsx js jsx go rs java c h cpp hpp rb php swift kt cs sh sql r jl lua pl pm scala ex exs zsh bash".split()
PROSE = "md txt rst org tex".split()
IMAGE = "png jpg jpeg webp gif bmp tiff".split()
TOOLS = (("pdf", "pdftotext"), ("docx doc odt rtf pptx ppt odp html", "doctotext"), ("xlsx xlsm xls ods csv tsv", "xlstotext"), ("tex latex", "latextotext"))
SHEBANG = r"^#!.*\b(python|node|ruby|perl|bash|sh|zsh|Rscript|lua|julia)\b"
TIERS = (200_000, 500_000, 1_000_000, 2_000_000)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([A-Za-z0-9]+)$", 1))


def is_image(path) -> Column:
    return extension(path).isin(*IMAGE)


def profile(path, first_line=None, prose=PROSE) -> Column:
    """code, prose or generic, by extension, else by a shebang line."""
    ext = extension(path)
    out = F.when(ext.isin(*CODE), "code").when(ext.isin(*prose), "prose")
    if first_line is not None:
        out = out.when((ext == "") & col(first_line).rlike(SHEBANG), "code")
    return out.otherwise("generic")


def role(path, kind, tokens, long_from: int = 6000) -> Column:
    """vision for images, long for long prose, else the profile."""
    kind = col(kind)
    return F.when(is_image(path), "vision").when(kind.isin("prose", "generic") & (col(tokens) > long_from), "long").otherwise(kind)


def tool_for(path) -> Column:
    ext = extension(path)
    out = F.lit("copy")
    for names, tool in reversed(TOOLS):
        out = F.when(ext.isin(*names.split()), tool).otherwise(out)
    return out


def route(rows: DataFrame, models: dict[str, str], fallback: str | None) -> DataFrame:
    """Adds model: the role's, else the fallback; models is a small table of configuration."""
    out = F.lit(fallback)
    for r, m in models.items():
        out = F.when(F.col("role") == r, m).otherwise(out)
    return rows.withColumn("model", out)


def batches(rows: DataFrame) -> DataFrame:
    """(model, rank, files, tokens): work by model, the ones that load fastest first, by the size that the model's name states."""
    model = F.col("model")
    rank = F.when(model.contains("7b"), 0).when(model.contains("8b"), 1).otherwise(2)
    return rows.where(model.isNotNull()).groupBy("model").agg(F.count("*").alias("files"), F.sum("est_tokens").alias("tokens")).withColumn("rank", rank).orderBy("rank", "model")


def lookup(c, known: dict, default) -> Column:
    """A value of configuration by name, or the default."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), col(c)), F.lit(default))


def environments(rows: DataFrame, of: dict[str, str], installed: DataFrame, fallback: str) -> DataFrame:
    """Adds env: the environment that the role has by configuration, if it is installed with a program that can be executed; else the
    default role's, if that one is; else the fallback. installed: (env, executable)."""
    usable = installed.where("executable").select(F.col("env").alias("_env")).distinct()
    wanted = rows.withColumn("_want", lookup("role", of, of["default"])).withColumn("_else", F.lit(of["default"]))
    first = wanted.join(usable, F.col("_want") == F.col("_env"), "left").withColumnRenamed("_env", "_first")
    second = first.join(usable, F.col("_else") == F.col("_env"), "left")
    return second.select(*rows.columns, F.coalesce("_first", "_env", F.lit(fallback)).alias("env"))


def pattern(glob: str) -> str:
    """Java regex of a glob, whole string, * crossing slashes."""
    return "^" + fnmatch.translate(glob).replace(r"\z", "").replace(r"\Z", "").removeprefix("(?s:").removesuffix(")") + "$"


def tree_pattern(glob: str) -> str:
    """Java regex of a glob over a tree: a star and a question mark stay within a folder, two stars as a whole segment are any folders."""
    out = ""
    for n, part in enumerate(segments := glob.split("/")):
        last = n == len(segments) - 1
        if part == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            for piece in re.split(r"(\*+|\?|\[[^\]]+\])", part):
                out += "[^/]*" if piece.startswith("*") else "[^/]" if piece == "?" else piece.replace("[!", "[^") if piece.startswith("[") else re.sub(r"([^\w/])", r"\\\1", piece)
            out += "" if last else "/"
    return f"(?s)^{out}$"


def matches(path, glob: str) -> Column:
    return col(path).rlike("(?s)" + pattern(glob))


def excluded(path, patterns: list[str]) -> Column:
    """Whether a pattern covers a path: the whole path, the base name, or a directory above it. Bare directory names match any
    segment; those with a slash or a wildcard hold from the root on."""
    path = col(path)
    base = F.element_at(F.split(path, "/"), -1)
    above = F.split(path, "/")
    above = F.slice(above, 1, F.greatest(F.size(above) - 1, F.lit(0)))
    out = F.lit(False)
    for p in filter(None, map(str.strip, patterns)):
        out = out | matches(path, p) | matches(base, p)
        top = next((p[: -len(s)] for s in ("/**", "/*", "/") if p.endswith(s)), p)
        if not top:
            continue
        if "/" in top or any(c in top for c in "*?["):
            out = out | (path == top) | path.startswith(top + "/") | matches(path, top + "/*")
        else:
            out = out | F.array_contains(above, top)
    return out


def glob(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files that a pattern includes, with the place of the first that does."""
    hit = F.coalesce(*(F.when(matches("path", p), i) for i, p in enumerate(patterns)))
    return files.withColumn("pattern", hit).where("pattern is not null")


def tier(seen) -> Column:
    """The least tier that holds the tokens seen, else these themselves."""
    seen = col(seen)
    return F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, TIERS)), lambda x: x >= seen)).cast("long"), seen)


def model_window(rows: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Adds known: the window of the longest prefix of the model's name, null if none."""
    out = F.lit(None).cast("int")
    for prefix, size in sorted(windows.items(), key=lambda x: len(x[0])):
        out = F.when(F.col("model").startswith(prefix), size).otherwise(out)
    return rows.withColumn("known", out)


def resolve_window(rows: DataFrame, windows: dict[str, int], default: int = 200_000) -> DataFrame:
    """Adds window: the model's, or the default, raised to the tier that holds what was seen."""
    rows = model_window(rows, windows)
    base = F.coalesce("known", F.lit(default)).cast("long")
    return rows.withColumn("window", F.when(F.col("seen") <= base, base).otherwise(tier("seen")))
