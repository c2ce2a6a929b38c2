"""Model replies: lenient JSON, code blocks, screens. Nothing here calls a model or runs code."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import TRIVIAL_TEXT, col

# Patterns that a check's code must not have.
DENIED = [r"system\s*\(", r"system2\s*\(", r"shell\s*\(", r"unlink\s*\(", r"file\.remove", r"file\.rename", r"file\.create", r"writeLines\s*\(", r"write\.csv", r"write\.table", "saveRDS", r"save\s*\(", r"download\.file", r"url\s*\(", "socketConnection", "curl", r"install\.packages", r"Sys\.setenv", r"setwd\s*\(", r"q\s*\(", r"quit\s*\(", r"\.Internal", r"eval\s*\(\s*parse", r"source\s*\(", "reticulate", "processx", "sys::"]


def screen(code) -> Column:
    """The denied patterns that a code has, joined; empty if none."""
    code = F.coalesce(col(code), F.lit(""))
    return F.array_join(F.filter(F.array(*map(F.lit, DENIED)), lambda p: F.rlike(code, p)), ", ")


def code_block(s) -> Column:
    """The first fenced block, else the whole text if it assigns a result, else null."""
    s = col(s)
    fenced = F.regexp_extract(s, r"(?s)```[A-Za-z]*\n(.*?)```", 1)
    return F.when(fenced != "", fenced).when(s.rlike(r"result\s*(?:<-|=)"), s)


def split_seat(s) -> tuple[Column, Column]:
    parts = F.split(col(s), "/", 2)
    return parts[0], F.get(parts, F.lit(1))


def lenient_json(text: str | None):
    """The JSON of a reply: fences stripped; raw line breaks and tabs inside strings mended; else the first balanced block; else None."""
    if not text:
        return None
    body = re.sub(r"^\s*```[A-Za-z]*\s*|\s*```\s*$", "", text.strip())
    starts = [m.start() for m in re.finditer(r"[{\[]", body)][:1]
    for candidate in (body, *(_balanced(body, s) for s in starts)):
        for attempt in (candidate, _mended(candidate)):
            try:
                return json.loads(attempt)
            except ValueError:
                continue
    return None


def _mended(s: str) -> str:
    """Raw control characters inside strings as escapes."""
    out, inside, escaped = [], False, False
    for c in s:
        if inside and not escaped and c in "\n\r\t":
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}[c])
            continue
        if c == '"' and not escaped:
            inside = not inside
        escaped = c == "\\" and not escaped
        out.append(c)
    return "".join(out)


def _balanced(s: str, start: int) -> str:
    depth, inside, escaped = 0, False, False
    for i in range(start, len(s)):
        c = s[i]
        if c == '"' and not escaped:
            inside = not inside
        escaped = c == "\\" and not escaped
        if not inside:
            depth += (c in "{[") - (c in "}]")
            if depth == 0:
                return s[start : i + 1]
    return s[start:]


def parse_replies(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, json): replies as JSON with sorted keys, null where there is none. Valid JSON is read in the JVM; what is left is mended in
    batches."""

    @F.pandas_udf("string")
    def mend(s: pd.Series) -> pd.Series:
        found = s.map(lenient_json)
        return found.map(lambda x: None if x is None else json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":")))

    read = rows.select(key, F.col(text).alias("_text"), F.try_parse_json(F.col(text)).alias("_v"))
    valid = read.where("_v is not null").select(key, F.to_json("_v").alias("json"))
    return valid.unionByName(read.where("_v is null").select(key, mend("_text").alias("json")))


def called(prompts: DataFrame, answer: Callable[[str], str], key: str = "prompt_id") -> DataFrame:
    """(key, ok, text, error, latency) of prompts (key, prompt): the uniform adapter of a provider, whose `answer` runs on the workers; a
    call that raises is a row with its error and doesn't sink the others."""
    import time

    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"{key} {dict(prompts.dtypes)[key]}, ok boolean, text string, error string, latency double")
    out = to_arrow_schema(schema)

    def one(prompt: str) -> tuple:
        began = time.monotonic()
        try:
            text = answer(prompt)
            return (bool(text), text, None if text else "empty completion", time.monotonic() - began)
        except Exception as e:
            return (False, None, type(e).__name__, time.monotonic() - began)

    def run(batches):
        for batch in batches:
            rows = [(k, *one(p or "")) for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return prompts.select(key, "prompt").mapInArrow(run, schema)


def prompt(template: str, **fields) -> Column:
    """A prompt text from a template with {fields}, each a column; missing values are empty."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(col(fields[x]).cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(pieces)))


def available_seats(wanted: str, settings: DataFrame, needs: dict[str, str | None]) -> DataFrame:
    """(pos, seat, provider, model) of the configured seats, a comma list of provider or provider/model, that can be used: whose provider
    needs no setting, or one that settings (name, value) has and is not blank. The list is configuration."""
    rows = [(i, s, s.partition("/")[0], s.partition("/")[2] or None) for i, s in enumerate(x.strip() for x in wanted.split(","))]
    rows = [(*r, needs[r[2]]) for r in rows if r[2] in needs]
    seats = settings.sparkSession.createDataFrame(rows, "pos int, seat string, provider string, model string, need string")
    there = settings.where(F.trim(F.coalesce("value", F.lit(""))) != "").select(F.col("name").alias("need"), F.lit(True).alias("there")).distinct()
    return seats.join(there, "need", "left").where("need is null or there").select("pos", "seat", "provider", "model")


def environment(packages) -> Column:
    """What the author of a check may use."""
    packages = col(packages)
    return F.when(F.size(packages) == 0, "Base only; no further packages are installed.").otherwise(F.concat(F.lit("Base, and these packages: "), F.array_join(packages, ", "), F.lit(".")))


def table_backed(prompts: DataFrame, replies: DataFrame, key: str = "prompt_id") -> DataFrame:
    """The stand-in of a model adapter: replies come from a table; a prompt without one has ok = false."""
    hits = replies.select(F.col(key).alias("_k"), F.col("reply"))
    return prompts.join(hits, F.col(key) == F.col("_k"), "left").select(*prompts.columns, F.col("reply").isNotNull().alias("ok"), "reply")


def image_claims(rows: DataFrame) -> DataFrame:
    """(key, topic, pos, text, status): bullet lines of image replies, backticks at their ends dropped, those under eight letters and trivial
    ones left out; not yet proven. topic: the first line that names one."""
    lines = F.transform(F.split("reply", "\n"), lambda x: F.trim(x))
    topic = F.try_element_at(F.transform(F.filter(lines, lambda x: x.rlike("(?i)^TOPIC:")), lambda x: F.trim(F.substr(x, F.lit(7)))), F.lit(1))
    line = F.filter(lines, lambda x: x.rlike(r"^[-*]\s+\S"))
    cleaned = F.transform(line, lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[-*]\s+", "")), "^`+|`+$", ""))
    kept = F.filter(cleaned, lambda x: (F.length(x) >= 8) & ~x.rlike(TRIVIAL_TEXT))
    return rows.select("key", F.coalesce(topic, F.lit("")).alias("topic"), F.posexplode(kept).alias("pos", "text")).withColumn("status", F.lit("NEEDS_AGENT"))


#: Verdicts that a local judge may give.
VERDICTS = ("CONFIRMED", "REFUTED", "UNSUPPORTED")


def judged(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, verdict, note) of a local judge's replies (key, ok, text): a call that failed, a reply without JSON and a verdict that is none
    count as UNSUPPORTED, with a note that says which it was."""
    read = parse_replies(answers, key, text)
    verdict = F.upper(F.trim(F.get_json_object("json", "$.verdict")))
    known = verdict.isin(*VERDICTS)
    note = F.when(~F.coalesce("ok", F.lit(False)), "no answer").when(F.col("json").isNull(), "no JSON").when(~F.coalesce(known, F.lit(False)), "no such verdict")
    rows = answers.select(key, "ok").join(read, key, "left")
    return rows.select(key, F.when(note.isNull(), verdict).otherwise("UNSUPPORTED").alias("verdict"), F.coalesce(note, F.get_json_object("json", "$.note")).alias("note"))


def last_json(stdout) -> Column:
    """The last line of a program's output that is JSON, null where none is."""
    lines = F.filter(F.transform(F.split(F.coalesce(col(stdout), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^[{\[]") & F.try_parse_json(x).isNotNull())
    return F.try_element_at(lines, F.lit(-1))
