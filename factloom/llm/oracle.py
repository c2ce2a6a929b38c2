"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from . import chat, quality_rules, url_filter

Q = "'"


def quoted(s: str) -> str:
    return Q + s.replace(Q, Q + Q) + Q


def op1() -> str:
    escaped = f"regexp_replace(t, {quoted(chat.SQL_PATTERN)}, '\\1\\\\\\2\\3', 'g')"
    role = "replace(replace(replace(r, '%', '%25'), chr(10), '%0A'), '<', '%3C')"
    return f"""
with m as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select cast(conv_id as bigint) conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  cast(sum(case when r = 'assistant' then length(t) else 0 end) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (where r = 'assistant'), '')) loss_sha256,
  cast(sum(length({role}) + length({escaped}) + {len(chat.OPEN) + 1 + len(chat.CLOSE)}) as bigint) formatted_chars
from m group by conv_id"""


def op7() -> str:
    order, prior = url_filter.ORDER, url_filter.PRIOR
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in rules]
    rule = "case " + " ".join(f"when {f} then '{h + p}'" for f, (_, h, p) in zip(fits, rules)) + " end"
    ruling = "case " + " ".join(f"when {f} then '{v}'" for f, (v, _, _) in zip(fits, rules)) + " end"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    held = f"left(md5(s), 1) in ({', '.join(map(quoted, url_filter.HELD_OUT))})"
    tables, joins, pa, pb = [], [], str(1 / url_filter.ALPHABET), str(1 / url_filter.ALPHABET)
    for k in range(1, order + 1):
        for kind, key in (("n", f"right(gram, {k})"), ("t", f"substr(gram, {order - k + 1}, {k - 1})")):
            tables.append(f"{kind}{k} as (select {key} k, sum(a) a, sum(b) b from counts group by 1)")
            joins.append(f"left join {kind}{k} on {kind}{k}.k = {key.replace('gram', 'g.gram')}")
        pa, pb = (f"((coalesce(n{k}.{y}, 0) + {prior} * {p}) / (coalesce(t{k}.{y}, 0) + {prior}))" for y, p in (("a", pa), ("b", pb)))
    return f"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{upper}', '{lower}') host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) path from pages),
j as (select *, {rule} rule_, {ruling} ruling, host || path s from u),
addr as (select s, ruling, count(*) n from j group by all),
pos as (select s, ruling, n, unnest(list_transform(range(1, length(s) + 2), lambda i: substr(repeat(chr(2), {order - 1}) || s || chr(3), i, {order}))) gram from addr),
counts as (select gram, sum(case when ruling = 'allow' then n else 0 end) a, sum(case when ruling = 'block' then n else 0 end) b from pos where ruling is not null and not {held} group by 1),
{', '.join(tables)},
w as (select g.gram, ln({pa}) - ln({pb}) weight from (select distinct gram from pos) g {' '.join(joins)}),
scored as (select s, ruling, n, round(avg(weight), 9) raw from pos join w using (gram) group by all),
both_ as (select count(distinct ruling) = 2 yes from scored where ruling is not null and {held}),
m as (select ruling, sum(n * raw) / sum(n) m, sqrt(greatest(sum(n * raw * raw) / sum(n) - (sum(n * raw) / sum(n)) ** 2, 0)) sd from scored, both_ where ruling is not null and ({held} or not yes) group by 1),
cut as (select case when a.sd + b.sd > 0 then (a.m * b.sd + b.m * a.sd) / (a.sd + b.sd) else (a.m + b.m) / 2 end cut from m a, m b where a.ruling = 'allow' and b.ruling = 'block')
select j.page_id, j.host, j.path, j.rule_ as "rule", coalesce(j.ruling, case when scored.raw < (select cut from cut) then 'block' else 'allow' end) verdict
from j join scored on j.s = scored.s and j.ruling is not distinct from scored.ruling"""


def op10() -> str:
    word, symbol = quoted(r"[^\x20\x09-\x0D]+"), quoted(quality_rules.SYMBOL)
    return f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
l as (select r, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) i from d),
l2 as (select *, len(regexp_extract_all(line, {word})) nw, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) nc, row_number() over (partition by r, line order by i) > 1 again,
    regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quoted(quality_rules.BOILERPLATE)}) phrases from l),
l3 as (select *, again
    or (length(line) - length(replace(line, '|', '')) > 0 and 4 * (length(line) - length(replace(line, '|', ''))) >= nw)
    or 2 * length(regexp_replace(line, '[^#*$%&<>]', '', 'g')) > nw
    or (nw >= 3 and (length(line) - length(replace(line, '!!', ''))) >= nw)
    or (len(phrases) > 0 and {quality_rules.PROSE_WORDS} * len(phrases) >= nw)
    or (nw <= 3 and not regexp_matches(line, {quoted(quality_rules.MARK_AT_END)})) fails from l2 where nw > 0),
lines as (select r, sum(case when again then 1 else 0 end) dup, sum(case when fails then nc else 0 end) lost from l3 group by r),
w as (select r, regexp_extract_all(t, {word}) w from d),
win as (select r, unnest(range(1, len(w) - 3)) i, w from w where len(w) >= 5),
win2 as (select r, i, count(*) over (partition by r, w[i], w[i+1], w[i+2], w[i+3], w[i+4]) c from win),
again as (select r, count(distinct p) n from (select r, unnest(range(i, i + 5)) p from win2 where c > 1) group by r),
f as (select doc_id, d.r, len(w.w) n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(dup, 0) n_dup_lines, coalesce(again.n, 0) n_repeat_words, coalesce(lost, 0) lost
  from d join w using (r) left join lines using (r) left join again using (r))
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines,
  cast(n_repeat_words as bigint) n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 2 * lost <= word_chars kept from f"""


def op12() -> str:
    score = "cast(list_sum(list_transform(range(1, greatest(len(a.x), len(b.x)) + 1), lambda i: coalesce(a.x[i], 0) * coalesce(b.x[i], 0))) as bigint)"
    return f"""
with v as (select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end lab, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) x
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select a.vec_id anchor_id, a.lab, b.vec_id, b.lab other, {score} score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id positive_id, score positive_score from s where lab = other qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) "rank", vec_id negative_id, positive_score, score negative_score
from p join s on p.anchor_id = s.anchor_id and lab <> other and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify "rank" <= 3"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": op1(), "op7_url_filters": op7(), "op10_quality_rules": op10(), "op12_hard_negatives": op12()}
