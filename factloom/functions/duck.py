"""The text functions as DuckDB SQL, spelled independently for the oracle queries."""

from __future__ import annotations

from . import text as tx
from .text import STOP


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def depluralise(w: str) -> str:
    return (
        f"case when ends_with({w}, 'ies') and length({w}) >= 6 then left({w}, length({w}) - 3) || 'y' "
        f"when regexp_matches({w}, '(?:sses|shes|ches|xes|zes|ses)$') and length({w}) >= 5 then left({w}, length({w}) - 2) "
        f"when regexp_matches({w}, '(?:ss|us|is)$') then {w} "
        f"when ends_with({w}, 'es') and length({w}) >= 5 then left({w}, length({w}) - 1) "
        f"when ends_with({w}, 's') and length({w}) >= 4 then left({w}, length({w}) - 1) else {w} end"
    )


def stem_steps(source: str, word: str = "w") -> str:
    """A subquery over `source` with a column `stem` for its column `word`."""
    return f"""(select * exclude (d_, s_), case when length({word}) <= 3 or regexp_matches({word}, '^[0-9]+$') then {word} when length(s_) > 3 and ends_with(s_, 'e') then left(s_, length(s_) - 1) else s_ end stem
 from (select *, case when d_ <> {word} then d_ when ends_with({word}, 'ing') and length({word}) >= 6 then left({word}, length({word}) - 3)
   when ends_with({word}, 'ed') and length({word}) >= 5 then left({word}, length({word}) - 2) else {word} end s_
  from (select *, {depluralise(word)} d_ from {source})))"""


def split_ident(s: str) -> str:
    """A list of words, some empty."""
    once = f"regexp_replace({s}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"string_split_regex(lower(regexp_replace({once}, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+')"


def norm_claim(s: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim({s})), '[[:punct:]]+', ' ', 'g'), '\\s+', ' ', 'g')"


def claim_tokens(s: str) -> str:
    parts = f"string_split({norm_claim(s)}, ' ')"
    return f"list_distinct(case when {parts}[-1] = '' then {parts}[1:len({parts}) - 1] else {parts} end)"


def plain_tokens(s: str, stop) -> str:
    words = f"string_split_regex(regexp_replace(lower(coalesce({s}, '')), '[^a-z0-9 ]', ' ', 'g'), '\\s+')"
    return f"list_filter(list_distinct({words}), lambda x: not list_contains({array(['', *stop])}, x))"


def jaccard(a: str, b: str) -> str:
    inter = f"len(list_intersect({a}, {b}))"
    return f"(case when len({a}) + len({b}) > 0 then {inter} / (len({a}) + len({b}) - {inter}) else 0.0 end)"


STOPS = array(STOP)


def words(s: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({s}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def porter(source: str, word: str = "w") -> str:
    """A subquery over `source` with the Porter stem of its column `word` as column p."""

    def replaced(by: dict[str, str], measure: str) -> str:
        out = []
        for suffix in sorted(by, key=len, reverse=True):
            left = f"left(p, length(p) - {len(suffix)})"
            extra = f" and regexp_matches({left}, '[st]$')" if suffix == "ion" else ""
            out.append(f"when ends_with(p, '{suffix}') then case when regexp_matches({left}, '{measure}'){extra} then {left} || '{by[suffix]}' else p end")
        return f"case {' '.join(out)} else p end"

    cut = lambda n, p="p": f"left({p}, length({p}) - {n})"
    fits = lambda x, how: f"regexp_matches({x}, '{how}')"
    doubled = " or ".join(f"ends_with(q, '{c}{c}')" for c in "bcdfghjkmnpqrtvwxyY")
    steps = [
        "case when starts_with(p, 'y') then 'Y' || substr(p, 2) else p end",
        f"case when ends_with(p, 'sses') or ends_with(p, 'ies') then {cut(2)} when ends_with(p, 's') and not ends_with(p, 'ss') then {cut(1)} else p end",
        f"""case when ends_with(p, 'eed') then case when {fits(cut(3), tx.OVER_0)} then {cut(1)} else p end
          when q is null then p when {fits('q', '(?:at|bl|iz)$')} then q || 'e' when {doubled} then {cut(1, 'q')} when {fits('q', tx.SHORT)} then q || 'e' else q end""",
        f"case when ends_with(p, 'y') and {fits(cut(1), tx.HAS_VOWEL)} then {cut(1)} || 'i' else p end",
        replaced(tx.PORTER_2, tx.OVER_0), replaced(tx.PORTER_3, tx.OVER_0), replaced(dict.fromkeys(tx.PORTER_4, ""), tx.OVER_1),
        f"case when ends_with(p, 'e') and ({fits(cut(1), tx.OVER_1)} or ({fits(cut(1), tx.ONE)} and not {fits(cut(1), tx.SHORT)})) then {cut(1)} else p end",
        f"case when ends_with(p, 'll') and {fits('p', tx.OVER_1)} then {cut(1)} else p end",
        "lower(p)",
    ]
    sql = f"(select *, {word} p, cast(null as varchar) q from {source})"
    for n, step in enumerate(steps):
        if n == 2:
            sql = f"(select * replace (case when ends_with(p, 'ed') and {fits(cut(2), tx.HAS_VOWEL)} then {cut(2)} when ends_with(p, 'ing') and {fits(cut(3), tx.HAS_VOWEL)} then {cut(3)} end as q) from {sql})"
        sql = f"(select * replace (case when length({word}) > 2 then {step} else p end as p) from {sql})"
    return f"(select * exclude (q) from {sql})"
