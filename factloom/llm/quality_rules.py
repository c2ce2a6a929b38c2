"""Line-first quality rules: judge each line, take failing lines out, then reject documents that lose too much text.

Words are runs of characters other than ASCII white space; lines end with \\n. A line with a word fails if

* navigation: it has a ``|`` and at least one for every four words,
* symbols: characters of ``#*$%&<>`` number more than half its words,
* shouting: it has three words or more and ``!!`` for at least half of them,
* boilerplate: it has one of PHRASES, in seven languages, for every PROSE_WORDS words (a longer line that only mentions one is prose),
  or repeats an earlier line of the text,
* punctuation: it has three words or fewer and no sentence or closing mark at its end.

A document's own base rules come first (base_failed). Then the line rules' verdict: it is rejected if failing lines hold more than
half of its word characters.

Defined results: null and empty texts have no words and fail the base rules; a text that loses exactly half of its characters is kept;
repeated rows are judged alike; texts are read whole at any length; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import WORD, batches_of, short_batches, texts

#: Fixed phrases of boilerplate lines: notices of rights, terms, cookies and scripts, and calls to click. Phrases and not words, so that
#: what is about cookies or copyright is prose. A-Z in lower case.
PHRASES = (
    # English
    "all rights reserved", "copyright \u00a9", "copyright (c)", "copyright 19", "copyright 20", "\u00a9 19", "\u00a9 20", "privacy policy", "privacy notice", "terms of service", "terms of use", "terms and conditions",
    "cookie policy", "cookie settings", "cookie preferences", "use cookies", "uses cookies", "use of cookies", "accept cookies", "accept all cookies", "enable javascript", "enable cookies", "javascript is disabled",
    "javascript is required", "requires javascript", "subscribe to our", "subscribe now", "our newsletter", "sign up for", "sign up now", "log in to", "log in or", "read more", "click here", "skip to content", "share on facebook", "share on twitter",
    # German
    "alle rechte vorbehalten", "datenschutzerkl\u00e4rung", "nutzungsbedingungen", "verwendet cookies", "verwenden cookies", "cookies akzeptieren", "javascript aktivieren", "newsletter abonnieren", "jetzt anmelden", "weiterlesen", "hier klicken",
    # French
    "tous droits r\u00e9serv\u00e9s", "politique de confidentialit\u00e9", "mentions l\u00e9gales", "conditions d'utilisation", "utilise des cookies", "accepter les cookies", "activer javascript", "notre newsletter", "lire la suite", "cliquez ici",
    # Spanish
    "todos los derechos reservados", "pol\u00edtica de privacidad", "aviso legal", "condiciones de uso", "utiliza cookies", "aceptar cookies", "leer m\u00e1s", "haga clic aqu\u00ed",
    # Italian
    "tutti i diritti riservati", "informativa sulla privacy", "condizioni d'uso", "utilizza cookie", "accetta i cookie", "leggi tutto", "clicca qui",
    # Portuguese
    "todos os direitos reservados", "pol\u00edtica de privacidade", "termos de uso", "leia mais", "clique aqui",
    # Dutch
    "alle rechten voorbehouden", "privacybeleid", "gebruiksvoorwaarden", "lees meer", "klik hier",
)
BOILERPLATE = "|".join(re.escape(p).replace(r"\ ", " ") for p in PHRASES)
#: Words of a line that one boilerplate phrase makes boilerplate.
PROSE_WORDS = 12
MARK_AT_END = r"[.!?:;…\"'»)\]][\x20\x09-\x0D]*$"
SYMBOL = r"[#*$%&|<>]"


@lru_cache(maxsize=1)
def _patterns():
    return re.compile(WORD).findall, re.compile(BOILERPLATE).findall, re.compile(MARK_AT_END).search


@lru_cache(maxsize=1)
def _phrases() -> list[bytes]:
    return [p.encode() for p in PHRASES]


def may_be_boilerplate(text: str) -> bool:
    """Whether a text holds any of PHRASES: most hold none, and their lines are not searched."""
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes.lower() moves A-Z only
    return any(p in data for p in _phrases())


def line_fails(line: str, n_words: int, repeats: bool, suspect: bool) -> bool:
    """Whether a line with n_words > 0 words fails; suspect: whether it may hold one of PHRASES."""
    from .common import ASCII_LOWER

    _, boilerplate, marked = _patterns()
    pipes = line.count("|")
    return bool(
        repeats
        or (pipes and 4 * pipes >= n_words)
        or 2 * (line.count("#") + line.count("*") + line.count("$") + line.count("%") + line.count("&") + line.count("<") + line.count(">")) > n_words
        or (n_words >= 3 and 2 * line.count("!!") >= n_words)
        or (suspect and (found := len(boilerplate(line.translate(ASCII_LOWER)))) and PROSE_WORDS * found >= n_words)
        or (n_words <= 3 and not marked(line))
    )


def repeated_words(words: list[str]) -> int:
    """Words in five-word windows that are found twice or more in the text, exactly: ranks of pairs, then of fours, then of fives."""
    import numpy as np

    n = len(words)
    if n < 6:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], "i8")
    if len(number) == n:
        return 0

    def ranks(left, right):
        keys = left * (int(right.max()) + 1) + right
        return np.unique(keys, return_inverse=True)[1]

    two = ranks(ids[:-1], ids[1:])
    four = ranks(two[:-2], two[2:])
    five, counts = np.unique(four[:-1] * (int(ids.max()) + 1) + ids[4:], return_inverse=True, return_counts=True)[1:]
    twice = counts[five] > 1
    if not twice.any():
        return 0
    ends = np.zeros(n + 1, "i8")
    at = np.flatnonzero(twice)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + 5, -1)
    return int((np.cumsum(ends)[:n] > 0).sum())


def judge(text: str) -> tuple[int, int, int, int, int, bool, bool]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of a whole text."""
    find, _, _ = _patterns()
    suspect = may_be_boilerplate(text)
    words: list[str] = []
    seen: set[str] = set()
    total = lost = dup = 0
    for line in text.split("\n"):
        own = find(line)
        if own:
            repeats = line in seen
            seen.add(line)
            dup += repeats
            chars = sum(map(len, own))
            total += chars
            if line_fails(line, len(own), repeats, suspect):
                lost += chars
            words += own
    n = len(words)
    again = repeated_words(words)
    failed = n < 10 or 100 * again > 20 * n
    symbols = sum(map(text.count, "#*$%&|<>"))
    return n, total, symbols, dup, again, failed, not failed and 2 * lost <= total


def clean(text: str) -> str:
    """The text without its failing lines; lines without words stay."""
    find, _, _ = _patterns()
    suspect = may_be_boilerplate(text)
    seen: set[str] = set()
    out = []
    for line in text.split("\n"):
        own = find(line)
        if own:
            repeats = line in seen
            seen.add(line)
            if line_fails(line, len(own), repeats, suspect):
                continue
        out.append(line)
    return "\n".join(out)


def apply_rules(df: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each document: counts, base_failed and kept; with_text adds `cleaned`, the text without failing lines. Narrow."""
    import pyarrow as pa

    short_batches(df.sparkSession)
    fields = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
    kinds = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    if with_text:
        fields, kinds = [*fields, ("cleaned", pa.string())], kinds + ", cleaned string"
    out = pa.schema(fields)

    def run(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), texts(batch, "text"))
            yield from batches_of(((k, *judge(t), *([clean(t)] if with_text else [])) for k, t in rows), out)

    return df.select(df["doc_id"].cast("long"), "text").mapInArrow(run, kinds)
