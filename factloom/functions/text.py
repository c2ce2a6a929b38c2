"""Text functions as Columns. Index-time and query-time normalisation are the same functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the keyword index.
STOP = """a an the and or but if then than that this these those is are was were be been
being of in on at to for from by with without into over under as it its his her their our your
my we you they he she i not no do does did done can could should would may might must will
shall have has had having each other more most some any all both few many much such only own
same so too very just also however therefore thus which who whom whose what when where why how
function method class value values return returns used use uses using set sets get gets""".split()
# The stop words of the relevance test, of petals and of emphasis.
STOP_RELEVANCE = "the a an of in on and or to for with by is are be as at from that this it its can may has have".split()
STOP_PETAL = "the a an of in on and or to for with by is are was were be as at from that this it its one patient week weeks".split()
STOP_EMPHASIS = "the a an of in and to for with by is are was were that this it no not all one four from on as at which".split()
# The stop words of the stemmed search (English function words).
STOP_SEARCH = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
did doing a an the and but if or because as until while of at by for with about against between into through during before after above
below to from up down in out on off over under again further then once here there when where why how all any both each few more most
other some such no nor not only own same so than too very s t can will just don should now""".split()
# Suffixes of the Porter stemmer and what takes their place, and the letters of its measure.
PORTER_2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
PORTER_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
PORTER_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
HAS_VOWEL = f"^(?:{CONSONANTS})?[aeiouy]"
OVER_0, ONE, OVER_1 = f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}", f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}(?:{VOWELS})?$", f"^(?:{CONSONANTS})?{VOWELS}{CONSONANTS}{VOWELS}{CONSONANTS}"
SHORT = f"^{CONSONANTS}[aeiouy][^aeiouwxy]$"
# Patterns of the index.
NUMBER = r"\b\d+(?:\.\d+)?%?\b"
VAGUE = r"(?i)^(?:this|it|the (?:code|file|module|function|script|document|paper))\b|\b(?:various|several|some|things?|stuff|etc|and so on|handles?|manages?|deals? with)\b"
TRIVIAL_ANCHOR = r"^\s*(?:import\s|from\s+[\w.]+\s+import\b|#include\b|require\s*\(|use\s+\w+::|package\s|using\s+\w+;|@?export\s*\{|const\s+\w+\s*=\s*require)"
TRIVIAL_TEXT = r"(?i)^(?:imports?\b|includes?\s+the\b|defines?\s+(?:a\s+)?(?:function|class|method|variable|constant)\s+(?:called|named)\b|declares?\s+(?:a\s+)?(?:function|class|variable|constant)\b|this\s+(?:line|statement)\s+)"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def depluralise(w) -> Column:
    """One plural ending less, by ordered rules that leave at least three letters."""
    w = col(w)
    n = F.length(w)
    two = w.endswith("ses") | w.endswith("shes") | w.endswith("ches") | w.endswith("xes") | w.endswith("zes")
    return (
        F.when(w.endswith("ies") & (n >= 6), F.concat(cut(w, 3), F.lit("y")))
        .when(two & (n >= 5), cut(w, 2))
        .when(w.endswith("ss") | w.endswith("us") | w.endswith("is"), w)
        .when(w.endswith("es") & (n >= 5), cut(w, 1))
        .when(w.endswith("s") & (n >= 4), cut(w, 1))
        .otherwise(w)
    )


def strip_suffix(w: Column, d: Column) -> Column:
    """d, the form without plural, if it differs from the word; else the word without -ing or -ed."""
    n = F.length(w)
    return F.when(d != w, d).when(w.endswith("ing") & (n >= 6), cut(w, 3)).when(w.endswith("ed") & (n >= 5), cut(w, 2)).otherwise(w)


def drop_e(w: Column) -> Column:
    return F.when((F.length(w) > 3) & w.endswith("e"), cut(w, 1)).otherwise(w)


def keeps(w: Column) -> Column:
    return (F.length(w) <= 3) | w.rlike("^[0-9]+$")


def stem(w) -> Column:
    """The index's stem of one word; short words and digits stay."""
    w = col(w)
    return F.when(keeps(w), w).otherwise(drop_e(strip_suffix(w, depluralise(w))))


def stems(words: Column) -> Column:
    """Stems of an array of words. Each step is a transform of its own, so that a word's forms are worked out once; outside of an array a
    filter on the stem would be pushed below its projection and work it out again."""
    forms = F.transform(words, lambda w: F.struct(w.alias("w"), depluralise(w).alias("d"), keeps(w).alias("k")))
    bare = F.transform(forms, lambda f: F.struct(F.when(f["k"], f["w"]).otherwise(strip_suffix(f["w"], f["d"])).alias("s"), f["k"].alias("k")))
    return F.transform(bare, lambda b: F.when(b["k"], b["s"]).otherwise(drop_e(b["s"])))


def split_ident(s) -> Column:
    """Lower-case words of an identifier or of prose: split at other than ASCII letters and digits, and at camel-case borders."""
    spaced = F.regexp_replace(col(s), "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    low = F.translate(spaced, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "")


def words(s) -> Column:
    """Lower-case runs of letters and digits, as full text sees them."""
    return F.filter(F.split(F.lower(F.coalesce(col(s), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def question_terms(s) -> Column:
    """A question's distinct terms for full text: words of letters, digits and underscores, two or more, that are no stop words, as stems."""
    terms = F.filter(F.split(F.lower(F.coalesce(col(s), F.lit(""))), r"[^\p{L}\p{N}_]+"), indexable)
    return F.array_distinct(stems(F.array_distinct(terms)))


def search_words(s) -> Column:
    """The words of the stemmed search: lower-case ASCII letters, without its stop words."""
    return F.filter(F.split(F.lower(F.coalesce(col(s), F.lit(""))), "[^a-z]+"), lambda w: (w != "") & ~w.isin(STOP_SEARCH))


def porter(words: Column) -> Column:
    """Porter stems of an array of lower-case words. Each step is a transform of its own, as in stems(), and looks at what the one before
    has left. Words of one or two letters pass the steps as capitals, which no rule knows. Meant for a vocabulary."""

    def replaced(w: Column, by: dict[str, str], measure: str) -> Column:
        """The longest suffix that fits decides, and goes if what is left measures enough."""
        out = None
        for suffix in sorted(by, key=len, reverse=True):
            left = cut(w, len(suffix))
            enough = left.rlike(measure)
            if suffix == "ion":
                enough = enough & left.rlike("[st]$")
            made = F.when(enough, F.concat(left, F.lit(by[suffix]))).otherwise(w)
            out = F.when(w.endswith(suffix), made) if out is None else out.when(w.endswith(suffix), made)
        return out.otherwise(w)

    def bare(w: Column) -> Column:
        """A word that has lost -ed or -ing."""
        return F.when(w.rlike("(?:at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(r"([^aeiou])\1$") & ~w.rlike("[lsz]$"), cut(w, 1)).when(w.rlike(SHORT), F.concat(w, F.lit("e"))).otherwise(w)

    def without_ending(w: Column) -> Column:
        cuts = F.when(w.endswith("ed") & cut(w, 2).rlike(HAS_VOWEL), cut(w, 2)).when(w.endswith("ing") & cut(w, 3).rlike(HAS_VOWEL), cut(w, 3))
        return F.when(w.endswith("eed"), F.when(cut(w, 3).rlike(OVER_0), cut(w, 1)).otherwise(w)).otherwise(F.coalesce(bare(cuts), w))

    steps = [
        lambda w: F.when(F.length(w) <= 2, F.upper(w)).when(w.startswith("y"), F.concat(F.lit("Y"), F.substring(w, F.lit(2), F.length(w)))).otherwise(w),
        lambda w: F.when(w.endswith("sses") | w.endswith("ies"), cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), cut(w, 1)).otherwise(w),
        without_ending,
        lambda w: F.when(w.endswith("y") & cut(w, 1).rlike(HAS_VOWEL), F.concat(cut(w, 1), F.lit("i"))).otherwise(w),
        lambda w: replaced(w, PORTER_2, OVER_0),
        lambda w: replaced(w, PORTER_3, OVER_0),
        lambda w: replaced(w, dict.fromkeys(PORTER_4, ""), OVER_1),
        lambda w: F.when(w.endswith("e") & (cut(w, 1).rlike(OVER_1) | (cut(w, 1).rlike(ONE) & ~cut(w, 1).rlike(SHORT))), cut(w, 1)).otherwise(w),
        lambda w: F.when(w.endswith("ll") & w.rlike(OVER_1), cut(w, 1)).otherwise(w),
        F.lower,
    ]
    for step in steps:
        words = F.transform(words, step)
    return words


def stop_array(words) -> Column:
    return F.array(*map(F.lit, words))


def keyword_words(text, snippet=None) -> list[tuple[float, Column]]:
    """(weight, array of words) of a claim, as they stand: quoted identifiers 3.0 and their parts 2.0, identifiers of the snippet 2.5 and their
    parts 1.5, numbers 2.0, prose words 1.0."""
    text = F.coalesce(col(text), F.lit(""))
    quoted = F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    sources = [(3.0, F.transform(quoted, lambda q: F.lower(F.trim(q)))), (2.0, F.flatten(F.transform(quoted, split_ident))), (2.0, numbers), (1.0, split_ident(F.regexp_replace(text, "`[^`]*`", " ")))]
    if snippet is not None:
        idents = F.regexp_extract_all(F.coalesce(col(snippet), F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
        sources += [(2.5, F.transform(idents, lambda q: F.lower(q))), (1.5, F.flatten(F.transform(idents, split_ident)))]
    return sources


def keyword_sources(text, snippet=None) -> Column:
    """Array of (keyword, weight) of a claim, some more than once, and some stop words."""
    return F.concat(*(F.transform(stems(F.filter(F.array_distinct(words), indexable)), _weighted(weight)) for weight, words in keyword_words(text, snippet)))


def _weighted(weight: float):
    return lambda w: F.struct(w.alias("keyword"), F.lit(weight).alias("weight"))


def indexable(word) -> Column:
    """Whether the index takes a word: two letters or more, and no stop word."""
    word = col(word)
    return (F.length(word) >= 2) & ~word.isin(STOP)


def norm_anchor(s) -> Column:
    return F.trim(F.regexp_replace(F.replace(col(s), F.lit("`"), F.lit("")), r"\s+", " "))


def norm_claim(s) -> Column:
    """Lower case, punctuation and white space to single spaces, ends not trimmed again."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(s))), r"\p{Punct}+", " "), r"\s+", " ")


def norm_text_key(s) -> Column:
    return F.lower(F.trim(F.regexp_replace(col(s), r"(?U)\W+", " ")))


def claim_tokens(s) -> Column:
    """Distinct tokens of a normalised claim; an empty last token doesn't count. The claim is normalised once, as the one element of an
    array."""
    none = F.array().cast("array<string>")
    tokens = F.transform(F.array(norm_claim(s)), lambda x: F.when(x == "", none).otherwise(F.array_distinct(F.split(F.regexp_replace(x, " $", ""), " "))))
    return F.element_at(tokens, 1)


def plain_tokens(s, stop) -> Column:
    """Distinct lower-case ASCII words without the given stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(col(s), F.lit(""))), "[^a-z0-9 ]", " "), r"\s+")
    return F.array_except(F.array_distinct(words), stop_array(["", *stop]))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def est_tokens(s) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(s)) / 4)).cast("long")


def specificity(text, snippet=None) -> Column:
    """How much a claim pins down, from 0 to 1."""
    text = col(text)
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    s = F.when(text.rlike("`[^`]+`"), 0.25).otherwise(0.0) + F.when(text.rlike(NUMBER), 0.2).otherwise(0.0)
    s = s + F.when(words.between(5, 28), 0.15).otherwise(0.0) - F.when(text.rlike(VAGUE), 0.35).otherwise(0.0)
    if snippet is not None:
        s = s + F.when(F.length(F.coalesce(col(snippet), F.lit(""))) > 0, 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s + 0.1))


def trust(status) -> Column:
    """Weight of a status in ranking; the gate is the status itself."""
    status = col(status)
    out = F.lit(0.3)
    for name, w in (("STALE", 0.0), ("REFUTED", 0.0), ("UNSUPPORTED", 0.15), ("PENDING", 0.4), ("NEEDS_AGENT", 0.5), ("DRIFTED", 0.9), ("CONFIRMED", 1.0)):
        out = F.when(status == name, w).otherwise(out)
    return out


def utility(status, spec, idf, hits, helpful, unhelpful) -> Column:
    hits, helpful, unhelpful = (F.coalesce(col(c), F.lit(0)) for c in (hits, helpful, unhelpful))
    fb = F.when(helpful + unhelpful > 0, F.try_divide(helpful, helpful + unhelpful)).when(hits > 0, 0.45).otherwise(0.5)
    t = trust(status)
    return F.when(t == 0, 0.0).otherwise(F.round(t * (0.45 * col(spec) + 0.30 * F.least(col(idf), F.lit(1.0)) + 0.25 * fb), 4))


def status_allowed(status, include_unproven: bool = False) -> Column:
    """The one gate: blocked statuses never pass, unproven ones on request."""
    status = col(status)
    gate = ~status.isin("REFUTED", "STALE")
    return gate if include_unproven else gate & ~status.isin("NEEDS_AGENT", "PENDING", "UNSUPPORTED")
