"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format.

Types: email, phone, card, ip (4 and 6), mac, iban, ssn, secret (tokens, keys and passwords), name (with a title, with a known first
name and a surname, or two capitalised words that the text around them calls a name: "my name is", a closing formula, "said" ...). A
replacement is a keyed permutation (a Feistel network over the entity's own characters, each within its class: digit, vowel or
consonant of a script; case and punctuation stay). It is a bijection on entities of one format, so that distinct entities stay
distinct and one entity is replaced alike in all documents, whatever its case or phone layout; no table of entities is needed for
that. Cards keep their first digit and whether their Luhn sum holds, IBANs their country and a right check sum, addresses keep whether
they are public, private or reserved, first names come from a list of their gender and script, and surnames that return alone in a
document are replaced there too.

Collision checks run over the whole corpus, on canonical forms (lower case, digits without layout), so that all spellings of an entity
move together: a replacement that equals any entity that was found, or another's replacement, is drawn anew under the next key until
there is none. What most_attempts rounds leave is settled format by format: drawn on until it is free where the format has room for
all, and else (more than half of its values are entities) each of its entities is replaced by the next one in a keyed order, so that
they stay distinct and none is itself; only there may a replacement be another entity. So may first names of the closed lists, which are
permuted and are left out of the check; names that no list has keep their gender unknown and are permuted among themselves. A value without letters or digits of CLASSES has one form only and stays. Such draws are few;
they are broadcast if they are MOST_BROADCAST or fewer, else joined. Tables that hold entities are deleted before anonymise returns;
what is read later holds keyed digests.

Defined results: null and empty texts stay as they are; a null key column is kept; repeated rows are replaced alike; of entities that
overlap the first, then the longest, counts, of equal ones the type that find() looks for first; texts are read whole at any length;
an empty table gives no rows; all further columns are kept, and n_chars, where there is one, follows the text.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, short_batches, spare, texts, written

MOST_BROADCAST = 50_000
ROUNDS = 10

# First names by script and gender, and titles by gender.
FIRST = {
    ("latin", "m"): "James Robert Michael William David Richard Joseph Charles Christopher Daniel Matthew Anthony Mark Paul Steven Andrew Kevin Brian George Peter Klaus Jürgen Pierre Jacques Carlos Miguel José Luis "
    "John Thomas Donald Ronald Kenneth Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Raymond Dennis Jerry Tyler Aaron Adam Nathan Henry Douglas Zachary Kyle Walter Ethan Jeremy Harold Keith Roger Arthur Terry Lawrence Sean Albert Jesse Bryan Bruce Ralph Philip Simon Martin Oliver Harry Graham Colin Neil "
    "Hans Heinz Jürg Wolfgang Werner Uwe Günter Günther Gerhard Horst Helmut Manfred Dieter Bernd Jens Stefan Frank Ralf Jörg Matthias Markus Andreas Michel Torsten Thorsten Sven Lukas Felix Jonas Tobias Florian Sebastian Christian Dirk Holger Rainer Karl Kurt Friedrich Wilhelm Johannes Johann Ulrich Volker "
    "Jean François Philippe Nicolas Laurent Julien Olivier Thierry Alain Bernard Marcel André Henri Louis Gérard Christophe Stéphane Guillaume Antoine Mathieu Sébastien Frédéric Éric Didier Yves René Étienne Benoît Luc Hugo "
    "Juan Antonio Manuel Francisco Javier Jesús Pedro Alejandro Rafael Fernando Sergio Pablo Jorge Alberto Diego Álvaro Raúl Enrique Ramón Vicente Andrés Joaquín Eduardo Ignacio Óscar Rubén Tomás Santiago Mateo".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Emily Michelle Laura Julia Sophie Claudia Sabine Camille Chloé Carmen Lucía María Sofía Paula "
    "Anna Betty Dorothy Ashley Kimberly Donna Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Emma Pamela Nicole Samantha Katherine Christine Helen Debra Rachel Carolyn Janet Maria Catherine Heather Diane Olivia Julie Joyce Victoria Kelly Christina Joan Evelyn Lauren Judith Andrea Hannah Megan Cheryl Jacqueline Martha Madison Teresa Gloria Sara Janice Ann Kathryn Abigail Sophia Alice Charlotte Isabella Lucy Fiona "
    "Ursula Monika Petra Gabriele Renate Helga Karin Brigitte Ingrid Erika Andrea Gisela Susanne Birgit Martina Heike Angelika Silke Anja Katja Katrin Kathrin Stefanie Nadine Tanja Sonja Ute Elke Lena Lea Johanna Franziska Elisabeth Christa Hannelore Heidi Greta Frieda "
    "Marie Nathalie Isabelle Sylvie Catherine Françoise Monique Martine Valérie Véronique Céline Aurélie Émilie Hélène Élise Élodie Juliette Manon Léa Chantal Jeanne Nicole Jacqueline Anne Louise Amélie Inès Mathilde Pauline "
    "Ana Isabel Pilar Teresa Cristina Dolores Rosa Mercedes Francisca Antonia Marta Elena Raquel Beatriz Silvia Rocío Inés Alba Irene Nuria Sara Andrea Alicia Marina Julieta Valentina Camila Gabriela".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Владимир Павел".split(),
    ("cyrillic", "f"): "Мария Анна Елена Ольга Наталья Татьяна Ирина Екатерина Светлана Юлия".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα".split(),
}
FIRST = {group: list(dict.fromkeys(names)) for group, names in FIRST.items()}
TITLES = {"Mr": "m", "Sir": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Dr": "", "Prof": "", "Professor": "", "Doctor": ""}
# Letters by class; a letter is replaced within its class.
CLASSES = ("0123456789", "aeiouy", "bcdfghjklmnpqrstvwxz", "áàâäãåéèêëíìîïóòôöõúùûüýÿæœø", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουωάέήίόύώ", "βγδζθκλμνξπρστφχψ")

# Words that end a stretch before a name, and verbs that follow one, each with its own space or sign.
CUES = tuple(
    "my name is|name is|name:|named|i am|i'm|signed|signed,|signed:|sincerely,|regards,|wishes,|cheers,|thanks,|yours,|contact|contact:|attn:|attention:|dear|author:|written by|posted by|sent by|from:|to:|cc:|patient|patient:|customer:|employee:|client:"
    "|name ist|ich heiße|heißt|grüßen|grüße|kontakt:|je m'appelle|m'appelle|s'appelle|nom est|nom:|cordialement,|contacter|me llamo|se llama|nombre es|nombre:|saludos,|atentamente,|меня зовут|зовут|имя:".split("|")
)
SAYS = tuple(" said| says| wrote| writes| told| asked| replied| added| explained| answered|, who | sagte| schrieb| a dit| écrit| dijo| escribió| сказал| написал".split("|"))
# Words that open a sentence and no name.
OPENERS = frozenset("The Then Later But And So When After Before In On At As Yet Now Today Yesterday Once Here There Also Der Die Das Und Aber Dann Le La Les Et Mais Puis El Los Las Pero Luego".split())
# What stands before a secret, and what announces a phone number of seven digits.
SECRET_KEYS = tuple("token secret passwd password passwort kennwort contraseña pwd passphrase apikey api_key api-key accesskey access_key access-key privatekey private_key private-key auth".split())
CALLS = tuple(f"{word}{rest} " for word in "call phone tel telephone dial ring mobile cell fax".split() for rest in ("", " at", " on", " me at", " us at", ".", ":"))
# What stands before and after long numbers that are no phone's, and words that begin or end the names of places.
COUNTED = (" id", " id:", " no.", " no", " number", " order", " ref", " ref:", " isbn", "#", " nr.", " nr")
UNITS = tuple(f" {u}" for u in "byte item row token user record file line event view entr year second ms people dollar euro unit time row page word".split())
PLACES = frozenset("New San Los Las Saint North South East West Upper Lower Great United Wall Street City River Lake Island County Bank University Party Church Times Post".split())
# Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

U, L = "A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΩА-ЯЁ", "a-zß-öø-ÿά-ώα-ωа-яё"
EMAIL = re.compile(r"(?<![\w.+-])[\w+-][\w.+-]*@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}(?![\w-])")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?!\w|\.\d)")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
MAC = re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![\w:-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{3,4}(?![\w-]|\.\d)")
PLUS = re.compile(r"(?<![\w+])\+\d(?:[ .()-]{0,2}\d){6,14}(?!\w)")
NATIONAL = re.compile(r"(?<![\w.+/-])(?:\(0[1-9]\d{1,3}\)|0[1-9]\d{1,3})[ /-]\d{3,4}(?:[ -]?\d{3,4})?(?![\w-]|[./]\d)")
TEN = re.compile(r"(?<![\w.+-])1?[2-9]\d{9}(?![\w-]|\.\d)")
SEVEN = re.compile(r"(?<![\w.+-])[2-9]\d\d-\d{4}(?![\w-]|\.\d)")
CARD = re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w-])")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
SIGN = re.compile(r"[:=](?=[ \t]*[\"']?([A-Za-z0-9+/_.~=-]{8,}))")
BEARER = re.compile(r"(?<!\w)[Bb]earer +([A-Za-z0-9._~+/=-]{16,})")
SAID = re.compile(r"(?i)(?<!\w)(?:password|passwort|passphrase|kennwort|contraseña|token|secret|api key) (?:is|ist|es|was)[:]? +[\"']?((?=[A-Za-z0-9+/_.~=!@#$%^&*-]*\d)[A-Za-z0-9+/_.~=!@#$%^&*-]{8,}[A-Za-z0-9])")
SAID_OF = ("passw", "passphrase", "kennwort", "contraseña", "token", "secret", "api key")
LOWER = re.compile(r"(?<!\w)[Mm]y name is ([a-z]+)(?: ([a-z]+))?(?!\w)")
BARE = re.compile(r"(?<!\w)(?:eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}(?:\.[A-Za-z0-9_-]*)?|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)")
NAME = re.compile(rf"(?<!\w)[{U}][{L}]+\.?(?: (?:(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Mme)\. )?[{U}][{L}]+(?:-[{U}][{L}]+)?){{1,3}}")
WORDS = re.compile(rf"(?<!\w)[{U}][{L}]+(?!\w)")
MAY_HOLD = re.compile(r"[0-9@]|::")

_TYPES = [(c, i) for i, alphabet in enumerate(CLASSES) for c in alphabet]
_CLASS = {c: i for c, i in _TYPES}
_PLACE = {c: alphabet.index(c) for alphabet in CLASSES for c in alphabet}
_FIRST = {n: k for k, names in FIRST.items() for n in names}
_LISTED = {**{n: n for n in _FIRST}, **{n.lower(): n for n in _FIRST}}
_OPENING = frozenset(c for c in CUES if c.isalpha())


def session_key(spark) -> str:
    """The key of the surrogates: the session's setting factloom.pii.key; where it is unset, one is drawn at random for the session. Whoever
    has the key can undo the replacements, so a run that others are to agree with has to name a secret one."""
    key = spark.conf.get("factloom.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("factloom.pii.key", key)
    return key


def luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


@lru_cache(maxsize=4096)
def _secret(key: bytes, tweak: str) -> bytes:
    return hmac.new(key, tweak.encode(), hashlib.sha256).digest()


def permuted(values: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed bijection on the mixed-radix numbers of the given sizes: each half in turn is moved by a function of the other."""
    own = _secret(key, f"{tweak}|{sizes}") if len(sizes) <= 40 else hmac.new(key, f"{tweak}|{sizes}".encode(), hashlib.sha256).digest()
    cut = len(sizes) // 2
    halves, limits = [0, 0], [1, 1]
    for side, part in enumerate((slice(0, cut), slice(cut, None))):
        for v, n in zip(values[part], sizes[part]):
            halves[side], limits[side] = halves[side] * n + v, limits[side] * n
    for r in range(ROUNDS):
        other = halves[1 - r % 2]
        moved = hashlib.sha512(own + bytes([r]) + other.to_bytes((other.bit_length() + 7) // 8 or 1, "big")).digest()
        while len(moved) * 8 < limits[r % 2].bit_length() + 64:
            moved += hashlib.sha512(own + moved).digest()
        halves[r % 2] = (halves[r % 2] + int.from_bytes(moved, "big")) % limits[r % 2]
    out: list[int] = []
    for side, part in ((1, sizes[cut:]), (0, sizes[:cut])):
        v, rest = halves[side], []
        for n in reversed(part):
            v, d = divmod(v, n)
            rest.append(d)
        out = rest[::-1] + out
    return out


def shaped(text: str, key: bytes, tweak: str, alphabets: tuple[str, ...] | None = None) -> str:
    """The text with its letters and digits permuted, each within its class; case and all other signs stay."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    if alphabets:
        kind = {c: i for i, a in enumerate(alphabets) for c in a}
        lists, of = alphabets, kind.get
    else:
        lists, of = CLASSES, _CLASS.get
    at = [(i, k) for i, c in enumerate(low) if (k := of(c)) is not None]
    if not at:
        return text
    new = permuted([lists[k].index(low[i]) for i, k in at], [len(lists[k]) for _, k in at], key, tweak)
    out = list(text)
    for (i, k), v in zip(at, new):
        c = lists[k][v]
        out[i] = c.upper() if text[i] != low[i] and len(c.upper()) == 1 else c
    return "".join(out)


def _digits(value: str, new: str) -> str:
    """New digits in the layout of the value."""
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _lead(phone: str) -> int:
    """Digits of a phone's country code, whatever its layout; without a plus the 0 of a national number, if it has one."""
    digits = "".join(c for c in phone if c.isdigit())
    return int(digits[0] == "0") if phone[0] != "+" else 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3


def _low(text: str) -> str:
    """Lower case, character by character."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _check_digits(country: str, rest: str) -> str:
    """The two check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02}"


def canonical(kind: str, value: str) -> str:
    """What all spellings of an entity have in common: the case of letters doesn't count but in secrets, nor do the layouts of numbers."""
    if kind in ("phone", "card"):
        return ("+" if value[0] == "+" else "") + "".join(c for c in value if c.isdigit())
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    if kind == "mac":
        return value.lower().replace("-", ":")
    return value if kind in ("secret", "first") else _low(value)


def like(kind: str, value: str, drawn: str) -> str:
    """A canonical surrogate in the spelling of the value."""
    if kind in ("phone", "card"):
        return _digits(value, drawn.lstrip("+"))
    if kind == "iban":
        it = iter(drawn)
        return "".join(" " if c == " " else next(it) for c in value)
    if kind == "ip6":
        new = str(ipaddress.IPv6Address(drawn)) if "::" in value else ":".join(f"{int(x, 16):x}" for x in drawn.split(":"))
        new = drawn if len(value) == 39 else new
        return new.upper() if value.upper() == value and value.lower() != value else new
    if kind == "mac":
        drawn = drawn.replace(":", value[2])
        return drawn.upper() if value.upper() == value else drawn
    return drawn if kind in ("secret", "first") else "".join(c.upper() if v != _low(v) and len(c.upper()) == 1 else c for v, c in zip(value, drawn))


def _band(address: int) -> str:
    a, b = address >> 24, address >> 16 & 255
    if a == 10 or a == 172 and 16 <= b < 32 or a == 192 and b == 168:
        return "private"
    return "reserved" if a in (0, 127) or a >= 224 or a == 169 and b == 254 else "public"


def first_name(name: str, key: bytes) -> str:
    """The next name of its gender and script in a keyed order: never itself, and no two names meet. A name that no list has is permuted
    among such names, so that it doesn't meet one of a list, either."""
    if name in _LISTED:
        listed = _LISTED[name]
        new = _successors(_FIRST[listed], key)[listed]
        return new if name == listed else new.lower()
    while True:
        name = shaped(name, key, "first")
        if name not in _LISTED:
            return name


@lru_cache(maxsize=64)
def _successors(group: tuple[str, str], key: bytes) -> dict[str, str]:
    order = sorted(FIRST[group], key=lambda n: hmac.new(key, f"{group}{n}".encode(), hashlib.sha256).digest())
    return dict(zip(order, [*order[1:], order[0]]))


def surrogate(kind: str, value: str, key: str, attempt: int = 0) -> str:
    """The replacement of one entity under a key; attempt: how often it had to be drawn anew."""
    own = _secret(key.encode(), f"attempt {attempt}")
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        kept = labels[-2:] if len(labels) > 1 and labels[-2].lower() == "example" else labels[-1:]
        head = ".".join(labels[: len(labels) - len(kept)])
        domain = ".".join(([shaped(head, own, "domain")] if head else []) + kept)
        return shaped(local, own, f"local@{head.lower()}.{'.'.join(kept).lower()}") + "@" + domain
    if kind == "phone":
        digits = "".join(c for c in value if c.isdigit())
        lead = _lead(value)
        least = int(not lead)  # a number that begins with neither a plus nor a 0 goes to such a number
        new = permuted([int(digits[lead]) - least, *(int(c) for c in digits[lead + 1 :])], [10 - least] + [10] * (len(digits) - lead - 1), own, f"phone{digits[:lead]}")
        return _digits(value, digits[:lead] + str(new[0] + least) + "".join(map(str, new[1:])))
    if kind == "card":
        digits = "".join(c for c in value if c.isdigit())
        if luhn(digits):
            body = digits[0] + "".join(map(str, permuted([int(c) for c in digits[1:-1]], [10] * (len(digits) - 2), own, f"card{digits[0]}")))
            return _digits(value, next(body + c for c in "0123456789" if luhn(body + c)))
        while True:  # walk the permutation to the next number whose sum doesn't hold either
            digits = digits[0] + "".join(map(str, permuted([int(c) for c in digits[1:]], [10] * (len(digits) - 1), own, f"number{digits[0]}")))
            if not luhn(digits):
                return _digits(value, digits)
    if kind == "ip":
        address = 0
        for x in value.split("."):
            address = address << 8 | int(x)
        band = _band(address)
        while True:
            a, b = permuted([address >> 16, address & 65535], [65536, 65536], own, f"ip {band}")
            address = a << 16 | b
            if _band(address) == band:
                return ".".join(str(address >> s & 255) for s in (24, 16, 8, 0))
    if kind == "secret":
        hexed = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
        fixed = re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-", value)
        head = fixed[0] if fixed else ""
        return head + shaped(value[len(head) :], own, f"secret{head}", ("0123456789abcdef",) if hexed else ("0123456789", "abcdefghijklmnopqrstuvwxyz"))
    if kind == "iban":
        at = canonical(kind, value)
        rest = shaped(at[4:], own, f"iban{at[:2]}", ("0123456789", "abcdefghijklmnopqrstuvwxyz"))
        return like(kind, value, at[:2] + _check_digits(at[:2], rest) + rest)
    if kind == "ip6":  # the first group tells what the address is for
        at = canonical(kind, value)
        return like(kind, value, at[:5] + shaped(at[5:], own, f"ip6{at[:5]}", ("0123456789abcdef",)))
    if kind == "mac":  # so does the first octet
        at = canonical(kind, value)
        return like(kind, value, at[:3] + shaped(at[3:], own, f"mac{at[:3]}", ("0123456789abcdef",)))
    if kind == "first":
        return first_name(value, own)
    if kind == "surname":
        # The end of a surname may show gender (Cyrillic, Greek); it stays.
        kept = 2 if len(value) > 4 and value[-1].lower() in "".join(CLASSES[5:]) else 0
        return shaped(value[: len(value) - kept], own, f"surname{value[len(value) - kept :].lower()}") + value[len(value) - kept :]
    return shaped(value, own, kind)  # ssn


def form(kind: str, value: str) -> tuple[str, int]:
    """The format that the surrogates of an entity (in its canonical form) share with it, and how many values it has."""

    def shape(text: str, alphabets: tuple[str, ...] = CLASSES):
        of, signs, n = {c: i for i, a in enumerate(alphabets) for c in a}, [], 1
        for c in text:
            low = c.lower() if len(c.lower()) == 1 else c
            if (k := of.get(low)) is None:
                signs.append(c)
            else:
                signs.append(f"<{k}{'' if c == low else 'U'}>")
                n *= len(alphabets[k])
        return "".join(signs), n

    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        kept = labels[-2:] if len(labels) > 1 and labels[-2].lower() == "example" else labels[-1:]
        (a, n), (b, m) = shape(local), shape(".".join(labels[: len(labels) - len(kept)]))
        return f"{a}@{b}|{'.'.join(kept)}", n * m
    digits = "".join(c for c in value if c.isdigit())
    if kind == "phone":
        lead = _lead(value)
        return f"{digits[:lead]}|{_digits(value, '0' * len(digits))}", (10 if lead else 9) * 10 ** (len(digits) - lead - 1)
    if kind == "card":
        holds = luhn(digits)
        return f"{digits[0]}|{holds}|{_digits(value, '0' * len(digits))}", (1 if holds else 9) * 10 ** (len(digits) - 2)
    if kind == "ip":
        private, reserved = (1 << 24) + (1 << 20) + (1 << 16), 34 * (1 << 24) + (1 << 16)
        band = _band(int.from_bytes(bytes(map(int, value.split("."))), "big"))
        return band, {"private": private, "reserved": reserved, "public": (1 << 32) - private - reserved}[band]
    if kind == "secret":
        hexed = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
        fixed = re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-", value)
        head = fixed[0] if fixed else ""
        own, n = shape(value[len(head) :], ("0123456789abcdef",) if hexed else ("0123456789", "abcdefghijklmnopqrstuvwxyz"))
        return f"{head}|{bool(hexed)}|{own}", n
    if kind in ("iban", "ip6", "mac"):
        lead = {"iban": 4, "ip6": 5, "mac": 3}[kind]
        own, n = shape(value[lead:], ("0123456789", "abcdefghijklmnopqrstuvwxyz") if kind == "iban" else ("0123456789abcdef",))
        return f"{value[: 2 if kind == 'iban' else lead]}|{own}", n
    if kind == "surname":
        kept = 2 if len(value) > 4 and value[-1].lower() in "".join(CLASSES[5:]) else 0
        own, n = shape(value[: len(value) - kept])
        return f"{own}|{value[len(value) - kept :]}", n
    return shape(value)


def _told(text: str, start: int, end: int) -> bool:
    """Whether the words around a run of capitalised words say that it is a name."""
    before = (" " + text[max(0, start - 24) : start]).lower().rstrip()
    for cue in CUES:
        if before.endswith(cue) and not before[-len(cue) - 1 : -len(cue)].isalnum():
            return True
    return text.startswith(SAYS, end)


def _names(text: str):
    """(start, end, kind, value) of first names and surnames."""
    surnames: set[str] = set()
    for m in NAME.finditer(text):
        words, at = m[0].split(" "), m.start()
        title = words[0].rstrip(".") in TITLES
        told = False
        if words[0].endswith(".") and not title:
            continue  # the end of a sentence
        if not title and words[0] not in _FIRST:
            i = next((i for i, w in enumerate(words) if (w in _FIRST and i + 1 < len(words)) or w.rstrip(".") in TITLES), None)
            if i:
                at += sum(len(w) + 1 for w in words[:i])
                words = words[i:]
                title = words[0].rstrip(".") in TITLES
            else:
                told = _told(text, at, m.end()) and PLACES.isdisjoint(words)
                if not told and words[0].lower() in _OPENING and len(words) > 2:  # "Contact Aisha Khan", "Dear Aisha Khan"
                    at, words, told = at + len(words[0]) + 1, words[1:], True
                if told and words[0] in OPENERS:
                    at, words = at + len(words[0]) + 1, words[1:]
                if not told or words[-1] in surnames:  # a surname alone, which is found below
                    continue
        if title:
            at += len(words[0]) + 1
            words = words[1:]
        for n, w in enumerate(words[:3]):
            first = n < max(1, len(words) - 1) and (told or w in _FIRST and (len(words) > 1 or not title))
            if not first:
                surnames.add(w)
            yield at, at + len(w), "first" if first else "surname", w
            at += len(w) + 1
    if surnames:  # the same surname alone, elsewhere in the text
        for m in WORDS.finditer(text):
            if m[0] in surnames:
                yield m.start(), m.end(), "surname", m[0]


def _secrets(text: str):
    """(start, end, kind, value) of what is assigned to a key of SECRET_KEYS, in any case, with or without quotes and blanks."""
    for m in SIGN.finditer(text):
        end = m.start()
        while end and text[end - 1] in " \t":
            end -= 1
        if end and text[end - 1] in "\"'":
            end -= 1
        if text[max(0, end - 12) : end].lower().endswith(SECRET_KEYS):
            yield *m.span(1), "secret", m[1]
    if "earer " in text:
        for m in BEARER.finditer(text):
            yield *m.span(1), "secret", m[1]
    low = text.lower()
    if any(word in low for word in SAID_OF):
        for m in SAID.finditer(text):
            yield *m.span(1), "secret", m[1]


def _announced(text: str, start: int) -> bool:
    """Whether the words before a place announce a phone number."""
    before = " " + text[max(0, start - 20) : start].lower()
    return any(before.endswith(x) and not before[-len(x) - 1].isalnum() for x in CALLS)


def _counted(text: str, start: int, end: int) -> bool:
    """Whether the words around a long number say that it counts or names something else than a phone."""
    before = (" " + text[max(0, start - 12) : start]).lower().rstrip()
    return before.endswith(COUNTED) or text[end : end + 12].lower().startswith(UNITS)


def _is_ip6(text: str) -> bool:
    """Whether it is an address that says more than that there is none (::) and can't be a time of day."""
    if len(text) < 6 or not ("::" in text or text.count(":") == 7):
        return False
    try:
        return int(ipaddress.IPv6Address(text)) > 0xFFFF
    except ValueError:
        return False


def _is_iban(text: str) -> bool:
    at = text.replace(" ", "")
    return 15 <= len(at) <= 34 and _check_digits(at[:2], at[4:]) == at[2:4]


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities of a whole text, none overlapping: of those that do, the first and longest stays."""
    found = list(_secrets(text))  # these two need neither a digit nor '@'
    found += [(*m.span(), "secret", m[0]) for m in BARE.finditer(text)]
    if MAY_HOLD.search(text):
        if "@" in text:
            found += [(*m.span(), "email", m[0]) for m in EMAIL.finditer(text)]
        found += [(*m.span(), "ip", m[0]) for m in IP.finditer(text)]
        if ":" in text or "-" in text:
            found += [(*m.span(), "mac", m[0]) for m in MAC.finditer(text)]
            found += [(*m.span(), "ip6", m[0]) for m in IP6.finditer(text) if _is_ip6(m[0])]
        found += [(*m.span(), "iban", m[0]) for m in IBAN.finditer(text) if _is_iban(m[0])]
        found += [(*m.span(), "ssn", m[0]) for m in SSN.finditer(text)]
        for m in CARD.finditer(text):
            if luhn("".join(c for c in m[0] if c.isdigit())):  # any other long number is not a card's
                found.append((*m.span(), "card", m[0]))
        phones = [(*m.span(), "phone", m[0]) for m in PHONE.finditer(text)]
        fixed = {start for start, _, _, v in phones if "(" in v or v[:2] in ("+1", "+7")}  # plans whose numbers end where these do
        found += phones
        found += [(*m.span(), "phone", m[0]) for m in PLUS.finditer(text) if m.start() not in fixed]
        found += [(*m.span(), "phone", m[0]) for m in TEN.finditer(text) if not _counted(text, *m.span())]
        found += [(*m.span(), "phone", m[0]) for m in NATIONAL.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 12 and not _counted(text, *m.span())]
        found += [(*m.span(), "phone", m[0]) for m in SEVEN.finditer(text) if m[0][:3] == "555" or _announced(text, m.start())]
    found += _names(text)
    for m in LOWER.finditer(text) if "name is" in text else ():
        if m[1] in _LISTED and m[1].islower():  # a listed name in lower case, and the word after it
            found.append((*m.span(1), "first", m[1]))
            if m[2] and m[2].islower() and len(m[2]) > 3:
                found.append((*m.span(2), "surname", m[2]))
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def digest(key: str, kind: str, value: str) -> bytes:
    """A keyed digest that stands for an entity where tables outlive their step."""
    return hmac.new(key.encode(), f"{kind}|{value}".encode(), hashlib.sha256).digest()[:16]


def replace(text: str, key: str, again: dict | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and (start, end, kind) of each in it. again: {digest of an entity: (attempt, drawn)} of those that are
    drawn anew; drawn, in canonical form, counts where the attempt is -1."""
    pieces, spans, at, length = [], [], 0, 0
    for start, end, kind, value in find(text):
        attempt, drawn = again.get(digest(key, kind, canonical(kind, value)), (0, None)) if again else (0, None)
        new = like(kind, value, drawn) if attempt < 0 else surrogate(kind, value, key, attempt)
        pieces += [text[at:start], new]
        length += start - at
        spans.append((length, length + len(new), kind))
        length += len(new)
        at = end
    return "".join([*pieces, text[at:]]), spans


def entities(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, value) of every entity that is found in documents (doc_id, text), in canonical form. Narrow."""
    import pyarrow as pa

    short_batches(documents.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("value", pa.string())])

    def run(batches):
        for batch in batches:
            yield from batches_of(((k, kind, canonical(kind, value)) for k, t in zip(batch.column(0).to_pylist(), texts(batch, "text")) for _, _, kind, value in find(t)), out)

    return documents.select(documents["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, value string")


def collisions(found: DataFrame, key: str, most_attempts: int = 20) -> DataFrame:
    """(kind, value, attempt, drawn) of the distinct entities (kind, value), in canonical form, whose first draw collides with an entity or
    another's draw; drawn is what replaces them, attempt is -1 in formats that have no room for all. First names of the lists are left
    out: those are permuted. The table holds entities: its reader discards it."""
    import pyarrow as pa

    out = pa.schema([("kind", pa.string()), ("value", pa.string()), ("attempt", pa.int32()), ("drawn", pa.string())])
    kinds = "kind string, value string, attempt int, drawn string"

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")))
            yield from batches_of(((k, v, a, canonical(k, surrogate(k, v, key, a))) for k, v, a in rows), out)

    own = found.where((F.col("kind") != "first") | ~F.col("value").isin(list(_LISTED))).select("kind", "value").distinct()
    now = written(own.withColumn("attempt", F.lit(0)).mapInArrow(run, kinds), "drawn")
    for attempt in range(most_attempts + 1):
        taken = now.select(F.col("value").alias("drawn"), "kind").distinct()
        twice = now.groupBy("kind", "drawn").agg(F.count("*").alias("n"), F.min("value").alias("keeps"))
        bad = now.join(taken, ["kind", "drawn"], "left_semi").select("kind", "value").unionByName(
            now.join(twice.where("n > 1"), ["kind", "drawn"]).where("value <> keeps").select("kind", "value")
        ).distinct()
        bad = written(bad, "bad")
        if bad.isEmpty():
            discard(bad)
            break
        if attempt == most_attempts:
            after = _settled(now, bad, key)
        else:
            moved = now.join(bad, ["kind", "value"]).withColumn("attempt", F.col("attempt") + 1).select("kind", "value", "attempt").mapInArrow(run, kinds)
            after = written(now.join(bad, ["kind", "value"], "left_anti").unionByName(moved), "drawn")
        discard(now, bad)
        now = after
    else:
        free = now.where("attempt >= 0").join(now.select(F.col("value").alias("drawn"), "kind").distinct(), ["kind", "drawn"], "left_semi")
        if not free.isEmpty() or not now.groupBy("kind", "drawn").count().where("count > 1").isEmpty():
            discard(now)
            raise RuntimeError("collisions: surrogates that are not distinct")
    out_rows = written(now.where("attempt <> 0"), "collisions")
    discard(now)
    return out_rows


def _settled(now: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    """The draws, with those of `bad` settled among all of their format: such formats are small beside the entities that they hold."""
    import pyarrow as pa

    out = pa.schema([("kind", pa.string()), ("value", pa.string()), ("attempt", pa.int32()), ("drawn", pa.string())])
    kinds = "kind string, value string, attempt int, drawn string"
    formed = pa.schema([*out, ("open", pa.bool_()), ("form", pa.string())])

    def forms(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (*out.names, "open")))
            yield from batches_of(((*row, form(row[0], row[1])[0]) for row in rows), formed)

    def settle(table):
        kind = table.column("kind")[0].as_py()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("value", "attempt", "drawn", "open"))))
        values = [v for v, *_ in rows]
        if form(kind, values[0])[1] < 2 * len(rows):
            order = sorted(values, key=lambda v: hmac.new(key.encode(), f"{kind}|{v}".encode(), hashlib.sha256).digest())
            done = [(kind, v, -1, w) for v, w in zip(order, [*order[1:], order[0]])]
        else:
            used, done = {*values, *(d for _, _, d, open_ in rows if not open_)}, []
            for v, a, d, open_ in rows:
                while open_ and d in used:
                    a += 1
                    d = canonical(kind, surrogate(kind, v, key, a))
                used.add(d)
                done.append((kind, v, a, d))
        return pa.Table.from_batches(list(batches_of(iter(done), out)), schema=out)

    marked = now.join(bad.withColumn("open", F.lit(True)), ["kind", "value"], "left").select("kind", "value", "attempt", "drawn", F.coalesce("open", F.lit(False)).alias("open"))
    marked = written(marked.mapInArrow(forms, f"{kinds}, open boolean, form string"), "forms")
    crowded = marked.where("open").select("kind", "form").distinct()
    rest = marked.join(crowded, ["kind", "form"], "left_anti").select(*out.names)
    after = written(marked.join(crowded, ["kind", "form"], "left_semi").groupBy("kind", "form").applyInArrow(settle, kinds).unionByName(rest), "drawn")
    discard(marked)
    return after


def anonymise(documents: DataFrame, key: str, spans: bool = False) -> DataFrame:
    """The documents with their text replaced, all columns kept; spans adds `entities` (with _ after it
    where the name is taken), an array of (start, end, kind) in the new text. The texts themselves are not shuffled, unless more draws collide than may be broadcast."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

    spark = documents.sparkSession
    short_batches(spark)
    found = written(entities(documents), "entities")
    moved = collisions(found, key)
    n = moved.count()
    schema = StructType(list(documents.schema.fields))
    where, often = spare(documents, "entities"), spare(documents, "_again")
    if spans:
        schema = schema.add(where, ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("kind", StringType())))
    out = to_arrow_schema(schema)
    again = {digest(key, r["kind"], r["value"]): (r["attempt"], r["drawn"]) for r in moved.collect()} if 0 < n <= MOST_BROADCAST else {}
    shared = spark.sparkContext.broadcast(again)
    source = documents
    if n > MOST_BROADCAST:
        # What stays until the texts are read holds digests, not entities.
        of = spare(documents, "_of")
        named = pa.schema([(of, pa.int64()), ("digest", pa.binary()), ("attempt", pa.int32()), ("drawn", pa.string())])

        def digests(batches):
            for batch in batches:
                rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "kind", "value", "attempt", "drawn")))
                yield from batches_of(((i, digest(key, k, v), a, d) for i, k, v, a, d in rows), named)

        met = found.join(moved, ["kind", "value"]).select("doc_id", "kind", "value", "attempt", "drawn").distinct()
        own = written(met.mapInArrow(digests, f"{of} long, digest binary, attempt int, drawn string").groupBy(of).agg(F.collect_list(F.struct("digest", "attempt", "drawn")).alias(often)), "again")
        source = documents.join(own, documents["doc_id"].cast("long").eqNullSafe(own[of]), "left").drop(of)
    discard(found, moved)

    def run(batches):
        for batch in batches:
            rows = batch.column("text").to_pylist()
            many = batch.column(often).to_pylist() if often in batch.schema.names else [None] * len(rows)
            done = [(t, []) if not t else replace(t, key, {bytes(x["digest"]): (x["attempt"], x["drawn"]) for x in m} if m else shared.value) for t, m in zip(rows, many)]
            columns = []
            for f in out:
                if f.name == "text":
                    columns.append(pa.array([t for t, _ in done], f.type))
                elif f.name == "n_chars":
                    columns.append(pa.array([None if t is None else len(t) for t, _ in done], f.type))
                elif f.name == where and spans:
                    columns.append(pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in done], f.type))
                else:
                    columns.append(batch.column(f.name).cast(f.type))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return source.mapInArrow(run, schema)
