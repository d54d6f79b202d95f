"""Surrogate generation for personal data.

Every detected entity is replaced by a made-up one of the same type. Types have keyed permutations of all
entities of a form: digits, letters and hex digits by place, names by script and gender. So an entity has one
surrogate in the whole corpus, in whatever writing; different entities have different ones, since a permutation
has no collisions; none is its own surrogate, since it is one cycle; and nobody gets back without the key.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from affinia.llm.common import Memo, wide_rows

# Titles by gender, and which of them prose writes in lower case.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа", "Κυρία"],
    "x": ["Dr", "Prof", "Professor"],
}
LOWER_TITLES = {"mr", "mrs", "ms", "mme", "dr", "prof", "professor", "monsieur", "madame", "señor", "señora", "doña", "sra", "господин", "госпожа", "κύριος", "κυρία"}
#: Letters of names by script, in lower case; sounds of syllables: onsets, vowels and codas, 256 in all; endings by gender.
SCRIPTS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", "bdfghjklmnprstvz", "aeiu", ["", "n", "r", "l"], {"m": "os", "f": "ia", "x": "oy", "": ""}),
    "cyrillic": ("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "бвгджзклмнпрстфх", "аеиу", ["", "н", "р", "л"], {"m": "ой", "f": "ия", "x": "оя", "": ""}),
    "greek": ("αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ", "βγδζθκλμνπρστφχξ", "αειυ", ["", "ν", "ρ", "λ"], {"m": "ος", "f": "ια", "x": "ου", "": ""}),
}
#: Further letters of the script, and what the surrogates of names with them begin with; at last, with any others.
MORE_LETTERS = {"latin": "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿāăąćčďđēęěğīıłńňőœřśşšťůūűźżž", "cyrillic": "іїєґўђјљњћџ", "greek": ""}
OTHER_LETTERS = {"latin": ("o", "e"), "cyrillic": ("о", "э"), "greek": ("ο", "η")}
_DIGITS = "0123456789"
#: Radix of a character's place by its class, and the characters.
_CLASSES = {"d": _DIGITS, "l": "abcdefghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef", "H": "0123456789ABCDEF", "n": "123456789abcdef"}
#: Beginnings and lengths of card numbers by issuer.
_ISSUERS = re.compile(r"4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|35\d{14}|6(?:011|5\d\d|4[4-9]\d)\d{12}|62\d{14,17}|(?:50|5[6-9]|6\d)\d{10,17}")

_TITLE_GENDER = {t.casefold(): g for g, ts in TITLES.items() for t in ts}
_TITLE = "|".join(sorted({re.escape(x) for ts in TITLES.values() for t in ts for x in ({t, t.upper()} | {t.lower()} & LOWER_TITLES)}, key=lambda x: (-len(x), x)))
_NAME = r"[^\W\d_]\w*(?:[-'’][^\W\d_]\w*)*"
_H, _V4 = r"[0-9A-Fa-f]{1,4}", r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PATTERN = re.compile(
    "|".join(
        f"(?P<{kind}>{pattern})"
        for kind, pattern in {
            "email": r"(?<![\w.%+\-])[\w.%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+",
            "secret": r"(?<=[\"'=:\s])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|eyJ[\w\-]+\.[\w\-]+\.[\w\-]+)(?![\w])",
            "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
            "mac": r"(?<![\w:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\w:])",
            "ipv6": rf"(?<![\w:])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{6}}{_V4}|(?:{_H}(?::{_H}){{0,6}})?::(?:(?:{_H}:){{0,5}}{_V4}|{_H}(?::{_H}){{0,6}})?)(?![\w:]|\.\d)",
            "ipv4": rf"(?<![\d.]){_V4}(?![\d]|\.\d)",
            "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
            "card": r"(?<![\d\-])(?:\d{4}[ \-]\d{6}[ \-]\d{4,5}|\d(?:[ \-]?\d){3}(?:[ \-]\d{4}){2,3}(?:[ \-]\d{1,3})?)(?![\d\-])|(?<![\d.,])\d{12,19}(?![\d])",
            "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|0\d{2,4}[ /\-]\d{3,4}[ \-]?\d{3,4})(?![\w\-])|(?<!\w)(?i:tel|phone|telephone|telefon|téléphone|teléfono|mobile|fax)(?:\.|:|\.:)? ?\d(?:[ /\-]?\d){6,11}(?!\w)",
            "person": r"(?<!\w)(?P<title>" + _TITLE + r")(?P<gap>\.?[ \xa0])(?P<name>" + _NAME + r"(?:[ \xa0]" + _NAME + r"){0,2})",
        }.items()
    )
)
#: What a text must hold for any pattern to match.
_MAYBE = re.compile(r"\d|@|::|(?<!\w)(?:" + _TITLE + r")\.?[ \xa0]|eyJ")


class Surrogates:
    """Surrogates under a key: the same wherever they are made."""

    def __init__(self, key: bytes):
        self.key = key

    def draw(self, *what: str) -> int:
        return int.from_bytes(hmac.digest(self.key, "\x1f".join(what).encode("utf-8", "surrogatepass"), hashlib.sha256), "big")

    def permuted(self, form: str, x: int, sizes: tuple[int, int]) -> int:
        """A keyed permutation, by form, of the numbers below the product of the sizes: a Feistel network's
        image, moved on by a keyed step and taken back, so that no number stays."""
        total = sizes[0] * sizes[1]
        if total < 2:
            return x
        rounds = range(10)

        def turned(x: int, sign: int) -> int:
            half = list(divmod(x, sizes[1]))
            for k in rounds if sign > 0 else reversed(rounds):
                half[k % 2] = (half[k % 2] + sign * self.draw(form, str(k), str(half[1 - k % 2]))) % sizes[k % 2]
            return half[0] * sizes[1] + half[1]

        step = 1 + self.draw(form, "step") % (total - 1)
        return turned((turned(x, 1) + step) % total, -1)

    def spelled(self, kind: str, value: str, classes: str) -> str:
        """A string of the same character classes, place by place; a dot in ``classes`` keeps its character.
        What is kept and the classes are part of the form, so different strings stay different."""
        places = [_CLASSES[c] if c != "." else None for c in classes]
        x, sizes, half = 0, [1, 1], sum(c != "." for c in classes) // 2
        at = 0
        for chars, c in zip(places, value, strict=True):
            if chars:
                x = x * len(chars) + chars.index(c)
                sizes[at >= half] *= len(chars)
                at += 1
        form = "\x1e".join((kind, classes, "".join(c for chars, c in zip(places, value, strict=True) if not chars)))
        x = self.permuted(form, x, (sizes[0], sizes[1]))
        out = []
        for chars, c in zip(reversed(places), reversed(value), strict=True):
            if chars:
                x, r = divmod(x, len(chars))
                c = chars[r]
            out.append(c)
        return "".join(reversed(out))

    def digits(self, kind: str, value: str) -> str:
        return self.spelled(kind, value, "d" * len(value))

    def like(self, kind: str, value: str, hexes: bool = False) -> str:
        """Each letter or digit becomes one of its class and case; other characters stay. Letters beyond
        ASCII have no such classes: such a string becomes 24 letters drawn from all of it."""
        if not value.isascii():
            x, out = self.draw(kind, value), []
            for _ in range(24):
                x, r = divmod(x, 26)
                out.append(_CLASSES["l"][r])
            return "".join(out)
        h = ("H" if value.upper() == value else "h" if value.lower() == value else "") if hexes and all(c in "0123456789abcdefABCDEF" for c in value if c.isalnum()) else ""
        return self.spelled(kind, value, "".join((h or ("d" if c.isdigit() else "u" if c.isupper() else "l")) if c.isalnum() else "." for c in value))

    def of(self, kind: str, value: str) -> str:
        """The surrogate of a canonical value."""
        if kind == "card":  # as valid or invalid as the number is
            fixed = 1 if value[0] == "4" else 4  # the issuer's digits
            new = value[:fixed] + self.digits(f"card{value[:fixed]}", value[fixed:-1])
            return new + str((int(value[-1]) + _luhn(value[:-1] + "0") - _luhn(new + "0")) % 10)
        if kind == "ipv4":
            x = int.from_bytes(bytes(map(int, value.split("."))), "big")
            return ".".join(map(str, self.permuted(kind, x, (1 << 16, 1 << 16)).to_bytes(4, "big")))
        if kind == "ipv6":
            if "." in value:
                start, _, v4 = value.rpartition(":")
                return f"{start}:{self.of('ipv4', v4)}"
            groups = re.findall(r"[0-9a-f]+|:+", value)
            return self.spelled(kind, value, "".join("." * len(g) if g[0] == ":" else "h" if len(g) == 1 else "n" + "h" * (len(g) - 1) for g in groups))
        if kind == "email":
            local, _, domain = value.rpartition("@")
            rest, _, top = domain.rpartition(".")
            return f"{self.like('local', local)}@{self.like('domain', rest)}.{top}"
        if kind == "iban":
            new = self.like(f"iban{value[:2]}", value[4:])
            return value[:2] + f"{(_iban_check(value[:2], new) + int(value[2:4]) - _iban_check(value[:2], value[4:])) % 100:02}" + new
        if kind == "phone" and value[0] == "+":
            code, _, rest = value[1:].partition(" ")
            return code + self.digits(f"phone+{code}", rest)
        if kind in ("phone", "ssn"):
            return self.digits(kind, value)
        return self.like(kind, value, hexes=True)

    def name(self, word: str, gender: str) -> str:
        """The surrogate of one word of a name, in lower case: syllables of its script, and an ending by the
        gender of a given name, none for a last one. Words are numbered, the shorter first; the numbers of as
        many syllables are permuted, and each makes other syllables. Parts by hyphens are names of their own."""
        parts = _JOINS.split(word.casefold())
        return "".join(x if k % 2 or not x else self._part(x, gender) for k, x in enumerate(parts))

    def _part(self, word: str, gender: str) -> str:
        script = _script(word)
        letters, onsets, vowels, codas, endings = SCRIPTS[script]
        tier, begin = 0, ""
        if not all(c in letters for c in word):
            letters += MORE_LETTERS[script]
            tier = 1 if all(c in letters for c in word) else 2
            begin = OTHER_LETTERS[script][tier - 1]
        code, base = (list(word.encode("utf-8", "surrogatepass")), 256) if tier == 2 else ([letters.index(c) for c in word], len(letters))
        x = 0
        for c in code:  # words of different lengths have different numbers
            x = x * base + c + 1
        n = 2
        while x >= 256**n:
            n += 1
        new = self.permuted(f"name {script} {gender} {tier} {n}", x, (256 ** (n // 2), 256 ** (n - n // 2)))
        out = []
        for _ in range(n):
            new, r = divmod(new, 256)
            out.append(onsets[r // 16] + vowels[r // 4 % 4] + codas[r % 4])
        made = begin + "".join(out) + endings[gender]
        return made + endings["m"] * 2 if made == word else made

    def person(self, gender: str, name: str) -> str:
        """Given names and the last name, each by itself, so that a later mention by a part agrees."""
        parts = re.split(r"(\s+)", name)
        words = parts[::2]
        out = [_cased(word, self.name(word, gender if k < len(words) - 1 else "")) for k, word in enumerate(words)]
        return "".join(x for pair in zip(out, [*parts[1::2], ""], strict=True) for x in pair)


_JOINS = re.compile(r"([-'’])")


def _cased(word: str, new: str) -> str:
    """new in the case of word, by its parts."""
    if len(word) > 1 and word.isupper():
        return new.upper()
    pairs = zip(_JOINS.split(word), _JOINS.split(new), strict=True)
    return "".join(b if a.islower() else b.capitalize() for a, b in pairs)


def _script(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


def _luhn(digits: str) -> int:
    """0 for a valid card number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _iban_check(country: str, rest: str) -> int:
    """The check digits that the rest of an account number needs."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def _address(raw: str) -> bool:
    """Whether this is an address rather than a scope in a program: a::b says neither."""
    try:
        ipaddress.IPv6Address(raw)
    except ValueError:
        return False
    return raw.count(":") > 2 or any(c.isdigit() for c in raw)


def _card(raw: str) -> bool:
    """Whether a number has the length, beginning and check digit of a card's."""
    digits = re.sub(r"\D", "", raw)
    return bool(_ISSUERS.fullmatch(digits)) and not _luhn(digits)


def _capital(word: str) -> bool:
    return word[:1].isupper()


_WORD = re.compile(_NAME)
_OWNS = re.compile(r"['’]s\Z", re.IGNORECASE)


def mentions(text: str, found: list[tuple[int, int, str, re.Match]]) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the further mentions, outside of all found, of persons found: the last
    name in any case but with a capital, and the given names of it right before; and given names alone, as
    kind "given"."""
    genders: dict[str, str] = {}
    given: dict[str, dict[str, str]] = {}
    alone: dict[str, str] = {}
    for start, end, kind, m in found:
        if kind == "person":
            *first, last = re.split(r"[ \xa0]", text[start:end].casefold())
            gender = _TITLE_GENDER[m["title"].casefold()]
            genders.setdefault(last, gender)
            for word in first:
                given.setdefault(last, {}).setdefault(word, gender)
                alone.setdefault(word, gender)
    out: list[tuple[int, int, str, str]] = []
    if not genders:
        return out
    at = 0
    for start, end in [*((x[0], x[1]) for x in found), (len(text), len(text))]:
        words: list[tuple[int, int, str]] = []
        for m in _WORD.finditer(text, at, start):
            stop = m.end() - 2 * (m[0].casefold() not in genders and bool(_OWNS.search(m[0])))
            word = text[m.start() : stop].casefold()
            words.append((m.start(), stop, word))
            if not _capital(m[0]) or word not in genders:
                if word in alone and _capital(m[0]):
                    out.append((m.start(), stop, "given", alone[word]))
                continue
            first, gender = len(words) - 1, genders[word]
            own = given.get(word, {})
            while first and words[first - 1][2] in own and _capital(text[words[first - 1][0] :]) and text[words[first - 1][1] : words[first][0]].isspace():
                first -= 1
                gender = own[words[first][2]]
            while out and out[-1][0] >= words[first][0]:
                out.pop()
            out.append((words[first][0], stop, "person", gender))
        at = end
    return out


def entities(text: str) -> list[tuple[int, int, str, re.Match]]:
    """(start, end, kind, match) of each entity, in order."""
    out: list[tuple[int, int, str, re.Match]] = []
    if not _MAYBE.search(text):
        return out
    m = _PATTERN.search(text)
    while m:
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "person":  # as many of the words as are capitalised
            words = re.split(r"[ \xa0]", m["name"])
            loud = m["title"].isupper() and len(m["title"]) > 1
            n = next((k for k, w in enumerate(words) if not (w.isupper() if loud else _capital(w))), len(words))
            start = m.start("name")
            end = start + len(" ".join(words[:n]))
            if _OWNS.search(text, start, end):
                end -= 2
        elif kind == "ipv6" and not _address(m[0]) or kind == "card" and not _card(m[0]):
            end = start
        elif kind == "phone":
            start += next(k for k, c in enumerate(m[0]) if c in "+(" or c.isdigit())
        elif kind == "email":
            end -= len(m[0]) - len(m[0].rstrip(".-"))
        if end > start:
            out.append((start, end, kind, m))
        m = _PATTERN.search(text, max(end, m.start() + 1))
    return out


def _canonical(kind: str, raw: str) -> str:
    if kind == "phone" and raw[0] == "+":
        code = re.match(r"\+\d{1,3}?(?=\D)|\+\d", raw)[0]
        return f"{code} " + re.sub(r"\D", "", raw[len(code) :])
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", raw)
    if kind == "iban":
        return raw.replace(" ", "")
    if kind == "ipv6" and "." not in raw:
        return ipaddress.IPv6Address(raw).compressed
    return raw if kind == "secret" else raw.lower()


def _groups_like(raw: str, new: str) -> str:
    """The IPv6 address new in the form of raw: short, or of eight groups with or without leading zeros."""
    if "::" in raw or "." in raw:
        return new
    groups = ipaddress.IPv6Address(new).exploded.split(":")
    return ":".join(groups if len(raw) == 39 else [g.lstrip("0") or "0" for g in groups])


def _written_like(raw: str, new: str, kept: str) -> str:
    """The characters of new at the places of raw's letters and digits, in raw's case."""
    out, at = [], iter(new)
    for c in raw:
        out.append(c if c in kept else next(at, ""))
    return "".join(out)


def replace(text: str, made: Surrogates | bytes) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of what was replaced."""
    found = entities(text)
    if not found:
        return text, []
    made = Surrogates(made) if isinstance(made, bytes) else made
    named = [(start, end, kind, _TITLE_GENDER[m["title"].casefold()] if kind == "person" else "") for start, end, kind, m in found]
    found = sorted(named + mentions(text, found))
    out, at = [], 0
    for start, end, kind, gender in found:
        raw = text[start:end]
        if kind == "given":
            new = _cased(raw, made.name(raw, gender))
        elif kind == "person":
            new = made.person(gender, raw)
        else:
            new = made.of(kind, _canonical(kind, raw))
            if kind in ("card", "phone", "ssn", "iban"):
                new = _written_like(raw, new, " .-()+/:")
            elif kind == "ipv6":
                new = _groups_like(raw, new)
            if kind not in ("card", "phone", "ssn", "iban", "secret") and raw.upper() == raw and raw.lower() != raw:
                new = new.upper()
        out += [text[at:start], new]
        at = end
    out.append(text[at:])
    return "".join(out), ["person" if x[2] == "given" else x[2] for x in found]


#: Setting of the session that holds the key of the query and the pipeline; without it each process draws one.
KEY_SETTING = "spark.affinia.pii.key"
_DRAWN = secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key in the session's settings, else one that this process has drawn and nobody knows."""
    return spark.conf.get(KEY_SETTING, None) or _DRAWN


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with the text column's personal data replaced by surrogates, all other columns as they are,
    and ``pii_kinds`` (array of the kinds of the entities, in order; a column of that name gives way).

    key is the secret of the permutations and must not be empty.
    Detected: e-mail addresses, secrets and long hex tokens, IBANs, MAC, IPv6 and IPv4 addresses, social
    security numbers, card numbers with the beginning, length and check digit of an issuer's, phone numbers
    (international, or with a leading zero, parts of 3-3-4 digits or a word such as tel before them), names after a
    title in the cases prose has it in, and wherever else such a person's last name or given names stand in
    the text with a capital. Persons without a title anywhere in the text stay, and other long numbers do.
    Surrogates keep type, length, punctuation, letter case and script; names keep script and, where they
    are given names, gender by their title; valid card and account numbers stay valid and invalid ones
    invalid. Equal entities (after case and punctuation are set aside) get equal surrogates in all documents
    and different ones different ones: every form has a permutation, so there are no collisions to resolve.
    Only e-mail parts with letters beyond ASCII are drawn, from 26**24 strings. A given name after a title
    of another gender counts as another. Text outside entities stays byte for byte.

    A null text stays null with no kinds; an empty one stays empty. Repeated rows are each replaced alike,
    as are ties of any kind. An empty table gives no rows.
    """
    if not key:
        raise ValueError("surrogates need a key")
    secret = hashlib.sha256(key.encode()).digest()
    docs = wide_rows(docs).drop("pii_kinds")
    at = docs.columns.index(text_col)

    def rows(it) -> Iterator:
        import pyarrow as pa

        made = _Remembering(secret)
        for batch in it:
            texts, kinds = [], []
            for text in batch.column(at):
                text = text.as_py()
                new, found = (None, []) if text is None else replace(text, made)
                texts.append(new)
                kinds.append(found)
            cols = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kinds, pa.list_(pa.string()))], names=[*batch.schema.names, "pii_kinds"])

    schema = T.StructType([*docs.schema.fields, T.StructField("pii_kinds", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(rows, schema)


class _Remembering(Surrogates):
    """Surrogates that a task has made before are looked up, up to a bounded number."""

    def __init__(self, key: bytes):
        super().__init__(key)
        self._of, self._name = Memo(lambda x: super(_Remembering, self).of(*x)), Memo(lambda x: super(_Remembering, self).name(*x))

    def of(self, kind: str, value: str) -> str:
        return self._of[kind, value]

    def name(self, word: str, gender: str) -> str:
        return self._name[word, gender]
