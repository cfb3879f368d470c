"""PII: surrogate generation.

Detected entities (e-mail and IPv4 addresses, telephone, card, account and social-security numbers, access keys,
secrets that are named as such, and persons after a title or a label such as "Name:", and where a text names them again in full, as written or in capitals)
receive keyed replacements of the same type, script, length and format.  The characters that vary form a number in
a mixed radix, which a keyed permutation without fixed points of exactly that range (a rotation between a Feistel
network with cycle walking and its inverse) maps to another: different values get different surrogates by
construction, none stays as it is, and a value gets the same one wherever and however it is written.  Check digits
are made to hold where they held.  A person's given name comes from a list of script and gender, the surname keeps
its script, vowels, consonants, accents and capitals in place; in other scripts both are spelled anew, an ideograph by any other.
A person has one surrogate in a text whatever the titles, unless they name both genders.

Collisions are checked over all rows: a surrogate that is a value of the data, or that another value got
too, makes the value try again under the next key, until none is left; only such exceptions travel to the texts
that need them.  A value that tries again often has a full range and gets a longer surrogate: a double, triple, ...
given name, more digits, an address of any length.  A lone surname may get another's real one: its surrogate is
the one that full names of that surname have.

Edge cases: a null text stays null and an empty one empty, both without entities; overlapping finds go to
the earlier, then the longer; repeated rows give repeated results; an empty table gives no rows.  Of ideographs
after a title, which no space ends, the first four at most count as the name.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, staged, take_turn

#: Rounds without fewer collisions after which an error is raised.
ATTEMPTS = 30
#: Attempts that a value makes in its own range before a name or a character is added, and again for each further one.
WIDEN = 3
#: Exceptions that are sent to all tasks; more are joined to the texts that hold them.
MAX_SENT = 100_000
#: Parts that each text's exceptions are joined in, so that copies of one text don't meet in one task.
SALTS = 16

# Alphabets whose letters replace each other, titles with their gender, names by script and gender.
ALPHABETS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αειουηω", "βγδζθκλμνξπρστφχψ", "ς", "אבגדהוזחטיכלמנסעפצקרשת", "ךםןףץ", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह"]
HEX = "0123456789abcdef"
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Г-н": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Sra": "f", "Г-жа": "f", "Госпожа": "f",
    "Dr": "n", "Prof": "n", "Professor": "n",
}
GIVEN = {
    ("latin", "m"): "Adam Alan Albert Andrew Arthur Benjamin Carl Daniel David Edward Felix Frank George Henry Hugo Jacob James Julian Leo Lewis Martin Max Noah Oliver Oscar Paul Peter Robert Samuel Simon Theodore Thomas Victor Walter William".split(),
    ("latin", "f"): "Ada Agnes Alice Amelia Anna Beatrice Caroline Charlotte Clara Diana Edith Eleanor Elena Emma Eva Flora Grace Hannah Helen Irene Isabel Julia Laura Lucy Margaret Maria Martha Nora Olivia Paula Rosa Ruth Sarah Sophia Vera".split(),
    ("latin", "n"): "Alex Ariel Charlie Dana Eden Jamie Jordan Kim Lee Morgan Noel Quinn Riley Robin Sage Sam Sasha Taylor".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Максим Николай Олег Павел Роман Сергей Тимур Юрий".split(),
    ("cyrillic", "f"): "Алина Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лариса Мария Нина Ольга Полина Раиса Софья Татьяна".split(),
    ("cyrillic", "n"): "Женя Саша Валя Слава".split(),
    ("greek", "m"): "Γιώργος Γιάννης Δημήτρης Κώστας Μιχάλης Νίκος Παύλος Πέτρος Σπύρος Στέφανος".split(),
    ("greek", "f"): "Αγγελική Άννα Βασιλική Δήμητρα Ειρήνη Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}

# Calling codes of one and of two digits; all others have three.
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}

_ALPHABET = {c: a for a in ALPHABETS for c in a}
_LOCAL, _DOMAIN = re.compile(r"[\w.+%-]+\Z"), re.compile(r"[\w-]+(?:\.[\w-]+)+")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)")
_PHONE = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])")
_CARD = re.compile(r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])")
_IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SECRET = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[:=]\s*[\"']?([A-Za-z0-9_\-+/.]{8,})")
_SECRET_NAMES = ("assw", "ecret", "oken", "pwd", "_key", "-key", "ikey", "ASSW", "ECRET", "OKEN", "PWD", "_KEY", "-KEY")
# Prefixes of access keys, and what follows them.
_KEY = re.compile(r"(?<![\w-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})(?![\w-])")
_KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
# a capital or a letter without case, then letters; O' before and capitals after an apostrophe, but not a possessive
_NAME = r"(?:\p{Han}{1,4}|(?:\p{Lu}['’]\p{L}|[\p{Lu}\p{Lt}\p{Lo}])[\p{L}\p{M}]+(?:(?:-|['’](?=\p{Lu})(?![sS]\b))[\p{L}\p{M}]+)*(?![\w\p{M}]))"
_INITIALS = r"(?:\p{Lu}(?:\. ?| ))+"
_TITLE = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + r")\.? ")
_AFTER_TITLE = regex.compile(rf"(?:(?P<given>{_INITIALS})(?P<surname>{_NAME})|(?P<given>{_NAME}) (?P<surname>{_NAME})|(?P<surname>{_NAME}))")
# Labels of a person's name.
_LABELS = ("Name", "Full name", "Contact person", "Customer name", "Имя", "ФИО")
_LABEL = re.compile(r"(?<!\w)(?:" + "|".join(_LABELS) + r"): ?")
_AFTER_LABEL = regex.compile(rf"(?:(?P<given>{_NAME}) (?P<surname>{_NAME})|(?P<surname>\p{{Han}}{{2,4}}))")
_GENDER = {name.lower(): gender for (_, gender), names in GIVEN.items() for name in names}
_ANY_DIGIT = re.compile(r"[0-9]")


@lru_cache(maxsize=65536)
def alphabet(c: str) -> str:
    """The letters that may stand for a lower-case letter: of its script, and vowel, consonant or accent like it; itself alone if it doesn't vary.

    Every letter of an alphabet has the same alphabet.
    """
    if c in _ALPHABET or not c.isalpha():
        return _ALPHABET.get(c, c)
    if "\u4e00" <= c <= "\u9fff":
        return _block(0x4E00, 0xA000, "Lo", "CJK")
    if "\uac00" <= c <= "\ud7a3":
        return _block(0xAC00, 0xD7A4, "Lo", "HANGUL")
    base, marks = (d := unicodedata.normalize("NFD", c))[0], d[1:]
    if base in _ALPHABET:
        made = [unicodedata.normalize("NFC", x + marks) for x in _ALPHABET[base]]
        return "".join(x for x in made if len(x) == 1 and x not in _ALPHABET and (x < "\u0280", _has_capital(x)) == (c < "\u0280", _has_capital(c))) if c in made else c
    start = ord(c) >> 7 << 7
    return _block(max(start, 0xD7A4) if "\ud7a4" <= c <= "\ud7ff" else start, start + 128, unicodedata.category(c), _script(c), _has_capital(c))


def _has_capital(c: str) -> bool:
    return c.upper() != c and c.upper().lower() == c and len(c.upper()) == 1


def _script(c: str) -> str:
    return unicodedata.name(c, "UNNAMED").split(" ")[0].split("-")[0]


@lru_cache(maxsize=None)
def _block(start: int, end: int, category: str, script: str, capital: bool = False) -> str:
    """Letters of one kind in a range of code points, without those that other alphabets hold."""
    found = (c for c in map(chr, range(start, end)) if unicodedata.category(c) == category and _script(c) == script and c not in _ALPHABET and c.lower() == c and _has_capital(c) == capital)
    return "".join(c for c in found if unicodedata.normalize("NFD", c)[0] not in _ALPHABET)


def luhn(digits: str) -> int:
    """The check digit that ``digits`` call for."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) in order, without overlaps; equal values are one entity, however written."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        reach, domain = 64, _DOMAIN.match(text, at + 1)
        local = _LOCAL.search(text, max(0, at - reach), at)
        while local and domain and local.start() == at - reach > 0:  # a name as long as that may go on
            reach *= 2
            local = _LOCAL.search(text, max(0, at - reach), at)
        if local and domain:
            found.append((local.start(), domain.end(), "email", text[local.start() : domain.end()].lower()))
        at = text.find("@", at + 1)
    if _ANY_DIGIT.search(text):
        found += ((m.start(), m.end(), "ip", m.group()) for m in _IP.finditer(text))
        for m in _PHONE.finditer(text):
            code, digits = "1", re.sub(r"\D", "", m.group())  # without a code only the ten-digit forms of code 1 are numbers
            if m.group()[0] == "+":
                n = next((n for n in (1, 2) if digits[:n] in _CODES), 3)
                code, digits = digits[:n], digits[n:]
            if len(digits) >= 6:
                found.append((m.start(), m.end(), "phone", f"+{code}/{digits}"))
        for m in _CARD.finditer(text):
            digits = re.sub(r"\D", "", m.group())
            if luhn(digits[:-1]) == int(digits[-1]) or (len(digits) == 16 and digits[0] in "3456"):
                found.append((m.start(), m.end(), "card", digits))
        found += ((m.start(), m.end(), "ssn", m.group().replace("-", "")) for m in _SSN.finditer(text))
        for m in _IBAN.finditer(text):
            account = m.group().replace(" ", "")
            if 15 <= len(account) <= 34 and _mod97(account) == 1:
                found.append((m.start(), m.end(), "iban", account))
        if "::" in text or text.count(":") > 6:
            found += ((m.start(), m.end(), "ip6", m.group().lower()) for m in _IP6.finditer(text))
    if any(s in text for s in _SECRET_NAMES):
        found += ((m.start(1), m.end(1), "secret", m.group(1)) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m.group(1)))
    if any(p in text for p in _KEY_PREFIXES):
        found += ((m.start(), m.end(), "key", m.group()) for m in _KEY.finditer(text))
    people: list[tuple[int, int, str, str, str]] = []  # start, end, gender, given name, surname
    if any(f"{t} " in text or f"{t}. " in text for t in TITLES):
        for m in _TITLE.finditer(text):
            if name := _AFTER_TITLE.match(text, m.end()):
                people.append((*name.span(), TITLES[m.group(1)], (name["given"] or "").strip().lower(), name["surname"].lower()))
    if any(f"{w}:" in text for w in _LABELS):
        for m in _LABEL.finditer(text):
            if name := _AFTER_LABEL.match(text, m.end()):
                people.append((*name.span(), "n", (name["given"] or "").lower(), name["surname"].lower()))
    if people:
        found += _persons(text, people)
    found.sort(key=lambda e: (e[0], -e[1]))
    out, end = [], 0
    for e in found:
        if e[0] >= end:
            out.append(e)
            end = e[1]
    return out


def _persons(text: str, people: list[tuple[int, int, str, str, str]]) -> Iterator[tuple[int, int, str, str]]:
    """Entities of persons that titles and labels name, and of all places that name them again in full."""
    genders: dict[tuple[str, str], set[str]] = {}
    for _, _, gender, given, surname in people:
        genders.setdefault((given, surname), set()).add(gender)
    again = {}
    for start, end, gender, given, surname in people:
        sure = genders[given, surname] - {"n"}
        if gender == "n":  # another title's gender, or the given name's
            gender = min(sure) if len(sure) == 1 else _GENDER.get(given, "n")
        value = f"{gender}/{given}/{surname}" if given else f"n//{surname}"
        if given:
            again.setdefault(text[start:end], value)
            again.setdefault(text[start:end].upper(), value)
        yield start, end, "person", value
    if again:
        names = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(again, reverse=True))) + r")(?!\w)")
        known = {(s, e) for s, e, *_ in people}
        yield from ((*m.span(), "person", again[m.group()]) for m in names.finditer(text) if m.span() not in known)


class Surrogates:
    """Keyed replacements of values; ``attempt`` chooses another permutation of the same range."""

    def __init__(self, key: str):
        self.key = key.encode()

    def _hash(self, *parts: object) -> int:
        data = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
        return int.from_bytes(hashlib.blake2b(data, key=self.key[:64], digest_size=32).digest(), "big")

    def permute(self, x: int, size: int, name: str) -> int:
        """A keyed permutation of range(size) that moves every number, if there are two at least."""
        if size < 2:
            return x
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1

        def mixed(x: int, turns: range) -> int:
            while True:
                left, right = x >> half, x & mask
                for turn in turns:
                    if turns.step > 0:
                        left, right = right, left ^ (self._hash(name, size, turn, right) & mask)
                    else:
                        left, right = right ^ (self._hash(name, size, turn, left) & mask), left
                x = left << half | right
                if x < size:  # else walk on along the cycle
                    return x

        turned = mixed(x, range(6)) + 1 + self._hash("turn", name, size) % (size - 1)
        return mixed(turned % size, range(5, -1, -1))

    def more(self, kind: str, value: str, attempt: int, letters: str) -> str:
        """What a value whose range is full gets more: a character for every ``WIDEN`` attempts."""
        x, out = self._hash("more", kind, attempt, value), ""
        for _ in range(attempt // WIDEN):
            x, i = divmod(x, len(letters))
            out += letters[i]
        return out

    def spelled(self, value: str, choices: list[str], name: str) -> str:
        """Replace every character by one of its choices; a character with one choice stays."""
        x, size = 0, 1
        for c, chosen in zip(value, choices, strict=True):
            x, size = x * len(chosen) + chosen.index(c), size * len(chosen)
        x = self.permute(x, size, name)
        out = []
        for chosen in reversed(choices):
            x, i = divmod(x, len(chosen))
            out.append(chosen[i])
        return "".join(reversed(out))

    def of(self, kind: str, value: str, attempt: int = 0) -> str:
        if kind == "email":
            head, dot, top = value.rpartition(".")
            if attempt >= WIDEN:  # few letters to vary, or none
                x, letters = self._hash("email", attempt, value), []
                for _ in range(20):
                    x, i = divmod(x, 26)
                    letters.append("abcdefghijklmnopqrstuvwxyz"[i])
                return f"{''.join(letters[:12])}@{''.join(letters[12:])}{dot}{top}"
            name = f"email/{attempt}/{''.join('0' if c.isdigit() else 'a' if c in _ALPHABET else c for c in value)}"
            letters = {c: "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"}
            return self.spelled(head, [letters.get(c) or _ALPHABET.get(c, c) for c in head], name) + dot + top
        if kind == "ip" and attempt >= WIDEN:
            x = self._hash("ip", attempt, value)
            return ".".join(str(x >> 8 * i & 255) for i in range(4)) if attempt < 10 * WIDEN else ":".join(f"{1 + (x >> 16 * i) % 0xFFFF:x}" for i in range(8))
        if kind == "ip6" and attempt >= WIDEN:
            x = self._hash("ip6", attempt, value)
            return ":".join(f"{1 + (x >> 16 * i) % 0xFFFF:x}" for i in range(8))
        if kind == "ip":
            ranges = [["0123456789"], [str(i) for i in range(10, 100)], [str(i) for i in range(100, 256)]]
            parts = value.split(".")
            chosen = [list(ranges[0][0]) if len(p) == 1 else ranges[len(p) - 1] for p in parts]
            x, size = 0, 1
            for p, c in zip(parts, chosen, strict=True):
                x, size = x * len(c) + c.index(p), size * len(c)
            x = self.permute(x, size, f"ip/{attempt}/{'.'.join(map(str, map(len, parts)))}")
            out = []
            for c in reversed(chosen):
                x, i = divmod(x, len(c))
                out.append(c[i])
            return ".".join(reversed(out))
        if kind == "ip6":
            shape = re.sub("[0-9a-f]", "0", value)
            choices = [HEX if c == "0" else c for c in shape]
            for group in re.finditer("0+", shape):  # no leading zeros but in a lone digit
                if group.end() - group.start() > 1 and value[group.start()] != "0":
                    choices[group.start()] = HEX[1:]
            return self.spelled(value, choices, f"ip6/{attempt}/{shape}/{''.join('1' if c == HEX[1:] else '0' for c in choices)}")
        if kind == "phone":
            code, digits = value.split("/")
            lead = "123456789" if digits[0] != "0" else "0"
            return code + "/" + self.spelled(digits, [lead, *["0123456789"] * (len(digits) - 1)], f"phone/{attempt}/{code}/{len(digits)}/{lead}") + self.more(kind, value, attempt, "0123456789")
        if kind == "card":
            off = (int(value[-1]) - luhn(value[:-1])) % 10  # 0 where the check digit holds
            body = value[0] + self.spelled(value[1:-1], ["0123456789"] * (len(value) - 2), f"card/{attempt}/{value[0]}/{len(value)}/{off}") + self.more(kind, value, attempt, "0123456789")
            return body + str((luhn(body) + off) % 10)
        if kind == "iban":
            letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
            kinds = "".join("0" if c.isdigit() else "A" for c in value[4:])
            body = self.spelled(value[4:], ["0123456789" if c.isdigit() else letters for c in value[4:]], f"iban/{attempt}/{value[:2]}/{kinds}") + self.more(kind, value, attempt, "0123456789")
            return f"{value[:2]}{98 - _mod97(value[:2] + '00' + body):02d}{body}"
        if kind == "ssn":
            return self.spelled(value, ["0123456789"] * 9, f"ssn/{attempt}") + self.more(kind, value, attempt, "0123456789")
        if kind in ("secret", "key"):
            head = next((p for p in _KEY_PREFIXES if kind == "key" and value.startswith(p)), "")
            tail = self.more(kind, value, attempt, "0123456789")
            value = value[len(head) :]
            if all(c in HEX for c in value):
                return head + self.spelled(value, [HEX] * len(value), f"hex/{attempt}/{head}/{len(value)}") + tail
            plain = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
            chosen = [next((a for a in plain if c in a), c) for c in value]
            return head + self.spelled(value, chosen, f"secret/{attempt}/{head}/{''.join(a[0] for a in chosen)}") + tail
        gender, given, surname = value.split("/")
        family = self.name(surname, "surname")
        if not given:
            return f"/{family}"
        names = GIVEN.get((_script(given[0]).lower(), gender), [])
        if not names or len(given) == 1 or "." in given or given[1] == " ":  # initials, and scripts without a list
            first = self.name(given, f"given/{attempt}")
            more = self.more(kind, value, attempt, alphabet(given[0]))
            return f"{first}{''.join(c + '.' for c in more) if '.' in given else more}/{family}"
        x, chosen = self._hash("given", attempt, given, gender), []
        for _ in range(1 + attempt // WIDEN):
            x, i = divmod(x, len(names))
            chosen.append(names[i].lower())
        if chosen == [given]:
            chosen = [names[(i + 1) % len(names)].lower()]
        return f"{'-'.join(chosen)}/{family}"

    def name(self, value: str, name: str) -> str:
        """A lower-case name spelled anew in its script; one whose letters all have no other is made of others."""
        choices = [alphabet(c) for c in value]
        if all(len(a) == 1 for a in choices):
            choices, value = ["aeiou" if i % 2 else ALPHABETS[1] for i in range(12)], "ba" * 6
            name = f"{name}/{value}"
        return self.spelled(value, choices, f"{name}/{''.join(a[0] for a in choices)}")


def rendered(original: str, kind: str, surrogate: str) -> str:
    """The surrogate in the format of the text: separators and capitals stay where they were."""
    if kind == "person":
        given, family = surrogate.split("/")
        own = original.rsplit(" ", 1)[-1] if given else original
        own = own.rsplit(".", 1)[-1]  # J.Smith
        own_given = original[: len(original) - len(own)].rstrip()
        gap = original[len(own_given) : len(original) - len(own)]
        return f"{_cased(own_given, given)}{gap}{_cased(own, family)}" if given else _cased(own, family)
    if kind in ("ip", "secret", "key"):
        return surrogate
    if kind == "ip6":
        return surrogate.upper() if original.isupper() else surrogate
    if kind == "email":
        return "".join(s.upper() if o.isupper() else s for o, s in zip(original, surrogate, strict=False)) if len(original) == len(surrogate) else surrogate
    if kind == "phone" and not original.startswith("+"):
        surrogate = surrogate.partition("/")[2]
    payload = surrogate.replace("/", "").replace("+", "")
    out, at = [], 0
    for c in original:
        if c.isalnum():
            out.append(payload[at])
            at += 1
        else:
            out.append(c)
    return "".join(out) + payload[at:]


def _cased(original: str, name: str) -> str:
    """``name``, which is in lower case, with the capitals of ``original``: letter by letter, or by its words."""

    def upper(c: str) -> str:
        return u if len(u := c.upper()) == 1 else c

    if len(original) > 2 and original.isupper():
        return "".join(map(upper, name))
    if len(original) == len(name) and (len(name) < 3 or "'" in original or "’" in original or not original[1:].islower()):
        return "".join(upper(n) if o.isupper() else n for o, n in zip(original, name, strict=True))
    if not original[:1].isupper():
        return name
    return "".join(upper(c) if not i or name[i - 1] in "-." else c for i, c in enumerate(name))


def _surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, attempt and surrogate of rows (kind, value, attempt)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Surrogates(key)
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.of(k, v, a) for k, v, a in rows], pa.string())], names=["kind", "value", "attempt", "surrogate"])

    return arrow_map(entities, make, "kind string, value string, attempt int, surrogate string")


def _shown(kind, value):
    """What a value looks like as a surrogate: persons without their gender."""
    return F.when(kind == "person", F.substring_index(value, "/", -2)).otherwise(value)


def _exceptions(entities: DataFrame, key: str) -> DataFrame | None:
    """kind, value and attempt of those values whose first surrogate collides; None if there are none.

    Only values that collide are made anew, and only their new surrogates are compared with the rest.
    """
    one = ["kind", "value"]
    values = entities.select(*one)
    real = values.select("kind", _shown(F.col("kind"), F.col("value")).alias("surrogate"))
    lone = (F.col("kind") == "person") & F.col("value").like("%//%")
    first = fresh = staged(_surrogate_table(values.withColumn("attempt", F.lit(0)), key), "pii-surrogates")
    moved = settled = None
    fewest, idle = None, 0
    while True:
        taken = [fresh.where(~lone).join(real, ["kind", "surrogate"], "left_semi")]
        if settled is not None:
            taken.append(fresh.join(settled, ["kind", "surrogate"], "left_semi"))
        keeps = fresh.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("keeps")).where("n > 1")
        taken.append(fresh.join(keeps, ["kind", "surrogate"]).where("value <> keeps"))
        bad = taken[0].select(*one, "attempt")
        for more in taken[1:]:
            bad = bad.unionByName(more.select(*one, "attempt"))
        bad = staged(bad.distinct(), "pii-collisions")
        left = bad.count()
        good = fresh.join(bad, one, "left_anti")
        settled = good if settled is None else settled.unionByName(good)
        if fresh is not first:
            moved = good if moved is None else moved.unionByName(good)
        if not left:
            return None if moved is None else staged(moved.select(*one, "attempt"), "pii-moved")
        idle = 0 if fewest is None or left < fewest else idle + 1
        fewest = left if fewest is None else min(fewest, left)
        if idle >= ATTEMPTS:
            kinds = ", ".join(sorted(r["kind"] for r in bad.select("kind").distinct().collect()))
            raise ValueError(f"{left} values have no free surrogate in their range: {kinds}")
        fresh = staged(_surrogate_table(bad.select(*one, (F.col("attempt") + 1).alias("attempt")), key), "pii-surrogates")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with surrogates in the text, and entities: kind, start and end (in the new text) of each.

    Whoever has ``key`` can undo the surrogates: keep it secret.
    """
    where = F.xxhash64(F.col(text_col))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("pii")
        for batch in slices(batches, "text"):
            rows = {(h, kind, value) for h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for _, _, kind, value in find_entities(text)}
            if rows:
                h, kind, value = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(kind, pa.string()), pa.array(value, pa.string())], names=["at", "kind", "value"])

    texts = docs.where(F.col(text_col).isNotNull()).select(where.alias("at"), F.col(text_col).alias("text"))
    found = staged(arrow_map(texts, detect, "at long, kind string, value string").distinct(), "pii-found")
    exceptions = _exceptions(found.select("kind", "value").distinct(), key)

    names = docs.columns
    slot = next(f"entities{i or ''}" for i in range(len(names) + 1) if f"entities{i or ''}" not in names)
    hint = next(f"_again{i}" for i in range(len(names) + 1) if f"_again{i}" not in names)
    again_type = "array<struct<kind: string, value: string, attempt: int>>"
    sent = {} if exceptions is None else {(r["kind"], r["value"]): r["attempt"] for r in exceptions.limit(MAX_SENT + 1).collect()}
    if len(sent) <= MAX_SENT:
        rows = docs.withColumn(hint, F.lit(None).cast(again_type))
    else:
        sent = {}
        by_text = found.join(exceptions, ["kind", "value"]).groupBy(F.col("at").alias(f"{hint}at")).agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(hint))
        by_text = by_text.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(f"{hint}salt"))
        salt = F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SALTS)).cast("int")  # copies of one text are dealt out
        rows = docs.join(by_text, (where == F.col(f"{hint}at")) & (salt == F.col(f"{hint}salt")), "left").select(*[docs[f"`{c}`"] for c in names], hint)
    entity = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    place = names.index(text_col)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("pii")
        own = Surrogates(key)
        for batch in slices(batches, text_col):
            new, spans = [], []
            for text, again in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                entities = find_entities(text) if text else []
                if not entities:
                    new.append(text)
                    spans.append([])
                    continue
                attempts = {(e["kind"], e["value"]): e["attempt"] for e in again} if again else sent
                parts, at, size, own_spans = [], 0, 0, []
                for start, end, kind, value in entities:
                    put = rendered(text[start:end], kind, own.of(kind, value, attempts.get((kind, value), 0)))
                    size += start - at
                    own_spans.append({"kind": kind, "start": size, "end": size + len(put)})
                    parts += [text[at:start], put]
                    at, size = end, size + len(put)
                new.append("".join([*parts, text[at:]]))
                spans.append(own_spans)
            columns = [pa.array(new, pa.string()) if i == place else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, entity)], names=[*names, slot])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(rows, replace, f"{fields}, `{slot}` array<struct<kind: string, start: long, end: long>>")
