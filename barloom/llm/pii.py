"""Operator 8: personal data replaced by keyed, type-consistent surrogates.

Entities are found by pattern: e-mail addresses, IPv4, IPv6 (compressed too) and MAC
addresses, IBANs, payment cards, US social security numbers, phone numbers, and names after
forms of address or words of introduction, in any script.  The words of a name found so are
then found wherever else the text has them.  A surrogate is a keyed permutation of the
entity's own form, so it is the same wherever the entity occurs (coreference) without any
table or shuffle, and no two entities share one (distinctness):

* Digits and letters are numbers in mixed radix, permuted by a Feistel network
  over HMAC-SHA256 within their form: digits stay digits, and letters stay in their
  case, script and block of the code.  Separators stay.
* Checks are kept: a card passes Luhn's test exactly if its original does, an IBAN's
  check digits are computed anew, an address stays public or private, and an area
  code doesn't begin with 0 or 1 unless the original's does.
* Known given names are permuted among the names of their gender and script; other
  words of names by letters, whatever their case, so "Mrs. Jones", "Anna Jones" and "JONES" still
  share a surname.  Forms of address stay, and with them gender.

Permuting again until a predicate holds that the original fulfils ("cycle walking")
keeps each map one to one.  :func:`collisions` checks that over a corpus: it
gives entities, of equal type, that share a surrogate or were left as they were; and
:func:`surrogate_report` with ``check`` refuses a corpus that has any.

Whoever has the key can undo the surrogates: it is an argument or ``KEY_SETTING``, or else
drawn at random for the session; there is no default.

Defined cases: a null text stays null; an empty one has no entities; each row is
treated by itself, so repeated rows and ids agree; extra columns are kept by
:func:`anonymize`.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.shared import columns, in_batches

KEY_SETTING = "spark.barloom.surrogate.key"
"""Where the registered query looks for its key; without one it draws a key for the session."""

# The kinds of entities.
KINDS = ("email", "ipv6", "mac", "ipv4", "iban", "card", "ssn", "phone", "name")

# Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Camille Carmen Charlotte Chloe Clara Claudia Elena Elizabeth Emma Eva Hannah Ines Isabel Jane Julia Karen Laura Lea Linda Louise Lucia Maria Marie Martha Mary Monica Nora Olivia Patricia Petra Sarah Sofia Susan Teresa Ursula".split(),
    ("m", "latin"): "Albert Alexander Anton Carlos Charles Daniel David Diego Edward Felix Frank George Hans Henri Hugo Jacques James Jean John Jorge Jose Juan Karl Louis Lucas Manuel Mark Martin Michael Miguel Oscar Paul Peter Pierre Richard Robert Thomas William".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Екатерина Елена Ирина Мария Наталья Ольга Светлана Софья Татьяна".split(),
    ("m", "cyrillic"): "Александр Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
}

# Forms of address and the gender that they tell ("" for none).
TITLES = {
    "Mr": "m", "Mister": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Господин": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f", "Señorita": "f", "Sra": "f", "Srta": "f", "Doña": "f", "Госпожа": "f",
    "Dr": "", "Prof": "", "Доктор": "",
}

# What introduces a name.
LEADS = (
    "my name is", "my name's", "mein name ist", "ich heiße", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es", "mi chiamo", "il mio nome è", "o meu nome é", "меня зовут", "моё имя",
)
# What stands before a number that is a telephone's, however it is written.
PHONES = ("phone", "telephone", "tel", "mobile", "cell", "call", "fax", "telefon", "handy", "téléphone", "teléfono", "móvil", "телефон")

_L = r"\p{L}\p{M}"
_WORD = rf"\p{{L}}[{_L}]*(?:[-'’]\p{{L}}[{_L}]*)*(?![{_L}\d_])"
_CAPITAL = rf"\p{{Lu}}[{_L}]*(?:[-'’]\p{{L}}[{_L}]*)*(?![{_L}\d_])"
_MAJOR = rf"(?:{_CAPITAL}|(?!\p{{Ll}}){_WORD})"  # in scripts without case, any word
_TITLE = "|".join(regex.escape(t) for t in sorted(TITLES, key=lambda t: (-len(t), t)))
_SHORT_TITLE = "|".join(regex.escape(t.lower()) for t in sorted(TITLES, key=lambda t: (-len(t), t)))
_PATTERNS = {
    "email": regex.compile(r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-]+(?:\.[\p{L}\p{N}_%+-]+)*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,24}(?![\p{L}\p{N}-])"),
    "ipv6": re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Za-z:])"),
    "mac": re.compile(r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])"),
    "ipv4": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)", re.A),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", re.A),
    "card": re.compile(r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d]|-\d)", re.A),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.A),
    "phone": re.compile(r"(?<![\d+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{2,4}(?:[ .-]\d{2,4}){1,3}(?!\d|[.-]\d)|(?<![\d+.-])\+\d{8,14}(?!\d)", re.A),
    # Forms of address in their own case with one or two capital words (or all in capitals), and, with a point, in lower case with one word.
    "name": regex.compile(
        rf"(?<![{_L}\d_])(?:(?:{_TITLE}|{_TITLE.upper()})(?![{_L}])\.?[ ])+(?P<a>{_MAJOR}(?:[ ]{_MAJOR})?)|(?<![{_L}\d_])(?:(?:{_SHORT_TITLE})\.[ ])+(?P<b>{_WORD}(?:[ ]{_WORD})?)"
        rf"|(?<![{_L}\d_])(?i:{'|'.join(map(regex.escape, LEADS))})[ ](?P<c>{_MAJOR}(?:[ ]{_MAJOR})?)"
    ),
}
# What a form of address looks like, loosely and quickly: few texts have it, and only they are looked through for names.
_ADDRESS = re.compile(rf"[{''.join(sorted({t[0] for t in TITLES}))}](?:{'|'.join(sorted({re.escape(x[1:]) for t in TITLES for x in (t, t.upper())}))})\.?[ ]")
_DOTTED = tuple(sorted(f"{t.lower()}. " for t in TITLES))
_PLAIN_TITLES = {t.lower() for t in TITLES}
_CUED = regex.compile(rf"(?<![{_L}])(?i:{'|'.join(PHONES)})(?![{_L}])[ .:#]{{0,3}}(?P<n>\+?\d[\d .()-]{{5,18}}\d)(?![\d])")
_HINT = {"email": "@", "ipv6": ":"}
_DIGITS = re.compile(r"\d[\d .()-]{5,}\d", re.A)


class Surrogates:
    """The keyed permutations of one key."""

    ROUNDS = 6

    def __init__(self, key: bytes) -> None:
        if not key:
            raise ValueError("surrogates need a key")
        self.key = key

    def _number(self, label: str, value: int, below: int) -> int:
        raw = hmac.digest(self.key, f"{label}|{value}".encode(), hashlib.sha256)
        size = (below.bit_length() + 71) // 8
        while len(raw) < size:
            raw += hmac.digest(self.key, raw, hashlib.sha256)
        return int.from_bytes(raw[:size]) % below

    def permute(self, label: str, x: int, n: int) -> int:
        """A keyed permutation of 0..n-1 that leaves nothing in place (of two or more).

        Numbers are put into a keyed order, each takes the place of the next in it: one cycle
        through all, which stays one cycle when it is walked on to the numbers with a property.
        """
        if n < 2:
            return x
        return self._ordered(label, (self._ordered(label, x, n) + 1) % n, n, back=True)

    def _ordered(self, label: str, x: int, n: int, back: bool = False) -> int:
        """The place of ``x`` in the keyed order of 0..n-1, or what is at place ``x``: a Feistel network, walked on until within n."""
        a = 1 << (n.bit_length() + 1) // 2
        b = -(-n // a)
        while True:
            left, right = x // a, x % a
            for k in reversed(range(self.ROUNDS)) if back else range(self.ROUNDS):
                sign = -1 if back else 1
                if k % 2:
                    right = (right + sign * self._number(f"{label}|{n}|{k}", left, a)) % a
                else:
                    left = (left + sign * self._number(f"{label}|{n}|{k}", right, b)) % b
            x = left * a + right
            if x < n:
                return x

    def form(self, label: str, text: str, keeps: Callable[[str], object] | None = None) -> str:
        """Permute a text among those of its form (and for which ``keeps`` is as for it)."""
        alphabets = [_alphabet(c) for c in text]
        shape = f"{label}|{''.join(a[0] if a else c for a, c in zip(alphabets, text, strict=True))}"
        x, n = 0, 1
        for a, c in zip(alphabets, text, strict=True):
            if a:
                x, n = x * len(a) + a.index(c), n * len(a)
        want = keeps(text) if keeps else None
        while True:
            x = self.permute(shape, x, n)
            rest, out = x, []
            for a, c in zip(reversed(alphabets), reversed(text), strict=True):
                if a:
                    rest, k = divmod(rest, len(a))
                    out.append(a[k])
                else:
                    out.append(c)
            new = "".join(reversed(out))
            if keeps is None or keeps(new) == want:
                return new

    def of(self, kind: str, text: str) -> str:
        return getattr(self, f"_{kind}", self._formed)(kind, text)

    def _formed(self, kind: str, text: str) -> str:
        return self.form(kind, text)

    def _hex(self, kind: str, text: str) -> str:
        """Hexadecimal digits move among themselves, and are written in the case of the original."""
        digits = [c for c in text if c not in ":-"]
        x = self.permute(f"{kind}|{len(digits)}|{''.join(c for c in text if c in ':-')}", int("".join(digits), 16), 16 ** len(digits))
        new = iter(f"{x:0{len(digits)}{'X' if text != text.lower() else 'x'}}")
        return "".join(next(new) if c not in ":-" else c for c in text)

    _mac = _ipv6 = _hex

    def _email(self, kind: str, text: str) -> str:
        """Letters of addresses know no case: permuted in lower case, then set as the original."""
        local, domain = _lower(text).rsplit("@", 1)
        name, top = domain.rsplit(".", 1)
        return _cased(f"{self.form('local', local)}@{self.form('domain', name)}.{top}", text)

    def _digits(self, label: str, text: str, keeps: Callable[[str], object]) -> str:
        """Digits alone count, however they are set apart."""
        new = iter(self.form(label, "".join(c for c in text if c.isdigit()), keeps))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def _card(self, kind: str, text: str) -> str:
        return self._digits(kind, text, lambda d: (luhn(d), d[0]))

    def _ssn(self, kind: str, text: str) -> str:
        return self._digits(kind, text, lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000")

    def _phone(self, kind: str, text: str) -> str:
        lead = re.match(r"\+\d{1,3}(?=\D)|\+\d", text)
        country = lead[0] if lead else ""
        return country + self._digits(f"phone{country}", text[len(country) :], lambda d: d[0] in "01")

    def _ipv4(self, kind: str, text: str) -> str:
        x = int.from_bytes(bytes(map(int, text.split("."))))
        want = _network(x)
        while True:
            x = self.permute(kind, x, 1 << 32)
            if _network(x) == want:
                return ".".join(map(str, x.to_bytes(4)))

    def _iban(self, kind: str, text: str) -> str:
        plain = text.replace(" ", "")
        body = self.form(f"iban{plain[:2]}", plain[4:])
        valid = _mod97(plain[4:] + plain[:4]) == 1
        digits = f"{98 - _mod97(body + plain[:2] + '00'):02d}" if valid else self.form("check", plain[2:4])
        new = iter(plain[:2] + digits + body)
        return "".join(next(new) if c != " " else c for c in text)

    def _name(self, kind: str, text: str) -> str:
        words = text.split(" ")
        titles = len(words) - len(_words(text))
        return " ".join([*words[:titles], *map(self.word, words[titles:])])

    def word(self, name: str) -> str:
        """One word of a name: a known given name among its like, another by letters; the case stays."""
        plain = _lower(name)
        known = _gender(plain)
        if known:
            pool = [_lower(x) for x in GIVEN[known]]
            new = pool[self.permute(f"given{known}", pool.index(plain), len(pool))]
            return new.upper() if name.isupper() else new if name == plain else new[:1].upper() + new[1:]
        return _cased(self.form("name", plain, lambda x: bool(_gender(x))), name)


def _words(name: str) -> list[str]:
    """The words of a name without the forms of address before it."""
    words = name.split(" ")
    while len(words) > 1 and _lower(words[0]).rstrip(".") in _PLAIN_TITLES:
        words = words[1:]
    return words


def _lower(text: str) -> str:
    """Lower case where that is one letter."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _cased(text: str, like: str) -> str:
    """``text`` in the case of ``like``, letter by letter."""
    return "".join(c.upper() if o.isupper() and len(c.upper()) == 1 else c for c, o in zip(text, like, strict=True))


# The letters that a script's common alphabet moves among.
_CORES = (("0", "9"), ("a", "z"), ("A", "Z"), ("α", "ω"), ("Α", "Ω"), ("а", "я"), ("А", "Я"))


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """The letters or digits among which a character may move; empty for separators.

    ASCII digits, and common letters of one case among themselves; other letters among those of their
    script, kind and block of 256 codes (Latin's first two blocks are one) whose case is one letter.
    """
    kind = unicodedata.category(c)
    core = next(((x, y) for x, y in _CORES if x <= c <= y), None)
    if core:
        found = [x for x in map(chr, range(ord(core[0]), ord(core[1]) + 1)) if x < "\x80" or x.upper().lower() == x or x.lower().upper() == x]
    elif kind in ("Ll", "Lu", "Lo") and ord(c) >= 128:
        script = unicodedata.name(c, "").split(" ")[0]
        block = range(0x80, 0x180) if ord(c) < 0x180 else range(ord(c) & ~255, (ord(c) | 255) + 1)
        found = [x for x in map(chr, block) if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script and len(x.upper()) == len(x.lower()) == 1]
        found = [x for x in found if (kind == "Lo" or x.upper().lower() == x.lower() and x.lower().upper() == x.upper()) and not any(a <= x <= b for a, b in _CORES)]
    else:
        return ""
    return "".join(found) if c in found else ""  # a letter whose case is two letters stays


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _network(x: int) -> int:
    """0 for public addresses; private, loopback and other special ranges by number."""
    for k, (net, bits) in enumerate(((10, 8), (127, 8), (0, 8), (172 << 4 | 1, 12), (192 << 8 | 168, 16), (169 << 8 | 254, 16), (14, 4), (15, 4)), 1):
        if x >> (32 - bits) == net:
            return k
    return 0


@lru_cache(maxsize=4096)
def _gender(name: str) -> tuple[str, str] | None:
    """Gender and script of a known given name, in lower case."""
    return next((k for k, pool in GIVEN.items() if name in map(_lower, pool)), None)


def _ipv6(text: str) -> bool:
    """Whether colons and digits are an address: eight groups, or a gap and three or more, or a gap after a network's usual first group."""
    groups = [g for g in text.split(":") if g]
    if "::" in text:
        if len(groups) < 3 and not (len(groups) == 2 and len(groups[0]) == 4 and groups[0][0] in "23fF"):
            return False
    elif len(groups) != 8:
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def _names(text: str) -> list[tuple[int, int]]:
    """Where names are: those told by what stands before them, then every other place of their words."""
    if not _ADDRESS.search(text) and not any(t in text for t in _DOTTED):
        low = text.lower()
        if not any(lead in low for lead in LEADS):
            return []
    told = []
    for m in _PATTERNS["name"].finditer(text):
        group = next(g for g in "abc" if m[g])
        a, b = m.span(group)
        first = m[group].split(" ")[0]
        if group == "b" and not _gender(_lower(first)):
            b = a + len(first)  # in lower case the next word is part of it only after a given name
        told.append((a if group == "c" else m.start(), b))
    words = {w for a, b in told for w in _words(text[a:b]) if len(w) > 2}
    if words:
        forms = words | {w.upper() for w in words} | {w[:1].upper() + w[1:].lower() for w in words}
        again = regex.compile(rf"(?<![{_L}\d_])(?:{'|'.join(map(regex.escape, sorted(forms, key=lambda w: (-len(w), w))))})(?![{_L}\d_])")
        told += [m.span() for m in again.finditer(text)]
    return told


def find(text: str) -> list[tuple[int, int, str]]:
    """Entities (start, end, kind) from left to right; of overlapping ones the kind listed first."""
    taken: list[tuple[int, int, str]] = []
    digits = None

    def take(a: int, b: int, kind: str) -> None:
        if all(b <= x or y <= a for x, y, _ in taken):
            taken.append((a, b, kind))

    for kind in KINDS:
        if kind == "name":
            for a, b in _names(text):
                take(a, b, kind)
            continue
        if kind in _HINT and _HINT[kind] not in text:
            continue
        if kind in ("ipv4", "card", "ssn", "phone", "iban", "mac"):
            if digits is None:
                digits = _DIGITS.search(text) is not None or "+" in text or ":" in text
            if not digits and kind not in ("iban", "mac"):
                continue
        for m in _PATTERNS[kind].finditer(text):
            if kind == "iban" and _mod97(m[0].replace(" ", "")[4:] + m[0][:4]) != 1 or kind == "ipv6" and not _ipv6(m[0]):
                continue
            take(m.start(), m.end(), kind)
        if kind == "phone" and digits:
            for m in _CUED.finditer(text):
                take(*m.span("n"), kind)
    return sorted(taken)


def replace(text: str, surrogates: Surrogates, memo: dict) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the entities found in it."""
    found = find(text)
    if not found:
        return text, found
    out, at = [], 0
    for a, b, kind in found:
        entity = kind, text[a:b]
        if entity not in memo:
            if len(memo) > 1 << 16:
                memo.clear()
            memo[entity] = surrogates.of(*entity)
        out += [text[at:a], memo[entity]]
        at = b
    return "".join([*out, text[at:]]), found


def session_key(spark: SparkSession) -> bytes:
    """The key of ``KEY_SETTING``, or one drawn for this session."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key.encode()


def surrogate_report(docs: DataFrame, key: bytes | None = None, check: bool = False) -> DataFrame:
    """Rows (doc_id, text, n_entities, kinds), one for each row of ``docs`` (doc_id, text): the new text and counts by kind.

    With ``check``, entities and surrogates of the whole corpus are compared first, and collisions are an error.
    """
    key = key or session_key(docs.sparkSession)
    if check and (clash := collisions(docs, key).limit(3).collect()):
        raise ValueError(f"surrogates collide: {[(r.kind, r.surrogate, r.n) for r in clash]}")

    def run(batches):
        surrogates, memo = Surrogates(key), {}
        for b in batches:
            text, n, kinds = [], [], []
            for t in b.column("text").to_pylist():
                new, found = (None, []) if t is None else replace(t, surrogates, memo)
                text.append(new)
                n.append(len(found))
                every = [k for _, _, k in found]
                kinds.append(",".join(f"{k}:{every.count(k)}" for k in KINDS if k in every))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(kinds, pa.string())], names=["doc_id", "text", "n_entities", "kinds"])

    return columns(docs, doc_id="long", text="string").transform(in_batches, run, "doc_id long, text string, n_entities long, kinds string")


def anonymize(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs``, all columns, with surrogates in ``text``."""
    key = key or session_key(docs.sparkSession)

    def run(batches):
        surrogates, memo = Surrogates(key), {}
        for b in batches:
            text = [None if t is None else replace(t, surrogates, memo)[0] for t in b.column("text").to_pylist()]
            k = b.schema.get_field_index("text")
            yield b.set_column(k, b.schema.field(k), pa.array(text, b.schema.field(k).type))

    return docs.transform(in_batches, run, docs.schema)


def _plain(kind: str, entity: str, surrogate: str) -> tuple[str, str, str]:
    """An entity without what tells no two apart: the case of names and addresses, and how digits are set."""
    if kind in ("name", "email", "ipv6", "mac"):
        return kind, _lower(entity), _lower(surrogate)
    return kind, entity, surrogate


def _movable(kind: str, entity: str) -> bool:
    """Whether a letter or digit of an entity has others to move among (the last part of an address stays)."""
    return any(map(_alphabet, entity.rsplit(".", 1)[0] if kind == "email" else entity))


def entities(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """Distinct rows (kind, entity, surrogate) of a corpus; names by word, and without those of which no letter or digit can move."""
    key = key or session_key(docs.sparkSession)

    def run(batches):
        surrogates = Surrogates(key)
        for b in batches:
            seen = {(k, w) for t in b.column("text").to_pylist() if t for x, y, k in find(t) for w in (_words(t[x:y]) if k == "name" else [t[x:y]])}
            rows = sorted({_plain(*e, surrogates.of(*e)) for e in seen if _movable(*e)})
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in rows], pa.string()) for k in range(3)], names=["kind", "entity", "surrogate"])

    return columns(docs, text="string").transform(in_batches, run, "kind string, entity string, surrogate string").distinct()


def collisions(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """Rows (kind, surrogate, n) where ``n`` entities share a surrogate, or one is its own."""
    found = entities(docs, key)
    return found.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("entity") == F.col("surrogate")).alias("same")).where("n > 1 or same").drop("same")
