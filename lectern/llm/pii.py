"""Surrogates for personal data: keyed, type-consistent and distinct replacements.

Every value is replaced by a keyed permutation of the values of its own format: a Feistel network
adds keyed digits to the characters of one half after the other, within the class of each
character (digit, vowel, consonant, case, script), then one character moves on by one and the network is undone, so
no value stays as it is.  Equal values get equal surrogates in every document without a table (coreference) and
different values different ones (distinctness).  Given names move along a keyed ring of the names of their script and gender,
alone or before a family name, so "John" and "John Smith" agree; a family name is permuted alike wherever it
stands.  Where a format has valid values only (check digits, address ranges) the permutation is walked until
it is back among them; these are a tenth or more of all, so walks are short.  ``collisions`` checks what was found.
"""

from __future__ import annotations

import hashlib
import ipaddress
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import checkpointed

ROUNDS = 8
#: Characters that stand for each other.
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèìòùâêîôûäëïöüãõåøæ", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜÃÕÅØÆ", "ñçšžčćřłńśźđ", "ÑÇŠŽČĆŘŁŃŚŹĐ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "άέήίόύώ", "ΆΈΉΊΌΎΏ",
)
HEX = "0123456789abcdef"
#: Given names by (script, gender).
GIVEN = {
    ("latin", "m"): "James John Robert Michael David Thomas Daniel Paul Peter Hans Karl Jürgen Pierre Jean Luc Carlos Juan Miguel José Andrés".split(),
    ("latin", "f"): "Mary Anna Linda Sarah Laura Emma Julia Clara Ingrid Greta Heike Marie Claire Sophie Camille María Lucía Carmen Elena Isabel".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Дмитрий Николай Павел Михаил".split(), ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Παύλος Γιάννης".split(), ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Δήμητρα".split(),
}
TITLES = {"m": "Mr Sir Herr Monsieur Señor Sr Господин Κύριος".split(), "f": "Mrs Ms Miss Lady Frau Madame Mme Mlle Señora Sra Госпожа Κυρία".split(), "": "Dr Prof".split()}
_TITLE_OF = {t: g for g, names in TITLES.items() for t in names}

PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])",
    "token": r"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk)[-_][0-9A-Za-z_-]{16,200}|gh[pousr]_[0-9A-Za-z]{30,200}|eyJ[0-9A-Za-z_-]{8,2000}\\.[0-9A-Za-z_-]{4,4000}\\.[0-9A-Za-z_-]{4,1000})(?![0-9A-Za-z_-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\w)|(?<![\w-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?!\w)",
    "name": rf"(?<!\w)(?P<title>{'|'.join(_TITLE_OF)})\.? (?P<own>\p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+){{0,2}})",
}
_ALL = regex.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
_DIGIT = regex.compile(r"[@\d]")
#: One of these (or a digit or @) is in every text with an entity.
_MARKS = [*(t + end for t in _TITLE_OF for end in (" ", ". ")), "AKIA", "ASIA", *(k + j for k in ("sk", "pk", "rk") for j in "-_"), "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "eyJ"]
_CLASS = {c: a for a in ALPHABETS for c in a}
_TOKEN = {c: a for a in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for c in a}


def _stream(key: bytes, tweak: str, turn: int, other: str, n: int) -> bytes:
    out, part = b"", 0
    while len(out) < n:
        out += hashlib.blake2b(f"{tweak}|{turn}|{part}|{other}".encode(), key=key).digest()
        part += 1
    return out[:n]


def _turns(chars: list[str], at: list[int], key: bytes, tweak: str, known: dict[str, str], back: bool) -> None:
    """The network's turns over the places ``at``, or the same undone."""
    halves = (at[::2], at[1::2])
    for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
        own, other = halves[turn % 2], halves[1 - turn % 2]
        noise = _stream(key, tweak, turn, "".join(chars[i] for i in other), 2 * len(own))
        for k, i in enumerate(own):
            letters = known[chars[i]]
            shift = 256 * noise[2 * k] + noise[2 * k + 1]
            chars[i] = letters[(letters.index(chars[i]) + (-shift if back else shift)) % len(letters)]


def permute(value: str, key: bytes, tweak: str, classes: dict[str, str] | None = None) -> str:
    """Keyed permutation of the strings with the same class at every place, without a fixed point; others stay.

    A step by one between a permutation and its inverse leaves nothing where it was.
    """
    known = _CLASS if classes is None else classes
    at = [i for i, c in enumerate(value) if c in known]
    if not at:
        return value
    kinds = tweak + "".join(known[c][0] if c in known else c for c in value)
    chars = list(value)
    _turns(chars, at, key, kinds, known, back=False)
    letters = known[chars[at[0]]]
    chars[at[0]] = letters[(letters.index(chars[at[0]]) + 1) % len(letters)]
    _turns(chars, at, key, kinds, known, back=True)
    return "".join(chars)


def walk(value: str, step: Callable[[str], str], kind: Callable[[str], object]) -> str:
    """``step`` until the value is of the kind it was of: again a permutation, of that kind alone."""
    wanted, at = kind(value), step(value)
    while kind(at) != wanted:
        at = step(at)
    return at


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def _ip(value: str, key: bytes) -> str:
    classes = dict.fromkeys(HEX, HEX)
    dotted = lambda h: str(ipaddress.IPv4Address(int(h, 16)))
    kind = lambda h: (lambda a: (a.is_private, a.is_multicast, a.is_reserved, a.is_loopback))(ipaddress.IPv4Address(int(h, 16)))
    return dotted(walk(f"{int(ipaddress.IPv4Address(value)):08x}", lambda h: permute(h, key, "ip", classes), kind))


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" else "latin"


@lru_cache(maxsize=64)
def _ring(key: bytes, script: str, gender: str) -> dict[str, str]:
    """Each known name to the next in a keyed order: no name stays."""
    names = sorted(GIVEN[script, gender], key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
    return dict(zip(names, names[1:] + names[:1], strict=True))


_KNOWN: dict[str, list[tuple[str, str]]] = {}
for _kind, _names in GIVEN.items():
    for _n in _names:
        _KNOWN.setdefault(_n, []).append(_kind)


def _name(value: str, gender: str, key: bytes) -> str:
    """A known given name moves along the ring of its script and gender wherever it stands; other names by letters.

    A name that is not listed could land on a listed one, and so meet its surrogate: it is moved on until it does not.
    Listed names are few, so that is one step.  ``gender`` (of a title) decides for a first name listed for both.
    """
    out = []
    for i, word in enumerate(value.split(" ")):
        kinds = _KNOWN.get(word)
        if kinds:
            own = next((k for k in kinds if i == 0 and k[1] == gender), kinds[0])
            out.append(_ring(key, *own)[word])
        else:
            out.append(walk(word, lambda w: permute(w, key, "name"), lambda w: w in _KNOWN))
    return " ".join(out)


def iban_checked(value: str) -> bool:
    """Whether the check digits hold (ISO 7064: remainder 1 by 97)."""
    bare = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _iban(value: str, key: bytes) -> str:
    """Country, groups and class of every account character stay; check digits are valid where they were."""
    account = [i for i, c in enumerate(value) if c != " "][4:]
    own = permute("".join(value[i] for i in account), key, "iban" + value[:2])
    chars = list(value)
    for i, c in zip(account, own, strict=True):
        chars[i] = c
    if iban_checked(value):
        rest = int("".join(str(int(c, 36)) for c in own + value[:2]) + "00") % 97
        chars[2:4] = f"{98 - rest:02d}"
    return "".join(chars)


@lru_cache(maxsize=100_000)
def surrogate(kind: str, value: str, gender: str, key: bytes) -> str:
    if kind == "ip":
        return _ip(value, key)
    if kind == "card":
        return walk(value, lambda v: v[0] + permute(v[1:], key, "card"), luhn)
    if kind == "secret":
        return permute(value, key, "secret", dict.fromkeys(HEX, HEX))
    if kind == "token":
        head = regex.match(r"(?:AKIA|ASIA|(?:sk|pk|rk)[-_]|gh[pousr]_|eyJ)", value)[0]
        return head + permute(value[len(head) :], key, "token" + head, _TOKEN)
    if kind == "name":
        return _name(value, gender, key)
    if kind == "iban":
        return _iban(value, key)
    if kind == "phone" and value.startswith("+"):
        head = regex.match(r"\+\d+", value)[0]
        return head + permute(value[len(head) :], key, "phone" + head)
    if kind == "email":
        own, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{permute(own, key, 'own')}@{permute(host, key, 'host')}.{top}"
    return permute(value, key, kind)


def entities(text: str) -> list[tuple[str, int, int, str, str]]:
    """``(kind, start, end, value, gender)`` of the entities of a whole text."""
    if not text or not (_DIGIT.search(text) or any(t in text for t in _MARKS)):
        return []
    out = []
    for m in _ALL.finditer(text):
        kind = next(k for k in PATTERNS if m[k] is not None)
        start, end = m.span("own" if kind == "name" else 0)
        gender = _TITLE_OF[m["title"]] if kind == "name" else ""
        out.append((kind, start, end, text[start:end], gender))
    return _recalled(text, out)


def _recalled(text: str, found: list[tuple[str, int, int, str, str]]) -> list[tuple[str, int, int, str, str]]:
    """``found`` and, for every full name that a title told, the places where it stands without one."""
    full = {value: gender for kind, _, _, value, gender in found if kind == "name" and " " in value}
    if not full:
        return found
    again = regex.compile(rf"(?<!\w)(?:{'|'.join(regex.escape(v) for v in sorted(full, key=lambda v: (-len(v), v)))})(?!\w)")
    taken = [(start, end) for _, start, end, _, _ in found]
    k, more = 0, []
    for m in again.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k == len(taken) or m.end() <= taken[k][0]:
            more.append(("name", m.start(), m.end(), m[0], full[m[0]]))
    return sorted(found + more, key=lambda e: e[1])


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, entities`` of every row: the text with surrogates, and per entity its
    kind, place in the original (code points), surrogate and a keyed digest of the original."""
    def change(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows, spans = [], []
            for text in texts.tolist():
                found, parts, at = [], [], 0
                for kind, start, end, value, gender in entities(text or ""):
                    new = surrogate(kind, value, gender, key)
                    digest = int.from_bytes(hashlib.blake2b(f"{kind}|{value}".encode(), key=key, digest_size=8).digest(), "big", signed=True)
                    parts += [text[at:start], new]
                    found.append((kind, start, end, new, digest))
                    at = end
                rows.append(text if not parts else "".join(parts) + text[at:])
                spans.append(found)
            yield pd.DataFrame({"text": pd.Series(rows, dtype=object), "entities": pd.Series([[dict(zip(("kind", "start", "end", "surrogate", "digest"), f, strict=True)) for f in s] for s in spans], dtype=object)})

    done = F.pandas_udf(change, "text string, entities array<struct<kind string, start long, end long, surrogate string, digest long>>")
    return docs.select("doc_id", done(F.col("text")).alias("_d")).select("doc_id", "_d.text", "_d.entities")


def collisions(done: DataFrame) -> DataFrame:
    """Surrogates that stand for different originals of a kind; none is expected."""
    found = done.select(F.explode("entities").alias("e")).select("e.kind", "e.surrogate", "e.digest")
    return found.groupBy("kind", "surrogate").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")


def pseudonymised(docs: DataFrame, key: bytes, attempts: int = 3) -> DataFrame:
    """``replaced``, stored and checked: with a collision everything is done again under the next key.

    ``key`` is the user's secret: whoever has it can undo the surrogates.  Null texts stay null, empty ones empty; repeated rows get equal results; null ids and further
    columns change nothing; an empty table gives no row.
    """
    for attempt in range(attempts):
        done = checkpointed(replaced(docs, key + bytes(attempt)))
        if collisions(done).isEmpty():
            return done
    raise ValueError("surrogates collide under every key")
