"""The recognisers of `pii` over one text at a time, for a kernel: what the column expressions there find.

A pattern is tried only on texts that may hold a match, which plain looks for a word tell: a line of a few
hundred characters costs as many of these looks as there are recognisers, not as many searches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from sprachwerk.resources import fixed


class Entity(NamedTuple):
    type: str
    text: str
    start: int
    end: int
    confidence: float
    source: str
    recognizer: str


def _digits(v: str) -> str:
    return re.sub(r"[^\d]", "", v)


def _compact(v: str) -> str:
    return re.sub(r"\s", "", v).upper()


def iban_valid(v: str) -> bool:
    c = _compact(v)
    return len(c) == 22 and c.startswith("DE") and c.isascii() and c[2:].isdigit() and int(c[4:] + "1314" + c[2:4]) % 97 == 1


def tax_id_valid(v: str) -> bool:
    d = [int(c) for c in _digits(v)]
    if len(d) != 11:
        return False
    counts = [d[:10].count(k) for k in range(10)]
    product = 10
    for x in d[:10]:
        product = 2 * ((x + product) % 10 or 10) % 11
    return sorted((counts.count(2), counts.count(3))) == [0, 1] and d[10] == (0 if product == 1 else 11 - product)


def svnr_valid(v: str) -> bool:
    c = _compact(v)
    return re.fullmatch(r"[0-9]{8}[A-Z][0-9]{3}", c) is not None and 1 <= int(c[2:4]) <= 31 and 1 <= int(c[4:6]) <= 12


def phone_valid(v: str) -> bool:
    return 7 <= len(_digits(v)) <= 15


def has_digit(v: str) -> bool:
    return re.search(r"\d", v) is not None


VALID: dict[str, Callable[[str], bool]] = {
    "de_iban": iban_valid,
    "de_tax_id": tax_id_valid,
    "de_svnr": svnr_valid,
    "de_mobile": phone_valid,
    "de_phone_intl": phone_valid,
    "de_phone": phone_valid,
    "de_invoice_number": has_digit,
    "de_customer_number": has_digit,
    "de_order_number": has_digit,
    "de_contract_number": has_digit,
}
_STREETS = ("straße", "strasse", "str", "str.", "weg", "allee", "platz", "gasse", "ring", "damm", "ufer", "steig", "chaussee", "graben", "markt", "berg", "feld", "hof", "garten", "park")
#: Where a number begins, and with it every match of some patterns; other patterns begin with letters that are plainly found.
_NUMBER = re.compile(r"(?<!\w)\d")
_BEGIN = {"de_iban": "DE", "de_vat_id": "DE", "de_hr_number": "HR", "de_phone_intl": "+49"} | dict.fromkeys(("de_tax_id", "de_tax_number", "de_svnr", "de_plz", "de_mobile", "de_phone"), "0")
#: Words one of which, in small letters, a text with a match holds; for texts that are `plain`. Of rules that need context these are its words.
_HELD = {
    "de_iban": ("de",),
    "de_vat_id": ("de",),
    "de_hr_number": ("hr",),
    "de_address": tuple(x for x in _STREETS if not any(o != x and o in x for o in _STREETS)),
    "de_mobile": ("01",),
    "de_phone_intl": ("+49",),
    "email": ("@",),
    "de_invoice_number": ("rechnung",),
    "de_customer_number": ("kunden", "kd"),
    "de_order_number": ("auftrag", "bestell"),
    "de_contract_number": ("vertrag",),
}


def plain(text: str) -> bool:
    """Whether small and capital letters go in pairs and digits are those of ASCII, as in nearly all texts."""
    if text.isascii():
        return True
    try:
        text.encode("cp1252")
    except UnicodeEncodeError:
        return False
    return True


class _Rule(NamedTuple):
    held: tuple[str, ...]
    begin: str | None
    name: str
    type: str
    pattern: re.Pattern[str]
    group: int
    confidence: float
    lifted: float
    context: tuple[str, ...]
    needed: bool
    valid: Callable[[str], bool] | None


def _rule(name: str, kind: str, pattern: str, group: int, confidence: float, context: str | None, needed: bool) -> _Rule:
    words = fixed.CONTEXT_WORDS[context] if context else ()
    # a word that holds another of them is found with the shorter one
    least = tuple(w for w in words if not any(o != w and o in w for o in words))
    held = least if needed else _HELD.get(name, ("",))
    return _Rule(held, _BEGIN.get(name), name, kind, re.compile(pattern, re.I if name in fixed.IGNORING_CASE else 0), group, confidence, min(1.0, round(confidence + 0.05, 10)), least, needed, VALID.get(name))


_RULES = tuple(_rule(*r) for r in fixed.RECOGNIZERS)


def shown(text: str) -> str:
    """The text as matches tell it: the noncharacters that `spans.find` marks with are U+FFFD."""
    for c in "\ufdd0\ufdd1\ufdd2":
        text = text.replace(c, "\ufffd")
    return text


def _any(text: str, words: tuple[str, ...]) -> bool:
    for w in words:
        if w in text:
            return True
    return False


def _near(text: str, start: int, end: int, words: tuple[str, ...]) -> bool:
    w = fixed.CONTEXT_WINDOW
    return _any(f"{text[max(0, start - w) : start]} {text[end : end + w]}".lower(), words)


def _places(text: str, begin: str) -> list[int]:
    out, at = [], text.find(begin)
    while at >= 0:
        out.append(at)
        at = text.find(begin, at + 1)
    return out


def _from(pattern: re.Pattern[str], text: str, places: list[int]) -> Iterator[re.Match[str]]:
    """pattern.finditer, where every match begins at one of these places."""
    end = 0
    for at in places:
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            yield m


def _behind_street(low: str, at: int) -> bool:
    """Whether a street's last syllable and white space stand before a place."""
    end = at
    while end and low[end - 1].isspace():
        end -= 1
    return end < at and low.endswith(_STREETS, 0, end)


def found(text: str) -> list[Entity]:
    """Entities of all recognisers, overlaps included."""
    usual, low, out = plain(text), text.lower(), []
    told = text if text.isascii() else shown(text)
    numbers = [m.start() for m in _NUMBER.finditer(told)]
    for held, begin, name, kind, pattern, group, confidence, lifted, context, needed, valid in _RULES:
        if usual:
            for w in held:
                if w in low:
                    break
            else:
                continue
            if name == "de_address" and not any(_behind_street(low, at) for at in numbers):
                continue
        matches = pattern.finditer(told) if begin is None else _from(pattern, told, numbers if begin == "0" else _places(told, begin))
        for m in matches:
            own, end = m[group], m.end()
            if not own.strip() or valid and not valid(own):
                continue
            start = end - len(own)
            near = bool(context) and _near(text, start, end, context)
            if near or not needed:
                out.append(Entity(kind, own, start, end, lifted if near else confidence, "regex", name))
    return out


def resolved(entities: list[Entity], least: float = 0.0) -> list[Entity]:
    """`pii.resolve` of entities that all come from patterns."""
    chosen: list[Entity] = []
    for e in sorted((e for e in entities if e.confidence >= least), key=lambda e: (-e.confidence, e.start - e.end, e.start, e)):
        if not any(o.start < e.end and e.start < o.end for o in chosen):
            chosen.append(e)
    return sorted(chosen, key=lambda e: (e.start, e.end, e))
