"""German normal forms, stems and estimates as column expressions. The text itself is never replaced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sprachwerk.functions.bind import let
from sprachwerk.functions.regex import java
from sprachwerk.resources.fixed import LIGHT_SUFFIXES

_SPACES = "\u00a0\u202f\u2009\u200a"
_GONE = "\u200b\u00ad\ufeff"
#: What most texts hold none of, so that a look for it is all they pay; in Latin-1, where a class is one table, and beyond.
_ODD = ("[\r\u00a0\u00ad]", r"[[^\x00-\xFF]&&[\u2009-\u200B\u202F\uFEFF\uFB00-\uFB04\u0132\u0133]]")
_LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\u0132": "IJ", "\u0133": "ij"}
_UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}
_QUOTES = '„“”"«»‟″'
#: What Python's str.strip() removes.
_STRIP = r"[\t-\r\x1C-\x20\x85\xA0[[^\x00-\xFF]&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]]]"


def _swap(c: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), pairs.items(), c)


def strip(c: Column) -> Column:
    """Without white space at its ends. A pattern would look at each character for the end, so texts that have none are not searched."""
    at_end = lambda x: F.substring(x, 1, 1).rlike(_STRIP) | F.substring(x, -1, 1).rlike(_STRIP)
    return let(c, lambda x: F.when(at_end(x), F.regexp_replace(x, rf"^{_STRIP}+|{_STRIP}+\z", "")).otherwise(x))


def unicode_form(c: Column) -> Column:
    """Line ends to \\n, odd spaces to plain ones, invisible marks gone, ligatures written out."""
    plain = F.regexp_replace(c, "\r\n?", "\n")
    return F.when(c.rlike(_ODD[0]) | c.rlike(_ODD[1]), _swap(F.translate(plain, _SPACES + _GONE, " " * len(_SPACES)), _LIGATURES)).otherwise(c)


def whitespace(c: Column) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("\t"), F.lit(" ")), "  +", " ")
    return strip(F.regexp_replace(_swap(c, {" \n": "\n", "\n ": "\n"}), "\n\n\n+", "\n\n"))


def quotes(c: Column) -> Column:
    """Double quotes become „ and “ by turns."""
    parts = F.split(c, f"[{_QUOTES}]", -1)
    marked = F.transform(parts, lambda x, i: F.when(i == 0, x).when(i % 2 == 1, F.concat(F.lit("„"), x)).otherwise(F.concat(F.lit("“"), x)))
    return F.array_join(marked, "")


def dashes(c: Column) -> Column:
    return F.translate(c, "—―−‐‑‒", "––----")


def umlauts(c: Column) -> Column:
    return _swap(c, _UMLAUTS)


def sharp_s(c: Column) -> Column:
    return F.replace(c, F.lit("ß"), F.lit("ss"))


def fold(c: Column) -> Column:
    """The key under which spellings are compared."""
    return F.lower(sharp_s(umlauts(c)))


def casefold(c: Column) -> Column:
    return sharp_s(F.lower(c))


def punctuation(c: Column) -> Column:
    return F.regexp_replace(c, java(r"[^\w\s]"), " ")


def search_form(c: Column, completed: Column | None = None) -> Column:
    """What is indexed. `completed` is the text after suspended hyphens were resolved, see operators.lexicon."""
    c = dashes(unicode_form(c)) if completed is None else completed
    return whitespace(F.lower(punctuation(umlauts(sharp_s(c)))))


def display_form(c: Column) -> Column:
    return whitespace(quotes(dashes(unicode_form(c))))


def light_stem(c: Column) -> Column:
    """The first suffix that leaves four characters is cut; null if none does."""
    cases = F
    for s in LIGHT_SUFFIXES:
        cut = c.endswith(s) & (F.length(c) - len(s) >= 4)
        cases = (F.when if cases is F else cases.when)(cut, F.substring(c, F.lit(1), F.length(c) - len(s)))
    return cases


def estimated_tokens(c: Column) -> Column:
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(c) / 4))).cast("int")


def whitespace_tokens(c: Column) -> Column:
    return F.filter(F.split(strip(c), java(r"\s+")), lambda x: x != "")


def words(c: Column) -> Column:
    """Words with inner hyphens."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


WORD = java("[\\w]+(?:[-–][\\w]+)*")
