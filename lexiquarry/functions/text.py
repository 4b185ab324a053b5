"""Tokens as Column expressions, inside the JVM.

An *atom* is one word by Unicode's default word rules, cut further at punctuation, with at least
one letter or digit; the underscore stays inside. Every atom has one position. The index side adds
the parts of identifiers (split at underscores and case changes) at the atom's own position.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Scripts written without spaces give one atom a sign; everything else runs on.
ATOM = (
    rf"[{_ALONE}\p{{No}}][\p{{M}}\p{{Cf}}]*"
    rf"|[\p{{IsAlphabetic}}\p{{Nd}}\p{{Nl}}\p{{Pc}}&&[^{_ALONE}]][\p{{IsAlphabetic}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\p{{M}}\p{{Cf}}&&[^{_ALONE}]]*"
)
WORDY = r"[\p{IsAlphabetic}\p{N}]"
_NOT_UPPER = r"[\p{IsAlphabetic}\p{N}&&[^\p{IsUppercase}]]"
_LOWER = r"[\p{IsAlphabetic}&&[^\p{IsUppercase}\p{N}]]"
CASE_CHANGE = rf"(?<={_NOT_UPPER})(?=\p{{IsUppercase}})|(?<=\p{{IsUppercase}})(?=\p{{IsUppercase}}{_LOWER})"
MAX_TERM_BYTES = 512

#: A text of such signs alone, Latin letters and what stands between words: its atoms are runs of letters, digits and underscores, found in a quarter of the time.
_PLAIN = r"^[\u0000-\u00AC\u00AE-\u00B1\u00B4-\u00B8\u00BA\u00BB\u00BF-\u024F\u2010-\u2027\u2030-\u203E\u20A0-\u20BF]*+$"
_PLAIN_ATOM = r"[A-Za-z0-9_\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]++"

_PY_ATOM = regex.compile("(?V1)" + ATOM.replace(r"\p{Is", r"\p{").replace("&&[^", "--[").replace(r"\p{Cf}--", r"\p{Cf}--"))
_PY_WORDY = regex.compile(r"(?V1)[\p{Alphabetic}\p{N}]")


def atoms(text: Column) -> Column:
    """Array of atoms in their own case; null text has none."""
    text = F.coalesce(text, F.lit(""))
    # only these signs can make an atom without a letter or digit, so most texts need no look at each atom
    plain, found = F.regexp_extract_all(text, F.lit(_PLAIN_ATOM), F.lit(0)), F.regexp_extract_all(text, F.lit(ATOM), F.lit(0))
    plain = F.when(F.contains(text, F.lit("_")), F.filter(plain, lambda a: a.rlike("[^_]"))).otherwise(plain)
    found = F.when(text.rlike(rf"[\p{{Pc}}{_ALONE}]"), F.filter(found, lambda a: a.rlike(WORDY))).otherwise(found)
    return F.when(text.rlike(_PLAIN), plain).otherwise(found)


def parts(atom: Column) -> Column:
    """Lower-case terms of one atom: the whole first, then its identifier parts, each once."""
    pieces = F.flatten(F.transform(F.split(atom, "_"), lambda s: F.split(s, CASE_CHANGE)))
    split = F.array_distinct(F.concat(F.array(F.lower(atom)), F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.lower(p))))
    return F.when(splittable(atom), split).otherwise(F.array(F.lower(atom)))


def splittable(atom: Column) -> Column:
    # the pattern is dear, and most atoms are of small ASCII letters
    some = (F.lower(atom) != atom) | F.contains(atom, F.lit("_")) | (F.octet_length(atom) != F.length(atom))
    return some & atom.rlike(rf"_|{CASE_CHANGE}")


def query_atoms(text: str) -> list[str]:
    """The same atoms, lower-cased, for a query string; identifiers stay whole."""
    return [a.lower() for a in _PY_ATOM.findall(text) if _PY_WORDY.search(a)]


def atom_spans(text: str) -> list[tuple[str, int, int]]:
    """Atoms with their code-point spans."""
    return [(m[0], m.start(), m.end()) for m in _PY_ATOM.finditer(text) if _PY_WORDY.search(m[0])]


_PY_CASE = regex.compile("(?V1)" + CASE_CHANGE.replace(r"\p{Is", r"\p{").replace("&&[^", "--["))


def atom_terms(atom: str) -> list[str]:
    """Lower-case whole and parts of one atom, each once; the Python twin of ``parts``."""
    pieces = [p for s in atom.split("_") for p in _PY_CASE.split(s) if p]
    return list(dict.fromkeys([atom.lower(), *[p.lower() for p in pieces]]))
