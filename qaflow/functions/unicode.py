"""Canonical decomposition as expressions; the tables come from the standard's data in Python."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hangul syllables and the parts that they are made of.
HANGUL = (0xAC00, 0xD7A3)
LEADS, VOWELS, TAILS = ((0x1100, 19), (0x1161, 21), (0x11A7, 28))


@cache
def _decompositions() -> tuple[str, list[str]]:
    """The characters with a decomposition, those with the most parts first, and the first, second, ... part of each, as far as it has one."""
    found = {}
    for code in range(sys.maxunicode + 1):
        if not HANGUL[0] <= code <= HANGUL[1] and not 0xD800 <= code <= 0xDFFF:
            whole = unicodedata.normalize("NFD", chr(code))
            if whole != chr(code):
                found[chr(code)] = whole
    order = sorted(found, key=lambda c: (-len(found[c]), c))
    most = max(map(len, found.values()))
    return "".join(order), ["".join(found[c][k] for c in order if len(found[c]) > k) for k in range(most)]


@cache
def _marks() -> tuple[str, str]:
    """Characters with a combining class, and for each a character that sorts as its class does."""
    marks = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    return "".join(marks), "".join(chr(0x100 + unicodedata.combining(m)) for m in marks)


@cache
def _class(characters: str) -> str:
    """A regex class of characters, as ranges."""
    codes, out = sorted(map(ord, characters)), []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


def _hangul(c: Column) -> Column:
    """The parts of a syllable: its number counts tails within vowels within leads."""
    n = F.ascii(c) - HANGUL[0]
    part = lambda base, i: F.substring(F.lit("".join(map(chr, range(base[0], base[0] + base[1])))), i + 1, F.lit(1))
    tail = n % TAILS[1]
    lead, vowel = (n / (VOWELS[1] * TAILS[1])).cast("int"), ((n % (VOWELS[1] * TAILS[1])) / TAILS[1]).cast("int")
    return F.concat(part(LEADS, lead), part(VOWELS, vowel), F.when(tail > 0, part(TAILS, tail)).otherwise(""))


def _parts(c: Column) -> Column:
    """The decomposition of one character. A character that a later part is missing for stands behind the others, and ``translate`` deletes it."""
    characters, parts = _decompositions()
    first = F.translate(c, characters, parts[0])
    plain = F.when(first == c, c).otherwise(F.concat(first, *[F.translate(c, characters, p) for p in parts[1:]]))
    return F.when(c.between(chr(HANGUL[0]), chr(HANGUL[1])), _hangul(c)).otherwise(plain)


def _ordered(cluster: Column) -> Column:
    """Marks sorted by class, those of one class as they stand; a leading character without a class stays first."""
    marks, classes = _marks()
    # characters without a class sort before all classes
    key = lambda c: F.when(F.translate(c, marks, classes) == c, "").otherwise(F.translate(c, marks, classes))
    tagged = F.transform(F.split(cluster, ""), lambda c, i: F.struct(key(c).alias("k"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.array_sort(tagged), lambda x: x["c"]), "")


def nfd(text: Column) -> Column:
    """Canonical decomposition (NFD) of a string column; null stays null.

    Text without a character that decomposes and without two marks in a row is returned as it is.
    """
    marks, _ = _marks()
    mark, changes = _class(marks), _class(_decompositions()[0] + "".join(map(chr, range(HANGUL[0], HANGUL[1] + 1))))
    apart = F.when(text.rlike(changes), F.array_join(F.transform(F.split(text, ""), _parts), "")).otherwise(text)
    return F.element_at(F.transform(F.array(apart), lambda t: F.when(t.rlike(f"{mark}{{2}}"), _reordered(t, mark)).otherwise(t)), 1)


def _reordered(text: Column, mark: str) -> Column:
    """Each character with the marks after it, or marks at the very start, put in order by itself."""
    clusters = F.regexp_extract_all(text, F.lit(f"(?s)[^{mark[1:-1]}]{mark}*|^{mark}+"), F.lit(0))
    return F.array_join(F.transform(clusters, lambda x: F.when(F.char_length(x) > 1, _ordered(x)).otherwise(x)), "")
