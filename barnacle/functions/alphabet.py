"""Bases as bits: each base or IUPAC code is a hexadecimal digit with one bit for each of A, C, G and T.

A base of a read that isn't A, C, G or T in either case has no bit, so it matches nothing, not even N. Comparing n
positions takes one AND and one bit_count for every 15 of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes, their complements, and the bits of A (1), C (2), G (4) and T (8) in each.
IUPAC = "ACGTRYSWKMBDHVN"
COMPLEMENTS = "TGCAYRSWMKVHDBN"
BITS = "12485A69C3EDB7F"

#: Digits in a word: a sixteenth would reach the sign of a BIGINT.
WORD = 15

MASKS = {c: int(b, 16) for c, b in zip(IUPAC, BITS)}


def expansions(code: str) -> list[str]:
    """The bases that an IUPAC code stands for."""
    return [b for b in "ACGT" if MASKS[b] & MASKS[code]]


def reverse_complement_text(text: str) -> str:
    return text.upper().translate(str.maketrans(IUPAC, COMPLEMENTS))[::-1]


def folded(c: Column) -> Column:
    """IUPAC letters in upper case; unlike upper() it never changes the length."""
    return F.translate(c, IUPAC.lower(), IUPAC)


def complement(c: Column) -> Column:
    return F.translate(folded(c), IUPAC, COMPLEMENTS)


def reverse_complement(c: Column) -> Column:
    return F.reverse(complement(c))


def nibbles(c: Column) -> Column:
    """A read's bases as hexadecimal digits."""
    return F.translate(F.regexp_replace(F.translate(c, "acgt", "ACGT"), "[^ACGT]", "0"), "ACGT", "1248")


def mask_words(text: str) -> list[tuple[int, int, int]]:
    """Start, length and mask of each word of a text of IUPAC codes in which `-` constrains nothing."""
    digits = "".join("0" if c == "-" else f"{MASKS[c]:x}" for c in text.upper())
    words = [(i, len(digits[i : i + WORD]), int(digits[i : i + WORD], 16)) for i in range(0, len(digits), WORD)]
    return [w for w in words if w[2]]


def word(digits: Column, start, length: int) -> Column:
    """Digits from a 0-based place as a BIGINT."""
    return F.conv(F.substring(digits, F.lit(start) + 1 if isinstance(start, int) else start + 1, F.lit(length)), 16, 10).cast("long")


def mismatches(digits: Column, offset, text: str) -> Column:
    """Positions at which a read's digits, from an offset on, don't fit a text of IUPAC codes and `-`."""
    out = F.lit(sum(c != "-" for c in text))
    for start, length, mask in mask_words(text):
        at = offset + start
        out = out - F.bit_count(word(digits, at, length).bitwiseAND(F.lit(mask)))
    return out.cast("int")


def mask_digits(c: Column) -> Column:
    """A barcode's codes as hexadecimal digits."""
    return F.translate(folded(c), IUPAC, BITS)
