"""Symbolic DNA as column expressions.  Spans are zero-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The IUPAC symbols, their complements and the bases each stands for.
SYMBOLS = "ACGTRYSWKMBDHVN"
COMPLEMENTS = "TGCAYRSWMKVHDBN"
BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
WEIGHTS = {"A": 1, "C": 2, "G": 4, "T": 8}


def symbol_mask(symbol: str) -> int:
    """The bases of a symbol as bits: A 1, C 2, G 4, T 8."""
    return sum(WEIGHTS[b] for b in BASES[symbol])


def dna_view(text: Column) -> Column:
    """Only the bases of a text, in upper case; stripped first, as upper() may lengthen other letters."""
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^ACGTacgt]", ""))


def iupac_view(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^ACGTRYNacgtryn]", ""))


def complement(seq: Column) -> Column:
    return F.translate(seq, SYMBOLS, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def masks(seq: Column) -> Column:
    """Base sets by position, as an array of bit masks."""
    digits = "".join(f"{symbol_mask(s):X}" for s in SYMBOLS)
    return F.transform(F.split(F.translate(seq, SYMBOLS, digits), ""), lambda d: F.conv(d, 16, 10).cast("int"))


def normalized(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, r"\s", ""))


def offending(raw: Column, alphabet: str = "ACGT") -> Column:
    """Distinct symbols outside the alphabet, sorted and joined."""
    rest = F.regexp_replace(normalized(raw), f"[{alphabet}]", "")
    return F.array_join(F.array_sort(F.array_distinct(F.split(rest, ""))), "")


def cardinality(seq: Column) -> Column:
    """How many exact words a symbolic one stands for, without expansion; decimal, as 4^n passes 2^63."""
    return F.aggregate(
        masks(seq), F.lit(1).cast("decimal(38,0)"), lambda n, m: (n * F.bit_count(m)).cast("decimal(38,0)")
    )


def pair_kind(left: Column, right: Column) -> Column:
    both = F.concat(left, right)
    return (
        F.when(both.isin("AT", "TA", "CG", "GC"), "watson_crick")
        .when(both.isin("GT", "TG"), "gt_wobble")
        .otherwise("hard_mismatch")
    )


def regional_difference(edits: Column, left: Column, right: Column) -> Column:
    """Edits beyond the difference of lengths, by the shorter length, at most 1."""
    shorter = F.greatest(F.lit(1), F.least(left, right))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (edits - F.abs(left - right)) / shorter))
