"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K


def dna_view(text: Column) -> Column:
    """The A, C, G and T letters of any text, upper-cased."""
    return F.upper(F.regexp_replace(text, "[^ACGTacgt]", ""))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def gc_count(seq: Column) -> Column:
    return count_chars(seq, "GCgc")


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTacgt", "TGCAtgca")


def cut(seq: Column, start: Column, end: Column) -> Column:
    """Bases ``start`` to ``end``, 1-based and inclusive, clipped to the sequence."""
    first = F.greatest(start, F.lit(1)).cast("int")
    return F.substr(seq, first, F.greatest(end.cast("int") - first + 1, F.lit(0)))


def strand_cut(seq: Column, start: Column, end: Column, complemented: bool = False) -> Column:
    """``cut`` for a hit; a start at or past the end means the reverse strand."""
    backwards = F.reverse(cut(seq, end, start))
    if complemented:
        backwards = complement(backwards)
    return F.when(end > start, cut(seq, start, end)).otherwise(backwards)


def evalue_number(text: Column) -> Column:
    """E-value text as a double. Old reports drop the 1 of ``1e-105``."""
    trimmed = F.trim(text.cast("string"))
    return F.regexp_replace(trimmed, "^[eE]", "1e").try_cast("double")


def first_token(header: Column) -> Column:
    return F.regexp_extract(header, r"^(\S+)", 1)


def contig_id(header: Column) -> Column:
    """Header text before the first bracketed attribute."""
    return F.regexp_extract(header, K.CONTIG_HEADER, 1)


def translate_codons(seq: Column) -> Column:
    """Protein for a coding sequence.

    Stops are dropped; codons with other letters and a partial last codon are skipped.
    """

    def base(codon: Column, place: int) -> Column:
        return F.instr(F.lit(K.CODON_BASES), F.substring(codon, place, 1)) - 1

    def residue(codon: Column) -> Column:
        first, second, third = (base(codon, i) for i in (1, 2, 3))
        known = (first >= 0) & (second >= 0) & (third >= 0)
        index = first * 16 + second * 4 + third + 1
        return F.when(known, F.substr(F.lit(K.CODON_RESIDUES), index, F.lit(1))).otherwise("")

    codons = F.regexp_extract_all(seq, F.lit("(?s).{3}"), F.lit(0))
    return F.replace(F.array_join(F.transform(codons, residue), ""), F.lit(K.STOP), F.lit(""))


def orf_header(header: Column) -> Column:
    """name, length, start, strand, ortholog e-value and description of an ORF header."""

    def part(i: int) -> Column:
        return F.regexp_extract(header, K.ORF_HEADER, i)

    def filled(value: Column) -> Column:
        return F.nullif(value, F.lit(""))

    return F.struct(
        filled(part(1)).alias("name"),
        filled(part(2)).cast("long").alias("length"),
        F.coalesce(filled(part(4)), filled(part(5))).cast("long").alias("start"),
        F.coalesce(filled(part(3)), filled(part(6))).alias("strand"),
        F.coalesce(filled(part(7)), F.lit("none")).alias("orth_eval"),
        part(8).alias("description"),
    )


def protein_header(header: Column) -> Column:
    """accession, description and gene of a UniProt-style header."""

    def part(i: int) -> Column:
        return F.regexp_extract(header, K.PROTEIN_HEADER, i)

    return F.struct(
        part(1).alias("accession"), part(2).alias("description"), part(3).alias("gene")
    )


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r of two arrays of equal size, NULL if one of them is constant."""
    n = F.size(x).cast("double")

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)

    def square(v: Column) -> Column:
        return v * v

    sum_x, sum_y = total(x), total(y)
    sum_xy = total(F.zip_with(x, y, lambda a, b: a * b))
    var_x = n * total(F.transform(x, square)) - square(sum_x)
    var_y = n * total(F.transform(y, square)) - square(sum_y)
    varied = (F.array_max(x) != F.array_min(x)) & (F.array_max(y) != F.array_min(y))
    return F.when(varied, F.try_divide(n * sum_xy - sum_x * sum_y, F.sqrt(var_x) * F.sqrt(var_y)))
