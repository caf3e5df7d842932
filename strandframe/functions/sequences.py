"""Scalar functions on nucleotide strings, chromosome names, variants and GFF attributes; all are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The alphabet and its complement.
ALPHABET = "ACGTUNRYSWKMBDHV"
COMPLEMENT = "TGCAANYRSWMKVHDB"


def is_valid(seq: Column) -> Column:
    return F.upper(seq).rlike(f"^[{ALPHABET}]*$")


def legacy_clean(seq: Column) -> Column:
    """What is not a base becomes A."""
    return F.regexp_replace(F.upper(seq), f"[^{ALPHABET}]", "A")


def dna(seq: Column) -> Column:
    return F.replace(F.upper(seq), F.lit("U"), F.lit("T"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(F.upper(seq), ALPHABET, COMPLEMENT))


def gc_percent(seq: Column) -> Column:
    """Null for an empty sequence."""
    return F.when(F.length(seq) > 0, 100.0 * F.regexp_count(F.upper(seq), F.lit("[GC]")) / F.length(seq))


def slice_of(seq: Column, start: Column | int, end: Column | int) -> Column:
    """[start, end), 0-based."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.substring(seq, start.cast("int") + 1, (end - start).cast("int"))


def windows(seq: Column, width: int, step: int = 1) -> Column:
    """Array of all windows of ``width``; empty where the sequence is shorter."""
    starts = F.sequence(F.lit(1), F.length(seq) - width + 1, F.lit(step))
    return F.when(F.length(seq) >= width, F.transform(starts, lambda i: F.substring(seq, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def is_human(tax_id: Column) -> Column:
    return tax_id == 9606


def is_autosome(name: Column) -> Column:
    number = F.regexp_replace(name, "^chr", "")
    return number.rlike(r"^\+?[0-9]+$") & F.coalesce(number.try_cast("decimal(38,0)") < F.lit(2**32), F.lit(False))


def is_sex_chromosome(name: Column) -> Column:
    return F.regexp_replace(name, "^chr", "").isin("X", "Y", "x", "y")


def is_mitochondrial(name: Column) -> Column:
    return F.upper(name).isin("CHRM", "MT", "CHRMT")


def variant_class(ref: Column, alt: Column) -> Column:
    a, b = F.length(ref), F.length(alt)
    return F.when((a == 1) & (b == 1), "SNP").when(a < b, "Insertion").when(a > b, "Deletion").otherwise("MNP")


def variant_id(given: Column, chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """The given id, or chrom:pos:ref>alt where it is '.', empty or null. pos is 0-based."""
    made = F.concat(chrom, F.lit(":"), pos.cast("string"), F.lit(":"), ref, F.lit(">"), alt)
    return F.when(F.coalesce(given, F.lit(".")).isin(".", ""), made).otherwise(given)


def strip_prefix(name: Column, prefix: str) -> Column:
    return F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 20)).otherwise(name)


def attributes(text: Column) -> Column:
    """Map of GFF3 (k=v) or GTF (k "v") attributes: keys in lower case, quotes trimmed, the last of a key wins."""
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x.rlike("[= ]"))

    def pair(x):
        # the mark is the first '=', or else the first space
        at = F.when(x.contains("="), F.instr(x, "=")).otherwise(F.instr(x, " "))
        value = F.trim(F.substring(x, at + 1, F.length(x)))
        value = F.trim(F.when(value.contains('"'), F.regexp_replace(value, '^"+|"+$', "")).otherwise(value))
        return F.struct(F.lower(F.trim(F.substring(x, F.lit(1), at - 1))).alias("key"), value.alias("value"))

    # of equal keys the last one stays, whatever the session's map policy is
    last = lambda pairs: F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    # as the one element of an array the pairs have a name: they are made once a text, not once for each use
    return F.map_from_entries(F.transform(F.array(F.transform(parts, pair)), last)[0])


def encode_vector(v: Column) -> Column:
    """Comma-separated with six decimals."""
    return F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x.cast("double"))), ",")


def decode_vector(text: Column) -> Column:
    """Tokens that are no numbers are left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
