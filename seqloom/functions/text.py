"""Scalar functions on strings of residues; every function takes and gives columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS = "XBZJUO"


def to_residues(sequence: Column) -> Column:
    """Upper case without any character outside the 20 letters; what stood around them closes up."""
    return F.regexp_replace(F.upper(sequence), f"[^{AMINO}]", "")


def is_residues(sequence: Column, ambiguous: bool = False) -> Column:
    """Whether the trimmed string isn't empty and holds residue letters of either case only. Null gives false."""
    letters = AMINO + (AMBIGUOUS if ambiguous else "")
    return F.coalesce(F.upper(F.trim(sequence)).rlike(f"^[{letters}]+$"), F.lit(False))


def checked_residues(sequence: Column, ambiguous: bool = False) -> Column:
    """The trimmed upper-case string; the query fails on a row that isn't one of residues."""
    clean = F.upper(F.trim(sequence))
    return F.when(is_residues(sequence, ambiguous), clean).otherwise(F.raise_error(F.concat(F.lit("no residue sequence: "), F.coalesce(sequence, F.lit("null")))).cast("string"))


def has_length(sequence: Column, least: int | None = None, most: int | None = None) -> Column:
    ok = F.lit(True)
    if least is not None:
        ok = ok & (F.length(sequence) >= least)
    return ok & (F.length(sequence) <= most) if most is not None else ok


def kmers(sequence: Column, k: int) -> Column:
    """All overlapping substrings of k characters, in order and in linear time; none if the string is shorter."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    # a lookahead consumes nothing, so matches overlap; no match begins inside a surrogate pair
    return F.regexp_extract_all(sequence, F.lit(f"(?s)(?![\\uDC00-\\uDFFF])(?=(.{{{k}}}))"), F.lit(1))


def kmers_or_whole(sequence: Column, k: int) -> Column:
    return F.when(F.length(sequence) < k, F.array(sequence)).otherwise(kmers(sequence, k))


def letters(sequence: Column) -> Column:
    return F.regexp_extract_all(sequence, F.lit("(?s)(.)"), F.lit(1))


def strip_fasta_header(record: Column) -> Column:
    """The record's lines that don't begin with >, without white space."""
    return F.regexp_replace(F.regexp_replace(record, r"(?m)^>.*$", ""), r"\s+", "")


def helm_body(helm: Column) -> Column:
    """What stands in the first pair of braces; empty without one."""
    return F.regexp_extract(helm, r"\{([^}]+)\}", 1)


def helm_to_residues(helm: Column, analogs: dict[str, str], unknown: str = "X") -> Column:
    """One letter per monomer of the first polymer: itself if it is a residue, its natural analog, or `unknown`."""
    known = {a: a for a in AMINO} | analogs
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    monomers = F.split(helm_body(helm), r"\.")
    found = F.transform(monomers, lambda m: F.coalesce(table[F.regexp_replace(m, r"[\[\]]", "")], F.lit(unknown)))
    return F.when(helm_body(helm) == "", F.lit("")).otherwise(F.array_join(found, ""))


def parse_residues(sequence: Column) -> Column:
    """A linear molecule: monomers by position, and one bond from each one's R2 to the next one's R1."""
    parts = letters(F.upper(sequence))
    monomers = F.transform(parts, lambda m, i: F.struct(i.alias("m_idx"), m.alias("abbr")))
    bonds = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda m, i: F.struct(i.alias("m_idx1"), F.lit("R2").alias("rg1"), (i + 1).alias("m_idx2"), F.lit("R1").alias("rg2")))
    return F.struct(monomers.alias("monomers"), bonds.alias("bonds"))


def format_residues(molecule: Column) -> Column:
    return F.array_join(F.transform(molecule["monomers"], lambda m: m.abbr), "")
