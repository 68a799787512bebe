"""Physico-chemical properties of residue strings as native expressions; a string that isn't one of residues gives null.

Constants: hydropathy (Kyte and Doolittle 1982), instability weights (Guruprasad et al. 1990, row by row), flexibility
(Vihinen et al. 1994), pK values (Bjellqvist et al. 1993, 1994), average residue masses (IUPAC).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions.text import AMINO, is_residues

HYDROPATHY = dict(zip("ARNDCQEGHILKMFPSTWYV", (1.8, -4.5, -3.5, -3.5, 2.5, -3.5, -3.5, -0.4, -3.2, 4.5, 3.8, -3.9, 1.9, 2.8, -1.6, -0.8, -0.7, -0.9, -1.3, 4.2)))
MASS = dict(A=71.0788, R=156.1875, N=114.1038, D=115.0886, C=103.1388, E=129.1155, Q=128.1307, G=57.0519, H=137.1411, I=113.1594, L=113.1594, K=128.1741, M=131.1926, F=147.1766, P=97.1167, S=87.0782, T=101.1051, W=186.2132, Y=163.1760, V=99.1326)
WATER = 18.01524
FLEXIBILITY = dict(A=0.984, C=0.906, E=1.094, D=1.068, G=1.031, F=0.915, I=0.927, H=0.950, K=1.102, M=0.952, L=0.935, N=1.048, Q=1.037, P=1.049, S=1.046, R=1.008, T=0.997, W=0.904, V=0.931, Y=0.929)
POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_TERM, C_TERM = 7.5, 3.55
N_TERM_OF = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
C_TERM_OF = {"D": 4.55, "E": 4.75}
#: Structure-forming residues.
HELIX, TURN, SHEET = "EMALK", "NPGSD", "VIYFWLT"


def count(sequence: Column, letters: str) -> Column:
    return F.length(sequence) - F.length(F.translate(sequence, letters, ""))


def weighted(sequence: Column, table: dict[str, float]) -> Column:
    """Sum of a constant per residue, by counting letters: no array of the string is made."""
    out = F.lit(0.0)
    for letter, value in sorted(table.items()):
        out = out + count(sequence, letter) * F.lit(value)
    return out


def molecular_weight(s: Column) -> Column:
    return weighted(s, MASS) + WATER


def hydropathy(s: Column) -> Column:
    return weighted(s, HYDROPATHY) / F.length(s)


def aromaticity(s: Column) -> Column:
    return count(s, "FWY") / F.length(s)


def aliphatic_index(s: Column) -> Column:
    return (count(s, "A") + 2.9 * count(s, "V") + 3.9 * count(s, "IL")) / F.length(s) * 100


def fraction(s: Column, letters: str) -> Column:
    return count(s, letters) / F.length(s)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once a row: expressions inside the lambdas of body would evaluate it anew in each step."""
    return F.transform(F.array(value), body)[0]


def _end(letter: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(letter == k, v).otherwise(out)
    return out


def _charged(s: Column) -> Column:
    """What the charge depends on: pK of both ends, and numbers of the residues with one."""
    ends = [_end(F.substring(s, 1, 1), N_TERM_OF, N_TERM).alias("first"), _end(F.substring(s, -1, 1), C_TERM_OF, C_TERM).alias("last")]
    return F.struct(*ends, *[count(s, x).alias(x) for x in (*POSITIVE, *NEGATIVE)])


def _charge_at(c: Column, ph: Column) -> Column:
    out = 1 / (1 + F.pow(F.lit(10.0), ph - c["first"])) - 1 / (1 + F.pow(F.lit(10.0), c["last"] - ph))
    for letter, pk in POSITIVE.items():
        out = out + c[letter] / (1 + F.pow(F.lit(10.0), ph - pk))
    for letter, pk in NEGATIVE.items():
        out = out - c[letter] / (1 + F.pow(F.lit(10.0), pk - ph))
    return out


def charge(s: Column, ph: Column | float = 7.0) -> Column:
    """Net charge by Henderson and Hasselbalch, with the pK of the ends set by their residues."""
    ph = F.lit(ph) if isinstance(ph, (int, float)) else ph
    return bound(_charged(s), lambda c: _charge_at(c, ph))


def isoelectric_point(s: Column, steps: int = 24) -> Column:
    """By bisection of the charge between pH 4.05 and 12; residues are counted once, not in each step."""
    state = F.struct(F.lit(4.05).alias("lo"), F.lit(12.0).alias("hi"))

    def bisected(c: Column) -> Column:
        def halve(acc: Column, _: Column) -> Column:
            mid = (acc.lo + acc.hi) / 2
            up = _charge_at(c, mid) > 0
            return F.struct(F.when(up, mid).otherwise(acc.lo).alias("lo"), F.when(up, acc.hi).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, halve, lambda acc: (acc.lo + acc.hi) / 2)

    return bound(_charged(s), bisected)


def flexibility(s: Column, window: int = 9) -> Column:
    """Mean over windows of 9 of the weighted mean flexibility; null for shorter strings. The string is split once."""
    table = F.create_map(*[F.lit(x) for pair in FLEXIBILITY.items() for x in pair])
    weights = (0.25, 0.4375, 0.625, 0.8125)
    split = F.transform(F.filter(F.split(s, ""), lambda x: x != ""), lambda x: table[x])
    n = F.length(s)

    def mean(parts: Column) -> Column:
        def at(i: Column) -> Column:
            total = F.get(parts, i + 4)
            for k, w in enumerate(weights):
                total = total + w * (F.get(parts, i + k) + F.get(parts, i + 8 - k))
            return total / 5.25

        scores = F.transform(F.sequence(F.lit(0), F.size(parts) - window), at)
        return bound(scores, lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / F.size(x))

    return F.when(n >= window, bound(split, mean))


def table_of(s: Column) -> dict[str, Column]:
    """Name -> expression of every property; null where the string holds anything but residues."""
    s = F.upper(F.trim(s))
    ok = is_residues(s)
    each = {
        "length": F.length(s).cast("double"),
        "molecular_weight": molecular_weight(s),
        "aromaticity": aromaticity(s),
        "isoelectric_point": isoelectric_point(s),
        "helix": fraction(s, HELIX),
        "turn": fraction(s, TURN),
        "sheet": fraction(s, SHEET),
        "hydrophobicity": hydropathy(s),
        "charge": charge(s),
        "aliphatic_index": aliphatic_index(s),
        "flexibility": flexibility(s),
    }
    return {k: F.when(ok, v) for k, v in each.items()}


LETTERS = AMINO
