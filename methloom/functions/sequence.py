"""Column expressions over base sequences: complement, motifs, codes."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# The IUPAC nucleotide letters, their complements and the bases that they stand for.
LETTERS = "ACGTRYSWKMBDHVN"
COMPLEMENTS = "TGCAYRSWMKVHDBN"
BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: Column | str) -> Column:
    """Reverse complement of an upper-case sequence; letters outside the table become N."""
    known = F.regexp_replace(_col(seq), f"[^{LETTERS}]", "N")
    return F.reverse(F.translate(known, LETTERS, COMPLEMENTS))


def expand_motifs(motifs: str) -> list[str]:
    """All plain sequences of a comma list of IUPAC motifs, sorted; they must have one length."""
    names = [m.strip().upper() for m in motifs.split(",")]
    out = sorted({"".join(p) for m in names for p in product(*(BASES[c] for c in m))})
    if len({len(m) for m in out}) != 1:
        raise ValueError("motifs must have one length")
    return out


def motif_hits(seq: Column | str, motifs: list[str], mod_loc: int = 0) -> Column:
    """Ascending places (from 0) of the modified base of every hit, overlapping ones too."""
    k = len(motifs[0])

    # Bytes are cut out in constant time, characters by walking from the text's start.
    def found(s: Column) -> Column:
        places = F.when(F.octet_length(s) >= k, F.sequence(F.lit(0), F.octet_length(s) - k)).otherwise(F.array().cast("array<int>"))
        hits = F.filter(places, lambda i: F.substring(s, i + 1, F.lit(k)).isin([m.encode() for m in motifs]))
        return F.transform(hits, lambda i: i + mod_loc) if mod_loc else hits

    return let(_col(seq).cast("binary"), found)


def base_codes(seq: Column | str) -> Column:
    """A, C, G, T as 0 to 3, any other letter as 4."""
    code = lambda b: F.when(b == "A", 0).when(b == "C", 1).when(b == "G", 2).when(b == "T", 3).otherwise(4)
    letters = F.filter(F.split(_col(seq), ""), lambda b: b != "")
    return F.transform(letters, lambda b: code(b).cast("tinyint"))
