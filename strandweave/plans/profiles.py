"""Published error profiles and motifs. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    """raw_rate, the shares of each kind, where an edit falls, and which base or motif it takes."""

    name: str
    raw_rate: float
    mismatch: float
    deletion: float
    insertion: float
    deletion_bases: dict[str, float]
    insertion_bases: dict[str, float]
    deletion_runs: float = 0.0
    insertion_runs: float = 0.0
    swaps: dict[str, dict[str, float]] = field(default_factory=dict)

    def scaled(self, times: float) -> Profile:
        """For PCR cycles or storage months: the rate times their number."""
        return Profile(**{**self.__dict__, "raw_rate": min(1.0, self.raw_rate * times)})


EVEN = {"A": 0.25, "C": 0.25, "G": 0.25, "T": 0.25}
MORE_A = {"A": 0.4, "C": 0.2, "G": 0.2, "T": 0.2}
MORE_GC = {"A": 0.15, "C": 0.35, "G": 0.35, "T": 0.15}
MORE_AT = {"A": 0.35, "C": 0.15, "G": 0.15, "T": 0.35}
TAG_TAC = {"TAG": {"TGG": 1.0}, "TAC": {"TGC": 1.0}}
CG = {"CG": {"CA": 0.5, "TG": 0.5}}

SYNTHESIS = {
    3: Profile("ErrASE (column)", 2.5e-05, 0.2, 0.6, 0.2, MORE_A, EVEN),
    4: Profile("Oligo Hybridization based error correction", 0.0004, 0.2, 0.6, 0.2, MORE_A, EVEN),
    5: Profile("High-temperature ligation/hybridization based error correction", 0.0017, 0.2, 0.6, 0.2, MORE_A, EVEN, swaps={"AAAA": {"ACGT": 1.0}, "ACCC": {"ACGC": 1.0}}),
    6: Profile("ErrASE (microarray)", 0.00125, 0.2, 0.6, 0.2, MORE_A, EVEN),
    7: Profile("Nuclease-based error correction", 0.00033, 0.2, 0.6, 0.2, MORE_A, EVEN),
    68: Profile("MutS", 0.0001, 0.15, 0.7, 0.15, MORE_A, EVEN),
    69: Profile("Consensus Shuffle", 0.000125, 0.15, 0.7, 0.15, MORE_A, EVEN),
    70: Profile("NGS-based error correction", 0.00011, 0.2, 0.6, 0.2, MORE_A, EVEN),
    71: Profile("None", 0.0, 0.3, 0.3, 0.3, MORE_A, EVEN),
}
SEQUENCING = {
    35: Profile("Single End", 0.0021, 0.9963, 0.0024, 0.0013, EVEN, EVEN, swaps={"A": {"C": 0.25, "G": 0.5, "T": 0.25}, "C": {"A": 0.25, "G": 0.5, "T": 0.25}, "T": {"G": 0.5, "A": 0.25, "C": 0.25}, "G": {"A": 0.25, "C": 0.25, "T": 0.5}}),
    36: Profile("Paired End", 0.0032, 0.79, 0.0018, 0.0011, EVEN, EVEN, swaps={"A": {"G": 0.5, "T": 0.25, "C": 0.25}, "T": {"G": 0.5, "A": 0.25, "C": 0.25}, "C": {"G": 0.5, "A": 0.25, "T": 0.25}, "G": {"T": 0.5, "A": 0.25, "C": 0.25}}),
    37: Profile("Subread", 0.02, 0.75, 0.2, 0.05, MORE_GC, MORE_AT, 0.85, 0.85, CG),
    38: Profile("CCS", 0.14, 0.37, 0.21, 0.42, MORE_GC, MORE_AT, 0.85, 0.85, CG),
    39: Profile("1D", 0.2, 0.48, 0.37, 0.15, MORE_GC, MORE_AT, 0.46, 0.46, TAG_TAC),
    40: Profile("2D", 0.13, 0.41, 0.36, 0.23, MORE_GC, MORE_AT, 0.46, 0.46, TAG_TAC),
    41: Profile("None", 0.0, 0.3, 0.3, 0.4, MORE_GC, MORE_AT, 0.46, 0.46, TAG_TAC),
}

#: Undesired subsequences; each is certain to fail. Fixed values.
MOTIFS = (
    "TATAAA", "TTGACA", "TGTATAATG", "GCCACCATGG", "ACCACCATGG", "AATAAA", "TTGTGTGTTG",
    "ATAACTTCGTATAGCATACATTATACGAAGTTAT", "ATAACTTCGTATAGCATACATTATACGAACGGTA", "TACCGTTCGTATAGCATACATTATACGAAGTTAT",
    "TACCGTTCGTATAGCATACATTATACGAACGGTA", "TACCGTTCGTATATGGTATTATATACGAAGTTAT", "TACCGTTCGTATATTCTATCTTATACGAAGTTAT",
    "TACCGTTCGTATAGGATACTTTATACGAAGTTAT", "TACCGTTCGTATATACTATACTATACGAAGTTAT", "TACCGTTCGTATACTATAGCCTATACGAAGTTAT",
    "ATAACTTCGTATATGGTATTATATACGAACGGTA", "ATAACTTCGTATAGTATACCTTATACGAAGTTAT", "ATAACTTCGTATAGTATACATTATACGAAGTTAT",
    "ATAACTTCGTATAGTACACATTATACGAAGTTAT", "GCATACAT", "TGGTATTA", "TTCTATCT", "GGATACTT", "TACTATAC", "CTATAGCC", "AGGTATGC", "TTGTATGG",
    "GGATAGTA", "GTGTATTT", "GGTTACGG", "TTTTAGGT", "GTATACCT", "GTACACAT", "GAAGAC", "GGTCTC", "CGTCTC", "GCTCTTC", "GCGATG",
    "CTCGTAGACTGCGTACCA", "GACGATGAGTCCTGAGTA", "GGTTCCACGTAAGCTTCC", "GCGATTACCCTGTACACC", "GCCAGTACATCAATTGCC",
    "AAATAT", "ACAGTT", "GTAATATGT", "GGTACCACCG", "GGTACCACCA", "AAATAA", "GTTGTGTGTT", "TATTGAAGCATATTACATACGATATGCTTCAATA",
    "ATGGCAAGCATATTACATACGATATGCTTCAATA", "TATTGAAGCATATTACATACGATATGCTTGCCAT", "ATGGCAAGCATATTACATACGATATGCTTGCCAT",
    "TATTGAAGCATATATTATGGTATATGCTTGCCAT",
)
MOTIF_PROB = 1.0
