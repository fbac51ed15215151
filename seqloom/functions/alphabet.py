"""Residue and nucleotide alphabets, the genetic code, and compressed residue alphabets."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

#: Residue order defines hashes; the code is listed for triplets in T, C, A, G order.
RESIDUES = "ARNDCEQGHILKMFPSTWYV*UO"
AMBIGUOUS = "BZXJ-"
NUCLEOTIDES = "TCAG"
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STOP = "*"
A20 = "(A) (R) (N) (D) (C) (E) (Q) (G) (H) (I) (L) (K) (M) (F) (P) (S) (T) (W) (Y) (V)"

CODONS = {"".join(t): GENETIC_CODE[i] for i, t in enumerate(itertools.product(NUCLEOTIDES, repeat=3))}


def parse_classes(text: str) -> list[list[str]]:
    """``(A B) (C)`` -> [[A, B], [C]]; classes don't nest and hold one-letter tokens; blank text has none."""
    if re.sub(r"\([^()]*\)", "", text).strip():
        raise ValueError(f"classes must be lists in parentheses, not nested: {text!r}")
    classes = [c.split() for c in re.findall(r"\(([^()]*)\)", text)]
    for token in itertools.chain.from_iterable(classes):
        if len(token) != 1:
            raise ValueError(f"a class member must be one letter: {token!r}")
    return classes


@dataclass(frozen=True)
class Alphabet:
    """Residue classes; class i is written as the i-th letter from A, the stop residue as itself."""

    classes: tuple[tuple[str, ...], ...]

    def __post_init__(self):
        members = [r for c in self.classes for r in c]
        if len(set(members)) != len(members):
            raise ValueError("a residue is in two classes")
        missing = set(GENETIC_CODE) - {STOP} - set(members)
        if missing:
            raise ValueError(f"residues without a class: {sorted(missing)}")

    @classmethod
    def parse(cls, text: str) -> Alphabet:
        return cls(tuple(map(tuple, parse_classes(text))))

    @property
    def size(self) -> int:
        return len(self.classes)

    @property
    def letters(self) -> dict[str, str]:
        return {r: chr(ord("A") + i) for i, c in enumerate(self.classes) for r in c}

    def get(self, residue_or_codon: str) -> str:
        """Class letter of a residue or of what a codon stands for."""
        r = CODONS[residue_or_codon] if len(residue_or_codon) == 3 else residue_or_codon
        return r if r == STOP and STOP not in self.letters else self.letters[r]

    def reverse_get(self, codon: str) -> str:
        """Class letter of the codon on the other strand."""
        return self.get(codon[::-1].translate(str.maketrans("ACGT", "TGCA")))


DEFAULT = Alphabet.parse(A20)


class ScoringMatrix:
    """Symmetric, case-insensitive residue scores; every pair of residues must be given."""

    def __init__(self, scores: dict[tuple[str, str], int]):
        self._of = {}
        for (a, b), s in scores.items():
            for key in ((a.upper(), b.upper()), (b.upper(), a.upper())):
                if self._of.setdefault(key, s) != s:
                    raise ValueError(f"two scores for {key}")
        lost = [p for p in itertools.combinations_with_replacement(RESIDUES, 2) if p not in self._of]
        if lost:
            raise ValueError(f"no score for {lost[:3]}")

    def score(self, a: str, b: str) -> int:
        return self._of[a.upper(), b.upper()]

    def rows(self) -> list[tuple[str, str, int]]:
        """(aa1, aa2, score), to make a dimension table of."""
        return [(a, b, s) for (a, b), s in sorted(self._of.items())]
