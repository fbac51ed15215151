import itertools

import pytest

from seqloom.functions.alphabet import A20, CODONS, GENETIC_CODE, RESIDUES, Alphabet, ScoringMatrix, parse_classes


def test_every_triplet_once():
    assert len(CODONS) == 64 and set(CODONS) == {"".join(t) for t in itertools.product("ACGT", repeat=3)}
    assert set(CODONS.values()) <= set(RESIDUES)
    assert CODONS["ATG"] == "M" and CODONS["TGG"] == "W" and {c for c, a in CODONS.items() if a == "*"} == {"TAA", "TAG", "TGA"}


def test_classes():
    a = Alphabet.parse("(A) (R N D) (C E Q G H) (I L) (K M) (F P S T) (W Y V)")
    assert a.size == 7
    assert a.get("D") == a.get("N") and a.get("K") == a.get("M") and a.get("F") == a.get("T")
    assert a.get("A") != a.get("R") and a.get("D") != a.get("V") and a.get("K") != a.get("I")
    assert a.get("ATG") == a.get("M") and a.get("TAA") == "*" and a.reverse_get("CAT") == a.get("M")


@pytest.mark.parametrize("text", ["(A V) (R N D) (C E Q G H) (I L) (K M) (F P S T) (W Y V)", "(A) (R N D) (C E Q G H) (I L) (K M) (F P S T) (W Y)"])
def test_bad_alphabets(text):
    with pytest.raises(ValueError):
        Alphabet.parse(text)


def test_parse_classes():
    assert parse_classes("(A) (R N D)") == [["A"], ["R", "N", "D"]] and parse_classes("") == [] and len(parse_classes(A20)) == 20
    assert len(parse_classes("(A R N D C E Q G H I L K M F P S T W Y)")[0]) == 19
    for bad in ("(A R (G H) Y)", ") (A", "(AB)", "A B"):
        with pytest.raises(ValueError):
            parse_classes(bad)


def test_scoring_matrix():
    full = {(a, b): 5 if a == b else -1 for a, b in itertools.combinations_with_replacement(RESIDUES, 2)}
    m = ScoringMatrix(full)
    assert m.score("r", "A") == m.score("A", "R") == -1 and m.score("v", "V") == 5
    with pytest.raises(ValueError):
        ScoringMatrix({("A", "A"): 1})


def test_code_length():
    assert len(GENETIC_CODE) == 64
