import pytest
from pyspark.sql import functions as F

from seqloom.functions import sequences as S
from seqloom.functions import vectors as V
from seqloom.functions.alphabet import DEFAULT
from seqloom.operators import kmers


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("line,want", [(">0 ATATAGTAGAT", 0), (">99  ATATATATATAT", 99), (">103\tATAGATAG", 103), (">107\nATAGATAG", 107), (">1337\n\t \tATATATA", 1337)])
def test_ids(spark, line, want):
    assert one(spark, S.parse_id(F.col("v")), v=line) == want


@pytest.mark.parametrize("line", ["> ATGTGTG", "> 123 ATGTGTG", ">123ATGTGTG", ">1F43 ATGTGTG"])
def test_bad_ids(spark, line):
    with pytest.raises(Exception, match="no sequence id"):
        one(spark, S.parse_id(F.col("v")), v=line)


def test_id_range(spark):
    assert one(spark, S.check_id(F.col("v"), 3), v=2) == 2
    with pytest.raises(Exception, match="out of range"):
        one(spark, S.check_id(F.col("v"), 3), v=3)


def test_reverse_complement(spark):
    assert one(spark, S.reverse_complement(F.col("v")), v="acgTTNx") == "AACGT"
    assert one(spark, S.reverse_complement(S.reverse_complement(F.col("v"))), v="GATTACA") == "GATTACA"


def test_six_frames(spark):
    frames = one(spark, S.six_frames(F.col("v")), v="ACTTGACA")
    want = {"Q*", "KD", "KQ", "EG", "TL", "PP"}
    letters = one(spark, F.transform(F.array(*map(F.lit, frames)), lambda x: S.compress(x)), v=1)
    assert {s for s in letters} == {"".join(DEFAULT.get(r) if r != "*" else r for r in f) for f in frames}
    assert set(letters) == want
    assert one(spark, S.translate_frame(F.col("v"), 0), v="ATGTGA") == "M*" and one(spark, S.translate_frame(F.col("v"), 0, True), v="ATGTGA") == "M"
    assert one(spark, S.translate_frame(F.col("v"), 0), v="AT") == "" and one(spark, S.translate_frame(F.col("v"), 0), v="ATN") == "X"
    assert one(spark, S.translate_frame(F.col("v"), 0), v="T,TTTTGGG") == "XFG"


@pytest.mark.parametrize("kmer,h", [("AAA", 0), ("RNA", 7), ("OOO", 286), ("aaa", 0), ("AXA", None), ("XAA", None), ("A-A", None)])
def test_three_mer_hash(spark, kmer, h):
    assert one(spark, S.kmer_hash(F.col("v"), 3), v=kmer) == h


@pytest.mark.parametrize("kmer,h", [("AA", 0), ("U*", 61), ("VK", 41), ("AV", 38), ("VV", 57)])
def test_two_mer_hash(spark, kmer, h):
    assert one(spark, S.kmer_hash(F.col("v"), 2), v=kmer) == h


def test_residue_hash(spark):
    assert one(spark, S.residue_hash(F.col("v")), v="v") == 19 and one(spark, S.residue_hash(F.col("v")), v="B") == -1
    with pytest.raises(Exception, match="not a residue"):
        one(spark, S.residue_hash(F.col("v")), v="1")


@pytest.mark.parametrize("seq,stride,last,want", [
    ("ABCDEFG", 1, False, ["ABC", "BCD", "CDE", "DEF", "EFG"]), ("ABCDEFG", 1, True, ["ABC", "BCD", "CDE", "DEF"]), ("ABCDEFG", 3, False, ["ABC", "DEF"]),
    ("ABCDEF", 3, False, ["ABC", "DEF"]), ("ABC", 1, True, []), ("AB", 1, False, []), ("", 3, False, []), ("ABCDEFG", 2, False, ["ABC", "CDE", "EFG"])])
def test_kmers(spark, seq, stride, last, want):
    assert one(spark, S.kmers(F.col("v"), 3, stride, last), v=seq) == want


def test_compress(spark):
    with pytest.raises(Exception, match="no class for residue B"):
        one(spark, S.compress(F.col("v")), v="ARB")
    assert one(spark, S.compress(F.col("v"), missing="drop"), v="ARB*") == "AB*" and one(spark, S.compress(F.col("v"), missing="-"), v="ARB") == "AB-"
    assert one(spark, S.compressed_kmer_hash(F.col("v"), 2), v="BC") == 5
    assert one(spark, S.neighbour_hashes(F.lit(-1)), v=1) == [] and one(spark, S.neighbour_hashes(F.lit(4)), v=1) == [4]


def test_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<bigint>")
    at = lambda c: one(spark, c, v=1)
    assert at(V.intersection(v(2, 1, 4), v(3, 5, 4))) == [4] and at(V.intersection_count(v(10, 69, 100), v(10, 100, 101))) == 2
    assert at(V.union(v(2, 1), v(3, 2))) == [1, 2, 3] and at(V.hamming(v(1, 2, 31), v(2, 31, 63))) == 2
    assert at(V.contains(v(31, 63), 31)) and at(V.with_kmer(v(0, 1, 4), 0, False)) == [1, 4] and at(V.with_kmer(v(4), 1)) == [1, 4]
    assert at(V.vector(v(3, -1, 3, 0))) == [0, 3] and at(V.intersects(v(31), v(31))) and at(V.count(v())) == 0
    for word, bits in ((0, 0), (1, 1), (5, 2), (0x0F, 4), (0xF0, 4), (0x80, 1), (0xFF, 8)):
        assert at(V.popcount(F.lit(word))) == bits
    with pytest.raises(ValueError):
        V.same_parameters(3, 23, 2, 23)


def test_frames_have_own_ids(spark):
    s = spark.createDataFrame([(0, "ACTTGACA"), (1, ""), (2, "ACG")], "seq_id bigint, seq string")
    ids = [r.frame_id for r in kmers.translate(s).collect()]
    assert sorted(ids) == list(range(18))
    long_form = kmers.presence(s.filter("seq_id = 0"), 2)
    assert kmers.unpacked(kmers.packed(long_form)).count() == long_form.count()
