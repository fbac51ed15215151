"""Column functions over sequences.  All are built-in expressions; null sequences give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import AMBIGUOUS, DEFAULT, GENETIC_CODE, NUCLEOTIDES, RESIDUES, Alphabet


def letters_of(text: Column) -> Column:
    """Upper-cased ASCII letters of a text; other characters go first, so that no case rule beyond ASCII applies."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def as_dna(seq: Column) -> Column:
    """Letters mapped to nucleotides in turn."""
    return F.translate(seq, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("ACGT" * 7)[:26])


def parse_id(line: Column) -> Column:
    """Number between ``>`` and the first white space of a simple FASTA line; raises if there is none."""
    found = F.regexp_extract(line, r"^>(\d+)[ \t\n]", 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no sequence id in: "), F.substring(line, 1, 40))).cast("bigint")).otherwise(found.cast("bigint"))


def parse_sequence(line: Column) -> Column:
    """What follows the header's first white space, trimmed."""
    return F.trim(F.regexp_extract(line, r"^>\S*\s+([\s\S]*)$", 1))


def check_id(seq_id: Column, n: Column | int) -> Column:
    """``seq_id`` if 0 <= seq_id < n, else an error."""
    ok = (seq_id >= 0) & (seq_id < n)
    return F.when(ok, seq_id).otherwise(F.raise_error(F.concat(F.lit("sequence id out of range: "), seq_id.cast("string"))).cast("bigint"))


def reverse_complement(seq: Column) -> Column:
    """Other strand in upper case; characters that are no nucleotides go."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgt]", ""), "ACGTacgt", "TGCATGCA"))


def _codon_residue(codon: Column) -> Column:
    triplets = ",".join(x + y + z for x in NUCLEOTIDES for y in NUCLEOTIDES for z in NUCLEOTIDES)
    at = F.instr(F.lit(triplets), codon)  # 4 * place + 1; a codon with a comma is found elsewhere, if at all
    return F.when(at % 4 == 1, F.substring(F.lit(GENETIC_CODE), F.call_function("shiftright", at, F.lit(2)) + 1, F.lit(1))).otherwise("X")


def translate_frame(seq: Column, offset: int, drop_last: bool = False) -> Column:
    """Residues of the codons at offset, offset + 3, ...; unknown codons give X.  ``drop_last`` leaves out a codon that
    ends exactly at the sequence's end."""
    end = F.length(seq) - (1 if drop_last else 0)
    codons = F.regexp_extract_all(F.substring(seq, F.lit(offset + 1), F.greatest(end - offset, F.lit(0))), F.lit("..."), F.lit(0))
    return F.array_join(F.transform(codons, _codon_residue), "")


def six_frames(seq: Column, drop_last: bool = False) -> Column:
    """Array of the three forward and the three reverse translations."""
    back = reverse_complement(seq)
    return F.array(*[translate_frame(s, k, drop_last) for s in (seq, back) for k in range(3)])


def compress(seq: Column, alphabet: Alphabet = DEFAULT, missing: str = "error") -> Column:
    """Residues as class letters.  Residues without a class: ``error``, ``drop``, or a character to write for them."""
    known = alphabet.letters
    source = "".join(known) + ("" if "*" in known else "*")
    target = "".join(known.values()) + ("" if "*" in known else "*")
    inside = "[^" + "".join("\\" + c if not c.isalnum() else c for c in source) + "]"
    if missing == "error":
        bad = F.regexp_extract(seq, inside, 0)
        seq = F.when(bad != "", F.raise_error(F.concat(F.lit("no class for residue "), bad)).cast("string")).otherwise(seq)
    else:
        seq = F.regexp_replace(seq, inside, "" if missing == "drop" else missing)
    return F.translate(seq, source, target)


def residue_hash(residue: Column) -> Column:
    """Index in the residue order, whatever the case; -1 for ambiguity codes; an error for anything else."""
    up = F.upper(residue)
    at = F.instr(F.lit(RESIDUES), up)
    return F.when(at > 0, at - 1).when(F.instr(F.lit(AMBIGUOUS), up) > 0, F.lit(-1)).otherwise(F.raise_error(F.concat(F.lit("not a residue: "), residue)).cast("int"))


def kmers(seq: Column, k: int, stride: int = 1, drop_last: bool = False) -> Column:
    """Array of the k-mers at 0, stride, 2 stride, ...; ``drop_last`` leaves out the one that ends the sequence, if any."""
    if stride == k:
        found = F.regexp_extract_all(seq, F.lit(f".{{{k}}}"), F.lit(0))
    else:
        found = F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))
        if stride > 1:
            found = F.filter(found, lambda x, i: i % stride == 0)
    if drop_last:
        ends = (F.length(seq) - k) % stride == 0
        found = F.when(ends & (F.size(found) > 0), F.slice(found, 1, F.size(found) - 1)).otherwise(found)
    return found


def kmer_hash(kmer: Column, k: int, base: int | None = None) -> Column:
    """Sum of residue index times base^position, base k by default (many k-mers share a hash) or, for one hash per
    k-mer, the number of residues; null if a residue is ambiguous or unknown."""
    base, up = base or k, F.upper(kmer)
    total = None
    for i in range(k):
        part = (F.instr(F.lit(RESIDUES), F.substring(up, i + 1, 1)) - 1).cast("bigint") * base**i
        total = part if total is None else total + part
    known = "[" + RESIDUES.replace("*", r"\*") + "]"
    return F.when(up.rlike(f"^{known}{{{k}}}$"), total)


def compressed_kmer_hash(kmer: Column, k: int, base: int | None = None) -> Column:
    """The same over class letters: A is 0."""
    up = F.upper(kmer)
    return sum(((F.ascii(F.substring(up, i + 1, 1)) - 65).cast("bigint") * (base or k) ** i for i in range(k)), F.lit(0).cast("bigint"))


def neighbour_hashes(h: Column) -> Column:
    """Hashes of the k-mers near one: itself; none for null or negative ones."""
    return F.when(h >= 0, F.array(h)).otherwise(F.array().cast("array<bigint>"))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(",", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
