import sys

import pytest

from seqloom.operators.routing import strict_join
from seqloom.sources import fasta
from seqloom.sources.fasta_source import FastaReader, Range, register
from seqloom.sources.pipe import pipe_clusters


def test_read_and_number(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x first one\nACGT\nAC\n>y\nGG\n\n")
    (tmp_path / "b.fa").write_text(">z  two words\r\nTT\r\nA")
    (tmp_path / "c.fa").write_text("")
    (tmp_path / "d.sfm").write_text("3\n")
    n = fasta.number_sequences(fasta.read_fasta(spark, str(tmp_path)))
    rows = sorted((r.seq_id, r.ext_id, r.description, r.seq) for r in n.collect())
    assert rows == [(0, "x", "first one", "ACGTAC"), (1, "y", "", "GG"), (2, "z", "two words", "TTA")]
    assert fasta.base_name(n) == "a"


def test_quality_separator(spark, tmp_path):
    (tmp_path / "q.qual").write_text(">x\n10 20\n30 40\n")
    assert fasta.read_fasta(spark, str(tmp_path / "q.qual"), line_sep=" ").first().seq == "10 20 30 40"


def test_missing_header(spark, tmp_path):
    (tmp_path / "bad.fa").write_text("ACGT\n>x\nA\n")
    with pytest.raises(Exception, match="no header"):
        fasta.read_fasta(spark, str(tmp_path / "bad.fa")).collect()


def test_many_splits(spark, tmp_path):
    (tmp_path / "m.fa").write_text("".join(f">s{i}\n{'ACGT' * (i % 7)}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        r = fasta.read_fasta(spark, str(tmp_path / "m.fa"))
        assert r.rdd.getNumPartitions() > 3
        rows = sorted((x.seq_id, x.ext_id, len(x.seq)) for x in fasta.number_sequences(r).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == [(i, f"s{i}", 4 * (i % 7)) for i in range(500)]


def test_writers(spark, tmp_path):
    s = spark.createDataFrame([(i, f"e{i}", "ACG" * i, i % 2) for i in range(9)], "seq_id bigint, ext_id string, seq string, cluster_id bigint")
    fasta.write_simple_fasta(s, str(tmp_path / "s"), 3)
    assert sorted(map(tuple, fasta.read_simple_fasta(spark, str(tmp_path / "s")).collect())) == [(i, "ACG" * i) for i in range(9)]
    fasta.write_meta(s, str(tmp_path / "m"))
    assert fasta.sequence_count(spark, str(tmp_path / "m")) == 9 and fasta.sequence_count(spark, str(tmp_path / "m"), 6) == 54
    assert sorted(map(tuple, fasta.read_meta(spark, str(tmp_path / "m")).collect())) == [(i, f"e{i}") for i in range(9)]
    for _ in range(2):  # writing again overwrites
        fasta.write_partitions(s, str(tmp_path / "p"))
    assert sorted(map(tuple, fasta.read_partitions(spark, str(tmp_path / "p")).collect())) == sorted((i % 2, i, "ACG" * i) for i in range(9))


def test_pipe(spark):
    s = spark.createDataFrame([(i % 2, i, "A" * i) for i in range(5)], "cluster_id bigint, seq_id bigint, seq string")
    count = [sys.executable, "-c", "import sys; print(sys.argv[2], sum(1 for _ in open(sys.argv[1])))", "{fasta}", "{cluster}"]
    assert sorted((r.cluster_id, r.output) for r in pipe_clusters(s, count).collect()) == [(0, "0 3\n"), (1, "1 2\n")]
    assert sorted(r.output for r in pipe_clusters(s, count, 2).collect()) == ["0 1\n", "0 2\n", "1 2\n"]


TEXT = ">x first one\nACGT\r\nAC\n>y\nGG\n\n>>odd\ttwo words \n\nT\n>last\n>z\nTT\nA"


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 1000])
def test_data_source_in_any_splits(tmp_path, size):
    """Each record once and in order, by its offset, wherever the splits cut."""
    (tmp_path / "a.fa").write_text(TEXT)
    (tmp_path / "b.fa").write_text("\n\n>w\nC\n")
    (tmp_path / "_SUCCESS").write_text("junk")
    (tmp_path / "empty.fa").write_text("")
    reader = FastaReader({"path": str(tmp_path), "splitBytes": str(size), "lineSep": "-"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["ext_id"], r["description"], r["seq"]) for r in rows] == [("x", "first one", "ACGT-AC"), ("y", "", "GG"), (">odd", "two words ", "-T"), ("last", "", ""), ("z", "", "TT-A"), ("w", "", "C")]
    assert [r["split_row"] for r in rows[:5]] == [TEXT.index(h) for h in (">x", ">y", ">>odd", ">last", ">z")]


def test_data_source_without_header(tmp_path):
    (tmp_path / "a.fa").write_text("ACGT\n>x\nA\n")
    for strict in ("true", "false"):
        reader = FastaReader({"path": str(tmp_path / "a.fa"), "strict": strict})
        if strict == "true":
            with pytest.raises(ValueError, match="no header"):
                list(reader.read(Range(str(tmp_path / "a.fa"), 0, 12)))
        else:
            assert [r["seq"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == ["A"]
    with pytest.raises(FileNotFoundError):
        FastaReader({"path": str(tmp_path / "none")}).partitions()


def test_data_source_equals_reader(spark, tmp_path):
    (tmp_path / "m.fa").write_text("".join(f">s{i} no {i}\n{'ACGT' * (i % 7)}\n" for i in range(300)))
    want = [(i, f"s{i}", f"no {i}", "ACGT" * (i % 7)) for i in range(300)]
    for at in (str(tmp_path / "m.fa"), f"file://{tmp_path}"):
        r = register(spark).read.format("fasta").option("splitBytes", 700).load(at)
        assert sorted((x.seq_id, x.ext_id, x.description, x.seq) for x in fasta.number_sequences(r).collect()) == want
    assert sorted((x.seq_id, x.ext_id, x.description, x.seq) for x in fasta.number_sequences(fasta.read_fasta(spark, str(tmp_path / "m.fa"))).collect()) == want


def test_lenient_lines(spark, tmp_path):
    (tmp_path / "l.sfa").write_text(">1 AC\nno header\n>x AC\n\n>22\tGG\n>3\n")
    assert sorted(map(tuple, fasta.read_simple_fasta(spark, str(tmp_path / "l.sfa"), strict=False).collect())) == [(1, "AC"), (22, "GG")]
    with pytest.raises(Exception, match="no sequence id"):
        fasta.read_simple_fasta(spark, str(tmp_path / "l.sfa")).collect()
    d = spark.createDataFrame([("a b c",), ("  x",), ("",), (None,)], "description string")
    assert [r.description for r in fasta.header_tokens(d).collect()] == ["a", "x", "", None]


def test_partitions_by_counted_size(spark, tmp_path):
    """A large cluster is written by several tasks, a small one to one file."""
    s = spark.createDataFrame([(i, "ACGT" * 10, 0 if i < 90 else 1) for i in range(100)], "seq_id bigint, seq string, cluster_id bigint")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        fasta.write_partitions(s, str(tmp_path / "p"), file_letters=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = lambda c: len(list((tmp_path / "p" / f"cluster_id={c}").glob("part-*")))
    assert files(0) > 1 and files(1) == 1
    assert sorted(map(tuple, fasta.read_partitions(spark, str(tmp_path / "p")).collect())) == [(0 if i < 90 else 1, i, "ACGT" * 10) for i in range(100)]
    assert spark.read.text(str(tmp_path / "p")).filter("value LIKE '>%'").count() == 100


def test_files_grow_with_the_shuffle(spark):
    """No query writes its table to a fixed number of files, each of which would hold a fixed share of it."""
    from seqloom import queries as q

    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        assert len(q.simple_fasta_round_trip(spark, "/root/testdata/sf0.001").inputFiles()) == 6
        assert q._files(spark, 3) == 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_texts_of_a_cluster_are_never_gathered(spark):
    """The join that brings clusters to the texts sorts none of them, and counts are sent to them rather than they dealt out by cluster, even if Spark took the counts for large."""
    s = spark.range(90).selectExpr("id as seq_id", "repeat('A', 10) as seq")
    a = spark.range(90).selectExpr("id as seq_id", "id % 2 as cluster_id")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = strict_join(s, a)
        lines = [x for x in joined._jdf.queryExecution().executedPlan().toString().split("\n") if "ShuffledHashJoin" in x or "Sort [" in x or "Window" in x]
        assert "ShuffledHashJoin" in lines[0] and not [x for x in lines if "Window" in x]
        plan = fasta.dealt(joined, 100)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "BroadcastHashJoin [cluster_id#" in plan and "SortMergeJoin [cluster_id#" not in plan
        assert sorted(r.value for r in fasta.dealt(joined, 100).collect()) == sorted(f">{i}\n" + "A" * 10 for i in range(90))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
