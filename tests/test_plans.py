import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from seqloom import session
from seqloom.operators import kmers
from seqloom.operators.search import bounded_pairs
from seqloom.plans import cli, pipelines
from seqloom.queries import _local_sql
from seqloom.session import aligner_archive
from seqloom.sources.pipe import Program, search_clusters
from seqloom.streaming.routes import read_queries, route_stream

ROOT = Path(__file__).resolve().parent.parent


def fixture(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text("".join(f">s{i} d\n{s}\n" for i, s in enumerate(["RNARNARNAWW", "RNARNARNAWY", "KLMKLMKLMFF", "KLMKLMKLMFP"])))
    return str(tmp_path / "in")


def test_partition_and_search(spark, tmp_path):
    path, out = fixture(tmp_path), str(tmp_path / "out")
    s = pipelines.number_sequences(pipelines.read_fasta(spark, path)).select("seq_id", "seq")
    r = pipelines.partition_database(s, 2, out=out)
    where = {x.seq_id: x.cluster_id for x in r["assignment"].collect()}
    assert where[0] == where[1] and set(where) == {0, 1, 2, 3}
    assert set(pipelines.partition_database(s, 2, steps=("transform", "cluster"))) == {"vectors", "assignment"}
    q = spark.createDataFrame([(7, "KLMKLMKLMF")], "query_id bigint, seq string")
    hit = pipelines.top_hits(pipelines.search(q, r["centers"], r["partitions"])).first()
    assert (hit.query_id, hit.seq_id, hit.score) == (7, 2, 100)


def test_command_line(spark, tmp_path, monkeypatch):
    path, out = fixture(tmp_path), str(tmp_path / "out")
    monkeypatch.setattr(cli, "build", lambda *a, **k: spark)
    for argv in (["partition", path, f"{out}/db", "--clusters", "2"], ["search", path, f"{out}/db", f"{out}/hits"], ["vectors", path, f"{out}/v"], ["metrics", path, f"{out}/db", f"{out}/m"],
                 ["simple-fasta", path, f"{out}/sf", "--shards", "2"], ["translate", path, f"{out}/t", "--shards", "2"], ["align", path, f"{out}/al", "--protein", "--method", "local"]):
        cli.main(argv)
    hits = {r._c0: r._c2 for r in spark.read.option("sep", "\t").csv(f"{out}/hits").collect()}
    assert hits == {"0": "0", "1": "1", "2": "2", "3": "3"}
    assert spark.read.option("sep", "\t").csv(f"{out}/al/pairs").count() == 6 and spark.read.text(f"{out}/t").count() == 24


def test_dna_alignment(spark, tmp_path):
    (tmp_path / "d.fa").write_text(">a\nACTTGACA\n>b\nACTTGACC\n")
    found = pipelines.align_fasta(spark, str(tmp_path / "d.fa"), str(tmp_path / "o"), "global")
    assert found.count() == 66


def test_stream_equals_batch(spark, tmp_path):
    centers = spark.createDataFrame([(0, 0), (1, 7)], "cluster_id bigint, h bigint")
    q = spark.createDataFrame([(i, "RNARNA" if i % 2 else "AAAAAA") for i in range(20)], "query_id bigint, seq string")
    q.repartition(5).write.parquet(str(tmp_path / "q"))
    stream = route_stream(read_queries(spark, str(tmp_path / "q"), 2), centers, str(tmp_path / "out"), str(tmp_path / "cp"))
    stream.awaitTermination(120)
    got = {(r.query_id, r.cluster_id, r.n_matches) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {tuple(r) for r in pipelines.route(q, centers).select("query_id", "cluster_id", "n_matches").collect()} and len(got) == 20


def test_entry_without_optional_parts(tmp_path):
    """The entry points import and list the core queries when the training-data subpackage isn't there."""
    import shutil

    shutil.copytree(ROOT / "seqloom", tmp_path / "seqloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(k.startswith('op') or k == 'pipeline' for k in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, extra = said.stdout.split()
    assert int(n) >= 40 and extra == "False"


def test_plans_push_down(spark, tmp_path):
    """Column pruning reaches the scan and the routed join needs no cartesian product."""
    spark.createDataFrame([(1, "RNA", "x")], "query_id bigint, seq string, other string").write.parquet(str(tmp_path / "q"))
    centers = spark.createDataFrame([(0, 7)], "cluster_id bigint, h bigint")
    plan = pipelines.route(spark.read.parquet(str(tmp_path / "q")), centers)._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert F is not None


def searched(spark, n=60):
    """Queries cut from sequences that differ in few letters, with exact copies, so that scores and bounds tie."""
    r = random.Random(9)
    some = lambda k: "".join(r.choice("RNDC") for _ in range(k))
    base = [some(120) for _ in range(6)]
    seqs = []
    for i in range(n):
        s = list(base[i % 6])
        for _ in range(r.choice([0, 0, 1, 5, 20])):
            s[r.randrange(len(s))] = r.choice("RNDC")
        seqs.append((i, "".join(s) + some(r.randint(0, 40)), i % 7))
    queries = [(i, base[i % 6][10:10 + r.choice([30, 70])]) for i in range(6)]
    queries += [(i, "".join(x if r.random() < 0.85 else "H" for x in base[i % 6][10:80])) for i in range(6, 12)] + [(50, "WWWWWW"), (51, "RND")]
    s = spark.createDataFrame(seqs, "seq_id bigint, seq string, cluster_id bigint")
    centers = kmers.presence(s.select("seq_id", "seq"), 3, 1, 23).join(s.select("seq_id", "cluster_id"), "seq_id").select("cluster_id", "h").distinct()
    return spark.createDataFrame(queries, "query_id bigint, seq string"), centers, s


def test_bounded_search_equals_whole_search(spark):
    """Same hits with far fewer alignments; no score is above its bound."""
    q, c, s = searched(spark)
    every = pipelines.search(q, c, s, base=23)
    best, counts = pipelines.search_best(q, c, s, base=23, bound_k=4)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, pipelines.top_hits(every).collect()))
    assert sum(counts) < 0.6 * every.count() and len(counts) > 1
    routes = every.select("query_id", "cluster_id").distinct()
    for k, costs in ((4, {}), (2, {"match": 1, "mismatch": -9, "gap": -9, "extend": 0}), (6, {"mismatch": 0})):
        bounded = bounded_pairs(routes, q, s, k, **costs).join(pipelines.search(q, c, s, base=23, **costs), ["query_id", "cluster_id", "seq_id"])
        assert bounded.count() == every.count() and bounded.filter("score > bound").count() == 0
    with pytest.raises(ValueError):
        bounded_pairs(routes, q, s, 4, mismatch=2)


def test_search_equals_sql_on_short_items(spark):
    """The SQL of local alignment over all pairs of shortened items."""
    q, c, s = searched(spark, 14)
    q = q.withColumn("seq", F.substring("seq", 1, 25))
    best, _ = pipelines.search_best(q, c, s, base=23)
    db = duckdb.connect()
    tables = {"q": [tuple(r) for r in q.collect()], "s": [(r.seq_id, r.seq) for r in s.collect()]}
    for name, rows in tables.items():
        db.execute(f"CREATE TABLE {name} (id BIGINT, seq VARCHAR)")
        db.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    found = db.execute(f"SELECT * FROM ({_local_sql('(SELECT q.id AS id_a, s.id AS id_b, q.seq AS s, s.seq AS t FROM q, s)')}) r").fetchall()
    want = {}
    for a, b, score, distance in found:
        want.setdefault(a, []).append((-score, b, distance))
    got = {r.query_id: (-r.score, r.seq_id, r.distance) for r in best.collect()}
    assert got == {a: min(x) for a, x in want.items() if a in got} and len(got) >= 12


def test_external_search_equals_native(spark):
    """Program and archive on the executors; parts and blocks of a few records; a program that fails says why."""
    q, c, s = searched(spark, 20)
    program = Program((sys.executable, "{archive}/local_align.py", "{queries}", "{database}"), aligner_archive(spark))
    rows = lambda d: sorted(map(tuple, d.select("query_id", "cluster_id", "seq_id", "score").collect()))
    native = pipelines.search(q, c, s, base=23)
    assert rows(pipelines.search(q, c, s, base=23, method="external", program=program)) == rows(native)
    routes = native.select("query_id", "cluster_id").distinct().join(q, "query_id")
    assert rows(search_clusters(routes, s, program, batch_letters=200, batch_queries=3)) == rows(native)
    with pytest.raises(Exception, match="no such thing"):
        search_clusters(routes, s, Program((sys.executable, "-c", "raise SystemExit('no such thing')"))).collect()
    with pytest.raises(ValueError):
        pipelines.search(q, c, s, method="external")


def test_external_program_aligns_only_pairs_that_can_win(spark, tmp_path):
    """The same best hits as of all pairs; no program is given a pair that can't win; a query whose first pairs give no hit keeps the others."""
    q, c, s = searched(spark)
    rows = lambda d: sorted(map(tuple, d.select("query_id", "cluster_id", "seq_id", "score", "distance").collect()))
    code = "import sys,uuid; sys.path.insert(0, sys.argv[1]); import local_align as l; n = [len(list(l.records(f))) for f in sys.argv[2:4]]; open(f'{sys.argv[4]}/{uuid.uuid4()}', 'w').write(str(n[0] * n[1])); l.main(*sys.argv[2:4])"
    program = Program((sys.executable, "-c", code, "{archive}", "{queries}", "{database}", str(tmp_path)), aligner_archive(spark))
    best, counts = pipelines.search_best(q, c, s, base=23, bound_k=4, method="external", program=program)
    every = pipelines.search(q, c, s, base=23)
    assert rows(best) == rows(pipelines.top_hits(every))
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == sum(counts) < 0.6 * every.count() and len(counts) > 1
    code = "import re,sys; ids = [re.findall('>([0-9]+)', open(f).read()) for f in sys.argv[1:3]]; print('\\n'.join(f'{a}\\t{b}\\t{sys.argv[3]}' for a in ids[0] for b in ids[1] if int(b) % 7 == 3))"
    said = lambda score, *more: Program((sys.executable, "-c", code, "{queries}", "{database}", score, *more))
    some, counts = pipelines.search_best(q, c, s, base=23, bound_k=4, method="external", program=said("1"))
    assert rows(some) == rows(pipelines.top_hits(pipelines.search(q, c, s, base=23, method="external", program=said("1")))) and some.count() and len(counts) > 1
    with pytest.raises(Exception, match="above its bound"):
        pipelines.search_best(q, c, s, base=23, method="external", program=said("100000"))
    for wrong in ({"method": "external"}, {"method": "other"}, {"program": program}, {"method": "external", "program": said("1", "{cluster}")}):
        with pytest.raises(ValueError):
            pipelines.search_best(q, c, s, base=23, **wrong)


def test_start_from_stored_steps(spark, tmp_path):
    """A run from a step on equals a whole run; missing, stale and differing steps raise."""
    path, out = fixture(tmp_path), str(tmp_path / "out")
    s = pipelines.number_sequences(pipelines.read_fasta(spark, path)).select("seq_id", "seq")
    rows = lambda d: sorted(map(tuple, d.collect()))
    whole = pipelines.partition_database(s, 2, max_iter=1)
    with pytest.raises(ValueError, match="has not finished"):
        pipelines.partition_database(s, 2, max_iter=1, out=out, start="cluster")
    with pytest.raises(ValueError, match="folder"):
        pipelines.partition_database(s, 2, max_iter=1, start="cluster")
    pipelines.partition_database(s, 2, max_iter=1, out=out, steps=("transform", "cluster"))
    for start in ("transform", "cluster", "write", "union"):
        r = pipelines.partition_database(s, 2, max_iter=1, out=out, start=start)
        assert rows(r["assignment"]) == rows(whole["assignment"]) and rows(r["centers"]) == rows(whole["centers"])
    with pytest.raises(ValueError, match="was run with"):
        pipelines.partition_database(s, 3, max_iter=1, out=out, start="write")
    pipelines.partition_database(s, 2, max_iter=1, out=out, steps=("transform",))
    with pytest.raises(ValueError, match="has not finished"):
        pipelines.partition_database(s, 2, max_iter=1, out=out, start="write")
    assert rows(pipelines.partition_database(s, 2, max_iter=1, out=out, start="cluster")["centers"]) == rows(whole["centers"])


def test_clustering_commands(spark, tmp_path, monkeypatch):
    path, out = fixture(tmp_path), str(tmp_path / "out")
    monkeypatch.setattr(cli, "build", lambda *a, **k: spark)
    aligner = aligner_archive(spark)
    for argv in (["vectors", path, f"{out}/v", "--base", "23"], ["cluster", f"{out}/v", f"{out}/c", "--clusters", "2", "--max-iter", "1", "--sample", "stride"], ["membership", f"{out}/c/assignment", f"{out}/m"],
                 ["cluster-vectors", f"{out}/m", path, f"{out}/cv", "--base", "23"], ["union-vectors", f"{out}/v", f"{out}/c/assignment", f"{out}/u"],
                 ["partition", path, f"{out}/db", "--clusters", "2", "--max-iter", "1", "--base", "23", "--steps", "transform"], ["partition", path, f"{out}/db", "--clusters", "2", "--max-iter", "1", "--base", "23", "--start", "cluster"],
                 ["search", path, f"{out}/db", f"{out}/h1", "--base", "23", "--best"],
                 ["search", path, f"{out}/db", f"{out}/h2", "--base", "23", "--archive", aligner, "--program", sys.executable, "{archive}/local_align.py", "{queries}", "{database}"]):
        cli.main(argv)
    tsv = lambda at: sorted(map(tuple, spark.read.option("sep", "\t").csv(at).collect()))
    assert {x for x, _ in tsv(f"{out}/c/assignment")} == {"0", "1", "2", "3"}
    own, every = spark.read.parquet(f"{out}/u"), spark.read.parquet(f"{out}/cv")
    assert own.count() > 0 and own.join(every, ["cluster_id", "h"], "left_anti").count() == 0 and every.count() > own.count()
    assert tsv(f"{out}/h1") == tsv(f"{out}/h2") and len(tsv(f"{out}/h1")) == 4


def test_settled_deletes_what_led_to_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    names = lambda: sorted(p.name.split("-")[1] for p in tmp_path.iterdir())
    kept = session.cut(spark.range(3), "before")
    inner = lambda: session.settled(spark, "inner", lambda: session.cut(kept, "step").withColumn("x", F.col("id") * 2))
    out = session.settled(spark, "outer", lambda: inner().filter("x > 0"))
    assert names() == ["before", "outer"] and sorted(map(tuple, out.collect())) == [(1, 2), (2, 4)] and kept.count() == 3

    def fails():
        session.cut(kept, "step")
        raise ValueError

    with pytest.raises(ValueError):
        session.settled(spark, "never", fails)
    assert names() == ["before", "outer"]


def test_clusters_of_the_same_queries_share_a_call(spark, tmp_path):
    """Forty clusters of one sequence, taken by the same two queries: one call; a sequence of several clusters keeps them all; {cluster} needs a call for each."""
    q = spark.createDataFrame([(c, i, "ACDEFGHIKL"[i:]) for c in range(40) for i in (0, 1)], "cluster_id bigint, query_id bigint, seq string")
    s = spark.createDataFrame([(c, c % 30, "ACDEFGHIKLMNPQ") for c in range(40)], "cluster_id bigint, seq_id bigint, seq string")
    code = "import re,sys,uuid; open(f'{sys.argv[3]}/{uuid.uuid4()}', 'w'); ids = [re.findall('>([0-9]+)', open(f).read()) for f in sys.argv[1:3]]; print('\\n'.join(f'{a}\\t{b}\\t7' for a in ids[0] for b in ids[1]))"
    for name, more, calls in (("shared", (), 1), ("own", ("{cluster}",), 40)):
        (tmp_path / name).mkdir()
        hits = search_clusters(q, s, Program((sys.executable, "-c", code, "{queries}", "{database}", str(tmp_path / name), *more))).collect()
        assert sorted((r.query_id, r.cluster_id, r.seq_id, r.score) for r in hits) == [(i, c, c % 30, 7) for i in (0, 1) for c in range(40)]
        assert len(list((tmp_path / name).iterdir())) == calls


def test_stored_vectors_are_rows(spark, tmp_path):
    """A step that starts from stored vectors deals out none of their k-mers; an older run's vectors in long form serve as well."""
    path, out = fixture(tmp_path), str(tmp_path / "out")
    s = pipelines.number_sequences(pipelines.read_fasta(spark, path)).select("seq_id", "seq")
    rows = lambda d: sorted(map(tuple, d.collect()))
    r = pipelines.partition_database(s, 2, max_iter=2, out=out)
    stored = spark.read.parquet(f"{out}/vectors")
    assert stored.columns == ["seq_id", "hashes"] and stored.count() == 4 and rows(r["vectors"]) == rows(kmers.presence(s))
    want = rows(r["assignment"]), rows(r["centers"])
    kmers.presence(s).write.mode("overwrite").parquet(f"{out}/vectors")
    again = pipelines.partition_database(s, 2, max_iter=2, out=out, start="cluster")
    assert (rows(again["assignment"]), rows(again["centers"])) == want
