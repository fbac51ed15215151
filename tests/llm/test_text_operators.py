import collections
import random
import zlib

import brute
import data
import pytest
from pyspark.sql import functions as F

from seqloom.llm import decontam, jaccard, langid, licenses, mixing, pii, quality, tokens


def rows_of(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


# -- quality rules


def test_quality_counts(spark):
    docs = data.documents()
    got = quality.apply_rules(data.frame(spark), carry=["doc_id"])
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == {i: brute.quality(t) for i, t, *_ in docs}
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    r = random.Random(2)
    rows = [(i, data.prose(r, 120), "en", "s") for i in range(60)] + [(60 + i, " ".join(w + "###" for w in data.prose(r, 120).split()), "en", "s") for i in range(3)]
    kept = {x.doc_id for x in quality.keep_good(data.frame(spark, rows)).collect()}
    assert kept == set(range(60))


def test_sketches_merge(spark):
    """Thresholds from the merged sketches of two halves are those of the whole; bins err by 1/32 at most."""
    v = spark.range(1, 5000, 7).select(F.col("id").alias("v"), quality.bin_of(F.col("id")).alias("b"))
    assert all(r.b <= r.v < r.b + max(1, r.b / 32) + 1e-9 or r.b == r.v for r in v.collect())
    m = data.frame(spark).withColumn("c", quality.counts(F.col("text"))).select("lang", "source", "c.*").withColumn("base_failed", F.lit(False))
    one = quality.sketches(m)
    half = quality.sketches(m.filter("n_words % 2 = 0")).union(quality.sketches(m.filter("n_words % 2 = 1"))).groupBy("lang", "source", "ratio", "bin").agg(F.sum("n").alias("n"))
    assert sorted(map(str, one.collect())) == sorted(map(str, half.collect()))


# -- mixing


def test_mix(spark):
    docs = data.documents()
    sizes = collections.Counter()
    for _, t, _, s in docs:
        sizes[s] += len(brute.words(t))
    want, mix = brute.targets(dict(sizes)), mixing.curriculum(data.frame(spark))
    rows = mix.collect()
    assert sorted(r.doc_id for r in rows) == [d[0] for d in docs]
    taken = collections.Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        assert all(p is None or 0 <= p <= 1 for p in (r.position, r.position_again))
    assert all(abs(taken[s] - want[s]) < 1 + 1e-9 for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.curriculum(data.frame(spark).repartition(7)).collect()))
    order = [r.position for r in mixing.training_order(mix).collect() if r.position is not None]
    assert order == sorted(order)


def test_schedule_is_inverted(spark):
    """The share of demand before position t is the schedule's integral up to t."""
    for s in mixing.SCHEDULES:
        u = spark.range(0, 101).select((F.col("id") / 100).alias("u")).withColumn("t", mixing._time(s, F.col("u")))
        for r in u.collect():
            area = total = 0.0
            for (t0, v0), (t1, v1) in zip(s, s[1:]):
                total += (t1 - t0) * (v0 + v1) / 2
                d = min(max(r.t - t0, 0), t1 - t0)
                area += d * (v0 + v0 + (v1 - v0) / (t1 - t0) * d) / 2
            assert area / total == pytest.approx(r.u, abs=1e-9)


# -- near duplicates


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    docs = data.documents(seed)
    got = jaccard.near_duplicates(data.frame(spark, docs))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute.jaccard([(i, t) for i, t, *_ in docs])


def test_families_with_frequent_entries(spark):
    """A family of near copies larger than RARE, whose members link in chains, beside documents that share a passage."""
    r, docs = random.Random(4), []
    base = data.prose(r, 90).split()
    for i in range(90):
        base = list(base)
        base[r.randrange(len(base))] = data.prose(r, 1)
        docs.append((i, " ".join(base), "en", "s"))
    passage = data.prose(r, 60)
    docs += [(100 + i, data.prose(r, 40) + " " + passage, "en", "s") for i in range(60)]
    got = rows_of(jaccard.near_duplicates(data.frame(spark, docs)), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard([(i, t) for i, t, *_ in docs])


def test_tree_of_several_levels(spark, monkeypatch):
    """Leaves of 3 points, 2 nodes to a parent: chains that only links across leaves join."""
    monkeypatch.setattr(jaccard, "LEAF", 3)
    monkeypatch.setattr(jaccard, "FAN", 2)
    r, docs = random.Random(14), []
    for family in range(3):
        base = data.prose(r, 60).split()
        for i in range(50):
            base = list(base)
            base[r.randrange(len(base))] = data.prose(r, 1)
            docs.append((100 * family + i, " ".join(base), "en", "s"))
    got = rows_of(jaccard.near_duplicates(data.frame(spark, docs)), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard([(i, t) for i, t, *_ in docs])


def test_components_in_one_task_and_in_rounds(spark):
    r = random.Random(5)
    edges = [(r.randint(-400, 400), r.randint(-400, 400)) for _ in range(350)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    one, rounds = ({(x.v, x.c) for x in jaccard.connected(df, in_one=k).collect()} for k in (1000, 0))
    assert one == rounds and (1060, 1000) in one and len(one) == len({v for v, _ in one})
    assert jaccard.connected(df.limit(0)).count() == 0


def test_bound_never_loses_a_link(spark):
    r = random.Random(9)
    for _ in range(200):
        a = {r.getrandbits(64) for _ in range(r.randint(1, 900))}
        b = set(list(a)[: r.randint(0, len(a))]) | {r.getrandbits(64) for _ in range(r.randint(0, 60))}
        x, y = (jaccard.np.array(sorted(s), jaccard.np.uint64) for s in (a, b or {1}))
        assert jaccard._most(jaccard._point(x), jaccard._point(y)) >= len(set(x) & set(y))
        v = jaccard.np.unique(jaccard._fine(x, 40))
        assert (jaccard._unpack(jaccard._pack(v)) == v).all() and (jaccard._wide(jaccard._narrow(x)) == x >> jaccard.np.uint64(16)).all()


def test_keep_one(spark):
    docs = data.documents()
    names = {c for _, c in brute.jaccard([(i, t) for i, t, *_ in docs]).values()}
    kept = jaccard.keep_one(data.frame(spark))
    assert kept.columns == data.frame(spark).columns and {r.doc_id for r in kept.collect()} == names


def test_keep_one_decides_by_row(spark):
    """Null, repeated and shared ids: one row of each group stays, and no text without a copy is lost."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(None, a), (None, a), (None, a.upper()), (1, b), (1, b), (1, b.upper()), (2, c), (3, c), (3, d), (None, d), (None, e), (9, ""), (9, None), (None, None), (None, None)]
    got = jaccard.keep_one(data.frame(spark, [(i, t, "x", "s") for i, t in rows])).collect()
    assert sorted((str(r.doc_id), str(r.text).lower()) for r in got) == sorted((str(i), str(t).lower()) for i, t in [(None, a), (1, b), (2, c), (3, d), (None, e), (9, ""), (9, None), (None, None), (None, None)])
    assert all(r.lang == "x" and r.source == "s" for r in got)


# -- language


def test_language(spark):
    r = random.Random(3)
    lexicon = {a: ["".join(r.choice(a) for _ in range(r.randint(4, 8))) for _ in range(40)] for a in ("abcd", "wxyz")}
    speak = lambda a: " ".join(r.choice(lexicon[a]) for _ in range(60))
    rows = [(i, speak("abcd" if i % 2 else "wxyz"), "p" if i % 2 else "q", None) for i in range(80)]
    rows += [(80, None, "p", None), (81, "123 -- !", "p", None), (82, "", None, None), (83, speak("abcd").upper() + "!", None, None), (84, speak("abcd") * 400, "p", None)]
    docs = data.frame(spark, rows)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    known = langid.train(docs.filter(~F.col("doc_id").isin(*held)))
    assert set(known) == {"p", "q"} and all(len(v) <= langid.BUDGET for v in known.values())
    got = {x.doc_id: x for x in langid.predict(docs.withColumn("score", F.lit("mine")), known).collect()}
    for i, t, lang, _ in rows[:80]:
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in (80, 81, 82, 83, 84)] == ["und", "und", "und", "p", "p"] and got[80].rejected and not got[84].rejected
    assert langid.train(data.empty(spark)) == {} and {x.lang_pred for x in langid.predict(docs, {}).collect()} == {"und"}


def test_every_language_is_learned(spark):
    """More languages than fit one group of dictionaries, the rarest of them with a single labelled row."""
    r, n = random.Random(5), 70
    lexicon = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 8))) for _ in range(30)] for _ in range(n)]
    speak = lambda k: " ".join(r.choice(lexicon[k]) for _ in range(60))
    rows = [(100 * k + i, speak(k), f"l{k:02}", None) for k in range(n) for i in range(1 if k == n - 1 else 4)]
    known = langid.train(data.frame(spark, rows))
    assert set(known) == {f"l{k:02}" for k in range(n)} and list(known)[-1] == "l69"
    asked = data.frame(spark, [(k, speak(k), None, None) for k in range(n)])
    assert {x.doc_id: x.lang_pred for x in langid.predict(asked, known).collect()} == {k: f"l{k:02}" for k in range(n)}
    copies = langid.train(data.frame(spark, [(7, lexicon[0][0] * 200, "same", None)] * 2000 + rows))
    assert set(copies) == {*known, "same"}


# -- personal data

TRICKY = [None, "", "x" * 20000 + "@", "a@b.c+d@e.f a.b@c-d.e.f@g.h", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111",
          "1 " * 9000, "9" * 9000, "+1 (743) 555-3824, +123 +44 20 7946 0958 x +1.......2345678901", "é😀 mail me@x.org 😀 4111111111111111é", "0000000000000000 00000000000000", "+1 4111 1111 1111 1111", "192.168.0.1:80, me@192.168.0.1"]


def test_pii_base(spark):
    docs = [(i, t, "en", "s") for i, t in enumerate(TRICKY + [t for _, t, *_ in data.documents()])]
    got = pii.digest(pii.scan(data.frame(spark, docs)))
    assert rows_of(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == {i: brute.pii_digest(t) for i, t, *_ in docs}


def test_pii_discovers_by_context(spark):
    """Tokens after a word that only ever precedes telephone numbers are found; the same tokens elsewhere aren't."""
    r = random.Random(6)
    docs = [(i, f"{data.prose(r, 8)} telnr: +1 212 555-{1000 + i} {data.prose(r, 8)}", "en", "s") for i in range(12)]
    docs += [(20, "we said telnr: 5553824x9 today", "en", "s"), (21, "part 5553824x9 is " + data.prose(r, 5), "en", "s"), (22, data.prose(r, 5) + " item 7734112 ok", "en", "s")]
    got = {x.doc_id: x.spans for x in pii.digest(pii.scan(data.frame(spark, docs))).collect()}
    assert got[20] == "ctx_phone:15:24" and got[22] == "" and got[21] == ""
    text = {x.doc_id: (x.text, x.n_chars) for x in pii.redact(data.frame(spark, docs)).collect()}
    assert text[20] == ("we said telnr: [CTX_PHONE] today", 32) and text[22][0] == docs[-1][1] and "[PHONE]" in text[3][0]


def test_redact_overlaps_and_nulls(spark):
    docs = [(i, t, "en", "s") for i, t in enumerate(TRICKY)]
    out = {x.doc_id: x.text for x in pii.redact(data.frame(spark, docs)).collect()}
    assert out[0] is None and out[1] == "" and out[9] == "é😀 mail [EMAIL] 😀 [CARD]é"
    for i, t, *_ in docs:
        want, at = "", 0
        for s, _, e, kind in brute.pii(t):
            if s >= at:
                want += t[at:s] + f"[{kind.upper()}]"
            at = max(at, e)
        assert out[i] == (None if t is None else want + t[at:])


# -- decontamination


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_decontamination(spark):
    docs = data.documents()
    r = random.Random(8)
    texts = [t for _, t, *_ in docs if t and len(t.split()) > 40]
    items = [(k, " ".join(t.split()[5:5 + r.randint(3, 30)])) for k, t in enumerate(texts[:12])] + [(50, "a B, c!"), (51, None), (52, ""), (53, "not in there at all"), (50, "é ü ß É é")]
    want = brute.decontam([(i, t) for i, t, *_ in docs], items)
    for block_words in (decontam.BLOCK_WORDS, 20):
        got = decontam.find_matches(data.frame(spark), bench(spark, items), block_words=block_words)
        assert sorted(map(tuple, got.select("doc_id", *decontam.DIGEST).collect())) == sorted(want)
    clean = decontam.remove_contaminated(data.frame(spark).withColumn("n_hit", F.lit("mine")), bench(spark, items))
    assert {x.doc_id for x in clean.collect()} == {w[0] for w in want if not w[-1]} and {x.n_hit for x in clean.collect()} == {"mine"}
    assert decontam.find_matches(data.frame(spark), bench(spark, [])).filter("contaminated").count() == 0


def test_longest_matches(spark):
    r = random.Random(1)
    item = data.prose(r, 40)
    docs = [(0, "x y " + " ".join(item.split()[3:25]) + " z", "en", "s"), (1, item + " " + item, "en", "s")]
    got = {x.doc_id: sorted((m.start, m.item_start, m.words) for m in x.matches) for x in decontam.find_matches(data.frame(spark, docs), bench(spark, [(7, item)])).collect()}
    assert got[0] == [(2, 3, 22)] and (0, 0, 40) in got[1] and (40, 0, 40) in got[1]


# -- tokens


def test_token_histogram(spark):
    import public_tokenizers

    with open(tokens.default_vocabulary(), "rb") as f:
        enc = tokens._encoding(f.read(), public_tokenizers.PATTERN)
    n = sorted(len(enc.encode_ordinary(t or "")) for _, t, *_ in data.documents())
    hist = tokens.length_histogram(data.frame(spark))
    for x in tokens.suffix_sums(hist).collect():
        assert (x.n_docs, x.docs_at_least, x.tokens_at_least) == (n.count(x.n_tokens), sum(v >= x.n_tokens for v in n), sum(v for v in n if v >= x.n_tokens))
        assert x.truncated_total == sum(min(v, x.n_tokens) for v in n) and x.share_at_most == pytest.approx(sum(v <= x.n_tokens for v in n) / len(n))
    limits = spark.createDataFrame([(k,) for k in (0, 1, 7, 128, 2048, 10**6)], "context_limit bigint")
    assert rows_of(tokens.truncated_totals(hist, limits), "context_limit", "total_tokens") == {k: (sum(min(v, k) for v in n),) for k in (0, 1, 7, 128, 2048, 10**6)}
    assert tokens.suffix_sums(hist).agg(tokens.quantile(hist, 0.5)).first()[0] == n[(len(n) - 1) // 2]


# -- licences


def test_licenses(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code\nmore code"), ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/y.py", "code"),
             ("a/z.py", "# Licensed under the Apache License, Version 2.0.\ncode\ncode\ncode"), ("q/w.py", "code"), (None, "code"), ("a/b/null", None), ("top.txt", "I need permission to go"), ("a/b/x.py", "code\nmore code")]
    s = spark.createDataFrame(files, "path string, text string").withColumn("license", F.lit("mine"))
    got = [(r.path, r.own_license, r.license, r.inherited_from) for r in licenses.scan(s).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [
        ("a/LICENSE", "MIT", "MIT", None), ("a/b/x.py", None, "MIT", "a"), ("a/b/x.py", None, "MIT", "a"), ("a/b/c/COPYING", "GPL-3.0", "GPL-3.0", None), ("a/b/c/d/y.py", None, "GPL-3.0", "a/b/c"),
        ("a/z.py", "Apache-2.0", "Apache-2.0", None), ("q/w.py", None, None, None), (None, None, None, None), ("a/b/null", None, "MIT", "a"), ("top.txt", None, None, None)]))


def test_a_notice_in_a_long_line_is_no_license_file(spark):
    long = "Released under the MIT License. " + "Nothing else in this line is about it, and it goes on and on. " * 20
    files = [("a/1.txt", long), ("a/2.txt", "code"), ("b/1.txt", "Released under the MIT License.\nThank you."), ("b/2.txt", "code")]
    got = {r.path: (r.own_license, r.license) for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a/1.txt": ("MIT", "MIT"), "a/2.txt": (None, None), "b/1.txt": ("MIT", "MIT"), "b/2.txt": (None, "MIT")}


def test_headers_identifiers_and_whole_licenses(spark):
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n\nx = 1"
    full = dict(licenses.FULL)
    said = [("MIT", "// SPDX-License-Identifier: MIT\nint x;"), ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nx = 1"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;"), ("GPL-3.0", gpl),
            ("GPL-unversioned", "GNU GENERAL PUBLIC LICENSE\nfor all"), ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("MIT", "Use of this source code is governed by the MIT license"), ("GPL-2.0", full["GPL-2.0"]), ("MIT", full["MIT"])]
    files = [(f"f{k}/x", t) for k, (_, t) in enumerate(said)] + [("f7/y", "code"), ("f8/y", "code"), ("f0/y", "There is no licence.")]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert [got[f"f{k}/x"].own_license for k in range(len(said))] == [k for k, _ in said]
    assert (got["f7/y"].license, got["f8/y"].license, got["f0/y"].own_license) == ("GPL-2.0", "MIT", None)


def test_short_names_without_other_vocabulary(spark):
    said = [("GPL-3.0", "GPLv3"), ("GPL-3.0", "This project is distributed under the GPLv3."), ("GPL-2.0", "Distributed under the terms of the GNU GPL v2 or later."), (None, "Sie kam mit dem Zug."), (None, "ER!! KAM!! MIT!! DEM!! ZUG!!")]
    files = [(f"f{k}/x", t) for k, (_, t) in enumerate(said)]
    got = {r.path: r.own_license for r in licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()}
    assert [got[f"f{k}/x"] for k in range(len(said))] == [k for k, _ in said]


def test_every_template_matches_itself(spark):
    t = licenses.templates(spark)
    hit = licenses.matched(t.select(F.array("notice").alias("said")), t)
    assert {(r.statement, r.license) for r in hit.filter("score > 0.999").collect()} == {(n, k) for k, n in licenses.TEMPLATES}


# -- empty tables and clashing columns


def test_empty_tables(spark):
    e = data.empty(spark)
    for df in (quality.apply_rules(e), mixing.training_order(mixing.curriculum(e)), jaccard.near_duplicates(e), pii.digest(pii.scan(e)), pii.redact(e), decontam.find_matches(e, bench(spark, [(1, "a b")])),
               tokens.suffix_sums(tokens.length_histogram(e)), licenses.scan(e.withColumn("path", F.lit("x")))):
        assert df.count() == 0


def test_clashing_columns(spark):
    d = data.frame(spark)
    for c in ("n_words", "Kept", "matches", "contaminated", "size", "target", "position", "n_shingles", "component_id", "base", "row", "spans", "a", "sig"):
        d = d.withColumn(c, F.lit("mine"))
    n = d.count()
    assert quality.apply_rules(d).count() == n and quality.apply_rules(d).schema["n_words"].dataType.typeName() == "long"
    assert quality.keep_good(data.frame(spark).withColumn("other", F.lit("mine"))).columns == [*data.frame(spark).columns, "other"]
    assert mixing.curriculum(d).count() == n and jaccard.near_duplicates(d).count() == n and pii.redact(d).columns == d.columns
    assert decontam.find_matches(d, bench(spark, [(1, "a b c")])).schema["contaminated"].dataType.typeName() == "boolean"


# -- long and repetitive texts, and discovered keys


def test_personal_data_in_long_chains(spark):
    """Chains that a recursive matcher would not survive, and texts with many spans."""
    texts = ["a@" + "b." * 300_000 + "c", "1." * 100_000, "+1 (017) 555-7713 " * 3_000, "x1@y.com " * 3_000]
    got = {r.doc_id: r for r in pii.digest(pii.scan(data.frame(spark, [(i, t, "x", "s") for i, t in enumerate(texts)]))).collect()}
    assert (got[0].n_email, got[3].n_email, got[2].n_phone) == (1, 3_000, 3_000)
    assert got[2].spans.startswith("phone:0:17,phone:18:35,") and got[3].spans.endswith(",email:26991:26999")


def test_keys_beside_a_cue_are_found(spark):
    r = random.Random(3)
    key = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f'{data.prose(r, 20)} token = "{key(40)}" {data.prose(r, 10)}', "en", "s") for i in range(12)]
    rows += [(100, "some words token=ab12cd34 here", "en", "s"), (101, "the build 7f3a9c1d2e5b8a4f6c0d1234 passed", "en", "s"), (102, "nothing of this kind 12345", "en", "s")]
    got = {x.doc_id: x.spans for x in pii.digest(pii.scan(data.frame(spark, rows))).collect()}
    for i, t, *_ in rows[:12]:
        at = t.index('"') + 1
        assert got[i] == f"ctx_secret:{at}:{at + 40}"
    assert got[100] == "ctx_secret:17:25" and got[101] == "" and got[102] == ""
    gone = {x.doc_id: x.text for x in pii.redact(data.frame(spark, rows)).collect()}
    assert 'token = "[CTX_SECRET]"' in gone[0] and gone[100] == "some words token=[CTX_SECRET] here" and gone[102] == rows[-1][1]


def test_mix_shuffles_rows_once(spark):
    """Window and join of the mix share one shuffle of the carried rows."""
    mix = mixing.curriculum(data.frame(spark), carry=["doc_id", "text"])
    plan = mix._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange" in line and "place" in line for line in plan.splitlines()) == 1
