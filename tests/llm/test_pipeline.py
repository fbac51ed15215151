import brute
import data

import corpus_pipeline


def test_stages(spark, tmp_path):
    rows = data.documents()
    at = str(tmp_path)
    data.frame(spark).write.parquet(f"{at}/documents.parquet")
    item = next(t for _, t, *_ in rows if t and len(t.split()) > 80)
    spark.createDataFrame([(1, " ".join(item.split()[2:30]))], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    docs, names = data.frame(spark), [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "decontamination", "personal data", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, at)
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name != "mixing":
            assert out.columns == data.frame(spark).columns
        if name == "near duplicates":
            assert set(after) == {c for _, c in brute.jaccard(before.items()).values()}
        if name == "decontamination":
            hit = {w[0] for w in brute.decontam(before.items(), [(1, " ".join(item.split()[2:30]))]) if w[-1]}
            assert set(after) == set(before) - hit
        if name in ("personal data", "mixing"):
            assert set(after) == set(before)
        docs = out.select("doc_id", "text", "lang", "source", "n_chars") if name != "mixing" else docs
    final = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, at).collect()}
    assert final == {r.doc_id: r.taken for r in after.values()}
