"""The pipeline's stages, each against brute force on what the stage before it kept."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_documents import brute_hits, brute_lines, brute_similar

from plumery.llm.common import materialise


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(materialise(stage(spark, kept[-1], small)))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert kept[-1].columns == columns
    rows = [[(r.doc_id, r.text) for r in k.collect()] for k in kept[:5]]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    gone = {i for i, _ in rows[0]} - {i for i, _ in rows[1]}
    assert not [i for i in gone if labels.get(i) == 1]
    assert sorted((repr(i), t) for i, t in rows[2]) == brute_lines(rows[1])

    lead = brute_similar({(i, t) for i, t in rows[2]})
    assert sorted(rows[3]) == sorted(set(lead.values()))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    before, after = dict(rows[3]), dict(rows[4])
    assert before.keys() == after.keys()
    for i, t in before.items():
        hits = brute_hits(t, items)[1]
        assert (after[i] == t) == (hits == 0)
    last = kept[5].collect()
    assert len(last) == len(rows[4]) and all(r.lossless for r in last)
    assert corpus_pipeline.run(spark, small).count() == len(last)


def test_odd_rows_through_the_stages(spark, small, tmp_path):
    long = "a line that is long enough to count as one that is shared by many"
    rows = [(n, f"{long}\nown words of number {n} stand here, all in order", "en", "s", 1) for n in range(8)]
    rows += [(20, None, None, None, None), (21, "", "en", "s", 0), (22, "one and the same text of several plain words", "en", "s", 2), (22, "one and the same text of several plain words", "en", "s", 2)]
    rows += [(22, "another text with the same id, of other words altogether", "en", "s", 2), (None, "no id but some words", "en", "s", 3), (None, "no id but some words", "en", "s", 3), (23, "word " * 20000, "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(7) for c in ("ids", "score", "spans", "n_lines", "node", "component_id", "one", "lead")})
    spark.createDataFrame([(n, 1, 0) for n in range(8)] + [(22, 1, 0), (23, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("b1", "own words of number 3 stand here, all in order"), ("b2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        kept, seen = materialise(start), []
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            done = stage(spark, kept, str(tmp_path))
            assert len(set(done.columns)) == len(done.columns)
            if n < 4:
                assert done.columns == docs.columns
            kept = materialise(done)
            seen.append(kept.collect())
    assert all(x == [] for x in seen)
    lines = materialise(corpus_pipeline.drop_shared_lines(spark, docs, str(tmp_path)))
    assert sum(long in (r.text or "") for r in lines.collect()) == 1 and lines.count() == len(rows)
    single = materialise(corpus_pipeline.drop_near_copies(spark, lines, str(tmp_path))).collect()
    assert sorted(repr(r.doc_id) for r in single) == sorted(map(repr, [*range(8), 20, 22, 22, None, None, 23]))
    clean = corpus_pipeline.cut_benchmark_text(spark, lines, str(tmp_path)).where("doc_id = 3").first()
    assert "number 3" not in clean.text and clean.n_chars == len(clean.text)
    last = corpus_pipeline.encode(spark, lines, str(tmp_path)).collect()
    assert len(last) == len(rows) and all(r.lossless for r in last) and "text" not in last[0]
