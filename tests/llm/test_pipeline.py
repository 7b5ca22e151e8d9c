"""The pipeline's stages, one after another, against what each may do to its own input."""

import re

import corpus_pipeline
from corpuslens.llm.shared import materialise

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), "test")
        tables.append(docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert ids[0] > ids[1] > ids[2] >= ids[3] and ids[4] == ids[5]
    bench = [r.text.lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    kept = [plain(r.text) for r in tables[3].collect()]
    assert not any(plain(b) in t for b in bench for t in kept)
    before = {plain(r.text) for r in tables[2].collect()}
    assert len(before) == tables[2].count()
    words = lambda t: sum(len(r.text.split()) for r in t.collect())
    assert abs(words(tables[4]) - words(tables[3])) < 0.02 * words(tables[3])
    assert tables[5].count() == tables[4].count()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def odd(spark):
    """Documents with null and shared ids, null, empty, long and repeated texts and columns whose names might clash."""
    texts = [None, "", "!!", "same words here and there again", "same words here and there again", "w " * 20000, " ".join(f"a{i}" for i in range(60))]
    rows = [(i if i % 3 else None, t, "en", None if i % 2 else "s", 0, "x", "r", "c", 1, 2) for i, t in enumerate(texts * 3)] + [(1, f"other text {i}", "en", "s", 0, "x", "r", "c", 1, 2) for i in range(3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __id string, __row string, __c0 string, v int, shard int")


def test_stages_of_odd_tables(spark, tmp_path):
    docs = odd(spark)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(10, 40))), (None, "w w w w w"), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    quality, first, clean, mix, ids = (f for _, f in corpus_pipeline.STAGES)
    for stage in (quality, first, clean, mix):
        assert stage(spark, docs, tmp_path).columns == docs.columns
        assert stage(spark, docs.limit(0), tmp_path).count() == 0
    assert set(rows(quality(spark, docs, tmp_path))) <= set(rows(docs))
    kept = first(spark, docs, tmp_path).collect()
    texts = [r.text for r in kept]
    assert texts.count("same words here and there again") == texts.count("w " * 20000) == 1 and sum(t.startswith("other") for t in texts if t) == 3
    assert {t for t in texts} == {r.text for r in docs.collect()}
    assert rows(clean(spark, docs, tmp_path)) == [r for r in rows(docs) if not (r[1] or "").startswith("a0 ")]
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert abs(words(mix(spark, docs, tmp_path)) - words(docs)) < 0.02 * words(docs)
    assert ids(spark, docs, tmp_path).count() == docs.count() and ids(spark, docs.limit(0), tmp_path).count() == 0
