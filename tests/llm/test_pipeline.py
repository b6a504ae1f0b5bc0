import random

import corpus_pipeline
from skeinwork.llm import ngram_join, packing, pii, quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in quality.query(docs).where("kept").collect()}
    now, steps = docs, dict(corpus_pipeline.STAGES)
    now = steps["quality_rules"](spark, now, sf).cache()
    assert {r["doc_id"] for r in now.collect()} == kept and now.columns == docs.columns
    one = steps["near_duplicates"](spark, now, sf).cache()
    groups = {(r["doc_id"], r["component_id"]) for r in ngram_join.link_components(now, 5, 80).collect()}
    assert {r["doc_id"] for r in one.collect()} == {c for _, c in groups}
    clean = steps["personal_data"](spark, one, sf).cache()
    assert clean.count() == one.count() and pii.query(clean).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    mixed = steps["mixture"](spark, clean, sf).cache()
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= kept
    packed = steps["packing"](spark, mixed, sf)
    assert packed.where("piece = 0").count() == mixed.count() and packed.groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.LENGTH}").count() == 0


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf)
    assert docs.count() == 0


def test_odd_tables(spark):
    """Null ids, texts, languages and sources, ties, repeats and clashing names pass all stages; clean rows stay."""
    text = lambda k: " ".join(f"w{random.Random(1000 * k + i).randrange(400)}" for i in range(80 + k)) + f". Line {k} ends here."
    rows = [(i, text(i), "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, 0, i, "x") for i in range(40)]
    rows += [rows[1], rows[1], (None, text(60), None, None, 0, 1, "x"), (None, text(61), "en", "s1", 0, 1, "x"), (None, None, None, None, None, None, None), (77, "", "en", "s1", 0, 1, "x"), (78, None, "en", "s1", 0, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, q_kept int, near_own string")
    now = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = step(spark, now, "").cache()
        assert now.columns == docs.columns, name
        ids = [r["doc_id"] for r in now.collect()]
        if name != "mixture":
            assert set(ids) == {*range(40), None} and (name == "quality_rules") == (len(ids) > 42), name
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert packed.where("piece = 0").count() == now.count()


def test_run_leaves_stages_only(spark, sf, tmp_path):
    """run() gives what the stages give one after another, and drops the tables in between."""
    import os

    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before}
    assert {f"pipeline-{n}" for n, _ in corpus_pipeline.STAGES[:-1]} <= left and not {x for x in left if x.startswith(("ngram", "quality", "pii", "mix"))}
