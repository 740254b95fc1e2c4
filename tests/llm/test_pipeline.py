import corpus_pipeline
from caseloom.llm import packing, quality, secrets, simhash
from test_packing import check_pack
from test_nearcopies import brute


def test_stages_on_their_own_input(spark, data):
    sf = f"{data}/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    given = docs
    stages = dict(corpus_pipeline.STAGES)
    assert [n.split()[0] for n in stages] == ["quality", "SimHash", "secret", "mixing", "best-fit"]

    kept = corpus_pipeline.durable(stages["quality classifier"](spark, given, sf))
    model = quality.fit(given, labels)
    want = {r.doc_id for r in given.collect() if 1 / (1 + 2.718281828459045 ** (model.thresholds[-1] - model.score(r.text or ""))) >= 0.5}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(toxic & want) <= 0.05 * len(toxic)

    one = corpus_pipeline.durable(stages["SimHash near-dedup"](spark, kept, sf))
    rows = kept.orderBy("doc_id").collect()
    assert sorted(r.doc_id for r in one.collect()) == [rows[g].doc_id for g in sorted(set(brute([r.text for r in rows])))]

    clean = corpus_pipeline.durable(stages["secret scans"](spark, one, sf))
    before = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        assert secrets.find(r.text) == [] and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or secrets.find(before[r.doc_id])

    mixed = corpus_pipeline.durable(stages["mixing sources to target weights"](spark, clean, sf))
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(clean.collect())

    packed = stages["best-fit packing"](spark, mixed, sf).collect()
    n, least = check_pack(mixed.collect(), packed)
    assert n <= least + 1


def test_run_and_empty_table(spark, data, tmp_path):
    assert corpus_pipeline.run(spark, f"{data}/sf0.001").count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{data}/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_are_importable():
    assert packing.CAPACITY == 4096 and simhash.RADIUS == 3


def test_stages_on_odd_rows(spark, nasty, nothing, tmp_path):
    """Nulls, repeated rows, very long texts, clashing names and no rows, stage after stage."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, None, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for given in (nasty, nothing):
        docs = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = corpus_pipeline.durable(stage(spark, docs, str(tmp_path)))
            assert after.columns == docs.columns, name
            if given is nothing:
                assert after.count() == 0
            docs = after
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        n, least = check_pack(docs.collect(), packed.collect()) if given is nasty and docs.count() else (0, 0)
        assert n <= least + 1


def test_near_dedup_stage_on_odd_rows(spark, nasty):
    kept = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, nasty, "")
    rows = nasty.collect()
    groups = set(brute([r.text for r in rows]))
    assert kept.count() == len(groups)
