import corpus_pipeline
import __spark_entry__
from tidemark.llm import decontaminate, packing, queries, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_stages_take_effect_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen.append((name, before.count(), docs.count()))
        if k < 4:
            assert docs.columns == columns
    assert [s[0] for s in seen] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    assert seen[0][2] < seen[0][1]
    assert seen[3][1] == seen[3][2] == seen[4][1]


def test_whole_run_equals_single_parts(spark):
    """Each part's own tests hold it against brute force; here their composition is rebuilt from row-level results."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.toxicity_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if model.scores([r.text.encode()])[0] < 0.5]
    fp = simhash.fingerprints_of([r.text.encode() for r in rows]).tolist()
    keep = {}
    group = list(range(len(rows)))
    for i, a in enumerate(fp):
        for j in range(i):
            if (a ^ fp[j]).bit_count() <= 4:
                old, new = sorted((group[i], group[j]), reverse=True)
                group = [new if g == old else g for g in group]
    for r, g in zip(rows, group, strict=True):
        if g not in keep or r.doc_id < keep[g].doc_id:
            keep[g] = r
    left = spark.createDataFrame(list(keep.values()), docs.schema)
    leaked = {r.doc_id for r in decontaminate.benchmark_leaks(left, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    words = {r.doc_id: len((secrets.redacted(r.text, secrets.secret_spans(r.text)[1])).encode().split()) for r in keep.values() if r.doc_id not in leaked}
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
        assert r.n_words <= packing.CAPACITY
    assert got == words


def edge_docs(spark):
    """Rows that the stages must live with: NULLs in every column, empty, long and repeated texts, ties, and extra columns with clashing names."""
    fields = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, _leak int, _kept_key int, fp double, score int, shard string, chunk int, `a.b` string"
    clean = "quiet words about the weather and the sea today"
    texts = [(1, clean), (1, clean), (2, None), (3, ""), (4, "long " * 30_000 + "end"), (None, "no id stands here at all"), (5, "x"), (6, clean + " password=hunter2secret"), (None, None)]
    rows = [(i, t, None if i == 3 else "en", None if i == 2 else "s", None if t is None else len(t), "k", 1, 2, 0.5, 3, "s", 4, "dot") for i, t in texts]
    return spark.createDataFrame(rows, fields)


def test_stages_keep_edge_rows_and_extra_columns(spark):
    docs = edge_docs(spark)
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        if name == "near_duplicates":
            assert sorted((r.doc_id for r in rows), key=str) == sorted([1, 2, 4, None, 5, 6], key=str)  # ids 2, 3 and NULL without words are one group
            assert sum(r.doc_id == 1 for r in rows) == 1
        else:
            assert len(rows) == docs.count(), name
        if name == "secrets":
            assert [(r.text, r.n_chars) for r in rows if r.doc_id == 6] == [("quiet words about the weather and the sea today [SECRET]", 56)]
        assert stage(spark, docs.where("doc_id = 99"), SF).count() == 0, name
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert sum(r.n_words for r in packed.collect()) == sum(len((r.text or "").split()) for r in docs.collect())
    assert packed.where("piece = 0").count() == docs.count()
    assert corpus_pipeline.STAGES[4][1](spark, docs.where("doc_id = 99"), SF).count() == 0


def test_toxic_rows_go_and_unlabelled_data_keep_all(spark):
    docs = edge_docs(spark)
    model = toxicity.ToxicityModel([], __import__("numpy").zeros(0, "float32"), -1.0)
    assert toxicity.drop_toxic(docs, model).count() == docs.count()
    real = toxicity.toxicity_model(*(spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")))
    bad = spark.createDataFrame([(1, "you worthless pathetic idiot, you clown.", "x"), (2, None, "y"), (3, "a calm word", "z")], "doc_id bigint, text string, score string")
    assert sorted(r.doc_id for r in toxicity.drop_toxic(bad, real).collect()) == [2, 3]
