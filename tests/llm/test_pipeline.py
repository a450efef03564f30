"""The pipeline against what its stages must leave."""

import corpus_pipeline
from astrolabe.llm import toxicity
from test_dedup import brute_components, exact_groups, shingles

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {r.doc_id for r in toxicity.score_toxicity(docs, model).where("predicted = 0").collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.staged(stage(spark, docs, SF), f"test-{name}")
        after[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        assert name == "packing" or docs.columns == before.columns
    assert sorted(after["toxicity"]) == sorted(left)
    ids = sorted(left)
    exact = sorted(min(ids[k] for k in g) for g in exact_groups([texts[i] for i in ids]).values())
    assert sorted(after["exact_dedup"]) == exact
    near = sorted({c for _, _, c in brute_components(exact, [texts[i] for i in exact], corpus_pipeline.NEAR_PERCENT)})
    assert sorted(after["near_dedup"]) == near
    assert set(after["mixing"]) <= set(near) and set(after["packing"]) == set(after["mixing"])
    assert corpus_pipeline.run(spark, SF).count() == len(after["packing"])


def test_near_stage_drops_copies_of_similarity_080_to_085(spark):
    base = [f"w{k}" for k in range(104)]
    texts = [" ".join(base), " ".join(base + [f"v{k}" for k in range(20)]), " ".join(base + [f"u{k}" for k in range(30)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()) == [0, 2]


def test_near_stage_keeps_one_of_each_component_at_080(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: shingles(r.text) for r in docs.collect()}
    least = {i: i for i in rows}
    for i in sorted(rows):
        for j in rows:
            both = len(rows[i] & rows[j])
            if j < i and both and 100 * both >= 80 * (len(rows[i]) + len(rows[j]) - both) and least[i] != least[j]:
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = {k: new if v == old else v for k, v in least.items()}
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values()))


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and blank texts, repeated ids and rows, columns of clashing names; and no rows at all."""
    long = " ".join(f"w{k * k}" for k in range(400))
    rows = [
        (1, None, "en", "a"), (None, "", "en", None), (2, " \n", None, "a"), (3, long, "en", "a"), (3, long, "en", "a"), (3, long + " more", None, None),
        (None, long.upper(), "fr", "b"), (None, "one text", "fr", "b"), (4, "one text", "fr", "b"), (4, "other words here", "fr", "b"),
    ]
    names = "doc_id long, text string, lang string, source string, score string, row_id string, copies int, keep_id int, size string"
    docs = spark.createDataFrame([(*r, "s", "r", k, 0, "z") for k, r in enumerate(rows)], names)
    for part, n in (("some", None), ("none", 0)):
        folder = f"{tmp_path}/{part}"
        (docs if n is None else docs.limit(0)).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, 1, 1), (3, None, None), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        at, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
        for name, stage in corpus_pipeline.STAGES:
            at = corpus_pipeline.staged(stage(spark, at, folder), f"odd-{name}")
            left[name] = at.collect()
            assert name == "packing" or at.columns == docs.columns
        assert corpus_pipeline.run(spark, folder).count() == len(left["packing"])
        if n == 0:
            assert not any(left.values())
            continue
        assert len(left["toxicity"]) == len(rows)
        # null and empty are equal; blank texts hold a space; of equal texts the least id that is not null
        assert sorted((str(r.doc_id), (r.text or "")[:12]) for r in left["exact_dedup"]) == sorted([
            ("1", ""), ("2", " \n"), ("3", long[:12]), ("3", long[:12]), ("None", long.upper()[:12]), ("4", "one text"), ("4", "other words ")
        ])
        near = [(str(r.doc_id), (r.text or "")[:5]) for r in left["near_dedup"]]
        assert sorted(near) == sorted([("1", ""), ("2", " \n"), ("3", long[:5]), ("4", "one t"), ("4", "other")])


def test_run_leaves_its_result_alone(spark):
    from pathlib import Path

    from astrolabe.sources.scratch import shared_folder

    home = Path(shared_folder(spark).removeprefix("file://"), "astrolabe")
    before = set(home.iterdir()) if home.exists() else set()
    out = corpus_pipeline.run(spark, SF)
    left = {p.name.rsplit("-", 1)[0] for p in set(home.iterdir()) - before}
    assert left == {"pipeline-packing"} and out.count() > 0
