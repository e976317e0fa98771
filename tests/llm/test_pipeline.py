"""The pipeline's stages on their own inputs."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from provaudit.llm import quality, toxicity
from tests.llm.test_llm import alike, shingle_set

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_their_operators_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id", "en", "s", 5), (10**6, None, "en", "s", 0), (10**6 + 1, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("doc_id", F.col("doc_id"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect() if r.doc_id is not None)
    kept = P.quality_stage(spark, docs, SF).cache()
    assert kept.columns == P.COLUMNS
    assert ids(kept) == ids(quality.scores(docs, labels).where("predicted = 1"))
    clean = P.toxicity_stage(spark, kept, SF).cache()
    assert ids(clean) == ids(toxicity.scores(kept, labels).where("predicted = 0"))
    single = P.near_duplicate_stage(spark, clean, SF).cache()
    # Brute force over all pairs of texts: of each group the smallest id stays.
    rows = sorted(((r.doc_id is None, r.doc_id or 0, shingle_set(r.text or "")) for r in clean.collect()), key=lambda r: r[:2])
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and alike(rows[i][2], rows[j][2]):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    assert ids(single) == sorted(rows[g][1] for g in set(group) if not rows[g][0])
    packed = P.packing_stage(spark, single, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} - {None} == set(ids(single))


def test_each_group_keeps_one_row_whatever_its_ids(spark):
    words = lambda k: [f"{k}w{i * i % 997}" for i in range(200)]
    text = {k: " ".join(words(k)) for k in "abcdef"}
    near = " ".join([*words("d")[:100], "changed", *words("d")[101:]])
    far = " ".join([*words("f")[:100], "changed", *words("f")[101:]])
    rows = [
        (None, text["a"]), (None, text["b"]), (5, text["c"]), (5, near), (3, text["d"]), (None, near), (7, text["e"]), (7, text["e"]), (None, text["f"]), (None, far)
    ]
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    single = [(r.doc_id, r.text) for r in P.near_duplicate_stage(spark, docs.repartition(3), SF).collect()]
    assert len(single) == 6
    assert {(None, text["a"]), (None, text["b"]), (5, text["c"]), (3, text["d"]), (7, text["e"])} < set(single)
    assert len({(None, text["f"]), (None, far)} & set(single)) == 1


def test_stages_on_empty_tables_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.limit(40).withColumns({"score": F.lit("x"), "node": F.lit(1), "fp": F.lit(2), "row": F.lit("r"), "length": F.lit(3), "y": F.lit(4)})
    long = " ".join(f"word{i % 50021}" for i in range(120_000))
    more = more.unionByName(spark.createDataFrame([(10**7, long, None, None, None)], docs.schema), allowMissingColumns=True)
    for name, stage in P.STAGES:
        none = stage(spark, more.where("false"), SF)
        assert none.count() == 0, name
        some = stage(spark, more, SF)
        assert some.columns == none.columns and (name == "packing" or some.columns == P.COLUMNS)
        assert some.select("doc_id").distinct().count() <= 41
        if name in ("near_duplicates", "packing"):
            assert some.where("doc_id = 10000000").count() >= 1


def test_run_over_documents(spark):
    out = P.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns
