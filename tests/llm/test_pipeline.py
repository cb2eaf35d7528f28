"""Each stage of the pipeline against brute force on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from repolith.llm import mixing, toxicity
from tests.llm.conftest import same
from tests.llm.test_dedup import exact_brute, near_brute
from tests.llm.test_text_operators import pieces_brute


def test_stages(spark, odd, tmp_path):
    rows, docs = odd
    folder = f"file://{tmp_path}"
    labels = [(i, int(i % 7 == 0)) for i in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality_toxic int").select("doc_id", F.lit(1).alias("quality"), F.col("quality_toxic").alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in now.collect()]
        out = stage(spark, now, folder)
        if k < 4:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        else:
            same(out.select("doc_id", "piece", "start", "length", "ids_crc32"), pieces_brute(before))
            break
        if name == "toxicity":
            machine = toxicity.fit(now, toxicity.learnable(spark.read.parquet(f"{folder}/labels.parquet")))
            scored = [tuple(r) for r in now.withColumn("score", toxicity.score(machine)("text")).collect()]
            same(out, [r[:-1] for r in scored if r[-1] < 0.7])
        elif name == "exact dedup":
            same(out.select("doc_id"), [(i,) for i, _, _, kept, _ in exact_brute(before) if kept])
        elif name.startswith("n-gram"):
            gone = {i for i, _, c in near_brute(before, 5, 80) if c is not None and c != i}
            same(out, [r for r in before if r[0] not in gone])
        else:
            chance = {r.doc_id: r.probability for r in mixing.mixed(now).select("row.doc_id", "probability").collect()}
            draw = {r.doc_id: r.u for r in now.select("doc_id", mixing.uniform(F.col("doc_id")).alias("u")).collect()}
            same(out.select("doc_id"), [(r[0],) for r in before if draw[r[0]] < chance[r[0]]])
        out.write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")


def test_whole_run_and_empty_documents(spark, tmp_path):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
