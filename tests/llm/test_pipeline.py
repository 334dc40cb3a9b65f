import corpus_pipeline as C
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"] and C.ORACLE_SQL is None
    counts = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        out = C.materialize(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        counts.append(out.count())
        docs = out
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0
    assert docs.where(F.col("text").contains("@mail")).count() == 0
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == counts[4]


def test_registered():
    import __spark_entry__ as E

    names = E.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
