from pyspark.sql import functions as F

from tarnlake.operators import episodes as E
from tarnlake.operators import state as T
from tarnlake.plans.bindings import plays
from tarnlake.streaming import sessions as S

SF = "/root/testdata/sf0.001"


def drain(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.sql(f"select * from {name}")


def test_run_loop_ends_as_the_batch_operator(spark, tmp_path):
    p = plays(spark, SF).select("user_id", "ts", "event_id", "outcome")
    cut = p.agg(F.percentile("event_id", 0.5)).first()[0]
    p.where(F.col("event_id") <= cut).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    p.where(F.col("event_id") > cut).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = drain(S.run_loop(stream, 2, 3, 12), "loops", "update")
    last = {r.user_id: (r.level, r.attempts, r.reason) for r in got.groupBy("user_id").agg(F.max_by(F.struct("level", "attempts", "reason"), "attempts").alias("s")).select("user_id", "s.*").collect()}
    rows = E.episode_rows(plays(spark, SF), ["user_id"], ["ts", "event_id"]).select("user_id", T.advancement(F.col("episode_outcomes"), 2, 3, 12).alias("a")).collect()
    assert last == {r.user_id: tuple(r.a) for r in rows}


def test_windows(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    got = drain(S.windowed(stream), "wins", "complete")
    assert got.agg(F.sum("n")).first()[0] == e.count()
