"""Streams against tables, and the readers on small files."""

from pyspark.sql import functions as F

from gridlark.operators import series, spatial, verdicts
from gridlark.sources import readers
from gridlark.streaming import intake

SF = "/root/testdata/sf0.01"


def test_stream_equals_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = intake.hourly(stream, "30 days").writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    query.awaitTermination()
    got, want = ({tuple(r) for r in df.select("hour", "event_type", "n").collect()} for df in (spark.table("hourly"), intake.hourly(events)))
    assert got == want


def test_guarded_upsert(spark, tmp_path):
    for name, share in (("a", 0.90), ("b", 0.84)):
        spark.createDataFrame([("x", share), ("y", 0.5)], "key string, coverage double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema("key string, coverage double").parquet(f"{tmp_path}/in/*")
        writer = intake.guarded_upsert(stream, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        writer.start().awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/1").collect()} == {("x", 0.90), ("y", 0.5)}


def test_only_what_is_missing_is_asked_for_across_restarts(spark, tmp_path):
    kind = "site long, start long, stop long"
    held = lambda s: s.read.schema(kind).parquet(f"{tmp_path}/held")
    add = lambda rows, at: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{at}")
    asked = lambda: sorted((r.batch, r.site, r.start, r.stop) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    def run():
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in/*")
        writer = intake.missing_requests(stream, ["site"], "start", "stop", held, f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        writer.start().awaitTermination()

    add([(1, 10, 20)], "held")
    add([(1, 0, 30), (1, 25, 40), (2, 5, 5)], "in/a")
    run()
    assert asked() == [(0, 1, 0, 10), (0, 1, 20, 40)]
    add([(2, 0, 3)], "held")
    add([(1, 35, 50), (2, 0, 9)], "in/b")
    run()  # a new query on the same checkpoint: what was asked for is not asked again
    assert asked() == [(0, 1, 0, 10), (0, 1, 20, 40), (1, 1, 40, 50), (1, 2, 3, 9)]


def test_text_files(spark, tmp_path):
    (tmp_path / "hill_permit/contract").mkdir(parents=True)
    (tmp_path / "hill_permit/contract/one.txt").write_text("a\nb")
    row = readers.text_files(spark, str(tmp_path)).first()
    assert (row["project"], row["stage"], row["kind"], row["file"], row["text"]) == ("hill", "permit", "contract", "one.txt", "a\nb")


def test_fixed_cases(spark):
    one = spark.range(1)
    named = [one.select(series.direction16(F.lit(float(d)))).first()[0] for d in (0, 11.24, 11.25, 348.75, 359)]
    assert named == ["N", "N", "NNE", "N", "N"]
    assert abs(one.select(series.shear_exponent(F.lit(6.0), F.lit(6.6), 80, 140)).first()[0] - 0.170314) < 1e-6
    items = spark.createDataFrame([(1, "CONDITIONAL", "HIGH"), (1, "CONDITIONAL", "LOW"), (1, "UNKNOWN", "MEDIUM"), (2, "IMPOSSIBLE", "LOW"), (3, "UNKNOWN", "LOW"), (3, "UNKNOWN", "LOW"), (3, "CONDITIONAL", "LOW")], "k int, status string, difficulty string")
    got = {r["k"]: (r["score"], r["grade"]) for r in verdicts.verdict_score(items, "k").collect()}
    assert got[1] == (74, "CONDITIONAL") and got[2] == (0, "IMPOSSIBLE") and got[3][1] == "UNKNOWN"
    needs = [one.select(verdicts.impact_assessment(F.lit(float(mw)))).first()[0] for mw in (89, 90, 100, 110, 111)]
    assert needs == ["SMALL", "BOTH", "BOTH", "BOTH", "FULL"]
    cells = spark.range(100).select(F.col("id").alias("x"), F.lit(0).alias("y"))
    areas = spatial.cell_areas(cells, cells.where("x < 30"), cells.where("x >= 20 AND x < 45"), 1.0).first()
    assert (areas["blocked_m2"], areas["conditional_m2"], areas["free_m2"]) == (30, 15, 55)
    json = one.select(readers.json_property(F.lit('{"a": 3}'), "a", "int"), readers.json_property(F.lit("x"), "a", "int")).first()
    assert tuple(json) == (3, None)
