from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from veinstone.operators.tables import register_tables
from veinstone.streaming.queries import answer_stream, search_stream
from veinstone.streaming.sessions import SESSIONS, stored_sessions


def test_every_query_of_a_batch_is_answered(spark, tmp_path):
    """Seven queries in one micro-batch, three taken up at a time."""
    spark.createDataFrame([(i, f"text {i}") for i in range(7)], "query_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    engine = SimpleNamespace(recommend=lambda text: spark.createDataFrame([(1, text, "r")], "rank int, expert_id string, reason string"))
    queries = spark.readStream.schema("query_id long, text string").parquet(str(tmp_path / "in"))
    answer_stream(engine, queries, str(tmp_path / "out"), str(tmp_path / "at"), most=3).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((int(r.query_id), r.expert_id, r.epoch) for r in rows) == [(i, f"text {i}", 0) for i in range(7)]


def at(minute: float):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def test_sessions_go_on_after_a_restart(spark, tmp_path):
    """Each event counts once, though the stream stops between files, events repeat and some come too late."""
    kinds, folder, n = "event_id long, user string, ts timestamp", tmp_path / "in", 0

    def arrive(rows):
        nonlocal n
        n += 1
        spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(str(folder / f"part={n}"))

    def run():
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
        stored_sessions(stream, str(tmp_path / "out"), str(tmp_path / "at"), key="user", gap_minutes=30)
        return sorted(((r.key, r.session, r.started, r.ended, r.events) for r in spark.read.schema(SESSIONS).parquet(str(tmp_path / "out")).collect()), key=str)

    arrive([(1, "a", at(0)), (2, "a", at(20)), (3, "b", at(5)), (4, "a", at(45))])
    assert run() == []  # the watermark has not passed any gap
    arrive([(2, "a", at(20)), (5, "a", at(50)), (6, "b", at(60))])
    assert run() == [("b", 1, at(5), at(5), 1)]
    arrive([(5, "a", at(50)), (7, "a", at(52)), (8, "c", at(200)), (9, None, at(150))])
    first = run()
    assert ("a", 1, at(0), at(52), 5) in first and ("b", 2, at(60), at(60), 1) in first
    arrive([(10, "a", at(55)), (11, "a", at(210)), (12, "c", at(400))])  # 10 is late: the watermark is at 190
    last = run()
    assert [r for r in last if r[0] is not None] == [("a", 1, at(0), at(52), 5), ("a", 2, at(210), at(210), 1), ("b", 1, at(5), at(5), 1), ("b", 2, at(60), at(60), 1), ("c", 1, at(200), at(200), 1)]
    assert run() == last


def test_a_micro_batch_is_one_plan(spark, tmp_path):
    """All queries of a batch go to search_many at once; a batch's files are its own."""
    spark.createDataFrame([(i, f"text {i}") for i in range(7)], "query_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = []

    def many(batch, **request):
        calls.append(request)
        return batch.select("query_id", F.lit(1).alias("rank"), F.col("text").alias("expert_id"), F.lit(1.0).alias("score"), F.lit(1).alias("stable_hits"), F.lit(0).alias("expanded_hits"))

    queries = spark.readStream.schema("query_id long, text string").parquet(str(tmp_path / "in"))
    search_stream(SimpleNamespace(search_many=many), queries, str(tmp_path / "out"), str(tmp_path / "at"), exclude=["x"]).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert calls == [{"exclude": ["x"]}] and sorted((int(r.query_id), r.expert_id, r.epoch) for r in rows) == [(i, f"text {i}", 0) for i in range(7)]


def test_batches_by_a_table_function(spark):
    register_tables(spark)
    rows = [(q, 10 * q + i, i + 1, [None, " a  b", "a b", "", "c"][(q + i) % 5]) for q in range(4) for i in range(q * 3)]
    spark.createDataFrame(rows, "batch_id long, expert_id long, rank int, gap string").createOrReplaceTempView("ranked_rows")
    for size in (1, 4, 0):
        got = spark.sql(f"SELECT * FROM reason_batches(TABLE(SELECT * FROM ranked_rows) PARTITION BY batch_id ORDER BY (rank), {size})").collect()
        want = {}
        for q in range(1, 4):
            own = [r for r in rows if r[0] == q]
            step = size or len(own)
            for p in range(0, len(own), step):
                gaps = list(dict.fromkeys(" ".join(r[3].split()) for r in own[p : p + step] if r[3] and r[3].strip()))
                want[q, p // step + 1] = ([r[1] for r in own[p : p + step]], gaps)
        assert {(r.batch_id, r.part): (r.expert_ids, r.gaps) for r in got} == want and all(r.n == len(r.expert_ids) for r in got)
