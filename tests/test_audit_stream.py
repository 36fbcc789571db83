import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from salesloom.operators import audit
from salesloom.plans import streams
from salesloom.streaming import jobs


def tag(spark, column, *questions):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "i int, q string")
    return [r[1] for r in df.select("i", column).orderBy("i").collect()]


def test_empty_results(spark):
    def empty(schema, *rows):
        return audit.audit_empty(spark.createDataFrame(list(rows), schema)).first()[0]

    assert empty("a int") and empty("a int, b string", (None, None), (None, "")) and not empty("a int, b string", (0, None))


def test_plausible(spark, rows):
    df = spark.createDataFrame([(1.8, 50.0, 120.0, 9)], "Win_Rate double, margin double, `Growth %` double, n int")
    assert rows(audit.audit_plausible(df)) == [("Growth %", 120.0, "over 100 percent"), ("Win_Rate", 1.8, "over 1")]
    assert audit.audit_plausible(spark.createDataFrame([(0.95,)], "Win_Rate double")).count() == 0
    assert audit.audit_plausible(spark.createDataFrame([(5,)], "n int")).count() == 0


def test_intent(spark):
    q = F.col("q")
    assert tag(spark, audit.tag_intent(q), "how many deals", "why did we lose", "top 5 at risk and why", "hello", " ") == ["quant", "qual", "hybrid", "hybrid", "qual"]
    assert tag(spark, audit.tag_intent(q, F.lit("QUAL")), "how many deals") == ["qual"]
    assert tag(spark, audit.tag_intent(q, F.lit("other")), "how many deals") == ["quant"]


def test_ambiguous_words(spark):
    got = tag(spark, audit.tag_ambiguous(F.col("q")), "revenue this year", "which salesperson is best", "Sales?", "ดูยอดขายเดือนนี้", "count of deals")
    assert got == [True, False, True, True, False]


def test_state_over_time(spark):
    got = tag(
        spark, audit.tag_state_over_time(F.col("q")),
        "pipeline week over week", "which deals had possibility dropped", "deals that went from Open to Lost", "ดีลเปลี่ยนจาก เปิด เป็น แพ้",
        "monthly revenue trend", "current pipeline", "won deals trend",
    )
    assert got == [True, True, True, True, False, False, False]


def test_subject(spark):
    got = tag(spark, audit.tag_subject(F.col("q"), ("salesperson1", "swd", "f1 gl")), "How is Salesperson1, doing?", "value of f1 gl deals", "total value", "SWD pipeline")
    assert got == ["Salesperson1", "f1 gl", None, "SWD"]


def test_query_log(spark, rows):
    texts = {
        1: 'EVALUATE FILTER(Fact_Opportunity, Fact_Opportunity[Status] IN {"Won", "Lost"} && MONTH(x) = 5 && MONTH(y) = 6 && Fact_Opportunity[IsWon] = 1)',
        2: 'EVALUATE ROW("a", [Total SO Actual Amount (P) by Person], "b", SUM(Fact_Opportunity[SO Actual Amount]))',
        3: "DEFINE MEASURE X[y] = 1\nEVALUATE Fact_Opportunity",
        4: 'EVALUATE CALCULATETABLE(Dim_Made_Up[a], TREATAS({2026}, Dim_Date[Year]), Dim_Date[Year] = 2026, SEARCH("kim", Fact_Opportunity[Sale Person Name], 1, 0) > 0)',
        5: "DROP TABLE Fact_Opportunity",
        6: 'EVALUATE ROW("a", SUM(Dim_Allocation[x]), "b", Dim_Date[YearMonth], "c", Fact_Opportunity[IsPipeline] = true)',
        7: 'EVALUATE TOPN(5, Dim_Account, [Solution Name] = "MES")',
    }
    log = spark.createDataFrame(list(texts.items()), "id int, q string")
    got = {}
    for r in audit.audit_query_log(log, "id", "q").collect():
        got.setdefault(r.id, []).append((r.kind, r.finding))
    assert got[1] == [("filter", "Status = Won, Lost"), ("filter", "Status = Won (IsWon=1)"), ("filter", "Month = 5, 6")]
    assert got[2] == [("concept", "Total SO Actual Amount (P) by Person"), ("concept", "SO Actual Amount")]
    assert got[3] == [("issue", "DEFINE block"), ("issue", "bare dump of Fact_Opportunity")]
    assert got[4] == [("filter", 'Sale Person ~ "kim"'), ("filter", "Year = 2026"), ("issue", "unknown table(s): Dim_Made_Up")]
    assert got[5] == [("issue", "data-changing keyword")]
    assert got[6] == [("issue", "table Dim_Allocation is not in the model"), ("issue", "column [YearMonth] does not exist"), ("issue", "flag compared to TRUE/FALSE")]
    assert got[7] == [("filter", "Solution = MES")]


def test_advisory(spark):
    def say(warnings, concepts, filters, meaning):
        def texts(values):
            return F.array(*[F.lit(v) for v in values]).cast("array<string>")

        return spark.range(1).select(audit.advisory_text(texts(warnings), texts(concepts), texts(filters), F.lit(meaning))).first()[0]

    assert say([], [], [], None) == ""
    assert say(["w1", "w2"], ["c"], ["f1", "f2"], "m") == "⚠️ w1\n\n⚠️ w2\n\n📊 ที่มา: ตัวเลขจาก c | เงื่อนไข: f1, f2\n\nℹ️ m"


def test_warnings_and_meaning(spark):
    q = F.col("q")
    assert tag(spark, audit.raw_sum_warning(q), "SUM( Fact_Opportunity[SO Actual Amount])", "SUM(x[y])") == [["raw sum of SO Actual Amount; use [Total SO Actual Amount (P) by Person]"], []]
    assert [len(w) for w in tag(spark, audit.state_warning(q), "pipeline week over week", "revenue", None)] == [1, 0, 0]
    concepts = F.when(q.contains("plan"), F.array(F.lit("Total SO Plan Amount"))).otherwise(F.array().cast("array<string>"))
    got = tag(spark, audit.meaning_text(audit.tag_ambiguous(q), concepts), "sales plan", "sales", "plan")
    assert got == ["amount was taken as Total SO Plan Amount; it could also be Total SO Actual Amount (P) by Person; Total Target Amount", None, None]


# ---- Streams: files arrive between runs -------------------------------------------------


def put(spark, root, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}")


def source(spark, root, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(root)


def test_ingest_reads_each_file_once(spark, rows, tmp_path):
    root = str(tmp_path)
    (tmp_path / "in/E/E").mkdir(parents=True)
    (tmp_path / "in/E/E/part-1.csv").write_text("1,a\n2,\n")
    for _ in range(2):
        jobs.stream_ingest(jobs.stream_parts(spark, f"{root}/in", "E", ["id", "name"]), f"{root}/ck", f"{root}/out")
    (tmp_path / "in/E/E/part-1.csv@snapshot=20250101T000000").write_text("1,b\n")
    jobs.stream_ingest(jobs.stream_parts(spark, f"{root}/in", "E", ["id", "name"]), f"{root}/ck", f"{root}/out")
    out = spark.read.parquet(f"{root}/out")
    assert rows(out, "id", "name", "_snapshot") == [("1", "a", ""), ("1", "b", "20250101T000000"), ("2", "", "")]


def test_upsert_over_batches(spark, rows, tmp_path):
    root, schema = str(tmp_path), "doc string, md_hash string, body string"
    put(spark, f"{root}/in", "b1", [("a", "1", "x"), ("b", "1", "x")], schema)
    jobs.stream_upsert(source(spark, f"{root}/in", schema), f"{root}/ck", f"{root}/t", ["doc"])
    put(spark, f"{root}/in", "b2", [("a", "1", "same hash"), ("b", "2", "new"), ("c", "1", "x")], schema)
    jobs.stream_upsert(source(spark, f"{root}/in", schema), f"{root}/ck", f"{root}/t", ["doc"])
    assert rows(jobs.current(spark, f"{root}/t", schema)) == [("a", "1", "x"), ("b", "2", "new"), ("c", "1", "x")]


def test_a_repeated_batch_gives_the_same_table(spark, rows, tmp_path):
    root, schema = str(tmp_path), "doc string, md_hash string"
    for batch_id, table in enumerate([[("a", "1"), ("b", "1")], [("a", "2"), ("b", "1")], [("a", "2"), ("b", "1"), ("c", "1")]]):
        jobs.write_version(spark.createDataFrame(table, schema), f"{root}/t", batch_id)
    assert rows(jobs.current(spark, f"{root}/t", schema)) == [("a", "2"), ("b", "1"), ("c", "1")]
    assert rows(jobs.current(spark, f"{root}/t", schema, before=1)) == [("a", "1"), ("b", "1")]
    jobs.write_version(spark.createDataFrame([("z", "1")], schema), f"{root}/t", 2)  # batch 2 runs again
    assert rows(jobs.current(spark, f"{root}/t", schema)) == [("z", "1")]
    assert jobs.current(spark, f"{root}/t", schema, before=0).count() == jobs.current(spark, f"{root}/none", schema).count() == 0


def test_latest_ignores_a_late_old_snapshot(spark, rows, tmp_path):
    root, schema = str(tmp_path), "k string, snap string, v string"
    for name, batch in (("b1", [("a", "2025-02", "new")]), ("b2", [("a", "2025-01", "old"), ("b", "2025-01", "only")])):
        put(spark, f"{root}/in", name, batch, schema)
        jobs.stream_latest(source(spark, f"{root}/in", schema), f"{root}/ck", f"{root}/t", ["k"], ["snap"])
    assert rows(jobs.current(spark, f"{root}/t", schema)) == [("a", "2025-02", "new"), ("b", "2025-01", "only")]


def test_hourly_counts_grow_with_new_batches(spark, rows, tmp_path):
    root, schema = str(tmp_path), "ts timestamp, kind string, value double"
    at = dt.datetime(2024, 1, 1, 10)
    table = "hour timestamp, kind string, events bigint, total double"
    for name, batch in (("b1", [(at, "x", 1.0), (at + dt.timedelta(minutes=59), "x", 2.0)]), ("b2", [(at + dt.timedelta(minutes=30), "x", 4.0), (at + dt.timedelta(hours=1), "y", 8.0)]), ("b3", [(at - dt.timedelta(days=3), "x", 16.0), (at, "x", 32.0)])):
        put(spark, f"{root}/in", name, batch, schema)
        jobs.stream_hourly_counts(source(spark, f"{root}/in", schema), "ts", "kind", "value", f"{root}/ck", f"{root}/t")
    got = rows(jobs.current(spark, f"{root}/t", table), F.hour("hour"), "kind", "events", "total")
    assert got == [(10, "x", 1, 16.0), (10, "x", 4, 39.0), (11, "y", 1, 8.0)]  # days late, and counted


def test_a_table_of_many_files_is_streamed_like_one_file(spark, rows, tmp_path):
    spark.range(20).repartition(4).write.parquet(f"{tmp_path}/many.parquet")
    spark.range(20).coalesce(1).toPandas().to_parquet(f"{tmp_path}/one.parquet")
    for name in ("many", "one"):
        for _ in range(2):  # the second run finds nothing new
            jobs.stream_ingest(jobs.table_stream(spark, str(tmp_path), name), f"{tmp_path}/check-{name}", f"{tmp_path}/out-{name}")
        assert rows(spark.read.parquet(f"{tmp_path}/out-{name}"), "id") == sorted([(i,) for i in range(20)], key=repr)


def test_batches_arrive_in_as_many_files_as_their_tasks_write(spark, tmp_path, monkeypatch):
    """No task reads a whole batch, and a batch of many files is still one batch of the stream."""
    monkeypatch.setattr(streams, "shared_dir", lambda spark, name: f"{tmp_path}/{name}")
    tables, seen = [spark.range(0, 100, 1, 4), spark.range(50, 150, 1, 3)], []
    job = lambda stream: jobs.run_available(stream, f"{tmp_path}/check", lambda batch, i: seen.append((i, batch.count())))
    streams._arrive(SimpleNamespace(spark=spark), "in", tables, job)
    assert seen == [(0, 100), (1, 100)]
    assert [len(list((tmp_path / "in" / str(i)).glob("*.parquet"))) for i in range(2)] == [4, 3]
