import json
import os

from pyspark.sql import functions as F

from salesloom.operators.ordered import one_page, paged_scan, previous_value
from salesloom.operators.rows import dedup_keep_last, derive_account_link, latest_snapshot, resolve_name
from salesloom.sources import files


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def snapshot_folder(root):
    base = f"{root}/Dim_Thing"
    put(f"{base}/Dim_Thing/part-001.csv", "1,old live\n")
    put(f"{base}/Dim_Thing/part-001.csv.snapshots/part-001.csv@snapshot=20250101T000000", "1,first\n2,\n")
    put(f"{base}/Dim_Thing/part-001.csv.snapshots/part-001.csv@snapshot=20250201T000000", "1,second\n3,ไทย\n")
    put(f"{base}/Dim_Thing/part-002.csv", '9,"two, words"\n')
    put(f"{base}/Dim_Thing/readme.txt", "8,not a part\n")
    put(f"{root}/Fact_Other/part-001.csv", "x\n")
    return root


def test_scan_reads_every_part_and_snapshot(spark, rows, tmp_path):
    df = files.scan_manifest_csv(spark, snapshot_folder(str(tmp_path)), "Dim_Thing", ["id", "name"])
    assert rows(df) == [
        ("1", "first"), ("1", "old live"), ("1", "second"), ("2", ""), ("3", "ไทย"), ("9", "two, words"),
    ]


def test_quoted_cells_keep_line_breaks_and_quotes(spark, rows, tmp_path):
    put(f"{tmp_path}/Dim_Note/part-001.csv", '1,"line one\nline two","say ""hi"""\n2,plain,x\n')
    df = files.scan_manifest_csv(spark, str(tmp_path), "Dim_Note", ["id", "body", "title"])
    assert rows(df) == [("1", "line one\nline two", 'say "hi"'), ("2", "plain", "x")]


def test_lineage_dedup_and_latest_snapshot(spark, rows, tmp_path):
    df = files.scan_manifest_csv(spark, snapshot_folder(str(tmp_path)), "Dim_Thing", ["id", "name"], lineage=True)
    assert rows(dedup_keep_last(df, ["id"], [F.col("_seq")]), "id", "name") == [
        ("1", "second"), ("2", ""), ("3", "ไทย"), ("9", "two, words"),
    ]
    # the live part is dropped as soon as a snapshot of it exists
    assert rows(latest_snapshot(df, "_part", "_snapshot"), "id", "name", "_part") == [
        ("1", "second", "001"), ("3", "ไทย", "001"), ("9", "two, words", "002"),
    ]


def test_missing_empty_and_unreadable_parts(spark, rows, tmp_path):
    root = snapshot_folder(str(tmp_path))
    os.makedirs(f"{root}/Dim_Empty")
    assert files.scan_manifest_csv(spark, root, "Dim_None", ["a"]).count() == 0
    assert files.scan_manifest_csv(spark, root, "Dim_Empty", ["a"]).columns == ["a"]
    assert files.scan_header_csv(spark, root, "Dim_None", ["a", "b"]).columns == ["a", "b"]
    put(f"{root}/Dim_Bad/part-001.csv", "1,ok\n2\n3,a,b,c\n")
    with open(f"{root}/Dim_Bad/part-002.csv.gz", "wb") as f:
        f.write(b"this is not gzip")
    assert rows(files.scan_manifest_csv(spark, root, "Dim_Bad", ["id", "name"])) == [("1", "ok"), ("2", ""), ("3", "a")]


def test_discover_manifest_and_load(spark, rows, tmp_path):
    root = snapshot_folder(str(tmp_path))
    assert rows(files.discover_entities(spark, root)) == [("Dim_Thing",)]
    put(f"{root}/model.json", json.dumps({"entities": [{"name": "Dim_Thing", "attributes": [{"name": "id"}, {"name": "name"}]}, {"name": "Fact_Other"}]}))
    manifest = files.manifest_columns(spark, f"{root}/model.json")
    assert manifest == {"Dim_Thing": ["id", "name"], "Fact_Other": []}
    loaded = files.load_entities(spark, root, manifest, only=["Dim_Thing"])
    assert list(loaded) == ["Dim_Thing"] and loaded["Dim_Thing"].count() == 6


def test_inferred_ingest_reports_every_outcome(spark, rows, tmp_path):
    root = str(tmp_path)
    put(f"{root}/Dim_Good/part-1.csv", "Account ID,Plan (THB)\n1,2.5\n2,3.5\n")
    put(f"{root}/Dim_Zero/part-1.csv", "a,b\n")
    report = dict(rows(files.ingest_entities(spark, root, ["Dim_Good", "Dim_Zero", "Dim_Gone"])))
    assert report["Dim_Good"] == "2" and report["Dim_Zero"] == "ZERO_ROWS" and report["Dim_Gone"].startswith("READ_FAIL")
    table = spark.table("dim_good")
    assert table.dtypes == [("Account_ID", "int"), ("Plan__THB_", "double")]
    spark.sql("DROP TABLE dim_good")


def test_each_part_by_its_own_header(spark, rows, tmp_path):
    root = str(tmp_path)
    put(f"{root}/Dim_T/part-1.csv", 'a,b\n1,2\n"x\ny",4\n')
    put(f"{root}/Dim_T/sub/part-2.csv", "b,a\n20,10\n")
    put(f"{root}/Dim_T/part-3.csv", "\ufeffA,c,,a\n100,300,5,6\n")
    put(f"{root}/Dim_T/part-4.csv", "a,b\n7,8,9\n1\n2,3\n")
    put(f"{root}/Dim_T/part-5.csv", "\n")
    put(f"{root}/Dim_T/part-6.csv", "a,b\n")
    put(f"{root}/Dim_T/notes.csv", "a,b\n9,9\n")
    assert rows(files.scan_header_csv(spark, root, "Dim_T", ["a", "b", "c", "z"])) == sorted(
        [("1", "2", "", ""), ("x\ny", "4", "", ""), ("10", "20", "", ""), ("100", "", "300", ""), ("7", "8", "", ""), ("1", "", "", ""), ("2", "3", "", "")]
    )
    assert files.scan_header_csv(spark, root, "Dim_T").columns == ["a", "b", "c", "_2", "a_3"]
    report = {r.part: (r.rows, r.malformed, r.outcome) for r in files.scan_report(spark, root, "Dim_T").collect()}
    assert report == {"1": (2, 0, "OK"), "2": (1, 0, "OK"), "3": (1, 0, "OK"), "4": (3, 2, "MALFORMED"), "5": (0, 0, "EMPTY"), "6": (0, 0, "ZERO_ROWS")}
    assert files.scan_report(spark, root, "Dim_None").count() == 0
    put(f"{root}/Dim_Empty/part-1.csv", "\n")
    assert files.scan_infer_csv(spark, root, "Dim_Empty") == (None, "EMPTY")


def test_inferred_types_follow_all_cells(spark, tmp_path):
    root = str(tmp_path)
    put(f"{root}/Dim_T/part-1.csv@snapshot=2", "i,l,d,b,day,t,s,n\n1,1,1,true,2026-01-02,2026-01-02 03:04:05,x,\n")
    put(f"{root}/Dim_T/part-1.csv@snapshot=1", "i\nan older snapshot\n")
    put(f"{root}/Dim_T/part-2.csv", "n,s,t,day,b,d,l,i\n,2,2026-01-03,2026-1-3,FALSE,2.5e3,9999999999,\n")
    rows, outcome = files.scan_infer_csv(spark, root, "Dim_T")
    assert outcome == "2"
    assert dict(rows.dtypes) == {"i": "int", "l": "bigint", "d": "double", "b": "boolean", "day": "date", "t": "timestamp", "s": "string", "n": "string"}
    assert sorted((r.l, r.i, r.s, r.n) for r in rows.collect()) == [(1, 1, "x", None), (9999999999, None, "2", None)]


def test_names(spark):
    assert files.sanitize_name("a b,c;d{e}(f)\tg=h") == "a_b_c_d_e__f__g_h"
    assert files.strip_brackets("[Account ID]") == "Account ID"
    assert files.strip_brackets("Account ID") == "Account ID"


def test_typed_rows_to_text(spark, rows):
    df = spark.createDataFrame([(80.0, 80.5, True, None, 1234567890.0)], "`[a]` double, `[b]` double, `[c]` boolean, `[d]` string, `[e]` double")
    out = files.typed_rows_to_text(df, ["c", "a", "b", "d", "e", "absent"])
    assert out.columns == ["c", "a", "b", "d", "e", "absent"]
    assert rows(out) == [("true", "80", "80.5", "", "1234567890", "")]


def test_paging(spark, rows):
    df = spark.range(0, 250).withColumnRenamed("id", "k").where("k % 3 != 0")
    paged = paged_scan(df, "k", page_size=40)
    expected = [k for k in range(250) if k % 3]
    assert rows(paged, "k", "page") == sorted(((k, i // 40) for i, k in enumerate(expected)), key=repr)
    assert [r.k for r in one_page(df, "k", 40, 40).collect()] == expected[40:80]
    assert one_page(df, "k", 40, 400).count() == 0


def test_previous_value_across_buckets(spark, rows):
    data = [("hot", i, None if i % 7 == 0 else float(i)) for i in range(60)] + [("cold", 5, 1.0)]
    df = spark.createDataFrame(data, "key string, pos int, value double")
    out = previous_value(df, "key", ["pos"], "value", F.floor(F.col("pos") / 10))
    expected = {("hot", i): (None if i == 0 or (i - 1) % 7 == 0 else float(i - 1)) for i in range(60)}
    expected["cold", 5] = None
    assert {(r.key, r.pos): r.previous for r in out.collect()} == expected


def test_account_link_last_duplicate_wins(spark, rows):
    deals = spark.createDataFrame([("o1", "a1", 1), ("o1", "a2", 2), ("o2", "a3", 1)], "deal_id string, account_id string, seq int")
    child = spark.createDataFrame([("x", "o1"), ("y", "o9"), ("z", None)], "child string, deal_id string")
    out = derive_account_link(child, deals, order_by=[F.col("seq")])
    assert rows(out, "child", "account_id") == [("x", "a2"), ("y", ""), ("z", "")]


def test_resolve_chain(spark, rows):
    def lookup(*pairs):
        return spark.createDataFrame(list(pairs), "id string, name string")

    ids = spark.createDataFrame([("AB",), ("cd",), ("ef",), ("gh",)], "account_id string")
    out = resolve_name(ids, "account_id", lookup(("ab", "One"), ("CD", "")), lookup(("Cd", "Two"), ("AB", "no")), lookup(("EF", "Three")))
    assert rows(out) == [("AB", "One", "dim"), ("cd", "Two", "primary"), ("ef", "Three", "heuristic"), ("gh", None, None)]
