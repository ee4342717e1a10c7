import csv
import io
import random

from pyspark.sql import functions as F

from tidewell.functions.csvtext import with_cells
from tidewell.functions.moments import source_rules
from tidewell.operators import parsing, timestamps

SOURCES = [("kb", 1, "Asia/Ho_Chi_Minh", "DMY"), ("ny", 2, "America/New_York", "MDY")]
S_SCHEMA = "source_system string, trust_rank int, default_tz string, date_order string"
L_SCHEMA = "line_id bigint, file_name string, line_no int, source_system string, layout string, raw_line string"
E_SCHEMA = "row_id bigint, run_id string, source_system string, chunk_id string, doc_id string, chunk_text string, effective_date string, exported_at string"
Q_SCHEMA = "quarantine_id bigint, source_system string, reason string, effective_date_normalized string"


def tables(spark, lines=(), export=(), quarantine=()):
    return (
        spark.createDataFrame([(i, "f", i, s, y, r) for i, (s, y, r) in enumerate(lines)], L_SCHEMA),
        spark.createDataFrame([(i, "r", s, "1", "d", t, e, x) for i, (s, t, e, x) in enumerate(export)], E_SCHEMA),
        spark.createDataFrame([(i, "kb", r, None) for i, r in enumerate(quarantine)], Q_SCHEMA),
        spark.createDataFrame(SOURCES, S_SCHEMA),
    )


def reasons(spark, **parts):
    return {(r.source_table, r.row_key): r.reason for r in parsing.failed_rows(*tables(spark, **parts)).collect()}


def test_cells_like_the_csv_module(spark):
    random.seed(3)
    records = []
    for _ in range(300):
        cells = ["".join(random.choice('ab,"\n\u0001\u0002 é') for _ in range(random.randint(0, 6))) for _ in range(random.randint(1, 5))]
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(cells)
        records.append((cells, out.getvalue() + random.choice(["", "\r"])))
    rows = spark.createDataFrame([(i, r) for i, (_, r) in enumerate(records)], "i int, raw string")
    got = {r.i: (r.csv_quoting_ok, r.csv_cells) for r in with_cells(rows, "raw").collect()}
    for i, (cells, _) in enumerate(records):
        assert got[i] == (True, cells), records[i]


def test_quoting(spark):
    broken = ['1,"a', '1,a"b,c', '1,"a"b,c', 'a\nb,c', '"a" ,b', None, '"a""b']
    fine = ['1,"a ""b"" c",d', ",,", "", '""', '"a\r\nb",c', "a\r", '"' + 'x""' * 40_000 + '",b']
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(broken + fine)], "i int, raw string")
    ok = {r.i for r in with_cells(rows, "raw").where("csv_quoting_ok").collect()}
    assert ok == set(range(len(broken), len(broken) + len(fine)))


def test_first_reason_of_each_row(spark):
    lines = [
        ("kb", "export", "1,d,t,2026-01-02,2024-03-06T04:14:10"), ("kb", "export", '1,d,"t,2026-01-02,x'), ("kb", "export", "1,d,t,2026-01-02"), ("kb", "export", "x,d,t,bad,bad"), ("kb", "export", "1,d,t,bad,bad"),
        ("kb", "export", "1,d,t,,bad"), ("kb", "quarantine", "1,d,t,,,nope,"), ("kb", "quarantine", "1,d,t,,,stale_effective_date,"), ("ny", "export", "1,d,t,01/13/2026,2024-03-06"), ("kb", "export", "1,d,t,01/13/2026,2024-03-06"),
        ("kb", "other", "1,d"), ("none", "export", "1,d,t,13/01/2026,08:00"),
    ]
    export = [
        ("kb", "tăng 6", "4% nếu chi phí vượt", "2026-01-02"), ("kb", "ca trực kéo dài", " sau đó gửi biểu mẫu", "2026-01-02"), ("kb", 'a.",2026-03-20,2024-03-05 17:33:38 UTC', None, None), ("kb", "a.,2026-03-20,", None, ""),
        ("kb", "plain, text", None, None), ("kb", "t", "chưa xác định", "2024-03-06"), ("kb", "t", " ", "2024-03-06"), ("kb", "t", "2026-02-30", "2024-03-06"), ("kb", None, None, None),
        ("kb", 'a.",2026-05-04,2024-03-02T02:32:06.179\n7521,the_khach_v4,"Nhân viên, trước', None, None),
    ]
    quarantine = [" Stale_Effective_Date ", None, "", "unknowndocid", "missing_chunk_text|stale"]
    got = reasons(spark, lines=lines, export=export, quarantine=quarantine)
    of = lambda table: {k[1]: v for k, v in got.items() if k[0] == table}
    assert of("policy_export_lines") == {1: "broken_quoting", 2: "column_count", 3: "invalid_chunk_id", 4: "invalid_effective_date", 5: "invalid_exported_at", 6: "invalid_reason", 9: "invalid_effective_date", 10: "column_count", 11: "invalid_exported_at"}
    assert of("policy_export_dirty") == {0: "column_count", 1: "column_count", 2: "broken_quoting", 3: "broken_quoting", 5: "invalid_effective_date", 7: "invalid_effective_date", 9: "broken_quoting"}
    assert of("quarantine_ci_smoke") == dict.fromkeys((1, 2, 3, 4), "invalid_reason")


def test_loaded_rows(spark):
    lines, _, _, sources = tables(spark, lines=[("kb", "export", '1,d,"a, ""b""",,\r'), ("kb", "export", "x,d,t,,")])
    rows = parsing.loaded_lines(lines.withColumn("reason", F.lit("clash")), source_rules(sources)).collect()
    assert [(r.line_id, r.chunk_text, r.exported_at) for r in rows] == [(0, 'a, "b"', "")]


def test_loaded_rows_of_all_tables(spark, data):
    lines = [("kb", "export", "1,d,t,,"), ("kb", "export", "x,d,t,,")]
    export = [("kb", "t", "2026-02-28", None), ("kb", "t", "2026-02-30", None), ("kb", "ca trực kéo dài", " sau đó gửi biểu mẫu", "2026-01-02"), ("none", None, None, None)]
    rows = parsing.loaded_rows(*tables(spark, lines=lines, export=export, quarantine=["stale_effective_date", None])).collect()
    assert {(r.source_table, r.row_key) for r in rows} == {("policy_export_lines", 0), ("policy_export_dirty", 0), ("policy_export_dirty", 3), ("quarantine_ci_smoke", 0)}
    assert {r.effective_date for r in rows if r.source_table == "policy_export_dirty"} == {"2026-02-28", None}

    from tidewell.queries import QUERIES

    loaded = {(r.source_table, r.row_key) for r in QUERIES["p5_loaded"](spark, data).select("source_table", "row_key").collect()}
    failed = {(r.source_table, r.row_key) for r in QUERIES["p5_found"](spark, data).collect()}
    every = {(t, r[0]) for t, k in (("policy_export_lines", "line_id"), ("policy_export_dirty", "row_id"), ("quarantine_ci_smoke", "quarantine_id")) for r in spark.read.parquet(f"{data}/{t}.parquet").select(k).collect()}
    assert not loaded & failed and loaded | failed == every


def test_normalised(spark):
    _, export, _, sources = tables(spark, export=[("kb", "t", "20/03/2026", "2024-03-06T04:14:10"), ("kb", "t", "2026-03-20", "2024-03-05T21:14:10.000000Z"), ("kb", "dài", " sau đó gửi biểu mẫu", "2026-01-02"), ("kb", None, None, None)])
    quarantine = spark.createDataFrame([(1, "ny", "x", "03/20/2026"), (2, "ny", "x", "2026-03-20"), (3, None, None, "20.03.2026")], Q_SCHEMA)
    got = {(r.source_table, r.row_key, r.field): r.value for r in timestamps.normalised(export, quarantine, sources).collect()}
    assert got == {
        ("policy_export_dirty", 0, "effective_date"): "2026-03-20", ("policy_export_dirty", 0, "exported_at"): "2024-03-05T21:14:10.000000Z",
        ("quarantine_ci_smoke", 1, "effective_date_normalized"): "2026-03-20", ("quarantine_ci_smoke", 3, "effective_date_normalized"): "2026-03-20",
    }
