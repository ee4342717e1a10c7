import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import chunking, cleaning, evaluation, quality, retrieval, snapshots
from tidewell.operators.joins import join_groups
from tidewell.plans import index, pipeline
from tidewell.sources import files, storage
from tidewell.streaming import events

CATALOG = [("policy_a_v1", "2026-01-01"), ("policy_b_v3", "2025-01-01")]


def catalog(spark):
    return spark.createDataFrame(CATALOG, "doc_id string, effective_date string")


EXPORT = [
    (1, "policy_a_v1", "The  Text", "2026-02-01", "x"), (2, " policy_a_v1 ", "the text", "2026-02-01", "x"), (3, "other", "", "", ""), (4, "policy_a_v1", "", "", None), (5, "policy_a_v1", "a", "1 May 2026", ""),
    (6, "policy_a_v1", "b", "31/12/2025", ""), (7, "policy_a_v1", None, "01/02/2026", ""), (8, "policy_b_v3", "the text", "2025-02-01", ""), (9, "policy_b_v3", "c 14 ngày làm việc", "2026-99-99", ""),
]


def export(spark):
    return spark.createDataFrame(EXPORT, "row_id bigint, doc_id string, chunk_text string, effective_date string, exported_at string")


def test_first_failing_rule_wins(spark):
    got = {r.row_id: r.reason for r in cleaning.clean(export(spark), catalog(spark)).collect()}
    assert got == {1: None, 2: "duplicate_chunk_text", 3: "unknown_doc_id", 4: "missing_effective_date", 5: "invalid_effective_date_format", 6: "stale_effective_date", 7: "missing_chunk_text", 8: "duplicate_chunk_text", 9: None}


def test_ids_and_rewrite(spark):
    rows = cleaning.clean(export(spark), catalog(spark)).where("reason IS NULL")
    fixed = cleaning.rewritten(rows, "%_v3", "ngày làm việc", "ngày", " [x]").orderBy("row_id").collect()
    assert [r.text for r in fixed] == ["The  Text", "c 14 ngày [x]"]
    assert [r.seq for r in cleaning.positional_ids(rows, block=3).orderBy("row_id").collect()] == [1, 2]
    assert cleaning.content_ids(rows).select("chunk_key").distinct().count() == 2


def test_suite_and_freshness(spark):
    rows = cleaning.clean(export(spark), catalog(spark)).where("reason IS NULL")
    results = quality.suite(rows, pipeline.expectations())
    assert {r.expectation: r.violations for r in results.collect()} == {"min_rows": 0, "no_empty_document": 0, "iso_date": 0, "text_of_eight_characters": 0}
    assert not quality.halts(results) and quality.halts(quality.suite(rows.where("1=0"), pipeline.expectations()))
    runs = spark.createDataFrame([("a", "2026-01-02T00:00:00+00:00", ""), ("b", None, None), ("c", "", "2026-01-01T00:00:00"), ("d", "", "2030-01-01"), ("e", "bad", "worse")], "run_id string, run_timestamp string, latest_exported_at string")
    assert {r.run_id: r.status for r in quality.freshness(runs, "2026-01-02 12:00:00").collect()} == {"a": "PASS", "b": "WARN", "c": "FAIL", "d": "PASS", "e": "WARN"}


def test_headers_sections_and_pieces(spark):
    text = "TITLE\nSource: a/b.md\nDepartment: HR\nSource: c.md\nnote\n\n=== One ===\nfirst\n\n\n\nmore\n=== Two ===\n" + "x" * 5000
    docs = spark.createDataFrame([(1, text), (2, "no heading"), (3, None), (4, "=== A ===\n \n=== B ===\ny")], "doc_id int, text string")
    rows = {r.doc_id: r for r in chunking.parsed(docs).collect()}
    assert (rows[1].h_source, rows[1].h_department, rows[1].h_access) == ("c.md", "HR", "internal")
    parts = chunking.sections(chunking.parsed(docs))
    got = [(r.doc_id, r.section) for r in parts.orderBy("doc_id", "section_no").collect()]
    assert got == [(1, "One"), (1, "Two"), (2, "General"), (4, "B")]
    pieces = chunking.fixed_pieces(parts.where("section = 'Two'"), "section_text").orderBy("piece_no").collect()
    assert len(pieces) == 4 and pieces[0].piece + "".join(p.piece[320:] for p in pieces[1:]) == "x" * 5000
    packed = chunking.packed_paragraphs(spark.createDataFrame([("aa\n\nbb\n \n" + "c" * 10,), (None,), (" ",)], "t string"), "t", size=8, overlap=2).collect()
    assert [r.piece for r in packed] == ["aa\n\nbb", "bbcccccc", "cccccc"]
    long = "\n\n".join(f"{i} " + "x" * (i % 50) for i in range(40_000))
    pieces = [r.piece for r in chunking.packed_paragraphs(spark.createDataFrame([(long,)], "t string"), "t", size=500, overlap=0).collect()]
    assert "\n\n".join(pieces) == long and max(map(len, pieces)) <= 500


def test_dense_and_diverse(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(30)] + [(30, None), (31, [0.0, 0.0, 0.0])], "vec_id bigint, embedding array<float>")
    queries = vectors.where("vec_id IN (3, 30)").withColumnRenamed("vec_id", "query_id")
    got = retrieval.dense_topk(queries, vectors, 3, 3).collect()
    assert {(r.query_id, r["rank"]) for r in got} == {(q, k) for q in (3, 30) for k in (1, 2, 3)}
    assert next(r.vec_id for r in got if r.query_id == 3 and r["rank"] == 1) == 3
    near = retrieval.dense_topk(queries, vectors, 5, 3).join(vectors.where("embedding IS NOT NULL"), "vec_id")
    assert retrieval.diversified(near.where("query_id = 3"), 2).count() == 2


def test_dense_by_scan_and_by_packs(spark, monkeypatch):
    numbers = np.random.default_rng(3).normal(size=(700, 4)).round(1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(numbers)] + [(700, [1.0]), (701, None)], "vec_id bigint, embedding array<float>").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(numbers[:520])] + [("none", None)], "query_id string, embedding array<float>")
    got = []
    for cells in (0, 10**9):
        monkeypatch.setattr(retrieval, "QUERY_CELLS", cells)
        got.append({(r.query_id, r.vec_id, r["rank"]) for r in retrieval.dense_topk(queries, vectors, 3, 4).collect()})
    assert got[0] == got[1] and len(got[0]) == 521 * 3


@pytest.mark.parametrize("cells", [0, 10**9])
def test_sparse_by_product_and_by_join(spark, cells, monkeypatch):
    monkeypatch.setattr(retrieval, "SPARSE_WORDS", cells)
    docs = spark.createDataFrame([(1, "the red fox"), (2, "the dog"), (3, None), (4, "fox fox the"), (5, "")], "doc_id bigint, text string")
    queries = spark.createDataFrame([("q1", "Red FOX"), ("q2", None), ("q3", "absent")], "query_id string, query string")
    got = [(r.query_id, r.doc_id, r["rank"]) for r in retrieval.bm25_topk(queries, docs, 5).orderBy("query_id", "rank").collect()]
    assert got == [("q1", 1, 1), ("q1", 4, 2)]


def test_fusion(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, doc_id bigint, rank int")
    b = spark.createDataFrame([("q", 3, 1), ("q", 2, 2)], "query_id string, doc_id bigint, rank int")
    assert [r.doc_id for r in retrieval.fused(a, b, 3).orderBy("rank").collect()] == [2, 1, 3]


def test_two_decimals_like_python(spark):
    values = [0.205, 0.625, 0.615, 0.995, 0.005, 1.0, 0.125, 0.375, *[k / 10000 for k in range(0, 10000, 7)]]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert all(r.s == f"{r.v:.2f}" for r in rows.select("v", evaluation.two_decimals(F.col("v")).alias("s")).collect())


def test_sides_are_compared_by_totals(spark):
    variant = spark.createDataFrame([("a", 1.0, None), ("b", 2.0, 1.0), ("c", 1.0, 1.0)], "id string, m double, n double")
    baseline = spark.createDataFrame([("a", None, 1.0), ("b", 5.0, None)], "id string, m double, n double")
    assert {r.id: (r.variant_total, r.baseline_total, r.winner) for r in evaluation.compared(variant, baseline, ["m", "n"]).collect()} == {"a": (1.0, 1.0, "Tie"), "b": (3.0, 5.0, "Baseline"), "c": (2.0, 0.0, "Variant")}
    assert {r.metric: (r.baseline, r.variant, r.delta) for r in evaluation.averages(variant, baseline.where("id = 'a'"), ["m", "n"]).collect()} == {"m": (None, 1.333333, None), "n": (1.0, 1.0, 0.0)}
    assert evaluation.both_sides(baseline, variant).groupBy("side").count().count() == 2


def test_a_text_on_a_third_of_all_rows_is_spread(spark):
    """Rows that repeat one text, and rows that failed a rule, don't meet in one task."""
    rows = spark.range(6000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "Same  text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"), (F.col("id") % 3 == 1).alias("bad"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        defaults = join_groups.__defaults__
        join_groups.__defaults__ = (100, *defaults[1:])
        out = cleaning.tagged(rows, [cleaning.Rule("bad", F.col("bad"))])
        sizes = out.groupBy(F.spark_partition_id()).count().collect()
        reasons = {r.reason: r["count"] for r in out.groupBy("reason").count().collect()}
    finally:
        join_groups.__defaults__ = defaults
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert reasons == {"bad": 2000, "duplicate_chunk_text": 1999, None: 2001}
    assert max(r["count"] for r in sizes) < 6000 / len(sizes) * 1.3


def test_context_prompt_and_parts(spark):
    rows = spark.createDataFrame([([("a.md", 0.5, "x"), (None, None, None)], [("r1",)]), ([], []), (None, None)], "c array<struct<source string, score double, text string>>, e array<struct<rule string>>")
    got = [r[0] for r in rows.select(evaluation.context_with_exceptions(F.col("c"), F.col("e"))).collect()]
    assert got == ["=== DOCUMENTS ===\n\n[1] a.md (relevance: 0.50)\nx\n\n[2] unknown (relevance: 0.00)\n\n\n=== POLICY EXCEPTIONS ===\n\n- r1", "(no context)", "(no context)"]
    prompt = rows.select(evaluation.grounded_prompt(F.lit("why?"), F.lit(None).cast("string"), "Q {question} C {context}.")).first()[0]
    assert prompt == "Q why? C ."
    parts = retrieval.decomposed(spark.createDataFrame([("q", "who pays and who signs? ok"), ("n", None)], "query_id string, query string"))
    assert {(r.query_id, r.part_no, r.query) for r in parts.collect()} == {("q", 0, "who pays"), ("q", 1, "who signs"), ("n", 0, "")}
    results = spark.createDataFrame([("q", 1, 0.5), ("q", 1, 0.7), ("q", 2, 0.6)], "query_id string, doc_id bigint, score double")
    assert [(r.doc_id, r.score) for r in retrieval.united(results, 5).orderBy("rank").collect()] == [(1, 0.7), (2, 0.6)]


def test_repeats_and_missing_fields(spark):
    rows = spark.createDataFrame([(1, "A  b"), (2, "a b "), (3, None), (4, "c")], "k int, t string")
    assert quality.repeats(rows, "t").first().violations == 1
    assert {r.k: r.missing for r in quality.missing_fields(rows, "k", ["t", "u"]).collect()} == {1: "u", 2: "u", 3: "t,u", 4: "u"}


def test_index_from_documents_to_search(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Source: a.md\n=== Fees ===\nthe refund fee"), (2, "Department: HR\n=== Leave ===\nannual leave days"), (3, None)], "doc_id bigint, text string")
    index.build(docs, str(tmp_path / "index"), "r1")
    queries = spark.createDataFrame([("q1", "refund fee"), ("q2", None)], "query_id string, query string")
    best = {r.query_id: r.chunk_id for r in index.search(spark, str(tmp_path / "index"), queries, 1).collect()}
    assert best["q1"] == "1-1-0"
    shown = index.listing(spark, str(tmp_path / "index")).collect()
    assert [(r.chunk_id, r.section, r.department) for r in shown] == [("1-1-0", "Fees", "unknown"), ("2-1-0", "Leave", "HR")]
    with pytest.raises(ValueError):
        index.build(docs.where("1=0"), str(tmp_path / "none"), "r1")


def test_reports_and_traces(spark, tmp_path):
    rows = spark.createDataFrame([("20260101-a", "é"), ("x", "b")], "run_id string, task string")
    for _ in range(2):
        files.write_traces(rows, str(tmp_path / "traces"))
    assert spark.read.json(str(tmp_path / "traces")).count() == 4
    files.write_log(spark, str(tmp_path / "logs/r.log"), {"raw_records": 3, "run_id": "r"})
    assert (tmp_path / "logs/r.log").read_text() == "raw_records=3\nrun_id=r\n"
    files.write_json(spark, str(tmp_path / "report.json"), {"single": {"n": 1}, "delta": None})
    files.write_json(spark, str(tmp_path / "report.json"), {"run_id": "r", "raw_records": 1})
    assert files.missing_keys(spark, str(tmp_path / "report.json")) == ["cleaned_records", "quarantine_records"] and len(files.missing_keys(spark, str(tmp_path / "no.json"))) == 4
    averages = spark.createDataFrame([("recall", 0.5), ("relevance", 0.0)], "metric string, average double")
    text = files.scorecard_markdown("v1", averages, spark.createDataFrame([("q1", None)], "id string, note string"))
    assert "| recall | 0.50 |" in text and "| relevance | N/A |" in text and "| q1 | N/A |" in text


def test_stream_resumes_and_drops_late_rows(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    part = lambda n, rows: spark.createDataFrame(rows, "t string, event_type string, value double").selectExpr("cast(t as timestamp) ts", "event_type", "value").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    seen = []
    source = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    part(1, [("2026-01-01 00:10:00", "a", 1.0), ("2026-01-01 09:00:00", "a", 1.0)])
    part(2, [("2026-01-01 00:20:00", "a", 5.0), ("2026-01-01 08:30:00", "a", 2.0)])
    got = {r.window_start: r.total for r in events.drained(events.windowed(source()), "t", ["window_start", "event_type"]).collect()}
    assert got["2026-01-01 09:00:00"] == 1.0 and got["2026-01-01 08:00:00"] == 2.0
    for _ in range(2):
        events.ingest(source(), lambda b: b.where("value > 1"), lambda b, n: seen.append(b.count()), str(tmp_path / "state")).awaitTermination()
    assert sum(seen) == 2


# A known export of ten records and what cleaning makes of it.
GOLDEN = [
    ("1", "policy_refund_v4", "Yêu cầu được gửi trong vòng 7 ngày làm việc kể từ thời điểm xác nhận đơn hàng.", "2026-02-01"),
    ("2", "policy_refund_v4", "Yêu cầu được gửi trong vòng 7 ngày làm việc kể từ thời điểm xác nhận đơn hàng.", "2026-02-01"),
    ("3", "policy_refund_v4", "Yêu cầu hoàn tiền được chấp nhận trong vòng 14 ngày làm việc kể từ xác nhận đơn (ghi chú: bản sync cũ policy-v3 — lỗi migration).", "2026-02-01"),
    ("4", "sla_p1_2026", "Ticket P1 có SLA phản hồi ban đầu 15 phút và resolution trong 4 giờ.", "2026-02-01"),
    ("5", "policy_refund_v4", "", ""),
    ("6", "it_helpdesk_faq", "Tài khoản bị khóa sau 5 lần đăng nhập sai liên tiếp.", "2026-02-01"),
    ("7", "hr_leave_policy", "Nhân viên dưới 3 năm kinh nghiệm được 10 ngày phép năm (bản HR 2025).", "2025-01-01"),
    ("8", "hr_leave_policy", "Nhân viên dưới 3 năm kinh nghiệm được 12 ngày phép năm theo chính sách 2026.", "2026-02-01"),
    ("9", "legacy_catalog_xyz_zzz", "Chunk nội dung đủ dài để vượt ngưỡng expectation độ dài tối thiểu trong cleaned export.", "2026-02-01"),
    ("10", "it_helpdesk_faq", "FAQ bổ sung: đổi mật khẩu qua portal self-service có thể mất tối đa 24 giờ để đồng bộ toàn hệ thống.", "01/02/2026"),
]
GOLDEN_QUARANTINE = {"2": "duplicate_chunk_text", "5": "missing_effective_date", "7": "stale_effective_date", "9": "unknown_doc_id"}
GOLDEN_KEYS = ["policy_refund_v4_1_3b11f30cc4b49d25", "policy_refund_v4_2_c96089a43e33aa9d", "sla_p1_2026_3_ab622211ba880896", "it_helpdesk_faq_4_ba09094c6802344b", "hr_leave_policy_5_818ac82ac90f32fc", "it_helpdesk_faq_6_76d38c1b20d4459f"]


def test_known_export(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text("chunk_id,doc_id,chunk_text,effective_date,exported_at\n" + "".join(f'{i},{d},"{t}",{e},2026-04-10T08:00:00\n' for i, d, t, e in GOLDEN) + "11,it_helpdesk_faq,a,2026-02-01,2026-04-10T08:00:00,more\n", encoding="utf-8")
    listed = spark.createDataFrame([("policy_refund_v4", "2000-01-01"), ("sla_p1_2026", "2000-01-01"), ("it_helpdesk_faq", "2000-01-01"), ("hr_leave_policy", "2026-01-01")], "doc_id string, effective_date string")
    rewrite = ("policy_refund_v4", "14 ngày làm việc", "7 ngày làm việc", " [cleaned: stale_refund_window]")
    run = pipeline.run(spark, str(raw), listed, str(tmp_path / "out"), "golden", rewrites=[rewrite])
    assert (run.manifest["raw_records"], run.manifest["cleaned_records"], run.manifest["quarantine_records"], run.manifest["latest_exported_at"]) == (11, 6, 5, "2026-04-10T08:00:00")
    quarantine = spark.read.csv(str(tmp_path / "out/quarantine/golden"), header=True).collect()
    assert {r.chunk_id: r.reason for r in quarantine if r.chunk_id} == GOLDEN_QUARANTINE and [r.reason for r in quarantine if not r.chunk_id] == ["column_count"]
    rows = cleaning.clean(files.read_export(spark, str(raw))[0], listed).where("reason IS NULL")
    keys = cleaning.positional_ids(cleaning.rewritten(rows, *rewrite)).orderBy("seq").collect()
    assert [r.chunk_key for r in keys] == GOLDEN_KEYS
    assert storage.exists(spark, str(tmp_path / "out/logs/golden.log"))


def test_recall_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(["a/x.md", "y.pdf"], ["X.MD"]), ([], ["x"]), (None, None), (["x"], None)], "e array<string>, f array<string>")
    recall, score = evaluation.context_recall(F.col("e"), F.col("f"))
    assert [tuple(r) for r in rows.select(recall, score).collect()] == [(0.5, 2), (None, None), (None, None), (0.0, 0)]


def test_checks_without_phrases(spark):
    rows = spark.createDataFrame([("17 ngày", ["7 ngày"], []), (None, [], ["x"])], "b string, w array<string>, f array<string>")
    wanted, banned = evaluation.retrieval_checks(F.col("b"), F.col("w"), F.col("f"))
    assert [tuple(r) for r in rows.select(wanted, banned).collect()] == [(True, False), (True, False)]


def test_hot_groups_join_whole(spark):
    rows = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    assert join_groups(rows, groups, ["k"], "n", "row_id", hot=100).select("row_id").distinct().count() == 5000
    assert join_groups(rows, groups.where("n > 1"), ["k"], "n", "row_id", hot=100).count() == groups.where("n > 1").agg(F.sum("n")).first()[0]


def test_pipeline_publishes_and_reruns(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    lines = ["chunk_id,doc_id,chunk_text,effective_date,exported_at"] + [f'{i},{d},"{(t or "").replace(chr(34), chr(34) * 2)}",{e},{x or ""}' for i, d, t, e, x in EXPORT]
    raw.write_text("\n".join(lines) + "\n", encoding="utf-8")
    first = pipeline.run(spark, str(raw), catalog(spark), str(tmp_path / "out"), "r1")
    assert first.code == pipeline.OK and (first.manifest["raw_records"], first.manifest["cleaned_records"]) == (9, 2)
    again = pipeline.run(spark, str(raw), catalog(spark), str(tmp_path / "out"), "r2")
    now = snapshots.current(spark, str(tmp_path / "out/index"))
    assert again.code == pipeline.OK and now.count() == 2 and now.select("run_id").distinct().first()[0] == "r2"
    assert pipeline.run(spark, str(tmp_path / "none.csv"), catalog(spark), str(tmp_path)).code == pipeline.NO_INPUT
    assert pipeline.run(spark, str(raw), catalog(spark).where("1=0"), str(tmp_path / "halt")).code == pipeline.HALTED
    assert pipeline.freshness_code(spark, str(tmp_path / "out/manifests/r1.json"), "2026-01-01 00:00:00") == 0
    body = b"".join(p.read_bytes() for p in (tmp_path / "out/cleaned/r1").glob("*.csv"))
    assert body.startswith(b"chunk_key,doc_id") and b"\r\n" in body


def test_files(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"a": 1}\n\nnot json\n{"a": 2}\n', encoding="utf-8")
    rows, broken = files.read_json_lines(spark, str(lines), spark.createDataFrame([], "a bigint").schema)
    assert sorted(r.a for r in rows.collect()) == [1, 2] and [r.value for r in broken.collect()] == ["not json"]
    files.write_csv(spark.createDataFrame([], "a string, b string"), str(tmp_path / "none"), ["a", "b"])
    assert (tmp_path / "none/part-00000.csv").read_bytes() == b"a,b\r\n"
    files.write_json(spark, str(tmp_path / "m.json"), {"run_id": "é"})
    assert json.loads((tmp_path / "m.json").read_text(encoding="utf-8")) == {"run_id": "é"}
    assert "| N/A |" in files.markdown_table(spark.createDataFrame([(None,)], "a string"))
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/x.txt").write_text("one\ntwo", encoding="utf-8")
    assert [tuple(r) for r in files.read_corpus(spark, str(tmp_path / "docs")).collect()] == [("x.txt", "one\ntwo")]


def test_snapshot_changes_and_upsert(spark, tmp_path):
    keys = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "b"), ("r2", "c"), ("r2", "c")], "run_id string, k string")
    assert {tuple(r) for r in snapshots.changes(keys, "run_id", "k").collect()} == {("r1", 0, 2, 0), ("r2", 1, 1, 1)}
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2)], "k string, v int")
    assert {tuple(r) for r in snapshots.upserted(old, new, "k", prune=False).collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(ValueError):
        snapshots.publish(old.where("1=0"), str(tmp_path), "r")
    assert snapshots.current(spark, str(tmp_path), allow_empty=True) is None
