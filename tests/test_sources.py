import datetime as dt
import random
"""File sources, rule packs, reports and streams."""

import json

from pyspark.sql import functions as F

from rampart.operators import report
from rampart.sources import files
from rampart.sources.rule_packs import read_rule_packs
from rampart.streaming import monitor


def test_files_and_lines(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("import os\nx = 1")
    (tmp_path / "b.js").write_text("eval(x)")
    told = files.read_files(spark, str(tmp_path))
    assert {(r.relative, r.language) for r in told.collect()} == {("src/a.py", "python"), ("b.js", "javascript")}
    assert files.lines_of(told).count() == 3
    assert files.ignore_globs("# c\n\ndist/\n*.log") == ["dist/**", "*.log"]


def test_registry_config_history(spark, tmp_path):
    (tmp_path / "npm.txt").write_text("left\n\nright\n")
    assert files.read_registry(spark, str(tmp_path)).count() == 2
    (tmp_path / ".scannerrc.json").write_text(json.dumps({"exclude": ["x"], "policy": {"max_warning": 3}}))
    config = files.load_config(str(tmp_path / "deep"))
    assert config["exclude"] == ["x"] and config["policy"]["block_on"] == "error" and config["policy"]["max_warning"] == 3
    folder = tmp_path / "results"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"timestamp": "2026-01-05T00:00:00", "grade": "A", "issues_count": 1}))
    (folder / "b.json").write_text(json.dumps({"timestamp": "2025-01-05T00:00:00", "grade": "B"}))
    assert [r.grade for r in files.read_history(spark, str(folder), 30, "2026-01-10").collect()] == ["A"]


def test_rule_packs(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("rules:\n  - id: one\n    languages: [generic]\n    severity: ERROR\n    patterns: ['(?i)abc', 'x(?i)y', '(bad']\n    metadata: {risk_score: 90, category: c, action: BLOCK}\n")
    (tmp_path / "b.yaml").write_text("rules:\n  - id: one\n    patterns: [later]\n")
    (tmp_path / "c.yaml").write_text(": : :\n- [")
    rules, errors = read_rule_packs(spark, str(tmp_path))
    assert [r.pattern for r in rules.collect()] == ["later"]
    assert errors.count() == 3


def test_sarif(spark):
    told = spark.createDataFrame([("a.py", 0, "r1", "error", " x "), ("a.py", 3, "r1", "info", "y")], "path string, line int, rule_id string, severity string, text string")
    doc = json.loads(report.sarif_document(told).first()[0])
    assert doc["version"] == "2.1.0" and len(doc["runs"][0]["results"]) == 2 and doc["runs"][0]["tool"]["driver"]["rules"][0]["id"] == "r1"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "bash", "rm -rf /", "2026-01-01 00:10:00"), (2, "bash", "ls", "2026-01-01 00:20:00")], "action_id int, action_type string, action_value string, t string")
    rows.withColumn("ts", F.col("t").cast("timestamp")).drop("t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("action_id int, action_type string, action_value string, ts timestamp").parquet(str(tmp_path / "in"))
    q = monitor.verdict_stream(stream).writeStream.format("memory").queryName("verdicts").start()
    q.processAllAvailable()
    q.stop()
    assert {r.verdict for r in spark.table("verdicts").collect()} == {"BLOCK", "ALLOW"}
    q = monitor.verdict_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r["count"] for r in spark.table("counts").collect()) == 2


def test_bounded_state(spark, tmp_path):
    """Micro-batches tell what the whole would, conversations that are over leave the state and begin anew."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitor.STORE)
    kinds, t0 = "conv_id long, turn long, hit boolean, ts timestamp", dt.datetime(2026, 1, 1)
    r = random.Random(3)
    rows = [(c, k, r.random() < 0.4, t0 + dt.timedelta(minutes=7 * k + c)) for k in range(12) for c in range(5)]
    spark.createDataFrame(rows[:7], kinds).coalesce(1).write.parquet(str(tmp_path / "turns"))
    q = monitor.prior_hits_stream(spark.readStream.schema(kinds).parquet(str(tmp_path / "turns")), keep="1 hour").writeStream.format("memory").queryName("prior").outputMode("append")
    q = q.start()
    try:
        for lo in range(7, len(rows), 13):
            q.processAllAvailable()
            spark.createDataFrame(rows[lo : lo + 13], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
        q.processAllAvailable()
        for hours in (30, 40):  # long after: all others are over
            spark.createDataFrame([(99, hours, True, t0 + dt.timedelta(hours=hours))], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
            q.processAllAvailable()
        spark.createDataFrame([(0, 50, False, t0 + dt.timedelta(hours=41))], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
        q.processAllAvailable()
        got = {(x.conv_id, x.turn): x.prior for x in spark.table("prior").where("not ended").collect()}
        ended = {(x.conv_id, x.prior) for x in spark.table("prior").where("ended").collect()}
        held = sum(s.numRowsTotal for s in q.lastProgress.stateOperators)
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {(c, k): sum(h for d, j, h, _ in rows if d == c and j < k) for c, k, _, _ in rows}
    assert {k: v for k, v in got.items() if k[0] < 5 and k[1] < 50} == want and got[0, 50] == 0
    assert {(c, sum(h for d, _, h, _ in rows if d == c)) for c in range(5)} <= ended and held <= 2
