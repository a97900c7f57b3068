"""The SARIF sink with empty, failing and odd inputs; readers of packs and diffs."""

import json

import pytest
from pyspark.sql import functions as F

from rampart.sources import formats, rule_packs

KINDS = "rule_id string, severity string, path string, line int, text string"


def test_one_document(spark, tmp_path):
    rows = [(f"r{i % 3}", ["error", "info", "warning", "odd"][i % 4], f"src/é {i % 5}.js", i, f'  say "{i}"\t ') for i in range(500)]
    told, path = spark.createDataFrame(rows, KINDS), str(tmp_path / "out" / "all.sarif")
    (tmp_path / "out").mkdir()
    for parts in (1, 7):
        formats.write_sarif(told.repartition(parts), path, tool="t", version="2")
        run = json.load(open(path, encoding="utf-8"))["runs"][0]
        got = sorted((x["ruleId"], x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], x["locations"][0]["physicalLocation"]["region"]["startLine"]) for x in run["results"])
        assert got == sorted((r, p, n + 1) for r, _, p, n, _ in rows)
        assert run["tool"]["driver"]["name"] == "t" and [x["id"] for x in run["tool"]["driver"]["rules"]] == ["r0", "r1", "r2"]
        assert [x.name for x in (tmp_path / "out").iterdir() if "parts" in x.name] == []
    formats.write_sarif(told.limit(0), path)
    assert json.load(open(path))["runs"][0]["results"] == []
    with pytest.raises(Exception):
        told.write.format("sarif").mode("append").save(path)


def test_one_document_read_by_many_tasks(spark, data, tmp_path):
    """A document is read in ranges, odd texts included, and no task takes it whole."""
    from rampart.plans.more import sarif_written

    rows = [(f"r{i % 3}", "error", f"src/é\r\u2028\u0085{i}.js", i, "x\n") for i in range(3000)] + [('{"ruleId":', "info", '"results": [', 0, "],")]
    path, kinds = str(tmp_path / "all.sarif"), "struct<ruleId:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        formats.write_sarif(spark.createDataFrame(rows, KINDS).repartition(3), path)
        told = formats.read_sarif(spark, path, kinds)
        assert told.rdd.getNumPartitions() > 5
        got = sorted((r.ruleId, r.locations[0].physicalLocation.artifactLocation.uri) for r in told.collect())
        assert got == sorted((r, p) for r, _, p, _, _ in rows)
        assert sarif_written(spark, data).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_compressed_document(spark, tmp_path):
    """Zstandard opens it whole, tasks read ranges of it; odd texts, empty parts and a text larger than a frame included."""
    import pyarrow as pa

    rows = [(f"r{i % 3}", "error", f"src/é\r\u2028\u0085{i}.js", i, "x\n") for i in range(9000)] + [('{"ruleId":', "info", '"results": [' + "y" * formats.FRAME, 0, "],")]
    told, path, plain = spark.createDataFrame(rows, KINDS), str(tmp_path / "all.sarif.zst"), str(tmp_path / "all.sarif")
    kinds = "struct<ruleId:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>"
    places = lambda run: sorted((x["ruleId"], x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]) for x in run["results"])
    want = sorted((r, p) for r, _, p, _, _ in rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        for some in (told.repartition(3), told.repartition(20, "rule_id"), told.limit(0)):
            formats.write_sarif(some, path)
            formats.write_sarif(some, plain)
            run = json.loads(pa.input_stream(path, compression="zstd").read())["runs"][0]
            assert run["tool"] == json.load(open(plain, encoding="utf-8"))["runs"][0]["tool"]
            back = formats.read_sarif(spark, path, kinds)
            got = sorted((r.ruleId, r.locations[0].physicalLocation.artifactLocation.uri) for r in back.collect())
            assert got == places(run) == (want if run["results"] else [])
            assert back.rdd.getNumPartitions() > 5 or not got
            assert sorted(x.name for x in tmp_path.iterdir()) == ["all.sarif", "all.sarif.zst"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "other.zst").write_bytes(pa.Codec("zstd").compress(b"no table", asbytes=True))
    with pytest.raises(Exception, match="seek table"):
        formats.read_sarif(spark, str(tmp_path / "other.zst"), kinds).collect()


def test_the_document_of_all_findings_is_small(spark, data, tmp_path, monkeypatch):
    """All findings go through the sink in less than 100 bytes of disk each, where their text has over 400, and nothing else is kept."""
    from rampart.plans.more import sarif_written

    monkeypatch.setattr("rampart.sources.stored.shared_folder", lambda _: f"file://{tmp_path}")
    n = sarif_written(spark, data).count()
    (whole,) = [x for x in tmp_path.rglob("*") if x.is_file()]
    assert n == spark.read.parquet(f"{data}/lineitem.parquet").count() and whole.stat().st_size < 100 * n


@pytest.mark.parametrize("name", ["x.sarif", "x.sarif.zst"])
def test_parts_go_while_they_are_put_together(tmp_path, monkeypatch, name):
    """However much one task writes, the document and what is left of the parts are little more than the document."""
    import hashlib

    import pyarrow as pa
    import pyarrow.fs
    import pyspark

    monkeypatch.setattr(pyspark, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda _: 0})())}))
    monkeypatch.setattr(formats, "PART", 20_000)
    monkeypatch.setattr(formats, "FRAME", 4_000)
    rows = [{"rule_id": "r", "severity": "error", "path": hashlib.sha256(str(i).encode()).hexdigest(), "line": i, "text": "x"} for i in range(5000)]
    writer, held, files = formats._SarifWriter(str(tmp_path / name), True, "t", "1"), [], formats._files
    told = [writer.write(iter(pa.Table.from_pylist(some).to_batches())) for some in (rows[:4000], [], rows[4000:])]

    class Watched:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, at):
            held.append(sum(x.stat().st_size for x in tmp_path.rglob("*") if x.is_file()))
            return getattr(self.fs, at)

    monkeypatch.setattr(formats, "_files", lambda uri: (lambda fs, path: (Watched(fs), path))(*files(uri)))
    writer.commit([*told, None])
    assert [x.name for x in tmp_path.iterdir()] == [name] and max(held) < (tmp_path / name).stat().st_size + 2 * formats.PART
    text = pa.input_stream(str(tmp_path / name), compression="zstd" if name.endswith("zst") else None).read()
    assert [x["locations"][0]["physicalLocation"]["region"]["startLine"] for x in json.loads(text)["runs"][0]["results"]] == list(range(1, 5001))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    told = spark.createDataFrame([("r", "error", "p", i, "x") for i in range(100)], KINDS).repartition(5)
    bad = told.withColumn("text", F.when(F.col("line") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception):
        formats.write_sarif(bad, str(tmp_path / "x.sarif"))
    assert list(tmp_path.iterdir()) == []


def test_result_with_all_it_can_hold():
    told = formats.sarif_result({"rule_id": "r", "severity": "error", "path": "p", "line": 4, "text": " x ", "message": "m", "steps": [{"line": 1, "text": "a"}, {"line": 4, "text": "b"}], "related": [{"path": "q", "line": 0, "message": "w"}], "fix": "y"})
    assert [x["location"]["physicalLocation"]["region"]["startLine"] for x in told["codeFlows"][0]["threadFlows"][0]["locations"]] == [2, 5]
    assert told["relatedLocations"][0]["message"]["text"] == "w" and told["fixes"][0]["artifactChanges"][0]["replacements"][0]["deletedRegion"] == {"startLine": 5}
    assert set(formats.sarif_result({"rule_id": "r", "severity": "x", "path": "p", "line": 0})) == {"ruleId", "level", "message", "locations", "partialFingerprints"}


def test_odd_values_in_results(spark, tmp_path):
    """Nulls, empty lists and characters that JSON escapes, by themselves and inside lists, go through the sink as they are."""
    odd, path = ["", None, 'a"\\\n\t\x00\x7f\u2028é😀'], str(tmp_path / "x.sarif.zst")
    rows = [(f"r{k}{x}", x, f"p{y}", k, x, y, [] if x is None else [(y, k, x)], None if y is None else [(k, x), (k + 1, y)], y) for k, (x, y) in enumerate((x, y) for x in odd for y in odd)]
    kinds = f"{KINDS}, message string, related array<struct<path:string,line:int,message:string>>, steps array<struct<line:int,text:string>>, fix string"
    formats.write_sarif(spark.createDataFrame(rows, kinds).coalesce(1), path)
    got = [json.loads(r.value.rstrip(",")) for r in spark.read.format("sarif").load(path).collect()]
    at = lambda p, n, m=None: {"physicalLocation": {"artifactLocation": {"uri": p}, "region": {"startLine": n + 1}}} | ({"message": {"text": m}} if m else {})
    assert len(got) == len(rows)
    for r, (rule, _, p, n, _, message, related, steps, fix) in zip(sorted(got, key=lambda r: r["locations"][0]["physicalLocation"]["region"]["startLine"]), rows):
        assert r["ruleId"] == rule and r["message"] == {"text": message or rule} and r["locations"] == [at(p, n)] and r["level"] == "warning"
        assert r.get("relatedLocations", []) == [{"id": 0} | at(*x) for x in related]
        assert ("codeFlows" in r) == (steps is not None) and (steps is None or r["codeFlows"][0]["threadFlows"][0]["locations"] == [{"location": at(p, *x)} for x in steps])
        assert ("fixes" in r) == (fix is not None) and (fix is None or r["fixes"][0]["artifactChanges"][0]["replacements"][0]["insertedContent"] == {"text": fix})
    with pytest.raises(Exception, match="findings without severity"):
        formats.write_sarif(spark.createDataFrame(rows, kinds).drop("severity"), path)


def test_packs_by_java(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("rules:\n- {id: one, patterns: ['\\p{Lu}+', '(?<n>a)\\k<n>', 'a++b', '(open', '(?P<py>x)']}\n- {id: two, pattern: 'x'}\n")
    (tmp_path / "b.yaml").write_text("rules: [")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.yaml").write_text("rules:\n- {id: two, patterns: ['later']}\n")
    rules, errors = rule_packs.read_rule_packs(spark, str(tmp_path))
    assert sorted((r.rule_id, r.pattern_idx, r.pattern) for r in rules.collect()) == [("one", 0, r"\p{Lu}+"), ("one", 1, r"(?<n>a)\k<n>"), ("one", 2, "a++b"), ("two", 0, "later")]
    told = {(r.file, r.rule_id, r.pattern) for r in errors.collect()}
    assert told == {("a.yaml", "one", "(open"), ("a.yaml", "one", "(?P<py>x)"), ("b.yaml", "", "")}
    formats.register(spark)
    assert spark.read.format("rulepack").load(str(tmp_path)).rdd.getNumPartitions() == 3
    (tmp_path / "none").mkdir()
    assert spark.read.format("rulepack").load(str(tmp_path / "none")).count() == 0


def test_packs_stay_off_the_driver(spark, data, tmp_path, monkeypatch):
    """Rules are parted by tasks, and a larger table is more files of packs, not larger ones."""
    from pyspark.sql.classic.dataframe import DataFrame

    from rampart.plans.more import packs_read

    n = 20_001
    spark.range(n).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    with monkeypatch.context() as m:
        for name in ("collect", "toPandas", "toArrow", "toLocalIterator"):
            m.setattr(DataFrame, name, lambda *a, **b: pytest.fail("rows came to the driver"))
        told = packs_read(spark, str(tmp_path))
    got = {(r.file, r.state): r["count"] for r in told.groupBy("file", "state").count().collect()}
    states = ["used", "used", "flags inside the pattern", "not compiled"]
    want = {}
    for k in range(n):
        want[k % 3, states[k % 4]] = want.get((k % 3, states[k % 4]), 0) + 1
    assert got == want


DIFF = """diff --git a/x b/x
--- a/x
+++ b/x.py
@@ -0,0 +1,3 @@
+one
+++ b/not a header
 three
@@ -9 +12 @@ ctx
-old
+new
--- a/gone
+++ /dev/null
@@ -1,2 +0,0 @@
-a
-b
diff --git a/y b/y
+++ b/y.js\t2026
@@ -1,3 +1,2 @@
 k
-l
\\ No newline at end of file
+m
"""


def test_diffs(spark, tmp_path):
    (tmp_path / "1.diff").write_text(DIFF)
    (tmp_path / "2.patch").write_text("")
    formats.register(spark)
    got = sorted(tuple(r) for r in spark.read.format("unidiff").load(str(tmp_path)).collect())
    assert got == [("1.diff", "x.py", 1, True, "one"), ("1.diff", "x.py", 2, True, "++ b/not a header"), ("1.diff", "x.py", 3, False, "three"), ("1.diff", "x.py", 12, True, "new"), ("1.diff", "y.js", 1, False, "k"), ("1.diff", "y.js", 2, True, "m")]
