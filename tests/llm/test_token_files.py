"""The token files' stripes, row indexes, Bloom filters and encodings, and that reads skip by them."""

import glob

import pyarrow.orc

from rampart.llm import token_files
from rampart.llm.bpe_automaton import vocabulary
from rampart.sources.stored import stored_path


def test_files_hold_indexes_and_reads_skip(spark):
    path = stored_path(spark, "orc-test")
    docs = spark.range(0, 40_000, 2).selectExpr("id as doc_id", "concat('word', id % 91, ' of ', id) as text")
    token_files.write_tokens(docs, vocabulary("word_bpe_49k.json"), path)
    found = sorted(glob.glob(path.removeprefix("file://") + "/*.orc"))
    rows = 0
    for at in found:
        held = pyarrow.orc.ORCFile(at)
        assert held.row_index_stride == 1000 and held.nstripes >= 1
        rows += held.nrows
        jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path("file://" + at), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        for stripe in reader.getStripes():
            footer = reader.rows().readStripeFooter(stripe)
            kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
            assert (1, "BLOOM_FILTER_UTF8") in kinds and (1, "ROW_INDEX") in kinds
            assert {footer.getColumns(k).getKind().toString() for k in (1, 2, 3, 4, 6)} == {"DIRECT_V2"}  # integers, run-length encoded
    assert rows == 20_000
    for wanted, most in (("doc_id = 20002", 2000), ("doc_id = 20003", 0)):  # an absent id within the range: only a Bloom filter can tell
        df = token_files.read_tokens(spark, path).where(wanted)
        assert df.count() == (1 if most else 0)
        df.collect()
        scans = df._jdf.queryExecution().executedPlan().collectLeaves()
        read = scans.apply(0).metrics().apply("numOutputRows").value()
        assert read <= most, (wanted, read)


def test_more_parts_than_one_stay_in_order(spark):
    path = stored_path(spark, "orc-order")
    docs = spark.range(3000).selectExpr("2999 - id as doc_id", "repeat(concat(id, ' '), cast(id % 5 as int)) as text")
    token_files.write_tokens(docs, vocabulary("word_bpe_49k.json"), path)
    rows = sorted(token_files.token_index(spark, path).collect(), key=lambda r: r.doc_id)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert len(rows) == 3000
