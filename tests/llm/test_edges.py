"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from rampart.llm import bpe_automaton, chat_format, html_extract, mixing, quality_classifier, quality_rules, sharding, simhash, token_files, topk_search
from rampart.sources.stored import stored_path

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, key string, size string, cut string, _doc int, quality string, shard int, fp string, ids string, _text string"
PROSE = " ".join(f"word{i % 37} of thing{i % 11}" for i in range(60))


def table(spark, *rows):
    return spark.createDataFrame([(*r, "en", 1, "k", "s", "c", 1, "q", 2, "f", "i", "t") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    return table(spark, (1, PROSE, "a"), (1, PROSE, "a"), (2, PROSE, "a"), (3, None, "a"), (4, "", "b"), (None, PROSE + " x", None), (5, " \n\t ", "b"), (6, long, "b"), (7, "é🎉 ß x", "c"), (8, "one", "c"), (None, None, None), (9, "x" * 50_000, "c"))


@pytest.fixture(scope="module")
def none(spark):
    return table(spark)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (2, 0, 0), (6, 1, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        sizes.setdefault(r.source, 0)
        sizes[r.source] += r["size"]
    assert all(r.source_size == sizes[r.source] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    twins = [r.taken for r in got if r.doc_id == 1]
    assert twins[0] == twins[1]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixing_targets(spark):
    told = spark.createDataFrame([("a", 100), ("b", 100), ("c", 10), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(told, (3, 1, 2), 1.5, 2).collect()}
    assert got["c"] == 20 and got[None] == 0 and got["a"] == 200 and abs(got["b"] - 95) < 1e-9
    all_full = {r.source: r.target for r in mixing.targets(told, (3, 1, 2), 3.0, 2).collect()}
    assert all_full == {"a": 200, "b": 200, "c": 20, None: 0}


def test_sharding(spark, docs, none):
    got = sharding.assign_shards(docs, 5).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r["size"] == len(PROSE) + 8}) == 1
    assert sharding.assign_shards(none).count() == 0


def test_a_group_above_a_fair_share_stays_whole(spark):
    told = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 400, "same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = sharding.assign_shards(told, 6).collect()
    big = {r.shard for r in got if r.doc_id < 400}
    assert len(big) == 1
    bytes_of = Counter()
    for r in got:
        bytes_of[r.shard] += r["size"]
    rest = [b for k, b in bytes_of.items() if k not in big]
    assert len(rest) == 5 and max(rest) - min(rest) <= 16 and bytes_of[big.pop()] == 400 * 17
    for k in bytes_of:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_differencing():
    ways = sharding.differencing([8, 7, 6, 5, 4], 2)
    assert abs(sum(s * (1 if w else -1) for s, w in zip([8, 7, 6, 5, 4], ways, strict=True))) == 2  # as the method is known to give
    assert sharding.differencing([], 3) == [] and sharding.differencing([5], 3) in ([0], [1], [2]) and sharding.differencing([5, 6], 1) == [0, 0]


@pytest.mark.parametrize("page", [None, "", "<", "<p>", "<!--", "<script>x", "<a href='", "&lt;b&gt;", "<p>" * 3000 + "x", "<div>" * 3000 + "deep", "</p></div>x"])
def test_odd_pages(page):
    assert isinstance(html_extract.main_text(page), str)


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (None, "u", "<article><p>Hi &amp; bye.</p></article>", 2), (2, "u", "<article><p>Hi &amp; bye.</p></article>", 3)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html_extract.extract(pages).collect()) == ["", "Hi & bye.", "Hi & bye."]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_classifier(docs, none, labels):
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert len(got) == docs.count() and not any(r.kept for r in got if r.log_ratio is None)
    assert quality_classifier.quality_classifier(docs, labels.limit(0)).where("kept").count() > 0
    assert quality_classifier.quality_classifier(none, labels).count() == 0
    assert quality_classifier.keep_by_classifier(docs, labels).columns == docs.columns


def test_rules(docs, none, labels):
    got = quality_rules.quality_rules(docs, labels).select("doc.doc_id", "quality.*").collect()
    assert len(got) == docs.count()
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (3, 4, 5, 8))
    assert next(r.n_words for r in got if r.doc_id == 6) == 60_000
    assert quality_rules.quality_rules(docs, labels.limit(0)).where("quality.kept").count() == sum(not r.base_failed for r in got)
    assert quality_rules.keep_by_rules(none, labels).count() == 0
    assert quality_rules.keep_by_rules(docs, labels).columns == docs.columns


def test_chats(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, None, "assistant", "[INST]"), (2, 5, "tool<<TEXT>>", "</s>"), (2, 4, "system", "é\n")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(turns)).collect()}
    assert got[1].n_turns == 3 and got[None].loss_chars == 6 and got[2].n_turns == 2 and got[2].loss_chars == 0
    assert chat_format.read_back(chat_format.format_conversations(turns.limit(0))).count() == 0


def test_search(spark):
    rows = [(100, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0]), (3, []), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (None, [1.0, 1.0]), (200, [1e30, -1e30]), (8, [3e30, 1.0]), (9, [1.0, 0.5])]
    told = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.top_k(told, F.col("vec_id") % 100 == 0).collect()
    mine = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 100]
    assert mine[-4:] == [(1, 1310720), (9, 1310720), (2, 1048576), (3, 0)] or mine[1:5] == [(1, 1310720), (9, 1310720), (2, 1048576), (3, 0)]
    assert [r["rank"] for r in sorted(got, key=lambda r: (r.query_id, r["rank"])) if r.query_id == 100] == list(range(1, len(mine) + 1))
    assert topk_search.top_k(told.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_tokens(spark, docs, none):
    path = stored_path(spark, "test")
    token_files.write_tokens(docs, bpe_automaton.vocabulary("word_bpe_49k.json"), path)
    got = sorted(token_files.token_index(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == docs.count() and got[0].start == 0
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    ids = [r.doc_id for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert token_files.read_tokens(spark, path).where("doc_id = 6").count() == 1
    path = stored_path(spark, "test")
    token_files.write_tokens(none, bpe_automaton.vocabulary("word_bpe_49k.json"), path)
    assert token_files.token_index(spark, path).count() == 0


def test_encoding(docs, none):
    got = bpe_automaton.encode_decode(docs, bpe_automaton.vocabulary("byte_bpe_50k.json"))
    told = {r.doc_id: r for r in got.collect()}
    assert told[3].ids == [] and told[4].decoded == "" and told[7].decoded == "é🎉 ß x"
    assert bpe_automaton.encode_decode(none, bpe_automaton.vocabulary("byte_bpe_50k.json")).count() == 0


def test_near_duplicates(docs, none):
    told, classes = simhash.near_duplicates(docs)
    got = {}
    for r in told.join(classes, "fp").collect():
        got.setdefault(r.doc_id, set()).add((r.fp, r.keeper.doc_id))
    assert {k for _, k in got[3] | got[4] | got[5]} == {3} and {f for f, _ in got[3]} == {0}
    assert {k for _, k in got[1] | got[2]} == {1}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 2 not in ids and 1 in ids
    assert simhash.one_of_each(none).count() == 0


def test_pipeline_stages(spark, docs, none, data):
    """Every stage on odd rows and on none: its columns stay, and just what its docstring says goes."""
    import corpus_pipeline as p

    for at, (_, stage) in enumerate(p.STAGES):
        got, empty = stage(spark, docs, data), stage(spark, none, data)
        assert empty.count() == 0
        if at < len(p.STAGES) - 1:
            assert got.columns == docs.columns == empty.columns and got.schema == docs.schema
        rows = [r.doc_id for r in got.collect()]
        if at == 0:
            assert set(rows) <= {1, 2, 6, None} and rows.count(1) in (0, 2)
        if at == 2:  # one row of 1, 1 and 2, whose texts are equal (None's is similar), and one of all without words
            assert sorted(x for x in rows if x is not None) == [1, 3, 6, 7, 8, 9] and None not in rows
        if at == 4:
            assert len(rows) == docs.count()


def test_long_turns_and_clashing_columns(spark):
    long = "[INST] </s> \\" * 40_000
    told = spark.createDataFrame([(1, 0, "user", long, 1, "x"), (1, 1, "assistant", long, 2, "y"), (None, 0, None, None, 3, "z")], "conv_id long, turn long, role string, text string, formatted int, loss_start string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(told)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == len(long) and got[None].n_turns == 1
    assert chat_format.read_back(chat_format.format_conversations(told.limit(0))).count() == 0
    vectors = spark.createDataFrame([(k, [float(k), 1.0], 1, 2, "b") for k in range(4)], "vec_id long, embedding array<double>, rank int, score int, block string")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.top_k(vectors, F.col("vec_id") == 0, 2).orderBy("rank").collect()] == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 1024 * 1024)]


def test_long_pages():
    said = "This sentence of the article is long enough to count as prose, and it says something that no menu says."
    page = "<article>" + "".join(f"<div><p>{k} {said}</p></div>" for k in range(5000)) + "</article><footer>Copyright</footer>"
    got = html_extract.main_text(page).split("\n")
    assert len(got) == 5000 and got[-1] == f"4999 {said}"
    assert html_extract.main_text("<div>" * 60_000 + said + "</div>" * 60_000) in ("", said)
