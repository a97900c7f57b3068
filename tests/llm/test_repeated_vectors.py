"""Repeated rows and query rows against the query's own SQL."""

import duckdb

from rampart.llm.topk_search import ORACLE_OP6, op6_topk_search


def test_repeated_rows_count(spark, tmp_path):
    rows = [(i, [float(i % 7), float(i % 5) / 4]) for i in [*range(1, 12), 3, 3, 6, 6, 100, 100, 200]] + [(200, [-1.0, 0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = op6_topk_search(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ORACLE_OP6).fetchall())
