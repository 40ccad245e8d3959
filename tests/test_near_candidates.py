"""near_candidates gives every pair inside the length ratio and band."""

import duckdb


def tables(spark, at, docs):
    """documents and labels of (doc_id, text, source)."""
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long") \
        .coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_pairs_that_share_no_chunk(spark, tmp_path):
    import __spark_entry__ as E

    # 14, 28: no capture noise; one pair of equal length with no character in common, one 3 longer, one out of band
    at = tables(spark, tmp_path, [(14, "a" * 300, "src17"), (28, "b" * 300, "src2"), (42, "c" * 303, "src3"), (56, "d" * 400, "src4")])
    got = {(r.n_len, r.c_len, r.k) for r in E.queries()["near_candidates"](spark, at).collect()}
    assert got == {(300, 300, 17), (300, 303, 17)}
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    assert {r[2:] for r in con.sql(E.oracle_sql()["near_candidates"]).fetchall()} == got


def test_texts_are_hashed_once(spark, tmp_path):
    import __spark_entry__ as E

    at = tables(spark, tmp_path, [(14, "a" * 300, "src17"), (28, "b" * 300, "src2")])
    df = E.queries()["near_candidates"](spark, at)
    # before: normalised and hashed again for the index, its use as an anti-join and the filters of both sides
    assert "sha2(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.n_len, r.c_len, r.k) for r in df.collect()] == [(300, 300, 17)]
