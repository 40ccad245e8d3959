"""Conversations without an id are formatted like all others."""

from conftest import SF_SMALL
from oracle_check import duck
from pyspark.sql import functions as F

from docsift.llm import chat_trees, oracles, queries


def test_messages_without_a_tree_id(spark):
    rows = [
        (None, 1, None, "user", "q", 1.0),
        (None, 2, 1, "assistant", "a", 1.0),
        (0, 1, None, "user", "zero", 1.0),
        (-(2**63), 1, None, "user", "least", 1.0),
    ]
    df = spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")
    for kind in ("long", "string"):
        out = chat_trees.format_branches(df.withColumn("tree_id", F.col("tree_id").cast(kind)))
        texts = chat_trees.read_turns(F.col("formatted"))["text"]
        got = {r.tree_id and int(r.tree_id) if r.tree_id != "0" else 0: r.t for r in out.select("tree_id", texts.alias("t")).collect()}
        assert got == {None: ["q", "a"], 0: ["zero"], -(2**63): ["least"]}


def test_query_matches_its_oracle_with_null_ids(spark, tmp_path):
    given = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    lost = F.when(F.col("conv_id") != given.agg(F.min("conv_id")).first()[0], F.col("conv_id"))
    given.withColumn("conv_id", lost).write.parquet(f"{tmp_path}/rows")
    sf_dir = str(tmp_path)
    spark.read.parquet(f"{tmp_path}/rows").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op2_chat_reply_trees(spark, sf_dir)
    con = duck("/nowhere")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    columns = ", ".join(got.columns)
    expect = set(con.execute(f"SELECT {columns} FROM ({oracles.CHAT})").fetchall())
    assert None in {r[0] for r in expect}
    assert {tuple(r) for r in got.collect()} == expect
