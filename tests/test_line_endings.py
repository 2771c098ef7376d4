"""Lines that end in a carriage return and a line feed."""

from wirelane.plans import catalog


def test_carriage_returns(spark, tmp_path):
    texts = ["one\r\nthree\n\r\n", "plain\nlines", "", "a lone \r one", None, "ends\r"]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.lines, r.longest) for r in catalog.lines_not_line_ending(spark, str(tmp_path)).collect()}
    assert got == {0: (4, 5), 1: (2, 5), 2: (1, 0), 3: (None, None), 5: (None, None)}
