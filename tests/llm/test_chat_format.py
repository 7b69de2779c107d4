from tidemill.llm import chat_format as op


def test_collapse_and_render(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (3, 2, "user", "more"),
        (4, 0, "user", "h"), (4, 1, None, ""), (5, 0, "user", "h"), (5, 1, "", None),
        (6, 0, "user", "hi"), (6, 0, "user", "hi"),
        (None, 0, "user", "lost"),
        (7, None, "user", "x" * 200_000),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, kept int")
    got = {r.conv_id: (r.n_turns, r.rendered) for r in op.chat_format(df).collect()}
    assert set(got) == {2, 4, 5, 6, None, 7}
    assert got[2] == (3, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n")
    assert got[6][0] == 2
    assert op.chat_format(df.limit(0)).count() == 0
