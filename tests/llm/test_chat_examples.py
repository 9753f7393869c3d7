"""The digest of the chat query comes from the examples."""

from panelcheck.llm import chat


def test_read_back_takes_masks_and_lengths_from_the_examples(spark, monkeypatch):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "first </s>"), (1, 2, "user", "and"), (1, 3, "assistant", "second")]
    stream = chat.expand(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    made = {r["place"]: r["n_chars"] for r in chat.examples(stream).collect()}
    (whole,) = chat.read_back(stream).collect()
    assert (whole["loss_chars"], whole["formatted_chars"]) == (len("first </s>second"), sum(made.values()))
    every = chat.examples
    monkeypatch.setattr(chat, "examples", lambda s: every(s).filter("place > 1"))
    (last,) = chat.read_back(stream).collect()
    assert (last["loss_chars"], last["formatted_chars"]) == (len("second"), made[3])
