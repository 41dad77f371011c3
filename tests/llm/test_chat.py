from quern.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, t string"


def test_merging_escaping_and_reading_back(spark):
    rows = [
        (1, 2, "assistant", "b", ""), (1, 1, "user", chat.FORGED, ""), (1, 3, "assistant", "<\\|x <|", ""), (1, 4, "tool", None, ""),
        (2, 1, None, "x", ""), (2, 1, None, "x", ""), (2, None, "u%<\nv", "y", ""), (None, 1, "user", "", ""), (3, 1, "assistant", "😀é", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    made = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in made.select("conv_id", "blocks", "formatted", chat.read_turns(made.formatted).alias("turns"), chat.loss_spans(made.formatted).alias("spans")).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", chat.FORGED), ("assistant", "b"), ("assistant", "<\\|x <|"), ("tool", "")]
    assert [(b["role"], list(b["texts"])) for b in got[1]["blocks"]] == [("user", [chat.FORGED]), ("assistant", ["b", "<\\|x <|"]), ("tool", [""])]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("u%<\nv", "y"), ("", "x"), ("", "x")]
    assert [(t["role"], t["text"]) for t in got[None]["turns"]] == [("user", "")]
    assert got[1]["formatted"].count("<|im_start|>") == 3 and chat.FORGED not in got[1]["formatted"]
    spans = [got[1]["formatted"][s["start"] : s["start"] + s["length"]] for s in got[1]["spans"]]
    assert spans == ["b", "<\\\\|x <\\|"]
    s = got[3]["spans"][0]
    assert got[3]["formatted"][s["start"] : s["start"] + s["length"]] == "😀é"


def test_long_conversation_and_empty_table(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}", "") for i in range(3000)]
    made = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    assert made.select(chat.read_turns(made.formatted).alias("t")).selectExpr("size(t)").first()[0] == 3000
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
