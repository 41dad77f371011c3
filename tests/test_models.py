"""Token counters, embedders and model identities that need no model, and an encoder small enough to write by hand."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import embed, match, models, score

MESSAGES = "array<struct<role:string,content:string>>"


def chat(spark):
    rows = [(0, "c0", [("user", "hi there!"), ("assistant", "the answer")]), (1, "c1", [("user", "q")])]
    return spark.createDataFrame(rows, f"ord long, id string, messages {MESSAGES}")


def test_python_counters_in_the_length_scorer(spark):
    for counter in (X.exact_approx_tokens, X.PythonCounter(lambda: lambda t: len(t.split())), X.approx_tokens):
        got = {r["id"]: r["scores"] for r in score.score_rows(chat(spark), (score.length_scorer(counter),)).collect()}
        assert got["c0"]["length"] == 2.0 and got["c1"] == {"length": 0.0, "response_ratio": 0.0, "turns": 0.0}


def test_bpe_counter(spark):
    import base64

    import public_tokenizers
    import tiktoken

    def load():
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})

    texts = ["hello world", "<|endoftext|>", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["n"] for r in rows.select(X.bpe_counter(load)(F.col("text")).alias("n")).collect()]
    own = load()
    assert got == [None if t is None else len(own.encode(t, disallowed_special=())) for t in texts] and got[1] > 1
    counted = score.score_rows(chat(spark), (score.length_scorer(X.bpe_counter(load)),)).first()["scores"]["length"]
    assert counted == len(own.encode("the answer"))


def test_table_embedder(spark):
    rows = spark.createDataFrame([(0, "a", "x"), (1, "b", "y")], "ord long, id string, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, vector array<double>")
    assert [r["vector"] for r in embed.from_table(vectors)(rows).orderBy("ord").collect()] == [[1.0, 0.0], [0.0, 1.0]]
    with pytest.raises(Exception, match="no vector for b"):
        embed.from_table(vectors.filter("id = 'a'"))(rows).collect()


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _value(name, kind, dims):
    shape = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in dims)
    return _field(1, name) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))


def encoder(path, table, inputs=("input_ids", "attention_mask")):
    """A model that looks token vectors up, in ONNX's own encoding."""
    weights = b"".join(_field(1, d) for d in table.shape) + _field(2, 1) + _field(8, "table") + _field(9, table.astype("<f4").tobytes())
    node = _field(1, "table") + _field(1, "input_ids") + _field(2, "tokens") + _field(4, "Gather")
    graph = _field(1, node) + _field(2, "g") + _field(5, weights)
    graph += b"".join(_field(11, _value(n, 7, ("b", "t"))) for n in inputs) + _field(12, _value("tokens", 1, ("b", "t", table.shape[1])))
    path.write_bytes(_field(1, 8) + _field(8, _field(1, "") + _field(2, 13)) + _field(7, graph))
    return str(path)


def test_onnx_embedder(spark, tmp_path):
    """Vectors of texts of many lengths are the means of their tokens' vectors, whatever they are padded to."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    table = np.random.default_rng(0).normal(size=(49408, 4)).astype(np.float32)
    model = encoder(tmp_path / "m.onnx", table)
    texts = ["one two", "three", "four five six " * 40, "seven, eight.", ""] * 9
    rows = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "ord long, id string, text string").coalesce(1)
    got = {r["ord"]: r["vector"] for r in embed.onnx(model, tokenizer, 50)(rows).collect()}
    coder = Tokenizer.from_file(tokenizer)
    for i, t in enumerate(texts):
        ids = coder.encode(t).ids[:50]
        want = table[ids].astype(float).mean(axis=0) if ids else np.zeros(4)
        assert np.allclose(got[i], want, atol=1e-6)
    hits = match.embedding_matcher(embed.onnx(model, tokenizer), 0.999).hits(rows.filter("ord < 2"), rows.filter("ord < 2"))
    assert sorted((r["train_ord"], r["eval_ord"]) for r in hits.collect()) == [(0, 0), (1, 1)]
    with pytest.raises(Exception, match="unknown inputs"):
        embed.onnx(encoder(tmp_path / "n.onnx", table, ("input_ids", "positions")), tokenizer)(rows).collect()
    with pytest.raises(ValueError):
        embed.onnx(model, tokenizer, 0)


def test_identities(tmp_path):
    """A cache belongs to the files of a model, not to its name."""
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "config.json").write_text("{}")
    (folder / "notes.md").write_text("x")
    before = models.fingerprint(folder)
    (folder / "notes.md").write_text("y")
    assert models.fingerprint(folder) == before
    (folder / "config.json").write_text("{ }")
    assert models.fingerprint(folder) != before
    for missing in (models.bundled, lambda: models.transformers("name"), lambda: models.transformers(""), lambda: models.llama("/none")):
        with pytest.raises(ValueError):
            missing()
    assert models.fixed(1.0, 2.0).told()["model"] == "1.0/2.0"


def test_losses_and_spans():
    rows = np.log(np.array([[0.5, 0.25, 0.25], [0.1, 0.8, 0.1]]))
    assert abs(models.mean_loss(rows + 7, [1, 1]) + (np.log(0.25) + np.log(0.8)) / 2) < 1e-12
    with pytest.raises(ValueError):
        models.mean_loss(np.full((1, 2), np.nan), [0])
    assert models.spans([1], [2, 3], 3) == ([1], [2, 3])
    for head, tail, most in (([], [1], 9), ([1], [], 9), ([1, 2], [3], 2)):
        with pytest.raises(ValueError):
            models.spans(head, tail, most)
