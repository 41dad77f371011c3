import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from cases import documents, frame
from quern.llm import packing


@pytest.mark.parametrize("window", [64, 4096])
def test_every_id_once_and_little_padding(spark, window):
    from tokenizers import Tokenizer

    rows = [*documents(), (None, "al1"), (5, "It's a <|endoftext|> x"), (5, "It's a <|endoftext|> x")]
    coder = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(frame(spark, rows), packing.default_tokenizer(), 2, window).collect()
    want = collections.Counter((i, tuple([*coder.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"] > 0
            at += r["length"]
        assert at == window or at & (at - 1) == 0
    for (i, n), pieces in by_doc.items():
        texts = [t for (j, t), c in want.items() for _ in range(c) if j == i and len(t) == n]
        assert sum(r["length"] for r in pieces) == n * len(texts)
        if len(texts) == 1:
            ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(pieces, key=lambda r: r["start"])])
            assert tuple(ids.tolist()) == texts[0]
    assert sum(r["length"] for r in got) == sum(len(t) * c for (_, t), c in want.items())


def test_level_rule_and_bound(monkeypatch):
    p = packing.Packer(10, 0)
    p.add(1, np.arange(6))
    p.add(2, np.arange(4))
    assert p.count == 0 and len(p.done) == 2
    monkeypatch.setattr(packing, "MAX_OPEN", 4)
    for i in range(50):
        p.add(i, np.arange(6))
    assert p.count <= 4
    p.finish()
    assert p.count == 0 and sum(len(d[2]) for d in p.done) == 10 + 300


def test_whole_texts_as_the_tokenizer_has_them():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    coder, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer())
    rnd = random.Random(2)
    texts = [None, "", " ", "Don't, stop. THE the, ÉTÉ. été, a,. ,", "<|startoftext|>x<|endoftext|>."]
    texts += ["".join(rnd.choice(["a", "Bc", "'s", ",", ".", " ", "\n", "É", " ", "́", "ﬁ", "中", "7", "😀", "Σ"]) for _ in range(40)) for _ in range(300)]
    ids, at = own.encode(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*coder.encode(t or "", add_special_tokens=False).ids, 2]


def test_empty_table(spark):
    assert packing.pack_documents(frame(spark, []), packing.default_tokenizer(), 2).count() == 0


def test_ids_are_the_tokenizers_own_on_marks_and_capitals():
    """Letters that lower-case to a letter and a mark, marks after white space, special tokens, and ends of words of all kinds."""
    rnd = random.Random(1)
    parts = [*"abzIİıßΣςé.,'-’ \n\t\x0b０9中ﬁǅ<|>", "é", "́,", "<|endoftext|>", "'s", "İ,", "TATİLİ,", "İKİNCİ.", "BELGESİ,", "é,", " ", " "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 30))) for _ in range(4000)]
    coder = packing.WordTokenizer(packing.default_tokenizer())
    ids, begin = coder.encode(pa.array(texts), 2)
    for i, text in enumerate(texts):
        assert ids[begin[i] : begin[i + 1]].tolist() == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 2], text


def test_a_tokenizer_that_joins_words_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="not those of its words"):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
