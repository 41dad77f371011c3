import random

from pyspark.sql import functions as F

from cases import frame
from quern.llm import brown


def test_words_outside_the_top_take_part_in_exchange(spark, monkeypatch):
    """Frequent words fill the TOP; words of two kinds follow one another, all about equally frequent."""
    monkeypatch.setattr(brown, "TOP", 6)
    rnd = random.Random(3)
    kind = [[f"{c}{i}" for i in range(12)] for c in ("noun", "verb")]
    def text(order):
        return " ".join(x for _ in range(20) for x in (rnd.choice(["the", "on", "of"]), rnd.choice(kind[order[0]]), rnd.choice(kind[order[1]])))
    rows = [(4 * i + 1, text((0, 1))) for i in range(150)] + [(4, text((0, 1))), (8, text((1, 0)))]
    got = {r["doc_id"]: r for r in brown.score_documents(frame(spark, rows), F.col("doc_id") % 4 == 0).filter("held_out").collect()}
    right, wrong = ((got[i]["score"] - got[i]["base_score"]) for i in (4, 8))
    assert right > wrong + 20
