import random
import re

import pytest
from pyspark.sql import functions as F

from choicegrid.functions import logits as lg
from choicegrid.functions import text as tx
from choicegrid.functions.scalars import canonical_code, finite, strip


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_span_places(spark):
    assert [tuple(p) for p in one(spark, "é: <<up>>; <<o\nk>>!", tx.span_places)] == [(5, 7), (13, 16)]
    assert one(spark, "no marks", tx.span_places) == []
    assert one(spark, "<<>> <<open", tx.choices) == [""]
    assert one(spark, "<<a\nb>>", tx.choices) == ["a\nb"]


def test_segments(spark):
    text = "Card game.\nFour decks.\n \t\nRound 1: take <<deck 2>>, win 3\nyou see <<red>> <<blue>>\nbreak\nRound 2: <<deck\n"
    df = spark.createDataFrame([(text,)], "t string").select(tx.header(F.col("t")).alias("h"), tx.segments(F.col("t")).alias("s"), tx.tail(F.col("t")).alias("e")).first()
    assert df.h == "Card game.\nFour decks.\n \t\n"
    assert df.s == ["Round 1: take <<deck 2>>, win 3\n", "you see <<red>> <<blue>>\n", "break\nRound 2: <<deck\n"]
    assert df.e == ""


def test_segments_are_lossless(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "<<", ">>", "\n", " ", "\t", "é", "x"]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.header(F.col("t")).alias("h"), tx.segments(F.col("t")).alias("s"), tx.tail(F.col("t")).alias("e")).collect()
    for r in rows:
        if "<<" not in r.t:
            assert r.s is None
            continue
        assert r.h + "".join(r.s) + r.e == r.t
        first = r.t.index("<<")
        blanks = [m.end() for m in re.finditer(r"\n(?:[ \t]*\n)+", r.t[:first])]
        assert len(r.h) == (blanks[-1] if blanks else 0)
        assert all("<<" in s and "<<" not in s[: s.rindex("\n", 0, len(s) - 1) + 1 if "\n" in s[:-1] else 0] for s in r.s)


@pytest.mark.parametrize(("n", "wanted"), [(100, [0, 1, 10, 50, 99]), (6, [0, 1, 2, 3, 5]), (3, [0, 1, 2])])
def test_anchor_targets(spark, n, wanted):
    assert one(spark, n, tx.anchor_targets, "int") == wanted


@pytest.mark.parametrize(("n", "points", "wanted"), [(3, 10, [0, 1, 2]), (9, 1, [8]), (9, 3, [0, 4, 8])])
def test_even_targets(spark, n, points, wanted):
    assert one(spark, n, lambda c: tx.even_targets(c, points), "int") == wanted


def test_codes_and_strip(spark):
    assert [one(spark, v, canonical_code) for v in ("1.0", "-1", "nan", "", " b ", "1.5")] == ["1", None, None, None, "b", "1.5"]
    assert one(spark, "  a　", strip) == "a"
    with pytest.raises(Exception, match="finite"):
        one(spark, float("nan"), lambda c: finite(c, "nll"), "double")


def test_logits(spark):
    lp = one(spark, [0.0] * 4, lg.log_softmax, "array<double>")
    assert all(abs(x + 1.3862943611198906) < 1e-12 for x in lp)
    assert one(spark, [1.0, 3.0, 3.0], lg.argmax, "array<double>") == 1
    assert [t.token_id for t in one(spark, [1.0, 3.0, 3.0], lambda c: lg.top_k(c, 2), "array<double>")] == [1, 2]
    assert one(spark, [1, 1, 1], lambda c: lg.option_status(c, 2), "array<int>") == "too_many_options"
    assert one(spark, [1, 2], lambda c: lg.option_status(c, 2), "array<int>") == "multi_token_option"
