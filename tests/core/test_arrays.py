"""Array functions: against plain loops, and in time that grows with the arrays' length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from choicegrid.functions import logits as lg
from choicegrid.functions import supervision as sv
from choicegrid.functions import text as tx
from choicegrid.functions.scalars import canonical_code, is_numeric, short_name, table_folder


def test_tokens_and_labels_equal_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        at, tokens = 0, []
        for _ in range(rng.randint(0, 12)):
            size = rng.choice([0, 1, 3])
            tokens.append((at, at + size))
            at += size + rng.choice([0, 0, 1])
        spans, p = [], 0
        for _ in range(rng.randint(0, 4)):
            a = p + rng.randint(0, 5)
            spans.append((a, a + rng.randint(0, 4)))
            p = spans[-1][1] + 1
        rows.append((i, list(range(100, 100 + len(tokens))), tokens, spans))
    rows.append((60, None, None, None))
    pair = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, ids array<int>, tokens {pair}, spans {pair}").repartition(3)
    out = df.select("i", sv.tokens_of_spans(F.col("tokens"), F.col("spans")).alias("p"), "ids").select("i", "p", sv.supervised_labels(F.col("ids"), F.col("p")).alias("l")).collect()
    assert len(out) == 61
    for r in out:
        _, ids, tokens, spans = rows[r.i]
        wanted = [[k for k, (a, b) in enumerate(tokens or []) if b > a and a < e and b > s] for s, e in spans or []]
        assert r.p == wanted, rows[r.i]
        assert r.l == [x if any(k in w for w in wanted) else sv.IGNORE for k, x in enumerate(ids or [])]


def seconds(frame):
    began = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


@pytest.mark.parametrize("kind", ["logits", "labels", "places"])
def test_time_grows_with_the_length(spark, kind):
    def made(n):
        base = spark.range(40)
        if kind == "logits":
            return base.select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (i * F.col("id") % 17).cast("double")).alias("x")).select(lg.top_k(lg.log_softmax(F.col("x")), 5))
        if kind == "labels":
            ids = F.sequence(F.lit(1), F.lit(n))
            tokens = F.transform(ids, lambda i: F.struct((i * 3).alias("start"), (i * 3 + 3).alias("end")))
            spans = F.transform(F.sequence(F.lit(1), F.lit(n // 8)), lambda i: F.struct((i * 24).alias("start"), (i * 24 + 4).alias("end")))
            return base.select(ids.alias("ids"), tokens.alias("t"), spans.alias("s"), "id").select(sv.supervised_labels(F.col("ids"), sv.tokens_of_spans(F.col("t"), F.col("s"))))
        return base.select(F.repeat(F.lit("A <<left>> then "), n).alias("t")).select(tx.span_places(F.col("t")))

    seconds(made(64))
    short, long = min(seconds(made(64)) for _ in range(3)), min(seconds(made(1024)) for _ in range(2))
    assert long < 16 * short + 2, (short, long)


def test_numbers_as_they_are_written(spark):
    values = ["1d", "2F", "3d", "1e20", "1_0", "0x1", "1e400", "٣", " 7.0\t", "+5", "-0.0", ".5", "5.", "inf"]
    out = [r.c for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(canonical_code(F.col("v")).alias("c")).collect()]
    assert out[:6] == ["1d", "2F", "3d", "100000000000000000000", "10", "0x1"] and out[8:10] == ["7", "5"] and out[10] == "0" and out[11:13] == [".5", "5"]
    said = [r.n for r in spark.createDataFrame([("3d",), ("1e3",), ("nan",), ("x",), ("",)], "v string").select(is_numeric(F.col("v")).alias("n")).collect()]
    assert said == [False, True, True, False, False]


def test_records_are_ascii_and_keep_text(spark):
    row = spark.createDataFrame([("é😀", "NaN", float("nan"), None)], "a string, b string, c double, d int").select(sv.marked_record(["a", "b"], ["c", "d"]).alias("t")).first()
    assert row.t == 'trial={"a":"\\u00e9\\ud83d\\ude00","b":"NaN"}\ntarget=<<{"c":null,"d":null}>>\n'


def test_names_of_experiments(spark):
    df = spark.createDataFrame([("fam/exp1.csv",), ("new/exp2/x.csv",), ("alone",)], "e string")
    got = df.select(table_folder(F.col("e"), {"old": "new"}).alias("f"), short_name(F.col("e")).alias("s")).collect()
    assert [tuple(r) for r in got] == [("fam/exp1", "fam e1"), ("old/exp2/x", "new e2/x"), ("alone/", "alone")]
