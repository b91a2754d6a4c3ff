"""Fill-in-the-middle: units against plain splits, outputs against a plain rendering, exact round trips."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from choicegrid.llm import fill_middle

TEXTS = ["a😀b", "😀😀", "éx\n\ny", "ab  cd. Ef!? g", "日本 12ab", " a\x00b\r\n", "", None, "x", "has <P> in it", "<S", "a<", "M>b", "same", "same", "long 😀 text " * 20_000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7, t, "clash", 1) for i, t in enumerate(TEXTS * 3)] + [(7, "id again", "c", 1), (7, "id again", "c", 1), (None, "no id", "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)


def plain(doc_id, text, cut, seed=1):
    text = text or ""
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = cut(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < 20:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


CUTS = {"code_point": list, "line": lambda t: re.findall(r"[^\n]*\n+|[^\n]+", t), "word": lambda t: re.findall(r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", t), "sentence": lambda t: re.findall(r"[^.!?]*[.!?]+|[^.!?]+", t)}


@pytest.mark.parametrize("grammar", CUTS)
def test_forms(docs, grammar):
    made = fill_middle.transform(docs, grammar).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    wanted = [plain(r.doc_id, r.text, CUTS[grammar]) for r in docs.collect()]
    assert sorted(map(repr, (tuple(r[:6]) for r in made))) == sorted(map(repr, wanted))
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert sorted(r.back for r in made) == sorted(r.text or "" for r in docs.collect())


def test_units_join_to_the_text(docs):
    for grammar in fill_middle.GRAMMARS:
        rows = docs.select("text", fill_middle.units(F.col("text"), grammar).alias("u")).collect()
        assert all("".join(r.u) == (r.text or "") and all(r.u) for r in rows)
    one = docs.select(fill_middle.units(F.lit("ab  cd. 日本12😀😀"), "class")).first()[0]
    assert one == ["ab", "  ", "cd", ".", " ", "日本", "12", "😀😀"]


def test_digests_and_empty(spark, docs):
    for r in fill_middle.digests(docs.where("doc_id is not null and doc_id <> 7")).collect():
        text = TEXTS[r.doc_id // 7 % len(TEXTS)] or ""
        want = plain(r.doc_id, text, list)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.n, r.form, r.output_sha256, r.restored_sha256) == (want[1], want[2], sha(want[5]), sha(text))
    assert fill_middle.digests(docs.where("false")).count() == 0


def test_control_strings_that_run_into_each_other():
    for bad in (("<P>", "<S>", ""), ("aba", "<S>", "<M>"), ("<P>", "P>x", "<M>"), ("<<P>>", "<P>", "<M>"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.check_sentinels(bad)
    fill_middle.check_sentinels(("[P]", "[S]", "[M]"))
