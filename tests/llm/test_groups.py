"""Near duplicates, classifiers and the pipeline: against brute force, held-out accuracy and planted cases."""

import random

import numpy as np
import pytest

import corpus_pipeline
from choicegrid.llm import embedding_dedup, jaccard_join, packing, quality, toxicity
from choicegrid.llm.common import table
from choicegrid.llm.components import components

SF = "/root/testdata/sf0.01"


def closed(n, edges):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    wanted = closed(500, edges)
    assert found == {x: wanted[x] for x in {y for e in edges if e[0] != e[1] for y in e}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 9)):
                rows.append((i, [float(x) for x in (centre + rng.normal(size=16) * 0.12) * rng.uniform(0.1, 9)], label))
                i += 1
    rows += [(i, None, 0), (i + 1, [0.0] * 16, 0), (i + 2, [float("nan")] + [1.0] * 15, 0), (i + 3, rows[0][1], 0), (i + 4, rows[0][1], 1), (i + 5, [None] + [1.0] * 15, 0), (i + 6, [1.0, 2.0], 0), (i + 7, [2.0, 4.0], 0), (i + 8, [], 0)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int").repartition(3)
    found = {r.vec_id: r for r in embedding_dedup.deduplicate(frame).collect()}

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or any(x is None or not np.isfinite(x) for x in (*a, *b)) or not any(a) or not any(b):
            return -1.0
        a, b = np.array(a), np.array(b)
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    edges = [(p, q) for p in range(len(rows)) for q in range(p) if rows[p][2] is not None and rows[p][2] == rows[q][2] and cosine(rows[p][1], rows[q][1]) >= 0.93]
    wanted = closed(len(rows), edges)
    for k in range(len(rows)):
        assert found[k].n_links == sum(k in e for e in edges)
        assert found[k].component_id == wanted[k] and found[k].kept == (wanted[k] == k)
    assert embedding_dedup.deduplicate(frame.where("false")).count() == 0


@pytest.mark.parametrize(("kind", "a", "b"), [("long", 5_000_000_000, 6), ("string", "cat", "dog"), ("double", 0.5, 1.5)])
def test_vectors_with_labels_of_any_type_and_ids_that_repeat(spark, kind, a, b):
    one, two = [1.0, 0.0, 0.1], [1.0, 0.01, 0.1]
    rows = [(1, one, a), (1, two, a), (2, two, b), (3, one, None), (None, one, a), (None, [0.0, 1.0, 0.0], b), (4, [0.0] * 3, a)]
    found = embedding_dedup.deduplicate(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in found) == [(-1, 0, -1), (-1, 2, 1), (1, 2, 1), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4)]


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (embedding_dedup.names(v, embedding_dedup.TABLES, embedding_dedup.PROBES) for v in (a, b))
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.999


def near_texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([4, 30, 120, 400]))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    base = rng.choices(words, k=80)
    for _ in range(60):  # one large group
        copy = list(base)
        copy[rng.randrange(80)] = rng.choice(words)
        out.append(" ".join(copy))
    return [*out, None, "", "  ", out[0].upper(), out[3], out[3], "x", "x y"]


@pytest.fixture(scope="module")
def near(spark):
    made = near_texts()
    return made, spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(made)] + [(None, made[3], "s", 1)], "doc_id long, text string, class_id string, n_chars long").repartition(3)


def brute(made):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for t in made]
    return [(p, q) for p in range(len(made)) for q in range(p) if len(sets[p] & sets[q]) / len(sets[p] | sets[q]) >= 0.8]


@pytest.mark.parametrize("blocks", [(2048, 250_000), (16, 600)])
def test_jaccard_join(spark, near, monkeypatch, blocks):
    made, frame = near
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(jaccard_join, "BLOCK_WORDS", blocks[1])
    edges = brute(made)
    wanted = closed(len(made), edges)
    rows = jaccard_join.similar(frame).collect()
    assert len(rows) == len(made) + 1
    for r in rows:
        if r.doc_id is None:
            assert r.class_id is None and r.n_links == 0
        else:
            assert r.class_id == wanted[r.doc_id] and r.n_links == sum(r.doc_id in e for e in edges), r


def test_one_of_each_class_stays(spark, near):
    made, frame = near
    kept = jaccard_join.keep_one(frame)
    assert kept.columns == frame.columns
    wanted = closed(len(made), brute(made))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([-1, *set(wanted)])
    assert jaccard_join.similar(frame.where("false")).count() == 0


def test_a_chain_of_texts_alike_to_the_next_only(spark):
    n = 5000
    texts = [(i, " ".join(f"w{k}" for k in range(4 * i, 4 * i + 60))) for i in range(n)]  # 52 of 60 n-grams shared with the next, 48 of 64 with the one after
    found = jaccard_join.similar(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(found) == n and {r.class_id for r in found} == {0}
    assert all(r.n_links == (1 if r.doc_id in (0, n - 1) else 2) for r in found)


def test_documents_with_several_texts_and_very_long_ones(spark):
    long = " ".join(f"w{i % 7919}x{i % 613}" for i in range(60_000))
    rows = [(1, long), (2, long.replace("w5x5 ", "other ")), (3, "a b c d e f"), (3, "g h i j k l"), (4, "a b c d e f"), (5, "g h i j k l"), (6, "nothing like it")]
    found = jaccard_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == [(1, 1, 1), (2, 1, 1), (3, 3, 1), (3, 3, 1), (4, 3, 1), (5, 3, 1), (6, 6, 0)]


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.999):
        bands, rows = jaccard_join.bands_and_rows(0.8, recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= 128


@pytest.fixture(scope="module")
def chars(spark):
    return toxicity.char_model(spark.createDataFrame([("you are a stupid idiot and a pathetic loser the other thing is here with them",)] * 20 + [(None,), ("",)], "text string"))


@pytest.mark.parametrize(("spelling", "wanted"), [("1d10t", "idiot"), ("$tup1d", "stupid"), ("stuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("p4th3tic", "pathetic"), ("l0ser", "loser"), ("other", "other")])
def test_viterbi(chars, spelling, wanted):
    assert toxicity.decode(spelling, chars) == wanted


@pytest.mark.parametrize("spaced", [False, True])
def test_decoding_equals_the_best_of_all_paths(chars, spaced):
    rng = random.Random(14)

    def paths(arcs, at=0, a="", b="", score=0.0, said=""):
        if at == len(arcs):
            yield score + chars.log(a, b, " "), said
            return
        for x, cost in arcs[at]:
            if not x:
                yield from paths(arcs, at + 1, a, b, score + cost, said)
                continue
            yield from paths(arcs, at + 1, b, x, score + cost + chars.log(a, b, x), said + x)
            if spaced and b:
                yield from paths(arcs, at + 1, " ", x, score + cost + chars.log(a, b, " ") + chars.log(b, " ", x) + toxicity.DROP_MARK, f"{said} {x}")

    seen = 0
    while seen < 300:
        spelling = "".join(rng.choice(rng.choice(["iidosttuup1!$*.-é ", "iidosttuupé", "ids,."]) if not spaced else "idost1!$.é") for _ in range(rng.randint(1, 6)))
        every = list(paths(toxicity.lattice(spelling)))
        score, said = toxicity.best_path(spelling, chars, spaced)
        best = max(v for v, _ in every)
        assert abs(score - best) < 1e-9 and said in {w for v, w in every if v > best - 1e-9}, spelling
        assert toxicity.decode(spelling, chars, spaced) in {w for v, w in every if v > best - 1e-9}, spelling
        if not spaced and spelling[-1] in toxicity.MARKS:
            assert toxicity.decode(spelling.rstrip(toxicity.MARKS), chars) in {w for v, w in every if v > best - 1e-9}, spelling
        seen += len(every) > 1


def test_a_word_in_two_pieces_is_evidence(chars):
    import pyarrow as pa

    model = toxicity.Model(chars, pa.array(["=idiot", "=another"], pa.large_string()), np.array([3.0, 2.0]), None, 0.1)
    shown = model.evidence(pa.array(["an id iot", "you are idiot", "the id here", "id", "iot", None, "i d"]))
    assert shown[:, 0].tolist() == [3.0, 3.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    words, codes, _ = toxicity.restore(pa.array(["i d"]), chars)
    assert words[int(codes[0])].as_py() == "id" or "id" in [words[int(c)].as_py() for c in codes]


def test_spacing_of_every_kind_is_read(chars):
    import pyarrow as pa

    model = toxicity.Model(chars, pa.array(["=idiot", "=stupid", "=pathetic"], pa.large_string()), np.array([3.0, 2.0, 1.0]), None, 0.1)
    said = {"s  t  u  p  i  d": 2.0, "s\t t \n u p i d": 2.0, "s - t - u - p - i - d": 2.0, "you i d i o t a b": 3.0, "a b i d i o t a b you": 3.0, "x p a t h e t i c": 1.0, "id i ot": 3.0, "i di  o t": 3.0, "$ t u p ! d": 2.0,
            "1d107": 3.0, "id i other": 0.0, "i d i": 0.0, "s t u p i": 0.0, "4041894974608795 1234": 0.0}
    shown = model.evidence(pa.array([f"the {x} here" for x in said]))
    assert dict(zip(said, shown[:, 0].tolist(), strict=True)) == said
    # pieces of two texts don't meet
    assert model.evidence(pa.array(["the id", "iot here", "i d i", "o t"]))[:, 0].tolist() == [0.0] * 4


def test_weights_and_evidence_by_plain_counts(spark):
    """Features, weights and evidence of a small table without disguise, counted by plain loops."""
    import math
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(8)
    rows = []
    for i in range(240):
        toxic = i % 3 == 0
        words = [rng.choice(["alpha", "bravo", "charlie", "delta", "echo"]) for _ in range(rng.randint(2, 6))] + ([rng.choice(["vilest", "grim", "nasty"])] if toxic or i % 40 == 1 else [])
        rows.append((i, f"{' '.join(words)} number{chr(97 + i // 26)}{chr(97 + i % 26)}", int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, keep_held_out=True, least_docs=3, least_weight=1.0)
    features = lambda text: {f for w in text.split(" ") for f in ["=" + w, *(w[:k] for k in (3, 4, 5, 6) if len(w) > k)]}
    counts = {t: Counter(f for _, text, label in rows if label == t for f in features(text)) for t in (0, 1)}
    base = sum(t for *_, t in rows) / len(rows)
    weigh = lambda f: math.log((counts[1][f] + base) / (counts[0][f] + 1 - base)) - math.log(base / (1 - base))
    wanted = {f: weigh(f) for f in counts[1] if counts[1][f] >= 3 and weigh(f) > 1.0}
    found = dict(zip(model.names.to_pylist(), model.weights.tolist(), strict=True))
    assert found == pytest.approx(wanted) and {"=vilest", "=grim", "=nasty"} <= set(found)
    shown = model.evidence(pa.array([text for _, text, _ in rows]))
    for (_, text, _), two in zip(rows, shown.tolist(), strict=True):
        best = sorted((found[f] for f in features(text) if f in found), reverse=True)[:2]
        assert two == pytest.approx(best + [0.0] * (2 - len(best)))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    p = model.calibration.proba(shown)
    assert [scores[i] for i, *_ in rows] == pytest.approx(p.tolist())


def test_toxicity_of_very_long_texts_ties_and_clashing_columns(spark):
    filler = " ".join(f"word{i % 97}" for i in range(300_000))
    rows = [(i, f"a kind thing number {i}" if i % 2 else f"a vile thing number {i}", 1, 1.0) for i in range(60)]
    rows += [(100, f"{filler} v1le {filler}", 1, 1.0), (101, filler, 1, 1.0), (7, "a kind thing number 7", 1, 1.0), (7, "a kind thing number 7", 1, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(i, None, (i + 1) % 2, "x") for i in range(60)], "doc_id long, quality int, toxic int, text string")
    out = [(r.doc_id, r.predicted, r.score) for r in toxicity.toxicity(docs, labels).collect()]
    assert len(out) == len(rows)
    said = {i: p for i, p, _ in out}
    assert said[100] == 1 and said[101] == 0 and said[8] == 1
    assert len({s for i, _, s in out if i == 7}) == 1
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, labels, keep_held_out=True))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*range(1, 60, 2), 101}


def test_restore_reads_spaced_words(chars):
    import pyarrow as pa

    words, codes, ends = toxicity.restore(pa.array(["the i d i o t here", None, "", "4041894974608795 1234", "A the&&&"]), chars)
    said = [[words[c].as_py() for c in codes[a:b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert "idiot" in said[0] and said[0][-1] == "here"
    assert len(said[3]) == 2 and said[4] == ["a", "the"]


def test_digits_alone_are_decoded(spark):
    import pyarrow as pa

    corpus = spark.createDataFrame([("what a lot he was, the gate is at the sea",)] * 20, "text string")
    chars = toxicity.char_model(corpus)
    words, codes, _ = toxicity.restore(pa.array(["107 7h3"]), chars)
    assert [words[c].as_py() for c in codes] == ["lot", "the"]
    for spelling in ("107", "455", "1234", "900", "4041"):
        assert toxicity.decode(spelling, chars) == toxicity.best_path(spelling, chars)[1]


def test_every_choice_of_a_lattice_is_read(spark):
    import pyarrow as pa

    plain = "you are a stupid idiot and a moron in the trash of the élan with идиот there"
    chars = toxicity.char_model(spark.createDataFrame([(plain,)] * 20, "text string"))
    said = {"iddiot": "idiot", "stuupid": "stupid", "идииот": "идиот", "iidiot": "idiot", "mmoron": "moron", "trrash": "trash", "éélan": "élan", "идиоот": "идиот", "idio+": "idiot", "+rash": "trash", "stupid!": "stupid"}
    words, codes, _ = toxicity.restore(pa.array([" ".join(said)]), chars)
    assert [words[c].as_py() for c in codes] == list(said.values())
    words, codes, _ = toxicity.restore(pa.array(["i d ! o t"]), chars)
    assert "idiot" in [words[c].as_py() for c in codes]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((out.score >= 0.5) == (out.predicted == 1)).all() and out.score.between(0, 1).all()
    assert (out.predicted == out.toxic).mean() > 0.9
    assert out[out.toxic == 0].predicted.mean() < 0.05


def test_rare_toxic_words_of_a_large_table(spark):
    word = lambda k: "".join("aeioubcdfg"[int(d)] for d in f"{k:03d}")
    rows = [(i, f"the {word(i % 1000)} zonk here" if i % 300 == 0 else f"the {word(i % 1000)} vile here", 1) for i in range(3000)]
    rows += [(3000 + i, f"the {word(i % 1000)} kind there", 0) for i in range(3000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None, t) for i, _, t in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, keep_held_out=True)
    assert "=zonk" in model.names.to_pylist() and "=vile" in model.names.to_pylist()


def test_toxicity_edge_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.0] * 4
    one = spark.createDataFrame([(1, None, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, one).count() == 4
    assert toxicity.toxicity(docs.where("false"), one).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    out = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (out.keep == (out.quality == 1)).mean() > 0.95


def test_quality_edge_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (2, None, None), (None, "", "s"), (1, "a b", "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.classify(docs, none).collect()] == [1.0] * 4
    kept = quality.keep(docs, quality.Model(1.0))
    assert kept.columns == docs.columns and kept.count() == 4
    assert quality.classify(docs.where("false"), none).count() == 0


def view_rows(y, rng):
    """Packed rows whose ratios and stated length both tell y."""
    rows = np.zeros(len(y), quality.PACKED)
    rows["ratios"], rows["size"] = y[:, None] * 2 + rng.normal(size=(len(y), quality.RATIOS)), y * 3 + rng.normal(size=len(y))
    return rows


def all_surest(uid, rows):
    """What quality.surest does, by sorting everything."""

    def ask(fitted, given, most):
        offers = []
        for k, x in enumerate(quality.unpack(rows)):
            p, picks = fitted[k].proba(x), []
            for label in (0, 1):
                sure = p if label else 1 - p
                order = [i for i in np.lexsort((uid, -sure)) if sure[i] >= quality.SURE and uid[i] not in given[k]][: most[label]]
                picks.append(np.array(order, int))
            at = np.concatenate(picks)
            offers.append((uid[at], np.repeat([0, 1], [len(x) for x in picks]), rows[at]))
        return offers

    return ask


def test_co_training_takes_the_surest_of_all_rows(spark):
    rng = np.random.default_rng(4)
    y = (rng.random(900) < 0.5).astype(int)
    rows = view_rows(y, rng)
    pool = spark.createDataFrame([(i, bytearray(rows[i].tobytes())) for i in range(80, 600)], "uid long, x binary").repartition(7)
    asked = quality.surest(pool)
    seen = []

    def ask(fitted, given, most):
        seen.append((given, asked(fitted, given, most)))
        return seen[-1][1]

    model = quality.co_train(rows[:80], y[:80], ask)
    brute = quality.co_train(rows[:80], y[:80], all_surest(np.arange(80, 600), rows[80:600]))
    views = quality.unpack(rows[600:])
    assert np.allclose(model.score(*views), brute.score(*views))
    assert ((model.score(*views) >= 0.5) == y[600:]).mean() > 0.95
    for given, offers in seen:
        for k in (0, 1):
            assert not set(given[k]) & set(offers[k][0])
    assert len(seen) == quality.ROUNDS and all(len(o[0]) for _, offers in seen for o in offers)


def test_pseudo_labels_never_go_to_labelled_or_held_out_rows(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    packed = quality.packed_views(docs)
    known = {r.doc_id for r in labels.where("quality is not null").collect()}
    pool = {r.doc_id for r in quality.unlabelled(packed, labels).collect()}
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    import zlib

    assert pool == {i for i in every - known if zlib.crc32(str(i).encode()) % 5}
    assert {r.doc_id for r in quality.unlabelled(packed, labels, keep_held_out=True).collect()} == every - known


def test_quality_learns_from_few_rows_and_reads_long_texts(spark):
    rows = [(i, "good calm words in a line" if i % 2 else "$$$ ### 0101 $$$", "s", "x", 9, i) for i in range(40)]
    rows += [(50, "good calm words in a line " * 60_000, "s", "x", 9, 1), (51, "$$$ ### 0101 $$$ " * 60_000, None, None, None, 1), (7, *rows[7][1:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, score long")
    labels = spark.createDataFrame([(i, i % 2, None, "x") for i in range(6)], "doc_id long, quality int, toxic int, text string")
    out = sorted((r.doc_id, r.keep, r.score) for r in quality.classify(docs, labels).collect())
    assert len(out) == len(rows) and all(keep == (i % 2 == 1) for i, keep, _ in out if i < 50)
    assert len({s for i, _, s in out if i == 7}) == 1
    said = {i: keep for i, keep, _ in out}
    assert said[50]


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in seen.select("doc_id").collect()}
        seen = stage(spark, seen, SF).cache()
        assert seen.columns == docs.columns, name
        gone = before - {r.doc_id for r in seen.select("doc_id").collect()}
        known = [labels[i] for i in gone if i in labels]
        if name == "quality classifier":
            assert np.mean([r.quality == 0 for r in known]) > 0.95
        if name == "toxicity":
            assert np.mean([r.toxic == 1 for r in known]) > 0.9
    rows = sorted((r.doc_id, r.text) for r in seen.collect())
    links = brute([t for _, t in rows])
    assert not links
    records = packing.pack(seen).collect()
    assert {r.doc_id for r in records} == {i for i, _ in rows}
    assert len(corpus_pipeline.STAGES) == 4


def odd_documents(spark, tmp_path, rows):
    """A folder of tables with nulls, repeats, ties, empty and long texts, and columns whose names the stages use themselves."""
    kind = "doc_id long, text string, lang string, source string, n_chars int, key string, score double, label int, uid long, name string, node long, copies int"
    spark.createDataFrame([(*r, "k", 0.5, 1, 7, "n", 3, 2) for r in rows], kind).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 4 != 0, i % 4 == 1) for i in range(60)] + [(None, 1, 0), (3, None, None), (5, 1, 1)]
    spark.createDataFrame([(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_pipeline_of_odd_documents(spark, tmp_path):
    body = lambda i: " ".join(f"w{(i * 31 + k) % 997}" for k in range(40))
    rows = [(i, f"{'junk $$$ ' * 9 if i % 4 == 0 else 'vile ' if i % 4 == 1 else ''}{body(i)}", "en", "s", 200) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "s", 0), (62, body(2), "en", "s", 200), (None, body(70), "en", "s", 200), (None, body(70), "en", "s", 200)]
    rows += [(63, body(71), None, "s", 200), (63, body(71), None, "s", 200), (64, body(80) + " and more" * 100_000, "en", "s", 900_000)]
    sf = odd_documents(spark, tmp_path, rows)
    seen = table(spark, sf, "documents")
    columns, kept = seen.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, sf).cache()
        assert seen.columns == columns, name
        kept.append({r.doc_id for r in seen.select("doc_id").collect()})
    assert not kept[0] & set(range(0, 60, 4)) and set(range(2, 60, 4)) <= kept[0]
    assert not kept[1] & set(range(1, 60, 4)) and set(range(2, 60, 4)) <= kept[1]
    assert {2, 63, None} <= kept[2] and not {62} & kept[2]
    assert seen.where("doc_id = 63").count() == 1 and seen.where("doc_id is null").count() == 2
    records = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in records} == kept[2]
    by_sequence = {}
    for r in records:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_pipeline_of_an_empty_table(spark, tmp_path):
    sf = odd_documents(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_intermediate_tables_can_be_released(spark):
    from choicegrid.llm import common

    common.release(spark)
    frame = common.materialize(spark.range(5).toDF("x"))
    assert frame.count() == 5 and common.release(spark) == 1 and common.release(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist"):
        frame.count()


def test_hot_rows_meet_their_key_by_broadcast(spark, monkeypatch):
    from choicegrid.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(k, i) for k in range(6) for i in range(1 if k else 50)]
    keyed = [(k, f"v{k}", 1 if k else 50) for k in range(6)]
    found = common.join_hot(spark.createDataFrame(rows, "k int, i int"), spark.createDataFrame(keyed, "k int, v string, n int"), "k", "n", len(rows))
    assert sorted(tuple(r) for r in found.select("k", "i", "v").collect()) == sorted((k, i, f"v{k}") for k, i in rows)
