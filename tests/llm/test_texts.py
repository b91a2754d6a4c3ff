"""Packing, BPE, fingerprints, language, chat: against brute force and exact round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from choicegrid.llm import binary_output, bpe, chat, fingerprints, language_id, packing
from choicegrid.llm.tokens import encode_texts, library, vocabulary

PIECES = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "1", "'s", "!", "<|endoftext|>", " ", "　", "日本", "😀", "The", " the", ".", "\r\n", "²", "_"]


def texts(n=300, seed=1):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [*made, None, "", " ", "x" * 5000, "the cat " * 3000, "same text", "same text"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"clash{i}", i, "k") for i, t in enumerate(texts())]
    rows += [(5, "a doc_id again", "c", 1, "k"), (None, "no id", "c", 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, start long, score string").repartition(3)


def encoded(text):
    return library(None).encode(text or "", add_special_tokens=False).ids


def test_encoding_equals_the_library():
    made = texts(3000, 2) + ["b a\n", "\nx y", "b c\n\n", "  x", "c\t", "\t\t", "q a\n", "\n\nq r "]
    random.Random(1).shuffle(made)
    made = [t or "" for t in made]
    ids, begins = encode_texts(vocabulary(None), pa.array(made))
    assert all(ids[begins[i] : begins[i + 1]].tolist() == encoded(t) for i, t in enumerate(made))


def test_packing(spark, docs):
    rows = packing.pack(docs, sequence=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    wanted = defaultdict(int)
    crc = defaultdict(list)
    for d in docs.collect():
        ids = [*encoded(d.text), 1]
        wanted[(d.doc_id, len(ids))] += len(ids)
        crc[d.doc_id].append(np.array(ids, "<u4"))
    assert {k: sum(r.length for r in v) for k, v in by_doc.items()} == wanted
    for r in rows:
        assert any(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in crc[r.doc_id])
    full = sorted(by_sequence)
    assert full == list(range(len(full)))
    for s, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == full[-1]
    assert packing.pack(docs.where("false")).count() == 0


def test_sequences_hold_the_ids(spark, docs):
    records = packing.pieces(packing.encode_documents(docs), 64, with_ids=True)
    found = packing.sequences(records).collect()
    assert sum(len(r.ids) for r in found) == sum(len(encoded(d.text)) + 1 for d in docs.collect())
    assert all(len(r.ids) == sum(r.lengths) for r in found)


def test_matrices(spark, docs):
    rows = binary_output.pack_matrices(docs, sequence=64).collect()
    seen = defaultdict(dict)
    for r in rows:
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(places) == 64 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert places[a:b].tolist() == list(range(b - a))
            seen[doc].setdefault(start, []).append(ids[a:b].tolist())
    pieces, wanted = defaultdict(int), defaultdict(int)  # repeated doc_ids and null ones too: the ids of all pieces, one by one
    for r in rows:
        ids = np.frombuffer(r.input_ids, "<u2")
        for k, doc in enumerate(r.doc_ids):
            for x in ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist():
                pieces[doc, x] += 1
    for d in docs.collect():
        for x in [*encoded(d.text), 1]:
            wanted[d.doc_id, x] += 1
    assert pieces == wanted
    for d in docs.collect():
        if d.doc_id not in (5, None):
            assert sum((seen[d.doc_id][s][0] for s in sorted(seen[d.doc_id])), []) == [*encoded(d.text), 1]
    assert binary_output.pack_matrices(docs.where("false")).count() == 0


def test_best_fit_is_the_tightest_row():
    rng = random.Random(3)
    lengths = [rng.randint(1, 150) for _ in range(400)]
    rows = binary_output.best_fit_decreasing(lengths, 64)
    assert sum(n for row in rows for _, _, n in row) == sum(lengths) and all(sum(n for _, _, n in row) <= 64 for row in rows)
    free = []
    for rest in sorted((n % 64 for n in lengths if n % 64), reverse=True):
        fit = min((f for f in free if f >= rest), default=None)
        if fit is None:
            free.append(64 - rest)
        else:
            free.remove(fit)
            free.append(fit - rest)
    assert len(rows) == sum(n // 64 for n in lengths) + len(free)


def test_bpe(spark, docs):
    found = bpe.decode(bpe.encode(docs, buckets=7)).collect()
    key = lambda i: -1 if i is None else i
    assert sorted((key(r.doc_id), list(r.ids)) for r in found) == sorted((key(d.doc_id), encoded(d.text)) for d in docs.collect())
    assert sorted((key(r.doc_id), r.decoded) for r in found) == sorted((key(d.doc_id), d.text or "") for d in docs.collect())
    row = bpe.digests(docs.where("doc_id = 4")).first()
    ids = encoded(docs.where("doc_id = 4").first().text)
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and row.n_tokens == len(ids)
    assert bpe.encode(docs.where("false")).count() == 0


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark):
    rng = random.Random(4)
    made = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 9)) for _ in range(rng.choice([3, 40, 400]))) for _ in range(60)]
    made += [made[0], None, "", "one"]
    rows = [(2 * i, t, "c") for i, t in enumerate(made)] + [(None, "no id at all", "c")]
    out = fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string, rng string")).collect()
    order = sorted(rows[:-1], key=lambda r: -r[0]) + rows[-1:]
    found = {r.doc_id: r for r in out}
    gaps = []
    for k, (doc, text, _) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        r = found[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b = shingles(text), shingles(changed)
        gaps.append(r.near_edited - (len(a & b) / len(a | b) if a | b else 1.0))
        assert 0 <= r.near_next <= 1
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.06
    assert found[0].fingerprint == found[2 * 60].fingerprint
    alone = fingerprints.compare_edited(spark.createDataFrame([(1, "a b c")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"a b a").hexdigest() and alone.near_next == 1.0
    assert fingerprints.compare_edited(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_bounds_above(spark, n):
    rng = random.Random(n)
    bounds = sorted(rng.sample(range(-100, 100), n))
    rows = spark.createDataFrame([(x,) for x in range(-110, 110)], "x long").select("x", fingerprints.bounds_above(F.col("x"), bounds).alias("n")).collect()
    assert all(r.n == sum(b > r.x for b in bounds) for r in rows)


def test_an_id_of_a_third_of_all_rows(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    rows = [(i, " ".join(word() for _ in range(6))) for i in range(150)] + [(77, " ".join(word() for _ in range(6))) for _ in range(200)]
    rows += [(None, " ".join(word() for _ in range(6))) for _ in range(150)] + [(77, "the same text"), (77, "the same text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.text))
    wanted = defaultdict(int)
    for k, r in enumerate(order):
        third = len(r.text) // 3
        changed = r.text[: len(r.text) - third] + order[(k + 1) % len(order)].text[:third]
        wanted[r.doc_id, hashlib.sha256(changed.encode()).hexdigest()] += 1
    found = defaultdict(int)
    for r in fingerprints.compare_edited(df).collect():
        found[r.doc_id, r.edited_sha256] += 1
    assert found == wanted
    sizes = [r["count"] for r in fingerprints.with_next(df).groupBy("rng").count().collect()]
    assert max(sizes) < 120 and len(sizes) > 8


def test_likeness_is_unbiased(spark):
    rows = []
    rng = random.Random(9)
    for i in range(200):
        common = [f"w{rng.random()}" for _ in range(150)]
        rows.append((i, " ".join(common + [f"x{rng.random()}" for _ in range(75)]), " ".join(common + [f"y{rng.random()}" for _ in range(75)])))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    got = df.select(fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))).alias("j")).toPandas().j
    a, b = shingles(rows[0][1]), shingles(rows[0][2])
    assert abs(got.mean() - len(a & b) / len(a | b)) < 0.01


def test_language(spark):
    rng = random.Random(6)
    words = {"en": ["the", "with", "thing", "ought"], "de": ["der", "schön", "nicht", "über"], "fr": ["été", "dans", "leçon", "eau"]}
    rows = [(i, " ".join(rng.choices(words[g], k=30)), g) for i, g in enumerate(rng.choices(sorted(words), k=300))]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (1003, "the with thing", None)]
    out = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, _, g in rows[:300]:
        assert out[i].lang_pred == g and 0 <= out[i].score <= 1
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [out[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "en"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.identify(empty).count() == 0


def naive_bayes(train, text):
    """(language, posterior) by plain counting."""
    counts, total, n = defaultdict(lambda: defaultdict(int)), defaultdict(int), defaultdict(int)

    def grams(t):
        codes = np.array([0, 0, *(ord(c) if c.isalpha() else 0 for c in t.lower()), 0, 0], np.int64)
        for order in language_id.ORDERS:
            yield from ((order, b) for b in (language_id.buckets(codes, order)[2:] - (order - 1) * language_id.BUCKETS).tolist() if b)

    for t, g in train:
        n[g] += 1
        for gram in grams(t):
            counts[g][gram] += 1
            total[g, gram[0]] += 1
    joint = {g: np.log(n[g] / len(train)) + sum(np.log((counts[g][x] + 0.5) / (total[g, x[0]] + 0.5 * (language_id.BUCKETS - 1))) for x in grams(text)) for g in sorted(n)}
    best = max(joint, key=joint.get)
    return best, 1 / sum(np.exp(v - joint[best]) for v in joint.values())


@pytest.mark.parametrize("block", [128, 2])
def test_naive_bayes_by_hand(spark, block):
    rng = random.Random(12)
    train = [("".join(rng.choices("abcdeé жя", k=12)), g) for g in rng.choices("vwxyz", k=60)]
    asked = ["ab", "жя ea", "éd cc a", "AB", "b\n!a"]
    made = spark.createDataFrame(train, "text string, lang string")
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in enumerate(asked)] + [(0, "ab", "clash", 1.0)], "doc_id long, text string, lang_pred string, score double")
    found = sorted((r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, made, block).collect())
    assert found[0] == found[1]
    for i, lang, score in found:
        best, posterior = naive_bayes(train, asked[i])
        assert lang == best and abs(score - posterior) < 1e-4


def test_language_of_long_texts(spark, monkeypatch):
    train = spark.createDataFrame([("the with thing ought", "en"), ("der schön nicht über", "de")], "text string, lang string")
    model = language_id.fit(train)
    texts = pa.array(["der schön " * 40 + "the ", None, "", "x", "nicht " * 30])
    whole = model.sums(texts)
    monkeypatch.setattr(language_id, "PIECE", 17)
    monkeypatch.setattr(language_id, "GATHERED", 10)
    cut = model.sums(texts)
    assert np.allclose(whole[0], cut[0], rtol=1e-6) and (whole[1] == cut[1]).all() and whole[1].tolist() == [True, False, False, True, True]


def test_a_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} </s>[INST] " + "word " * (20_000 if t == 7 else 3)) for t in range(20_000)]
    row = chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))).first()
    said = "".join(r[3] for r in rows if r[2] == "assistant")
    assert row.n_turns == 20_000 and row.loss_chars == len(said) and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(8)
    pieces = [*chat.CONTROL, "\\", "<\\s>", "[\\INST]", "[\\\\INST]", " ", "a", "]", "[", "\n", " [/INST]", " [/OUT]</s>", "é"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", "a]b\\"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8)))) for c in range(40) for t in range(rng.randint(1, 5))]
    rows += [(99, 0, "assistant", None), (99, 1, None, "x"), (None, 0, "user", "no conversation"), (98, 0, "user", "twice"), (98, 0, "user", "twice")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t, role or "", text or ""))
    assert set(out) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert out[c].formatted_chars == sum(len(chat.render_turn(r, x)) for _, r, x in turns)
    assert chat.read_back(chat.format_turns(frame.where("false"))).count() == 0
