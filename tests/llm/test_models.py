import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from colloquy.llm import pieces
from colloquy.llm.components import components
from colloquy.llm import decontaminate, toxicity as tox
from colloquy.llm.decontaminate import contaminated, lcs, search_task
from colloquy.llm.langid import identify, viterbi
from colloquy.llm.toxicity import toxicity
from colloquy.llm.words import Words, flat_texts, minimisers, mix

ODD = ["", "  a  b ", "héllo 漢字 ▁x\n\n\tab", "   ", "<s> </s> [INST]", "x" * 300 + " " + "ab" * 200, "日本語のテキスト" * 20, "\u0000é\U0001F600"]


@pytest.fixture(scope="module")
def model():
    return pieces.load_pieces(pieces.PIECES)


def test_without_dropout_equals_the_library(model, prose):
    import sentencepiece

    texts = [t for t in ODD if "▁" not in t] + [prose(80, i) for i in range(20)]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.PIECES)
    flat, at = pieces.encode_batch(*flat_texts(pa.array(texts)), np.arange(len(texts)), model, 1, 0.0)
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [sp.encode(t) for t in texts]


def slow_segment(model, symbols, salt, dropout):
    """One merge at a time, over spans."""
    spans = [(i, i + 1, s) for i, s in enumerate(symbols)]
    while True:
        best = None
        for n in range(len(spans) - 1):
            (b, m, x), (_, e, y) = spans[n], spans[n + 1]
            rank = pieces.find_merges(model, np.array([x]), np.array([y]))
            if rank[0] < pieces.NONE and not pieces.skipped(np.array([salt], np.uint64), np.array([b]), np.array([m]), np.array([e]), dropout)[0]:
                best = min(best or (1 << 40, 0, 0), (int(rank[0]), n, int(model["order"][rank[0]])))
        if best is None:
            return [s for _, _, s in spans]
        n = best[1]
        spans[n : n + 2] = [(spans[n][0], spans[n + 1][1], best[2])]


@pytest.mark.parametrize("dropout", [0.0, 0.3, 1.0])
def test_agenda_equals_slow_form(model, dropout):
    r = random.Random(4)
    chars = [int(model["chars"][ord(c)]) for c in "etaoinshr"]
    rows = [[model["space"]] + [r.choice(chars) for _ in range(r.randint(1, 10))] for _ in range(40)]
    salts = np.array([r.getrandbits(63) for _ in rows], np.uint64)
    table = np.full((40, 12), -1, np.int32)
    for i, row in enumerate(rows):
        table[i, : len(row)] = row
    keep, done = pieces.segment_side_by_side(model, table, np.array([len(x) for x in rows]), salts, dropout)
    for i, row in enumerate(rows):
        want = slow_segment(model, row, int(salts[i]), dropout)
        assert done[i][keep[i]].tolist() == want == pieces.segment_long(model, list(row), int(salts[i]), dropout)


def test_dropout_varies_and_decodes(spark, docs, prose):
    texts = [*ODD, None, prose(3000, 1), prose(3000, 1)]
    frame = docs(texts)
    got = {r.doc_id: r for r in pieces.encode_texts(frame, dropout=0.2).collect()}
    assert all(r.lossless for r in got.values()) and got[len(ODD)].pieces is None
    assert got[len(ODD) + 1].pieces != got[len(ODD) + 2].pieces
    assert [r.pieces for r in pieces.encode_texts(frame, dropout=0.2).orderBy("doc_id").collect()] == [got[i].pieces for i in range(len(texts))]
    back = {r.doc_id: r.text for r in pieces.decode_texts(pieces.encode_texts(frame, dropout=0.2)).collect()}
    assert back == dict(enumerate(texts))
    assert pieces.encode_texts(frame.limit(0)).count() == 0


def test_words_and_minimisers(prose):
    texts = ["a  b\tc", "", None, "été a", "b"]
    words = Words(pa.array(texts))
    assert words.counts.tolist() == [3, 0, 0, 2, 1]
    h = words.hashes
    assert h[0] == h[4] and h[1] == h[5] and len(set(h.tolist())) == 4
    assert Words(pa.array(texts).slice(3)).hashes.tolist() == h[3:].tolist()
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    want = {i for a in range(200 - 7 + 1) for i in range(a, a + 7) if x[i] == x[a : a + 7].min()}
    assert set(np.flatnonzero(minimisers(x, 7)).tolist()) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_viterbi_equals_brute_force():
    from itertools import product

    r = np.random.default_rng(2)
    sizes = [5, 1, 0, 3]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = r.normal(size=(9, 3)).astype(np.float32)
    path = viterbi(scores, first, 0.7)
    for a, b in zip(first[:-1], first[1:], strict=True):
        best = max(product(range(3), repeat=b - a), key=lambda p: sum(scores[a + i, x] for i, x in enumerate(p)) - 0.7 * sum(x != y for x, y in zip(p, p[1:], strict=False)), default=())
        assert tuple(path[a:b]) == best


def test_blocks_join_to_the_best_path(monkeypatch):
    from colloquy.llm import langid

    r = np.random.default_rng(5)
    sizes = [700, 1, 0, 3, 64, 65, 333]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = (r.normal(size=(int(first[-1]), 4)) * r.choice([0.2, 1.0, 3.0], size=(int(first[-1]), 1))).astype(np.float32)
    value = lambda path: sum(scores[i, path[i]] - (1.3 if i not in first and path[i] != path[i - 1] else 0.0) for i in range(len(path)))
    whole = viterbi(scores, first, 1.3)
    for steps, span in ((64, 100), (7, 50), (1, 10), (10_000, 1 << 18)):
        monkeypatch.setattr(langid, "STEPS", steps)
        monkeypatch.setattr(langid, "SPAN", span)
        asked = []
        path = viterbi(lambda a, b: asked.append(b - a) or scores[a:b], first, 1.3, 4)
        assert path.tolist() == whole.tolist() and abs(value(path) - value(whole)) < 1e-3
        assert max(asked) <= max(span + steps, 0) or steps > span


def test_a_text_of_four_million_words():
    import time

    from colloquy.llm.langid import count_grams, fit_languages, label_texts

    names, said = ["en", "fr"], ["the house and the river ", "la maison du fleuve "]
    parts = list(count_grams(pa.array(said), names))
    model = fit_languages(names, np.repeat([0, 1], [len(p[1]) for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
    text, begun = (said[0] * 1000 + said[1] * 1000) * 444, time.monotonic()
    lang, score, spans = label_texts(pa.array([text, said[1] * 2000], pa.large_string()), model, 8.0)
    assert time.monotonic() - begun < 120
    assert lang == ["en", "fr"] and len(spans[0]) == 888 and spans[0][:2] == [(0, 5000, "en"), (5000, 9000, "fr")]


def test_language_spans(spark):
    en, ru, fr = "the house and the river with all of them", "москва и река дом у воды", "la maison et le fleuve avec toutes les choses"
    train = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([(en, "en"), (ru, "ru"), (fr, "fr")] * 5)] + [(99, en, None)], "doc_id long, text string, lang string")
    texts = [en, ru, "the river and the house " + ru, None, "123 !!", "", fr]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as lang", "1 as score")
    got = {r.doc_id: r for r in identify(frame, train, penalty=2.0).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["en", "ru", "ru", "und", "und", "und", "fr"]
    assert [(s.begin, s.end, s.lang) for s in got[2].spans] == [(0, 5, "en"), (5, 11, "ru")]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in identify(frame, train.limit(0)).collect()} == {"und"} and identify(frame.limit(0), train).count() == 0


def test_toxicity_finds_planted_words(spark, prose):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        text = prose(r.randint(20, 80), i)
        if bad := r.random() < 0.15:
            words = text.split()
            words.insert(r.randrange(len(words)), r.choice(["Nastyword,", "vileword", "grimword!"]))
            text = " ".join(words)
        rows.append((i, text))
        if i % 2:
            labels.append((i, int(bad), i % 3))
    rows += [(1000, None), (1001, ""), (1002, "a vileword")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as score", "1 as toxic")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    got = {x.doc_id: x.score for x in toxicity(docs, docs.where("doc_id < 400"), marks).collect()}
    truth = {i: any(b in t.lower() for b in ("nastyword", "vileword", "grimword")) for i, t in rows[:600]}
    assert sum((got[i] >= 0.3) == truth[i] for i in range(400, 600)) >= 180
    assert got[1000] == got[1001] < 0.3 <= got[1002] and all(0 <= s <= 1 for s in got.values())
    assert {x.score for x in toxicity(docs, docs.limit(0), marks).collect()} == {0.0}
    assert toxicity(docs.limit(0), docs.limit(0), marks.limit(0)).count() == 0


def test_decontamination(spark, prose):
    assert lcs(np.array([1, 2, 3, 4]), np.array([2, 9, 4, 1])) == 2
    items = [(i, prose(12 + 4 * i, 700 + i)) for i in range(6)] + [(50, None), (51, "")]
    held = {i: t for i, t in items[:6]}
    para = held[4].split()
    para[3] = para[9] = "other"
    texts = [prose(100, i) for i in range(40)]
    planted = [(100 + i, prose(90, 40 + i) + "\n" + t.upper() + ". " + prose(150, 60 + i)) for i, t in held.items()] + [(200, prose(50, 90) + " " + " ".join(para) + " " + prose(60, 91)), (201, None), (202, ""), (203, held[5])]
    docs = spark.createDataFrame(list(enumerate(texts)) + planted, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as cosine")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as doc_id")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(100 + i, i) for i in held} | {(200, 4), (203, 5)}
    assert contaminated(docs.limit(0), bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


def test_a_copy_is_found_whatever_the_space_holds(prose):
    words = Words(pa.array([prose(24, 2000), prose(24, 2001)]))
    items = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    terms = np.unique(words.hashes)
    v, idf = len(terms), np.ones(len(np.unique(words.hashes)))
    held = SimpleNamespace(value=(terms, idf, np.ones(1), np.zeros((v, 2), np.float32), decontaminate.plain_scores(items, terms, idf), items, np.array([7, 8])))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": [prose(60, 1) + " " + prose(24, 2001) + " " + prose(60, 2), prose(100, 3)]})
    (got,) = search_task(held, 0.2, 0.6, 0.5)(iter([batch]))
    assert [(r["id"], r["item_id"]) for r in got.to_pylist()] == [(1, 8)]


def test_search_equals_brute_force(prose):
    """Every passage against every item, without pruning."""
    r = random.Random(9)
    texts, raw = [], [prose(r.randint(3, 60), 4000 + n) for n in range(30)] + ["a b a b a b c"]
    for n in range(120):
        item = raw[n % len(raw)].split()
        for _ in range(n % 9):
            item[r.randrange(len(item))] = "other%d" % r.randint(0, 9)
        if n % 4 == 0:
            item = item[: len(item) // 2] + prose(r.randint(1, 40), n).split() + item[len(item) // 2 :]
        texts.append(prose(r.randint(0, 60), 5000 + n) + " " + " ".join(item) + " " + prose(r.randint(0, 60), 6000 + n))
    words = Words(pa.array(raw), folded=True)
    items = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    terms = np.unique(words.hashes)
    random_state = np.random.default_rng(3)
    idf, rest = random_state.uniform(0.5, 5, len(terms)), random_state.uniform(0.5, 5, 64)
    latent = (random_state.normal(0, 0.05, (len(terms), len(items)))).astype(np.float32)
    plain = decontaminate.plain_scores(items, terms, idf)
    held = SimpleNamespace(value=(terms, idf, rest, latent, plain, items, np.arange(len(items))))
    (got,) = search_task(held, 0.2, 0.6, 0.5)(iter([pa.RecordBatch.from_pydict({"id": range(len(texts)), "text": texts})]))
    want = set()
    for t, text in enumerate(texts):
        own = Words(pa.array([text]), folded=True)
        h = own.hashes
        weight = rest[decontaminate.buckets(h, 64)]
        at = np.searchsorted(terms, h)
        there = terms[np.minimum(at, len(terms) - 1)] == h
        weight[there] = idf[at[there]]
        _, begin, end = decontaminate.passages(own)
        for b, e in zip(begin.tolist(), end.tolist(), strict=True):
            for n, item in enumerate(items):
                use = np.arange(b, e)[there[b:e]]
                score = max((weight[use] @ x[at[use], n]) / np.linalg.norm(weight[b:e]) for x in (latent, plain))
                around = h[max(0, b - len(item)) : e + len(item)]
                tail = item[-max(1, len(item) // 4) :]
                if score >= 0.2 and lcs(item, around) >= 0.6 * len(item) and lcs(tail, around) >= 0.5 * len(tail):
                    want.add((t, n))
    assert len(want) > 60 and {(r["id"], r["item_id"]) for r in got.to_pylist()} == want


def test_pair_sums_equal_the_matrix(prose):
    words = Words(pa.array([prose(90, 1), "", prose(20, 2), prose(33, 3)]))
    terms = np.unique(words.hashes)[::2]
    hit, term = decontaminate.find_terms(terms, decontaminate.term_table(terms), words.hashes)
    _, begin, end = decontaminate.passages(words)
    r = np.random.default_rng(4)
    weight, scale, slots = r.uniform(1, 2, len(terms)), r.uniform(1, 2, len(begin)), 8
    slot, sign, total = r.integers(0, slots, len(terms)), r.choice([-1.0, 1.0], len(terms)), np.zeros(len(terms) * slots)
    decontaminate.pair_sums(hit, term, weight[term], begin, end, scale, slot, sign, total)
    a, s = np.zeros((len(begin), len(terms))), np.zeros((len(terms), slots))
    for p, (b, e) in enumerate(zip(begin, end, strict=True)):
        for h, t in zip(hit, term, strict=True):
            if b <= h < e:
                a[p, t] += weight[t] * scale[p]
    s[np.arange(len(terms)), slot] = sign
    assert np.allclose(total.reshape(len(terms), slots), a.T @ a @ s, rtol=1e-4)


def test_more_items_than_a_block(spark, prose):
    items = [(i, prose(24, 2000 + i)) for i in range(600)]
    rows = [(i, prose(60, i) + " " + items[i * 15][1] + " " + prose(60, 500 + i)) for i in range(40)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == {(i, i * 15) for i in range(40)}


def test_common_words_outside_the_benchmark_weigh_little(spark, prose):
    item, filler = prose(8, 3000), prose(60, 3001)
    rows = [(i, filler + (" " + item if i % 2 else "") + " " + filler) for i in range(120)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")
    assert {r.doc_id for r in contaminated(docs, bench).collect()} == set(range(1, 120, 2))


def test_pu_risk_and_gradient_by_plain_formulas():
    r = np.random.default_rng(8)
    dense = {"p": r.random((7, 5)) < 0.4, "u": r.random((20, 5)) < 0.4}
    made = {k: (*np.nonzero(x), len(x)) for k, x in dense.items()}
    for prior, scale in ((0.1, 1.0), (0.9, 4.0)):  # the second has a negative bracket
        w, b = r.normal(size=5) * scale, 0.3 * scale

        def parts(w, b, prior=prior):
            p, u = (1 / (1 + np.exp(-(x @ w + b))) for x in (dense["p"], dense["u"]))
            return prior * (1 - p).mean(), u.mean() - prior * p.mean()

        toxic, clean = parts(w, b)
        got, grad = tox.risk(made["p"], made["u"], w, b, prior)
        assert np.isclose(got, toxic + max(0, clean))
        for n in range(6):
            d = np.zeros(6)
            d[n] = 1e-6
            (t1, c1), (t0, c0) = parts(w + d[:5], b + d[5]), parts(w - d[:5], b - d[5])
            slope = ((t1 - t0) + (c1 - c0)) / 2e-6 if clean >= 0 else -(c1 - c0) / 2e-6
            assert np.isclose(grad[n], slope, atol=1e-5)


def test_toxic_stems_with_unseen_endings(spark, prose):
    r = random.Random(11)
    rows = []
    for i in range(500):
        words = prose(r.randint(20, 60), 9000 + i).split()
        if i % 6 == 0:
            words.insert(r.randrange(len(words)), "grimwo" + "".join(r.choice("abcdefg") for _ in range(6)))
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    marks = spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in toxicity(docs, docs.where("doc_id < 300"), marks).collect()}
    held = [(got[i], y) for i, _, y in rows if i >= 300]
    assert sum(s >= 0.3 for s, y in held if y) >= 0.9 * sum(y for _, y in held) and sum(s >= 0.3 for s, y in held if not y) <= 3


def test_every_occurrence_has_draws_of_its_own(model):
    flat, at = pieces.encode_batch(*flat_texts(pa.array(["understanding " * 400])), np.array([5]), model, 1, 0.2)
    back, _ = pieces.decode_flat(flat, at, model)
    assert bytes(back).decode() == "understanding " * 400
    text, kinds = "", set()
    own: list[int] = []
    for piece in flat.tolist():
        raw = model["raw"][model["raw_at"][piece] : model["raw_at"][piece + 1]].tobytes().decode()
        if raw.startswith(" ") and own:
            kinds.add(tuple(own))
            own = []
        own.append(piece)
        text += raw
    assert len(kinds) > 16


def test_long_runs_without_spaces(model):
    text = "".join(random.Random(1).choice("etaoin") for _ in range(60_000))
    flat, at = pieces.encode_batch(*flat_texts(pa.array([text])), np.array([1]), model, 1, 0.1)
    assert bytes(pieces.decode_flat(flat, at, model)[0]).decode() == text


def test_many_languages_and_neighbours(spark, prose):
    codes = [f"l{n:03d}" for n in range(300)]
    train = spark.createDataFrame([(n, prose(30, 7000 + n), c) for n, c in enumerate(codes)], "doc_id long, text string, lang string")
    asked = train.select("doc_id", "text")
    got = {r.doc_id: r.lang_pred for r in identify(asked, train).collect()}
    assert sum(got[n] == c for n, c in enumerate(codes)) > 250
    from colloquy.llm.langid import count_grams, fit_languages, label_texts

    rows = [(names := ["en", "fr"]).index(lang) for lang in ("en", "fr")]
    parts = list(count_grams(pa.array(["the house and river", "la maison du fleuve"]), names))
    model = fit_languages(names, np.repeat(rows, [len(p[1]) for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
    alone = label_texts(pa.array(["the river"]), model, 2.0)
    beside = label_texts(pa.array(["la", "the river", "maison"]), model, 2.0)
    assert alone[0][0] == beside[0][1] and alone[1][0] == beside[1][1]


def test_word_hashes_of_any_length():
    texts = ["a" * n for n in (1, 7, 8, 9, 16, 64, 65, 200)] + ["b" + "a" * 199]
    once, again = Words(pa.array(texts)), Words(pa.array(["x " + t + " y" for t in texts]))
    assert len(set(once.hashes.tolist())) == len(texts) and again.hashes[1::3].tolist() == once.hashes.tolist()
    assert int(mix(np.array([12345], np.uint64), 3)[0]) == pieces.mix_one(12345, 3)


def test_operators_run_outside_the_repository(tmp_path):
    """The workers have no copy of the package."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
sys.path.append({root!r})
from colloquy.llm import registry
for name in ("op10_decontamination", "op4_minhash_neardup"):
    print(name, registry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "op4_minhash_neardup 200" in done.stdout, done.stderr[-2000:]
