import math
import random
import re

import pytest
from colloquy.llm import mixture as M
from colloquy.llm.registry import op12_source_mix
from compare import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares of all words by weight; what is above the cap is shared again among the others, as long as there is any."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, rest = set(), sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = rest - sum(cap * sizes[s] for s in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in open_) for s in order}
        above = {s for s in open_ if target[s] > cap * sizes[s]}
        if not above:
            return target
        full |= above


def plain_tilt(sizes, target, cap=3):
    """By halving alone."""
    sizes = [s for s in sizes if s]
    mean = sum(sizes) / len(sizes)
    taken = lambda t: sum(s * min(cap, math.exp(min(50, t * s / mean))) for s in sizes)
    low, high = -1e5, mean * math.log(cap) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if taken(mid) < target else (low, mid)
    return high, mean


def check(rows, docs):
    """Sizes, targets, rates and sums against plain forms."""
    sizes, own = {}, {}
    for _, source, text in docs:
        n = len(WORD.findall(text or ""))
        sizes.setdefault(source, []).append(n)
    totals = {s: sum(x) for s, x in sizes.items()}
    targets = plain_targets(totals)
    assert len(rows) == len(docs)
    by_id = {i: (s, t) for i, s, t in docs}
    taken = dict.fromkeys(sizes, 0)
    tilts = {s: plain_tilt(x, targets[s]) for s, x in sizes.items() if sum(x)}
    for r in rows:
        source, text = by_id[r.doc_id]
        assert r.size == len(WORD.findall(text or "")) and r.source_size == totals[source]
        assert r.target == pytest.approx(targets[source], rel=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 3 * r.size
        if r.size and targets[source] < 3 * totals[source]:
            tilt, mean = tilts[source]
            assert r.rate == pytest.approx(min(3, math.exp(min(50, tilt * r.size / mean))), rel=2e-4, abs=1e-6)
        taken[source] += r.taken
        own.setdefault(source, []).append(r)
    for source, x in sizes.items():
        # at most half of the least document is missed where others can make up for it
        assert abs(taken[source] - targets[source]) <= max(0.51 * max(min((n for n in x if n), default=0), 1), 1e-9 * targets[source]) or len(set(x)) < 30
    return own, targets, taken


def made(spark, docs, parts=3):
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "'x' as size", "1 as n", "2 as tree", "'y' as mark", "0 as total")
    return frame.repartition(parts)


def some_docs(seed, n=1500, sources=9):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = "hot" if r.random() < 0.4 else r.choice([None, "", "é", *(f"s{j}" for j in range(sources))])
        out.append((i, source, r.choice([" ", "\n", "\t "]).join(["w"] * int(r.expovariate(1 / 120)))))
    return out + [(n + j, "hot", " ".join(["copy"] * 77)) for j in range(400)] + [(n + 500, "s1", None), (n + 501, "s1", " "), (n + 502, "void", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_plain_forms(spark, seed):
    docs = some_docs(seed)
    rows = M.mixed(made(spark, docs)).collect()
    own, _, _ = check(rows, docs)
    copies = [r.copies for r in own["hot"] if r.size == 77]
    assert max(copies) - min(copies) <= 1  # equal documents share alike
    again = M.mixed(made(spark, docs, 7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)


def test_capped_targets(spark):
    docs = [(i, "a" if i < 40 else "b", " ".join("w" * (1 + i % 50))) for i in range(1000)]
    _, targets, taken = check(M.mixed(made(spark, docs)).collect(), docs)
    assert taken["a"] == targets["a"] == 3 * sum(1 + i % 50 for i in range(40))


def test_long_text_and_rounding_carry(spark):
    docs = [(0, "a", "w " * 300_000)] + [(i, "a", "w " * 100) for i in range(1, 900)] + [(1000 + i, "b", "x " * (i % 97 + 1)) for i in range(3000)]
    _, targets, taken = check(M.mixed(made(spark, docs)).collect(), docs)
    assert abs(taken["a"] - targets["a"]) <= 50 and abs(taken["b"] - targets["b"]) <= 1


def test_equal_and_null_ids_and_empty_tables(spark):
    docs = [(None, "a", "x y z")] * 3 + [(1, "a", "x"), (1, "a", "x y"), (2, None, None)]
    rows = M.mixed(made(spark, docs)).collect()
    assert sorted(r.size for r in rows) == [0, 1, 2, 3, 3, 3] and sum(r.taken for r in rows) == 12
    assert M.mixed(made(spark, docs).limit(0)).count() == 0
    assert [r.taken for r in M.mixed(made(spark, [(1, None, None), (2, "a", "")])).collect()] == [0, 0]


def test_whole_table(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()]
    rows = op12_source_mix(spark, SF).collect()
    targets = plain_targets({s: sum(len(WORD.findall(t or "")) for _, x, t in docs if x == s) for s in {d[1] for d in docs}})
    source = {d[0]: d[1] for d in docs}
    taken = dict.fromkeys(targets, 0)
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        assert r.target == pytest.approx(targets[source[r.doc_id]])
    assert all(abs(taken[s] - t) <= 0.02 * t + 5 for s, t in targets.items())
