import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from colloquy.llm import suffixes
from colloquy.llm.anchors import anchors_of
from colloquy.llm import lines as lines_module
from colloquy.llm.lines import alike, bucket_keys, dedup_lines, first_pairs, line_decisions, other_pairs, with_blocks, with_features
from colloquy.llm.neardup import near_duplicates
from colloquy.llm.substrings import substring_dedup
from colloquy.llm.suffixes import repeated_runs
from colloquy.llm.words import Words, ints
from pyspark.sql import functions as F


def corpus(prose, seed=3):
    r = random.Random(seed)
    base = [prose(r.randint(1, 160), i) for i in range(30)]
    shared = prose(70, 999)
    out = list(base)
    out += [base[1], base[1], base[2] + " tail", "x y " + shared + " z", shared, prose(40, 500) + "\n" + shared + "\t" + prose(20, 501)]
    words = prose(120, 77).split()
    for k in range(12):
        copy = list(words)
        for _ in range(k % 4):
            copy[r.randrange(len(copy))] = "edit%d" % r.randint(0, 99)
        out.append(" ".join(copy))
    return out + ["", None, "   ", "a b c", "a b c", "ho " * 90]


def windows(texts, span):
    seen, where = {}, []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        where.append(w)
        for i in range(len(w) - span + 1):
            seen[tuple(w[i : i + span])] = seen.get(tuple(w[i : i + span]), 0) + 1
    for w in where:
        gone = set()
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i : i + span])] > 1:
                gone |= set(range(i, i + span))
        yield w, gone


def test_substring_dedup_equals_brute_force(spark, docs, prose):
    texts = corpus(prose)
    got = {r.doc_id: r for r in substring_dedup(docs(texts).repartition(3), 35).collect()}
    for i, (w, gone) in enumerate(windows(texts, 35)):
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert {n for a, b in got[i].removed for n in range(a, b)} == gone
    assert substring_dedup(docs(texts).limit(0), 35).count() == 0


def test_repeated_rows_null_and_equal_ids(spark, docs, prose):
    rows = [(1, prose(60, 1)), (1, prose(60, 1)), (2, prose(50, 2)), (2, prose(60, 1) + " more"), (None, prose(50, 3)), (None, None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(docs(rows), 35).collect())
    assert got == [(False, 1, 60, 60), (False, 1, 60, 60), (False, 2, 50, 0), (False, 2, 61, 60), (True, 0, 0, 0), (True, 0, 50, 0)]


def test_long_text(spark, docs, prose):
    body = prose(200_000, 8)
    got = {r.doc_id: r.n_removed for r in substring_dedup(docs([body, "lead " + " ".join(body.split()[1000:1100])]), 35).collect()}
    assert got == {0: 100, 1: 100}


def test_suffix_runs_equal_brute_force(spark, docs, prose):
    texts = corpus(prose, 4)
    got = {}
    for r in repeated_runs(docs(texts).repartition(3), 50).collect():
        got.setdefault(r.doc_id, set()).update(range(r.begin, r.begin + r.length))
        assert r.match_id is not None
    want = {i: gone for i, (_, gone) in enumerate(windows(texts, 50)) if gone}
    assert got == want
    assert repeated_runs(docs(texts).limit(0), 50).count() == 0


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_equal_brute_force(spark, docs, prose):
    texts = corpus(prose, 5)
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicates(docs(texts).repartition(3)).collect()}
    assert got == {i: (g, group.count(g)) for i, g in enumerate(group)}
    assert near_duplicates(docs(texts).limit(0)).count() == 0


def test_large_groups_are_cut_into_tiles(spark, docs, prose, monkeypatch):
    from colloquy.llm import neardup

    words = prose(120, 7).split()
    texts = [" ".join(words[:i] + ["w%d" % i] + words[i:]) for i in range(20)] + [prose(100, 9)]
    for unit, spokes in ((300, 3), (2_000_000, 4096)):  # the same result whatever the tasks' size
        monkeypatch.setattr(neardup, "UNIT", unit)
        monkeypatch.setattr(neardup, "SPOKES", spokes)
        got = {r.doc_id: r.class_id for r in near_duplicates(docs(texts)).collect()}
        assert got == {i: 0 if i < 20 else 20 for i in range(21)}


def test_near_duplicates_of_equal_and_null_ids(spark, docs, prose):
    """Two texts of similarity about 0.65, and two near copies, whatever their ids."""
    r, rows = random.Random(21), []
    for n in range(6):
        words = prose(100, 600 + n).split()
        other = list(words)
        for i in range(5, 100, 25):
            other[i] = "other"
        rows += [" ".join(words), " ".join(other), " ".join(words[:50] + ["one"] + words[50:])]
    for ids in (range(18), [n // 3 for n in range(18)], [None] * 18):
        got = near_duplicates(docs([(i, t) for i, t in zip(ids, rows, strict=True)])).collect()
        assert len(got) == 18 and len({x.class_key for x in got}) == 12 and sorted(x.class_size for x in got) == [1] * 6 + [2] * 12


def test_line_dedup(spark, docs, prose):
    line, other = prose(40, 1), prose(30, 2)
    near = " ".join(line.split()[:-1] + ["changed"])
    texts = [line + "\n\n" + other, "  " + line.upper() + " \nnew words here", near, None, "", other + "\n" + other]
    got = {r.doc_id: (r.n_lines, r.removed) for r in line_decisions(docs(texts)).collect()}
    assert got == {0: (3, []), 1: (2, [0]), 2: (1, [0]), 3: (1, []), 4: (1, []), 5: (2, [0, 1])}
    kept = {r.doc_id: r.text for r in dedup_lines(docs(texts)).collect()}
    assert kept == {0: texts[0], 1: "new words here", 2: "", 3: None, 4: "", 5: ""}
    assert dedup_lines(docs(texts)).columns == docs(texts).columns and line_decisions(docs(texts).limit(0)).count() == 0


def test_edit_similarity_is_exact(spark):
    r = random.Random(2)
    pool = ["the", "of", "ther", "ing", "thaon", "x", "zzz"]
    rows = []
    for _ in range(400):
        a = [r.choice(pool) for _ in range(r.randint(1, 10))]
        b = list(a)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(b))
            b[k : k + r.randint(0, 1)] = [r.choice(pool)] * r.randint(0, 1) or ["q"]
        rows.append((" ".join(a), " ".join(b)))
    frame = spark.createDataFrame(rows, "a string, b string")
    plain = F.levenshtein("a", "b") <= F.floor(0.2 * F.greatest(F.length("a"), F.length("b")) + 1e-6)
    want = frame.where(plain)
    assert 100 < want.count() < 400 and alike(frame, "a", "b", 0.8).exceptAll(want).count() == 0 and want.exceptAll(alike(frame, "a", "b", 0.8)).count() == 0


def edited_lines(prose, n=300, words=20, edits=3):
    """Pairs of lines of which some words are replaced, of edit similarity 0.8 at least."""
    r, out = random.Random(13), []
    while len(out) < n:
        line = prose(words, 20_000 + r.randrange(10**6)).split()
        other = list(line)
        for i in r.sample(range(words), edits):
            other[i] = prose(1, r.randrange(10**6))
        a, b = " ".join(line), " ".join(other)
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
        if 0 < row[-1] <= 0.2 * max(len(a), len(b)):
            out.append((a, b))
    return out


def test_fuzzy_pairs_are_found(spark, docs, prose):
    for words, edits in ((20, 3), (8, 1), (50, 7)):
        pairs = edited_lines(prose, 200, words, edits)
        got = {r.doc_id: r.n_removed for r in line_decisions(docs([x for pair in pairs for x in pair])).collect()}
        assert sum(got[2 * n + 1] for n in range(len(pairs))) >= 0.95 * len(pairs), (words, edits)


def test_short_lines_meet_by_trigrams(spark, docs):
    texts = ["antidisestablishment", "antidisestablishmemt", "chapter eleven overview", "chapter eleven overviev", "something else"]
    assert [r.n_removed for r in line_decisions(docs(texts)).orderBy("doc_id").collect()] == [0, 1, 0, 1, 0]


@pytest.mark.parametrize("side", [1024, 3])
def test_every_two_lines_of_a_bucket_meet(spark, prose, side, monkeypatch):
    monkeypatch.setattr(lines_module, "SIDE", side)
    base = prose(20, 31).split()
    lines = [" ".join(base[:12] + prose(8, 40 + n).split()) for n in range(12)]  # words in common, not alike all
    frame = with_features(spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "nh long, norm string")).selectExpr("nh", "words", "grams", "length(norm) size", "1L n")
    every_pair_of_a_bucket(with_blocks(frame, "size", "n"))


def every_pair_of_a_bucket(blocked):
    sizes, keys = {r.nh: r.size for r in blocked.collect()}, {}
    for r in blocked.select("nh", bucket_keys(F.col("blocks")).alias("keys")).collect():
        for k in r["keys"]:
            keys.setdefault(k, set()).add(r.nh)
    want = {(a, b) for s in keys.values() for a in s for b in s if a < b and abs(sizes[a] - sizes[b]) <= int(0.2 * max(sizes[a], sizes[b]) + 1e-6)}
    pairs, members = first_pairs(blocked, 0.8)
    got = [tuple(r) for r in other_pairs(members, blocked.selectExpr("*", "nh label"), 0.8).collect()]
    met = {(r.b, r.a) for r in pairs.collect()}
    assert len(want) > 5 and len(set(got)) == len(got) and set(got) | met == want
    assert other_pairs(members, blocked.selectExpr("*", "1L label"), 0.8).count() == 0


@pytest.mark.parametrize("side", [1024, 3])
def test_lines_that_share_two_blocks_only_meet(spark, side, monkeypatch):
    """Neither is a centre of the bucket, and they have nothing else in common."""
    monkeypatch.setattr(lines_module, "SIDE", side)
    rows = [(n, [1, 2, 100 + n, 200 + n], 50, 1) for n in range(9)]
    every_pair_of_a_bucket(spark.createDataFrame(rows, "nh long, blocks array<int>, size int, n long"))


def test_groups_of_lines_are_those_of_brute_force(spark, docs, prose):
    """Lines of three frequent passages, edited; no group joins others, and those found are 0.95 of them (blocks are a sample)."""
    r = random.Random(4)
    lines = []
    for k in range(3):
        base = prose(16, 600 + k).split()
        for _ in range(25):
            line = list(base)
            for i in r.sample(range(16), r.randint(0, 6)):
                line[i] = prose(1, r.randrange(10**6))
            lines.append(" ".join(line))
    frame = spark.createDataFrame(list(enumerate(lines)), "n long, x string")
    near = F.levenshtein("p.x", "q.x") <= F.floor(0.2 * F.greatest(F.length("p.x"), F.length("q.x")) + 1e-6)
    alike_pairs = frame.alias("p").join(frame.alias("q"), (F.col("p.n") < F.col("q.n")) & near).select("p.n", "q.n").collect()
    first = list(range(len(lines)))
    for _ in lines:
        for a, b in alike_pairs:
            first[a] = first[b] = min(first[a], first[b])
    want = {n for n, f in enumerate(first) if f < n}
    got = {x.doc_id for x in line_decisions(docs(lines)).where("n_removed > 0").collect()}
    assert len(want) > 20 and got <= want and len(got) >= 0.95 * len(want)


def test_changed_characters_do_not_take_blocks(spark, docs, prose):
    """One character is changed in eight of twenty words."""
    r, texts = random.Random(9), []
    for n in range(100):
        words = prose(20, 70_000 + n).split()
        other = list(words)
        for i in r.sample([i for i, w in enumerate(words) if len(w) > 2], 8):
            k = r.randrange(len(other[i]))
            other[i] = other[i][:k] + "z" + other[i][k + 1 :]
        texts += [" ".join(words), " ".join(other)]
    got = {x.doc_id: x.n_removed for x in line_decisions(docs(texts)).collect()}
    assert sum(got[2 * n + 1] for n in range(100)) >= 90


def test_passages_also_quoted_in_part(prose, monkeypatch):
    # passages whose only anchor ends where the heads end and begins where the tails begin
    passages = [p for p in (prose(60, 3000 + n) for n in range(600)) if Words(pa.array([p])).grams(16)[1].argmin() == 22][:6]
    texts = []
    for n, passage in enumerate(passages):
        passage = passage.split()
        parts = [passage] * 2 + [passage[:38]] * 40 + [passage[-38:]] * 40
        texts += [prose(20, 1000 * n + i) + " " + " ".join(p) + " " + prose(20, 1000 * n + 500 + i) for i, p in enumerate(parts)]
    words = Words(pa.array(texts))
    at, h = anchors_of(words, 16, 50)
    text = np.searchsorted(words.first, at, side="right") - 1
    for often, block in ((10, 20_000), (10, 7), (5000, 20_000), (5000, 7)):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        live = [[{"pos": int(at[j] - words.first[i]), "n": often, "h": int(ints(h)[j])} for j in np.flatnonzero(text == i)] for i in range(len(texts))]
        rows = pa.RecordBatch.from_pydict({"doc": range(len(texts)), "rep": range(len(texts)), "text": texts, "live": pa.array(live, pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int64()), ("h", pa.int64())])))})
        order = [(c, "ascending") for c in ("h", "cut", "salt", "after")]
        found = pa.Table.from_batches(suffixes.context_task(16, 50)(iter([rows]))).sort_by(order)
        got = {}
        for _ in range(2):
            if not len(found):
                break
            out = pa.Table.from_batches(suffixes.match_task(16, 50)(iter(found.to_batches(max_chunksize=3)))).to_pylist()
            for r in out:
                if r["begin"] is not None:
                    got.setdefault(r["doc"], set()).update(range(r["begin"], r["end"]))
            again = [{c: r[c] for c in found.column_names} | {"salt": -1} for r in out if r["begin"] is None]
            assert bool(again) == (often > suffixes.HOT and _ == 0)
            found = pa.Table.from_pylist(again, found.schema).sort_by(order)
        assert got == {i: gone for i, (_, gone) in enumerate(windows(texts, 50)) if gone} and len(got) == 12


def test_near_duplicates_with_a_line_repeated(spark, docs, prose):
    plain = [prose(104, 800 + n) for n in range(12)]
    texts = plain + [t + (" " + prose(15, 900 + n)) * 50 for n, t in enumerate(plain)]
    assert all(0.8 < len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.9 for a, b in zip(plain, texts[12:], strict=True))
    assert {r.doc_id: r.class_id for r in near_duplicates(docs(texts)).collect()} == {i: i % 12 for i in range(24)}


def test_subtrees_whatever_the_groups(spark, docs, prose, monkeypatch):
    from colloquy.llm import substrings

    texts = corpus(prose, 8)
    want = {i: len(gone) for i, (_, gone) in enumerate(windows(texts, 35))}
    for leaves, room in ((2, 1 << 20), (50, 1 << 20), (2, 0)):  # groups of a few suffixes: deeper prefixes, and parts of hot ones, told to tasks or joined
        monkeypatch.setattr(substrings, "LEAVES", leaves)
        monkeypatch.setattr(substrings, "HOT_BYTES", room)
        assert {r.doc_id: r.n_removed for r in substring_dedup(docs(texts).repartition(3), 35).collect()} == want
    group, k1, k2 = np.array([1, 1, 1, 1, 1, 2]), np.array([5, 5, 5, (1 << 33) + 1, (1 << 33) + 2, (1 << 33) + 2]), np.array([1 << 32, 1 << 32, (1 << 32) + 1, 0, 0, 0])
    lcp = substrings.shared_depths(group, k1, k2)
    assert lcp.tolist() == [-1, 4, 3, 0, 1, -1]
    assert [x.tolist() for x in substrings.nodes_at(lcp, 3)] == [[0, 3, 4, 5], [3, 4, 5, 6]]


def quoting(prose, n=150):
    """Lines of one passage between words of their own, most of them not alike."""
    passage = prose(30, 8_000)
    return [prose(12, 8_100 + i) + " " + passage + " " + prose(12, 8_500 + i) for i in range(n)]


def test_lines_that_quote_a_passage_are_not_all_paired(spark, prose):
    """Their rarest words are their own, so they meet in few buckets."""
    lines = quoting(prose)
    own = [w for line in lines for w in line.split()[:12] + line.split()[-12:]]
    lines += [f"{a} {b} {c} {d}" for a, b, c, d in zip(own[::4], own[1::4], own[2::4], own[3::4], strict=True)]  # no word is of one line alone
    frame = with_features(spark.createDataFrame(list(enumerate(lines)), "nh long, norm string")).selectExpr("nh", "words", "grams", "length(norm) size", "1L n")
    blocked = with_blocks(frame, "size", "n")
    _, members = first_pairs(blocked, 0.8)
    assert other_pairs(members, blocked.selectExpr("*", "nh label"), 0.8).where("a < 150 and b < 150").count() < 1500


def test_lines_little_more_than_a_passage_are_found(spark, docs, prose):
    """Two words of each line are its own, and another line has them."""
    passage, lines = prose(60, 9_000), []
    for i in range(60):
        a, b = prose(1, 9_100 + i) + "xyzzy%d" % i, prose(1, 9_300 + i) + "plugh%d" % i
        lines += [f"{a} {passage} {b}", f"{a} {b} " + prose(6, 9_500 + i)]
    got = {r.doc_id: r.n_removed for r in line_decisions(docs(lines)).collect()}
    assert sum(got[2 * i] for i in range(60)) == 59


def test_texts_without_a_partner_are_not_shuffled(spark, docs, prose, monkeypatch):
    from colloquy.llm.tables import may_be_among

    frame = spark.range(-500, 500).withColumnRenamed("id", "k")
    found = spark.range(-500, 500, 7).withColumnRenamed("id", "k").cache()
    got = {r.k: r.may for r in may_be_among(frame, "k", found, "may").collect()}
    assert len(got) == 1000 and all(got[k] for k in range(-500, 500, 7)) and sum(got.values()) < 160
    assert may_be_among(frame, "k", found.limit(0), "may").where("may").count() == 0
    texts = [prose(20, 1), prose(20, 2) + "\n" + prose(20, 1), None, "", prose(30, 3)]
    want = [texts[0], prose(20, 2), None, "", texts[4]]
    for room in (lines_module.BROADCAST_BYTES, 0):  # lines fetched by a broadcast, and by a shuffle
        monkeypatch.setattr(lines_module, "BROADCAST_BYTES", room)
        assert [r.text for r in dedup_lines(docs(texts)).orderBy("doc_id").collect()] == want
        assert {r.doc_id: r.n_removed for r in line_decisions(docs([prose(40, 5), prose(39, 5) + " changed"])).collect()} == {0: 0, 1: 1}


def test_blocks_whichever_features_are_common(spark, prose, monkeypatch):
    """Common features are broadcast and rare ones shuffled; the blocks are the same."""
    lines = [prose(12, n // 2) + " " + prose(6, 300) for n in range(40)]
    frame = with_features(spark.createDataFrame(list(enumerate(lines)), "nh long, norm string")).selectExpr("nh", "words", "grams", "length(norm) size", "1L n")
    found = []
    for often, common in ((64, 1 << 17), (3, 1 << 17), (1, 1), (1, 1 << 17)):
        monkeypatch.setattr(lines_module, "OFTEN", often)
        monkeypatch.setattr(lines_module, "COMMON", common)
        found.append(sorted((r.nh, r.blocks, r.quoted, r["size"], r.n) for r in with_blocks(frame, "size", "n").collect()))
    assert len(found[0]) == 40 and all(x == found[0] for x in found)


def test_stars_need_no_round(spark, monkeypatch):
    from colloquy.llm import components as module

    tables, write = [], module.written
    monkeypatch.setattr(module, "written", lambda frame, what: tables.append(what) or write(frame, what))
    got = {r.node: r.label for r in module.components(spark.createDataFrame([(1, 2), (3, 1), (7, 5), (2, 1), (4, 4)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5} and len(tables) == 1
    chain = spark.createDataFrame([(n, n + 1) for n in range(30)], "a long, b long")
    assert {(r.node, r.label) for r in module.components(chain).collect()} == {(n, 0) for n in range(31)}


def test_edits_of_aligned_words_bound_the_distance(spark, prose):
    pairs = [(a + " ", b + " ") for a, b in edited_lines(prose, 40)] + [(prose(8, n) + " ", prose(9, n + 50) + " ") for n in range(40)] + [("a b c ", "n a b c ")]
    rows = spark.createDataFrame(pairs, "a string, b string").selectExpr("levenshtein(a, b) d", "split(trim(a), ' ') x", "split(trim(b), ' ') y")
    got = [(r.d, r.most) for r in rows.withColumn("most", lines_module.edits_at_most("x", "y")).collect()]
    assert all(d <= most for d, most in got) and got[-1] == (2, 2)


def test_edits_of_aligned_words_are_close(spark, prose):
    """Words that are misspelt, or that also occur elsewhere, do not spoil the bound; over the limit, any number over it."""
    r = random.Random(9)
    pairs = []
    for n in range(40):
        words = " ".join(w + " the of" for w in prose(14, n).split()).split()
        other = [w[:-1] + "x" if len(w) > 3 and r.random() < 0.3 else w for w in words]
        del other[3:5]
        pairs.append((" ".join(words), " ".join(other)))
    rows = spark.createDataFrame(pairs, "a string, b string").selectExpr("levenshtein(a, b) d", "split(a, ' ') x", "split(b, ' ') y", "2 few")
    got = rows.select("d", lines_module.edits_at_most("x", "y").alias("bound"), lines_module.edits_at_most("x", "y", "few").alias("over")).collect()
    assert all(r.d <= r.bound for r in got) and sum(r.bound for r in got) <= 1.3 * sum(r.d for r in got) and all(r.over > 2 for r in got if r.bound > 2)


def test_pairs_are_compared_once_and_few_lines_are_kept(spark, docs, prose, monkeypatch):
    """The second round leaves out what the first found unlike, and neither all lines nor buckets' keys of one line are written."""
    rounds, tables, verify, write = [], {}, lines_module.verified, lines_module.written

    def verified(pairs, *args):
        rounds.append({(max(r.a, r.b), min(r.a, r.b)) for r in pairs.collect()})
        return verify(pairs, *args)

    def written(frame, what):
        tables[what] = write(frame, what)
        return tables[what]

    monkeypatch.setattr(lines_module, "verified", verified)
    monkeypatch.setattr(lines_module, "written", written)
    shared = prose(3, 900)
    texts = [f"{shared} {prose(9, n)}" for n in range(4)] + [prose(12, 50 + n) for n in range(20)]
    want = [(n, []) for n in range(24)]
    assert sorted((r.doc_id, r.removed) for r in line_decisions(docs(texts)).collect()) == want
    assert len(rounds) == 2 and rounds[0] and not rounds[0] & rounds[1] and len(rounds[0] | rounds[1]) == 6
    assert "lines" not in tables and tables["members"].select("nh").distinct().count() == 4


def test_callers_columns_are_left_as_they_are(spark):
    from colloquy.llm.tables import may_be_among

    names = ["__slot", "__row", "__bit", "__bits", "__byte"]
    frame = spark.range(50).selectExpr("id as k", *(f"concat('{c}', id) as `{c}`" for c in names))
    rows = may_be_among(frame, "k", spark.range(0, 50, 7).withColumnRenamed("id", "k"), "may").collect()
    assert len(rows) == 50 and all(r[c] == f"{c}{r.k}" for r in rows for c in names) and all(r.may for r in rows if r.k % 7 == 0)
