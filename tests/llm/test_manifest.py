from hashlib import sha256
from zlib import crc32

import pytest
from colloquy.llm import manifest as M
from colloquy.llm import registry
from compare import SF


def plain_levels(nodes, depth=None):
    """All levels, by their definition."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1 if depth is None else len(levels) <= depth:
        levels.append([M.digest_of(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    path = []
    for nodes in levels[:-1]:
        run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
        path.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return path


def plain_rows(rows):
    """(id, group, leaf, changed) to the operator's rows, null groups and ids first."""
    key = lambda x: (x is not None, x if not isinstance(x, str) else x.encode())
    groups = {}
    for row in sorted(rows, key=lambda r: (key(r[1]), key(r[0]), r[2])):
        groups.setdefault(row[1], []).append(row)
    trees = {g: plain_levels([r[2] for r in x]) for g, x in groups.items()}
    top = plain_levels([t[-1][0] for t in trees.values()])
    out = []
    for number, (g, members) in enumerate(groups.items()):
        for i, (row_id, _, leaf, changed) in enumerate(members):
            path = plain_path(trees[g], i) + plain_path(top, number)
            out.append((row_id, leaf, trees[g][-1][0], top[-1][0], M.digest_of([a + b for a, b in path]), (back := M.folded(changed or leaf, path)), back == top[-1][0]))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 28, 81, 82, 243, 500])
def test_traversal_equals_definition(n):
    leaves = [M.digest_of([str(i)]) for i in range(n)]
    for depth in (M.depth_of(n), M.depth_of(n) + 2):
        levels = plain_levels(leaves, depth)
        assert list(M.authentication_paths(leaves, depth)) == [plain_path(levels, i) for i in range(n)]


def test_traversal_holds_few_digests():
    n, most = 3**6, 0
    walk = M.authentication_paths([M.digest_of([str(i)]) for i in range(n)], 6)
    for _ in walk:
        if walk.gi_frame:
            own = walk.gi_frame.f_locals
            most = max(most, sum(len(x) for a in own["ahead"] for x in a.stack.open) + sum(len(a.found) for a in own["ahead"]) + sum(map(len, own["runs"])) + sum(map(len, own["behind"].open)))
    assert most <= 12 * 6  # of 729 leaves


def rows_of(spark, rows, **options):
    frame = spark.createDataFrame(rows, "key long, host string, leaf string, other string").selectExpr("*", "'x' as tree", "0 as idx", "1 as n", "'y' as source", "2 as number")
    found = M.merkle_manifest(frame.repartition(3), "key", "host", "leaf", "other", **options)
    return [tuple(r) for r in found.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_blocks_equal_definition(spark, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 3**levels)
    rows = [(i, "hot" if i % 3 else f"s{i % 22}", sha256(str(i).encode()).hexdigest(), sha256(b"x").hexdigest() if i % 5 == 0 else None) for i in range(130)]
    rows += [(None, None, "aa", None), (None, "hot", "ab", None), (None, "hot", "aa", None), (7, "hot", "zz", None), (900, "é", "c", None), (901, "lone", "d", "e")] + [rows[3]] * 4
    key = lambda r: tuple(map(str, r))
    assert sorted(rows_of(spark, rows), key=key) == sorted(plain_rows(rows), key=key)


def test_paths_are_returned_on_demand(spark):
    rows = [(i, "a" if i < 9 else "b", M.digest_of([str(i)]), None) for i in range(14)]
    frame = spark.createDataFrame(rows, "key long, host string, leaf string, other string")
    for r in M.merkle_manifest(frame, "key", "host", "leaf", with_path=True).collect():
        assert M.folded(r.leaf, [(s.left, s.right) for s in r.path]) == r.root and r.verified


def test_one_row_and_none(spark):
    assert rows_of(spark, []) == []
    empty = sha256(b"").hexdigest()
    assert rows_of(spark, [(1, "a", "l", None)]) == [(1, "l", "l", "l", empty, "l", True)]


def test_fields_are_told_apart(spark):
    rows = [("1", None), (None, "1"), ("é", ""), ("", "é"), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(M.leaf_digest(["a", "b"])).collect()]
    want = ["".join("-" if x is None else f"{len(x.encode())}:{x}" for x in r) for r in rows]
    assert got == [sha256(w.encode()).hexdigest() for w in want]


def test_tampering_is_found(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = registry.op13_merkle_manifest(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.verified == ("\n" not in (docs[r.doc_id] or "") or crc32(str(r.doc_id).encode()) % 2 != 0)
