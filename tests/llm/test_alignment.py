import hashlib
import random
from collections import Counter
from itertools import product

import pytest
from colloquy.llm import alignment as A
from compare import SF


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A.BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=A.PIECES)
    a.encode_special_tokens = True
    with open(A.BYTE_BPE, encoding="utf-8") as bpe, open(A.PIECES, "rb") as pieces:
        own = A.Aligner(bpe.read(), pieces.read())
    return a, b, own


def slow(texts, both):
    """Whole texts by both libraries, groups by sets of offsets, links one by one: per text (n_a, n_b, groups, links)."""
    a, b, own = both
    out = []
    for text in texts:
        raw = (" " + (text or "")).encode()
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        if not text or b"".join(own.a_bytes[i] for i in x) != raw or b"".join(own.b_bytes[i] for i in y) != raw:
            out.append((0, 0, [], Counter()))
            continue
        ends = []
        for ids, spelled in ((x, own.a_bytes), (y, own.b_bytes)):
            ends.append([])
            for i in ids:
                ends[-1].append((ends[-1][-1] if ends[-1] else 0) + len(spelled[i]))
        groups, done = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            now = [e.index(end) + 1 for e in ends]
            groups.append((x[done[0] : now[0]], y[done[1] : now[1]]))
            done = now
        out.append((len(x), len(y), groups, Counter(p for g in groups for p in product(*g))))
    return out


def rows_of(texts, both):
    found = slow(texts, both)
    held = Counter(p for f in found for p in f[3])
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    rows = []
    for x, y, groups, links in found:
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        total = sum(links.values())
        rows.append((x, y, len(groups), total, sum(n for p, n in links.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return rows, held


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
BITS = ["a", "b", " ", "  ", "\n", "\t", "\n\n", "é", "漢", "字", "▁", "<s>", "</s>", "<|endoftext|>", "\u3000", "\u2003", "\x1c", "\x85", "\xa0", "!", "'s", "don't", "123", " the", "The", "=====", "\r\n", "😀", "\x00", "ﬁ", "e\u0301", "\ufeff", "\u200b", "word", "  x", "\x1f ", "½"]


@pytest.mark.parametrize("mapped", [True, False])
def test_alignment_equals_slow_form(spark, docs, both, mapped, monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(1, 14))) for _ in range(300)] + [None, "", " ", "a", "a", "a "]
    want, held = rows_of(texts, both)
    found = A.align_tokens(docs(texts).repartition(5), mapped=mapped)
    got = {x.doc_id: tuple(x[c] for c in COLUMNS) for x in found.documents.collect()}
    assert got == dict(enumerate(want))
    assert {(x.a_id, x.b_id): x.n_docs for x in found.pairs.collect()} == held


def test_whole_table(spark, both):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    want, _ = rows_of([t for _, t in texts], both)
    from colloquy.llm.registry import op11_token_alignment

    got = {x.doc_id: tuple(x[c] for c in COLUMNS) for x in op11_token_alignment(spark, SF).collect()}
    assert got == {i: w for (i, _), w in zip(texts, want, strict=True)}


def test_parts_and_forgetting_do_not_matter(both, monkeypatch, prose):
    own = both[2]
    texts = [prose(400, i) + "\n" + " \n x" + prose(300, i + 1) for i in range(6)]
    want, _ = rows_of(texts, both)
    monkeypatch.setattr(A, "PART", 97)
    monkeypatch.setattr(A, "HELD", 20_000)
    for text, w in zip(texts, want, strict=True):
        numbers, digest, key, times = A.long_text(own, " " + text)
        assert (*numbers[:4], digest) == (*w[:4], w[6]) and times.sum() == w[3] and len(set(key.tolist())) == len(key)


def test_large_group_is_counted_not_paired(both, monkeypatch):
    own, text = both[2], "".join(random.Random(1).choice("漢=-x") for _ in range(400))
    want, _ = rows_of([text], both)
    monkeypatch.setattr(A, "BIG", 1)
    own.forget()
    numbers, digest, _, times = A.long_text(own, " " + text)
    assert (*numbers[:4], digest) == (*want[0][:4], want[0][6]) and times.sum() == want[0][3]


def test_odd_tables(spark, docs):
    assert A.align_tokens(docs([])).documents.count() == 0
    rows = A.align_tokens(docs([(None, "x y"), (None, "x y"), (1, None)])).documents.collect()
    assert sorted((r.doc_id is None, r.n_a) for r in rows) == [(False, 0), (True, 2), (True, 2)]
    assert A.align_tokens(docs([None, ""])).pairs.count() == 0
