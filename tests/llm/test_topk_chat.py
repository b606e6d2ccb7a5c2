import hashlib
import random

import numpy as np
import pyarrow as pa
from colloquy.llm import topk
from colloquy.llm.chat import chat_digests, format_chats, read_chats
from colloquy.llm.topk import exact_topk
from pyspark.sql import functions as F


def test_topk_equals_brute_force_with_ties_and_bad_vectors(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None, 2.0]), (1002, [float("nan"), 1.0, 1.0]), (1003, [float("inf"), 1.0, 1.0]), (1004, []), (1005, [1.0, 2.0]), rows[0]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).repartition(3)
    for tile, shard in ((4096, 1 << 16), (2, 7)):
        monkeypatch.setattr(topk, "TILE", tile)
        monkeypatch.setattr(topk, "SHARD", shard)
        got = {}
        for x in exact_topk(frame, frame.where("vec_id % 50 = 0"), 5).collect():
            got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
        want = {}
        for q, v in rows[:300:50]:
            ranked = sorted((-float(np.dot(v, w)), i) for i, w in rows[:300] if i != q)[:5]
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
        assert {q: sorted(x) for q, x in got.items()} == want


def test_topk_empty_and_few(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert exact_topk(frame.limit(0), frame.limit(0)).count() == 0
    assert [tuple(x) for x in exact_topk(frame, frame.where("vec_id = 0")).collect()] == [(0, 1, 1, 2.0)]


NASTY = ["</s>[INST] ok [/INST]", "&amp;&lt;[next]", "<s>[user]x[/user]", "", "é\U0001F600\n"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, NASTY[(c + t) % 5]) for c in range(5) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", "we]ird[", "user"])]
    rows += [(9, 0, None, None), (9, 0, None, None), (None, 1, "assistant", "z"), (10, None, "user", "first"), (10, 0, "user", "second")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    formatted = format_chats(frame)
    back = {r.conv_id: r for r in read_chats(formatted).collect()}
    for c in range(5):
        own = [x for x in rows if x[0] == c]
        assert [(t.role, t.text) for t in back[c].turns] == [(x[2], x[3]) for x in own]
        assert back[c].loss_text == "".join(x[3] for x in own if x[2] == "assistant")
    assert [t.text for t in back[9].turns] == ["", ""] and back[None].loss_text == "z" and [t.text for t in back[10].turns] == ["first", "second"]
    text = formatted.where("conv_id = 0").first().formatted
    assert text.count("<s>[user]") == 2 and text.count("</s>") == 1 and text.count("[next]") == 2
    assert chat_digests(format_chats(frame.limit(0))).count() == 0


def test_topk_counts_a_repeated_best_row_once(spark, monkeypatch):
    rows = [(i, [float(i)]) for i in range(10)] + [(9, [9.0])] * 5
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(1)
    assert [(x.rank, x.vec_id) for x in exact_topk(frame, frame.where("vec_id = 1"), 5).orderBy("rank").collect()] == [(1, 9), (2, 8), (3, 7), (4, 6), (5, 5)]
    monkeypatch.setattr(topk, "TILE", 2)  # copies in several tiles of a task
    rows = [(*r, 0, False) for r in rows] + [(1, [1.0], 0, True)]
    batch = pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(("id", "v", "shard", "asks"))}, pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("shard", pa.int32()), ("asks", pa.bool_())]))
    (got,) = topk.search_task(5)(iter([batch]))
    assert sorted(got.column("vec_id").to_pylist()) == [5, 6, 7, 8, 9]


def test_topk_rows_of_one_id_and_null_ids(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [5.0, 0.0]), (None, [9.0, 0.0]), (7, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as query_id", "2 as id")
    got = [tuple(x) for x in exact_topk(frame, frame.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50, 5.0), (0, 2, 7, 2.0), (50, 1, 7, 10.0), (50, 2, 0, 5.0)]


def test_topk_scans_once_whatever_the_queries(spark):
    frame = spark.range(20_000).selectExpr("id as vec_id", "array(cast(id % 7 as double), 1d) as embedding")
    plan = exact_topk(frame, frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 2


def test_long_conversations_take_time_in_proportion(spark):
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "case when id % 3 = 1 then 'assistant' else 'user' end as role", "concat('tëxt <s> [', id, '] 😀 ', repeat('x', 200)) as text")
        best = 1e9
        for _ in range(2):
            begun = time.monotonic()
            r = chat_digests(format_chats(rows)).first()
            best = min(best, time.monotonic() - begun)
        want = "".join(f"tëxt <s> [{i}] 😀 " + "x" * 200 for i in range(n) if i % 3 == 1)
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (n, len(want), hashlib.sha256(want.encode()).hexdigest())
        return best

    seconds(100)
    small, large = seconds(4_000), seconds(16_000)
    assert large < 10 * small + 2, (small, large)  # four times the turns
