import json
import random

import pytest
from colloquy.sources import deltas
from colloquy.streaming.state import run_to_end


def chunk(text, **more):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}], **more}, ensure_ascii=False) + "\n\n"


def read(spark, folder, **options):
    deltas.register(spark)
    rows = spark.read.format("deltas").options(path=str(folder), **options).load().collect()
    return [(r.request, r.delta, r.done) for r in sorted(rows, key=lambda r: (r.file, r.offset))]


def test_two_deltas(spark, tmp_path):
    (tmp_path / "r1.txt").write_text('data: {"choices":[{"delta":{"content":"Hello "}}]}\n\ndata: {"choices":[{"delta":{"content":"world"}}]}\n\ndata: [DONE]\n\n')
    assert read(spark, tmp_path) == [("r1", "Hello ", False), ("r1", "world", False), ("r1", None, True)]


def test_forms_of_events(spark, tmp_path):
    body = ": comment\r\nid: a\r\ndata:" + json.dumps({"choices": [{"delta": {"content": "x\né 漢"}}]}) + "\r\n\r\n"
    body += 'event: note\n\ndata: {"choices":\ndata:  [{"delta": {"content": "two lines"}}]}\n\n' + chunk("") + 'data: {"choices": []}\n\ndata: {"choices":[{"delta":{}}]}\n\nid: b\n\n' + chunk("z") + "data: [DONE]\n\n" + chunk("cut off")[:-1]
    (tmp_path / "log.txt").write_bytes(body.encode())
    (tmp_path / "_ignored").write_text("data: nothing\n\n")
    (tmp_path / "empty.txt").write_text("")
    assert read(spark, tmp_path) == [("a", "x\né 漢", False), ("a", "two lines", False), ("b", "z", False), ("b", None, True)]


def test_broken_data_fail(spark, tmp_path):
    (tmp_path / "r.txt").write_text("data: {nope\n\n")
    with pytest.raises(Exception, match="not a completion chunk"):
        read(spark, tmp_path)


def recorded(seed, n):
    r = random.Random(seed)
    rows, text = [], ""
    for i in range(n):
        text += f"id: q{i}\n"
        for _ in range(r.randint(1, 5)):
            word = "".join(r.choice("aé漢 \n") for _ in range(r.randint(1, 30)))
            text += r.choice(["", ": ping\n\n"]) + chunk(word)
            rows.append((f"q{i}", word, False))
        text += "data: [DONE]\n\n"
        rows.append((f"q{i}", None, True))
    return rows, text


@pytest.mark.parametrize("size", [1, 7, 50, 333])
def test_ranges_do_not_matter(spark, tmp_path, size, monkeypatch):
    rows, text = recorded(1, 4 if size < 7 else 30)
    (tmp_path / "log.txt").write_text(text)
    monkeypatch.setattr(deltas, "STEP", 11)
    found = []
    files = deltas.Files({"path": str(tmp_path), "rangeBytes": size})
    for span in files.spans({}, files.sizes()):
        for batch in deltas.rows_of(span, files.system()[0]):
            found += [(r["request"], r["delta"], r["done"]) for r in batch.to_pylist()]
    assert found == rows
    if size == 333:
        assert read(spark, tmp_path, rangeBytes="333") == rows


def test_stream_restarts_without_loss_or_repeat(spark, tmp_path):
    deltas.register(spark)
    rows, text = recorded(2, 40)
    other_rows, other = recorded(3, 5)
    raw, folder = text.encode(), tmp_path / "in"
    folder.mkdir()
    for n, cut in enumerate((0, 900, 901, 2500, len(raw))):
        (folder / "log.txt").write_bytes(raw[:cut])  # grows, cut anywhere, characters and events included
        if n == 2:
            (folder / "more.txt").write_text(other)
        stream = spark.readStream.format("deltas").options(path=str(folder), rangeBytes="700").load()
        run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r.file, r.offset))
    assert [(r.request, r.delta, r.done) for r in got] == rows + other_rows
