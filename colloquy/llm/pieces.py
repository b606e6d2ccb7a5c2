"""SentencePiece BPE encoding with seeded merge-dropout, and decoding (operator 2).

A chunk is a run of spaces with what follows up to the next space; pieces never cross chunks, since
no piece holds a space after another character. Encoding a chunk processes its agenda of adjacent
symbol pairs, best score first and leftmost among equals. A candidate merge is skipped when the hash
keyed with (seed, document's id, chunk's number, begin, middle, end) falls below the dropout rate; a
skipped candidate never comes back, other merges go on. So every occurrence of a chunk has draws of
its own; the chunks of a slice are segmented side by side in numpy.

Characters without a piece become byte pieces; a literal U+2581 does too, as the model writes spaces
with it. So decoding gives back each text, byte for byte.

Defined results: a null text encodes as null, decodes as null and counts as lossless; an empty text
has no pieces; a null id draws as 0; a dropout of 0 gives the model's own segmentation; repeated
rows are encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, flat_texts, mix, slices

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Chunks of at most so many characters are segmented side by side, longer ones one by one.
WIDTHS = (3, 5, 7, 9, 12, 16, 24, 48)
ROWS = 1 << 15
NONE = np.int32(1 << 30)
_MASK = (1 << 64) - 1


def load_pieces(path: str) -> dict:
    """The model's tables, as arrays: characters, merges (an open-addressing table), and bytes of pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    odd = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
    is_byte = [sp.is_byte(i) for i in range(size)]
    names = [sp.id_to_piece(i) for i in range(size)]
    known = {names[i]: i for i in range(size) if not odd[i] and not is_byte[i]}
    byte_ids = np.zeros(256, np.int32)
    for i in np.flatnonzero(is_byte):
        byte_ids[int(names[i][3:5], 16)] = i
    order = sorted(known.values(), key=lambda i: (-sp.get_score(i), i))
    rank = {i: n for n, i in enumerate(order)}
    chars = np.full(0x110000, -1, np.int32)
    chars[:128] = byte_ids[:128]
    for name, i in known.items():
        if len(name) == 1:
            chars[ord(name)] = i
    chars[ord(SPACE)] = -1
    pairs = [(known[n[:c]], known[n[c:]], i) for n, i in known.items() for c in range(1, len(n)) if n[:c] in known and n[c:] in known]
    bits = max(4, int(np.ceil(np.log2(max(len(pairs), 1) * 3))))
    keys, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
    for left, right, made in pairs:
        key = left << 32 | right
        at = (key * 0x9E3779B97F4A7C15 & _MASK) >> (64 - bits)
        while keys[at] != -1:
            at = (at + 1) & ((1 << bits) - 1)
        keys[at], values[at] = key, rank[made]
    raw = [b"" if odd[i] else bytes([int(names[i][3:5], 16)]) if is_byte[i] else names[i].replace(SPACE, " ").encode() for i in range(size)]
    return {"chars": chars, "space": known[SPACE], "bytes": byte_ids, "bits": bits, "keys": keys, "values": values, "order": np.array(order, np.int32), "raw": np.frombuffer(b"".join(raw), np.uint8), "raw_at": np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)}


def find_merges(model: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The rank of each pair's merge (NONE: no merge)."""
    shape, left, right = left.shape, left.ravel(), right.ravel()
    rank = np.full(len(left), NONE, np.int32)
    todo = np.flatnonzero((left >= 0) & (right >= 0))
    key = (left[todo].astype(np.int64) << 32) | right[todo]
    at = ((key.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - model["bits"])).astype(np.int64)
    while len(todo):
        there = model["keys"][at]
        hit = there == key
        rank[todo[hit]] = model["values"][at[hit]]
        go = ~hit & (there != -1)
        todo, key, at = todo[go], key[go], (at[go] + 1) & ((1 << model["bits"]) - 1)
    return rank.reshape(shape)


def mix_one(x: int, seed: int) -> int:
    """``mix`` of one number."""
    x ^= seed * 0x9E3779B97F4A7C15 & _MASK
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & _MASK
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & _MASK
    return x ^ x >> 33


def skipped(salt: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, dropout: float) -> np.ndarray:
    code = (begin.astype(U) << U(42)) | (middle.astype(U) << U(21)) | end.astype(U)
    return (mix(salt ^ mix(code, 3), 4) >> U(11)).astype(np.float64) < dropout * (1 << 53)


def segment_side_by_side(model: dict, symbols: np.ndarray, lengths: np.ndarray, salts: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols remain (mask) and all symbols (rows padded with -1); a row is a chunk.

    A merged symbol stands where its left part began; ``after`` and ``before`` link the living
    symbols of a row, so nothing moves. The agenda is a rank for each living symbol: that of merging
    it with the next one.
    """
    n, width = symbols.shape
    symbols = symbols.copy()
    after = np.minimum(np.arange(1, width + 1, dtype=np.int32)[None, :], lengths[:, None].astype(np.int32))
    before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy()
    alive = np.arange(width)[None, :] < lengths[:, None]
    rank = np.full((n, width), NONE, np.int32)
    rank[:, :-1] = find_merges(model, symbols[:, :-1], symbols[:, 1:])
    flat_symbols, flat_after, flat_before, flat_alive = symbols.reshape(-1), after.reshape(-1), before.reshape(-1), alive.reshape(-1)

    def offered(row: np.ndarray, left: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Ranks of merging the symbols at left and middle of each row."""
        base = row * width
        got = find_merges(model, flat_symbols[base + left], flat_symbols[base + middle])
        some = np.flatnonzero(got < NONE)
        if dropout > 0 and len(some):
            r, x, m = row[some], left[some], middle[some]
            got[some[skipped(salts[r], x, m, flat_after[r * width + m], dropout)]] = NONE
        return got

    if dropout > 0:
        r, c = np.nonzero(rank < NONE)
        out = skipped(salts[r], c, c + 1, flat_after[r * width + c + 1], dropout)
        rank[r[out], c[out]] = NONE
    rows = np.arange(n)
    while len(rows):
        col = rank.argmin(axis=1)
        least = rank[np.arange(len(rows)), col]
        go = least < NONE
        if not go.any():
            break
        if 2 * np.count_nonzero(go) < len(rows):  # those that are done go
            rank, rows, col, least = rank[go], rows[go], col[go], least[go]
            at = np.arange(len(rows))
        else:
            at = np.flatnonzero(go)
            col, least = col[at], least[at]
        row = rows[at]
        base = row * width
        gone = flat_after[base + col]
        end = flat_after[base + gone]
        flat_symbols[base + col] = model["order"][least]
        flat_after[base + col] = end
        flat_alive[base + gone] = False
        rank[at, gone] = NONE
        rank[at, col] = NONE
        more = np.flatnonzero(end < lengths[row])
        flat_before[base[more] + end[more]] = col[more]
        rank[at[more], col[more]] = offered(row[more], col[more], end[more])
        left = flat_before[base + col]
        more = np.flatnonzero(left >= 0)
        rank[at[more], left[more]] = offered(row[more], left[more], col[more])
    return alive, symbols


def segment_long(model: dict, symbols: list[int], salt: int, dropout: float) -> list[int]:
    """The same for one long chunk, with a heap for the agenda and a dictionary for the merges."""
    if "ranks" not in model:
        there = model["keys"] >= 0
        model["ranks"] = dict(zip(model["keys"][there].tolist(), model["values"][there].tolist(), strict=True))
    ranks, order = model["ranks"], model["order"]
    n, least = len(symbols), dropout * (1 << 53)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive, agenda = [True] * n, []

    def offer(i: int, j: int) -> None:
        rank = ranks.get(symbols[i] << 32 | symbols[j], -1) if symbols[i] >= 0 and symbols[j] >= 0 else -1
        if rank >= 0 and not (dropout > 0 and mix_one(salt ^ mix_one(i << 42 | j << 21 | after[j], 3), 4) >> 11 < least):
            heapq.heappush(agenda, (rank, i, j, after[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while agenda:
        rank, i, j, end = heapq.heappop(agenda)
        if not (alive[i] and j < n and alive[j] and after[i] == j and after[j] == end):
            continue
        symbols[i], after[i], alive[j] = int(order[rank]), end, False
        if end < n:
            before[end] = i
            offer(i, end)
        if before[i] >= 0:
            offer(before[i], i)
    return [s for s, a in zip(symbols, alive, strict=True) if a]


def chunks_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end bytes of the chunks, and the number of each text's first chunk."""
    space = data == 32
    edge = np.zeros(len(space) + 1, bool)
    edge[offs] = True
    before = np.zeros(len(space), bool)
    before[1:] = space[:-1]
    begins = np.flatnonzero((space & ~before) | edge[:-1])
    return begins, np.append(begins[1:], len(space)), np.searchsorted(begins, offs)


def several(rows: np.ndarray) -> list[np.ndarray]:
    return [rows[a : a + ROWS] for a in range(0, len(rows), ROWS)]


def encode_batch(data: np.ndarray, offs: np.ndarray, ids: np.ndarray, model: dict, seed: int, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Flat piece ids and where each text's begin."""
    begins, ends, first = chunks_of(data, offs)
    n = len(begins)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    lead = np.zeros(n, bool)
    lead[first[:-1][np.diff(first) > 0]] = True  # the model puts a space before a text
    number = (np.arange(n) - first[text]).astype(U)
    salt = mix(mix(ids.astype(np.int64).view(U), seed)[text] ^ mix(number, 9), seed + 1)
    size = ends - begins
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = (data & 0xC0) != 0x80
    count = np.add.reduceat(heads, begins, dtype=np.int64) if len(points) == np.count_nonzero(heads) else size
    symbol = model["chars"][points]
    symbol = np.where(points == 32, model["space"], np.where(symbol < 0, -2 - points.astype(np.int32), symbol)).astype(np.int32)
    starts = np.cumsum(count) - count
    count_in = count + lead
    lens = np.zeros(n, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    low = 0
    for width in WIDTHS:
        for rows in several(np.flatnonzero((count_in > low) & (count_in <= width))):
            col = np.arange(width)[None, :] - lead[rows][:, None]
            there = (col >= 0) & (col < count[rows][:, None])
            table = np.where(there, symbol[np.where(there, starts[rows][:, None] + col, 0)], -1)
            table[lead[rows], 0] = model["space"]
            keep, done = segment_side_by_side(model, table, count_in[rows], salt[rows], dropout)
            lens[rows] = np.count_nonzero(keep, axis=1)
            parts.append((rows, done[keep]))
        low = width
    for row in np.flatnonzero(count_in > WIDTHS[-1]).tolist():
        own = [model["space"]] * bool(lead[row]) + symbol[starts[row] : starts[row] + count[row]].tolist()
        done = segment_long(model, own, int(salt[row]), dropout)
        lens[row] = len(done)
        parts.append((np.array([row]), np.array(done, np.int32)))
    offset = np.concatenate([[0], np.cumsum(lens)])
    out = np.zeros(int(offset[-1]), np.int32)
    for rows, made in parts:  # each chunk's pieces go to its place in the texts
        own = lens[rows]
        out[np.repeat(offset[rows] - (np.cumsum(own) - own), own) + np.arange(len(made))] = made
    bounds = offset[first]
    strange = np.flatnonzero(out < 0)
    if len(strange):  # characters without a piece: their bytes
        coded = {int(s): model["bytes"][np.frombuffer(chr(-2 - int(s)).encode(), np.uint8)] for s in np.unique(out[strange])}
        extra = np.zeros(len(out), np.int64)
        extra[strange] = [len(coded[int(s)]) - 1 for s in out[strange]]
        moved = np.arange(len(out)) + np.cumsum(extra) - extra
        wide = np.zeros(len(out) + int(extra.sum()), np.int32)
        wide[moved] = out
        for i in strange.tolist():
            code = coded[int(out[i])]
            wide[moved[i] : moved[i] + len(code)] = code
        bounds = bounds + np.concatenate([[0], np.cumsum(extra)])[bounds]
        out = wide
    return out, bounds


def decode_flat(ids: np.ndarray, bounds: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins, without the space that the model puts before a text."""
    size = np.diff(model["raw_at"])[ids]
    ends = np.cumsum(size)
    raw = model["raw"][np.repeat(model["raw_at"][ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
    at = np.concatenate([[0], ends])[bounds]
    lead = at[:-1][np.diff(at) > 0]
    keep = np.ones(len(raw), bool)
    keep[lead] = raw[lead] != 32
    return raw[keep], at - np.concatenate([[0], np.cumsum(~keep)])[at]


def encode_task(held, seed: int, dropout: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = dict(held.value)
        for whole in batches:
            for part in slices(whole, "text"):
                column = part.column("text")
                ids = pc.fill_null(part.column("draw_id"), 0).to_numpy(zero_copy_only=False)
                data, offs = flat_texts(column)
                flat, bounds = encode_batch(data, offs, ids, model, seed, dropout)
                back, at = decode_flat(flat, bounds, model)
                same = np.diff(at) == np.diff(offs)
                if len(back) == len(data):
                    wrong = np.flatnonzero(back != data)
                    same[np.searchsorted(at, wrong, side="right") - 1] = False
                else:  # compare text by text
                    same &= [back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(at[:-1], at[1:], offs[:-1], offs[1:], strict=True)]
                null = np.asarray(pc.is_null(column))
                pieces = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([part.column("id"), pieces, pa.array(np.diff(bounds)), pa.array(same | null)], names=["id", "pieces", "n_pieces", "lossless"])

    return run


def encode_texts(docs: DataFrame, seed: int = 20, dropout: float = 0.1, path: str = PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, pieces, n_pieces, lossless); lossless: decoding the pieces gave back the text."""
    held = docs.sparkSession.sparkContext.broadcast(load_pieces(path))  # a vocabulary, of fixed size
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("draw_id"))
    return rows.mapInArrow(encode_task(held, seed, dropout), f"id {kind}, pieces array<int>, n_pieces long, lossless boolean").withColumnRenamed("id", id_col)


def decode_texts(encoded: DataFrame, path: str = PIECES, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """Rows (id, text)."""
    held = encoded.sparkSession.sparkContext.broadcast(load_pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column("pieces")
            n = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            raw, at = decode_flat(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(n)]), held.value)
            null = pc.is_null(lists).to_pylist()
            texts = [None if gone else raw[a:b].tobytes().decode("utf-8", "replace") for a, b, gone in zip(at[:-1], at[1:], null, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(pieces_col).alias("pieces")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
