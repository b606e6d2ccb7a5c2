"""Language identification (operator 8).

Script ranges narrow the candidates of each word to the languages written in its scripts. Each word
has a score per candidate, the log-likelihood of its byte n-grams (1 to 4, word ends included) under
smoothed counts of that language; a Viterbi path over the words, with a penalty for each switch,
labels spans. A text's language is the one whose spans hold the most letter bytes.

The model is fitted on at most ``per_language`` training documents of each language (the least
keyed hashes of the ids). Their n-grams are counted in the executors, whole texts whatever their
length; the driver gets the sums, and the model takes some 0.8 MB a language. Every text is labelled
whole, in slices that shrink with the number of languages; words are scored in blocks of bytes and
tiles of languages. A long text's path is found in blocks of words side by side, which max-plus products
join; the scores of a span of words are held at a time.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows with a null
language train nothing; without any training row every text is ``und``; repeated rows are labelled
alike; equal totals go to the language first in order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import bounded_sample
from .words import SLICE_BYTES, U, Words, slices, text_array

BUCKETS = 1 << 16
#: Bytes and languages that are scored at once.
BLOCK_BYTES, TILE = 1 << 18, 8
ORDERS = (2, 3, 4)
#: Words of a block and of a span whose scores are held, and labels up to which texts are cut into blocks (its cost is their square).
STEPS, SPAN, LABELS = 1 << 10, 1 << 18, 32
#: Scripts by the first byte of a UTF-8 code point (first byte, last byte, script bit).
SCRIPTS = ((0x41, 0x5A, 0), (0x61, 0x7A, 0), (0xC3, 0xC9, 0), (0xCE, 0xCF, 1), (0xD0, 0xD3, 2), (0xD4, 0xD5, 3), (0xD6, 0xD7, 4), (0xD8, 0xDB, 5), (0xE0, 0xE0, 6), (0xE1, 0xE1, 7), (0xE3, 0xE3, 8), (0xE4, 0xE9, 9), (0xEA, 0xED, 10), (0xF0, 0xF0, 11))


def script_masks() -> np.ndarray:
    masks = np.zeros(256, np.uint16)
    for low, high, bit in SCRIPTS:
        masks[low : high + 1] = 1 << bit
    return masks


def letter_bytes() -> np.ndarray:
    """Bytes that count as letters when spans are weighed: ASCII letters and all of other scripts."""
    return (script_masks() > 0) | (np.arange(256) >= 0x80)


def gram_buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the bytes that end at each place (ASCII letters in lower case)."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(U)
    low = np.where((data == 32) | ((data >= 9) & (data <= 13)), U(32), low)
    out, code = [], low
    for order in range(2, max(ORDERS) + 1):
        before = np.full(len(low), U(32))
        before[order - 1 :] = low[: len(low) - order + 1]
        code = code | (before << U(8 * (order - 1)))
        if order in ORDERS:
            out.append((((code * U(0x9E3779B97F4A7C15)) >> U(48)) ^ U(order * 7919)).astype(np.int64) % BUCKETS)
    return out


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)


def count_grams(texts: pa.Array, langs: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each language: slots (an order's bucket, or after these a script bit) and their counts in the texts."""
    masks = script_masks()
    at = np.array(langs)
    for lang in sorted(set(langs)):
        counts = np.zeros(len(ORDERS) * BUCKETS + 16, np.int64)
        for i in np.flatnonzero(at == lang).tolist():
            data = np.frombuffer(f" {texts[i].as_py()} ".encode("utf-8", "replace"), np.uint8)
            for a in range(0, len(data), BLOCK_BYTES):
                low = max(0, a - max(ORDERS) + 1)
                own = data[low : a + BLOCK_BYTES]
                for n, buckets in enumerate(gram_buckets(own)):
                    counts[n * BUCKETS : (n + 1) * BUCKETS] += np.bincount(buckets[a - low :], minlength=BUCKETS)
                seen = np.bincount(masks[own[a - low :]], minlength=1 << 16)
                for bit in range(16):
                    counts[len(ORDERS) * BUCKETS + bit] += seen[1 << bit]
        some = np.flatnonzero(counts)
        yield lang, some, counts[some]


def fit_languages(names: list[str], lang: np.ndarray, slot: np.ndarray, n: np.ndarray, smoothing: float = 0.5) -> dict:
    """names: sorted; lang, slot, n: number of the language, slot and count (see count_grams)."""
    size = len(ORDERS) * BUCKETS
    scores = np.full((len(ORDERS), BUCKETS, len(names)), smoothing, np.float32)
    grams = slot < size
    scores.reshape(size, len(names))[slot[grams], lang[grams]] += n[grams]
    scripts = np.zeros((len(names), 16))
    scripts[lang[~grams], slot[~grams] - size] = n[~grams]
    if names:
        scores /= scores.sum(axis=1, keepdims=True, dtype=np.float64).astype(np.float32)
        np.log(scores, out=scores)
        scores -= scores.mean(axis=2, keepdims=True)
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return {"names": names, "scores": scores, "scripts": ((share > 0.01) * (1 << np.arange(16))).sum(axis=1).astype(np.uint16)}


def word_scores(words: Words, model: dict, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Scores (words from begin to end x languages); a language that lacks a word's scripts is out, unless all do."""
    end = len(words.starts) if end is None else end
    langs, data = len(model["names"]), words.data
    score = np.empty((end - begin, langs), np.float32)
    blocks = np.unique(np.clip(np.searchsorted(words.starts, np.arange(0, len(data), BLOCK_BYTES)), begin, end))
    for a, b in zip(blocks.tolist(), [*blocks[1:].tolist(), end], strict=True):
        if a == b:
            continue
        low = max(0, int(words.starts[a]) - max(ORDERS) + 1)
        own = data[low : int(words.ends[b - 1]) + 1]
        grams = gram_buckets(own)
        bounds = np.empty(2 * (b - a), np.int64)
        # the byte after a word tells its end
        bounds[0::2], bounds[1::2] = words.starts[a:b] - low, np.minimum(words.ends[a:b] + 1 - low, len(own))
        for tile in range(0, langs, TILE):
            some = slice(tile, tile + TILE)
            per_byte = np.zeros((len(own) + 1, min(TILE, langs - tile)), np.float32)
            for n, buckets in enumerate(grams):
                per_byte[:-1] += model["scores"][n][:, some][buckets]
            score[a - begin : b - begin, some] = np.add.reduceat(per_byte, bounds, axis=0)[0::2]
    if end > begin:
        first, last = int(words.starts[begin]), int(words.ends[end - 1])
        seen = np.bitwise_or.reduceat(script_masks()[data[first:last]], words.starts[begin:end] - first)
        fits = (model["scripts"][None, :] & seen[:, None]) > 0
        score[~fits & fits.any(axis=1)[:, None]] -= 1000.0
    return score


def advanced(scores: np.ndarray, begins: np.ndarray, sizes: np.ndarray, value: np.ndarray, penalty: float, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Runs of words, longest first, advance side by side, a word a step, from the values (runs x labels) before them.

    Returns the values after them and, if they are kept, for each word the labels that stay and the one from which the others came.
    """
    stays, came = (np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)) if keep else (None, None)
    value, final = value.astype(np.float32), np.empty(value.shape, np.float32)
    for step in range(int(sizes[0])):
        n = int(np.searchsorted(-sizes, -step, side="left"))  # runs longer than this step
        final[n : len(value)] = value[n:]
        value, at = value[:n], begins[:n] + step
        top = value.argmax(axis=1)
        leap = value[np.arange(n), top][:, None] - np.float32(penalty)
        if keep:
            stays[at] = value >= leap
            came[at] = top
        value = np.maximum(value, leap) + scores[at]
    final[: len(value)] = value
    return final, stays, came


def viterbi(scores: np.ndarray | Callable[[int, int], np.ndarray], first: np.ndarray, penalty: float, langs: int | None = None) -> np.ndarray:
    """The best label of each word, texts beginning at ``first``; scores of all words, or a function of a range of them.

    Texts are cut into blocks of ``STEPS`` words (where there are not too many labels). Of each block of a longer text the best value from every
    label before it to every label at its end is found, all blocks side by side; these matrices are joined
    by max-plus products along the text, which tells the label at every border; then the blocks' own paths
    are found, side by side again. Scores are held for about ``SPAN`` words at a time.
    """
    whole = scores if isinstance(scores, np.ndarray) else None
    langs = whole.shape[1] if whole is not None else langs
    total = int(first[-1])
    path = np.zeros(total, np.int16)
    if not total:
        return path
    steps = STEPS if langs <= LABELS else total
    begins = np.concatenate([np.arange(a, b, steps) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if b > a])
    ends = np.append(begins[1:], total)
    text = np.searchsorted(first, begins, side="right") - 1
    many = np.bincount(text, minlength=len(first))[text] > 1
    groups = np.split(np.arange(len(begins)), np.flatnonzero(np.diff(begins // SPAN)) + 1)
    held: dict[int, np.ndarray] = {}

    def of_group(g: int, blocks: np.ndarray) -> np.ndarray:
        low, high = int(begins[blocks[0]]), int(ends[blocks[-1]])
        if g not in held:
            held.clear()
            held[g] = whole[low:high] if whole is not None else scores(low, high)
        return held[g]

    before, after = np.full(len(begins), -1), np.full(len(begins), -1)  # labels at the borders of blocks; -1: any
    if many.any():
        products = np.zeros((len(begins), langs, langs), np.float32)
        start = np.where(np.eye(langs, dtype=bool), 0.0, -np.inf)
        for g, blocks in enumerate(groups):
            some = blocks[many[blocks]]
            if len(some):
                some = some[np.argsort(begins[some] - ends[some], kind="stable")]
                own, at = of_group(g, blocks), np.repeat(begins[some] - begins[blocks[0]], langs)
                products[some] = advanced(own, at, np.repeat(ends[some] - begins[some], langs), np.tile(start, (len(some), 1)), penalty, False)[0].reshape(len(some), langs, langs)
        for t in np.unique(text[many]).tolist():
            blocks = np.flatnonzero(text == t)
            value, came = np.zeros(langs), []
            for block in blocks.tolist():
                through = value[:, None] + products[block]
                came.append(through.argmax(axis=0))
                value = through.max(axis=0)
            label = int(value.argmax())
            for block, back in zip(blocks[::-1].tolist(), came[::-1], strict=True):
                after[block] = label
                label = int(back[label])
                before[block] = label
            before[blocks[0]] = -1
    for g, blocks in enumerate(groups):
        some = blocks[np.argsort(begins[blocks] - ends[blocks], kind="stable")]
        own, at, sizes = of_group(g, blocks), begins[some] - begins[blocks[0]], ends[some] - begins[some]
        start = np.where((before[some] < 0)[:, None] | (before[some][:, None] == np.arange(langs)), 0.0, -np.inf)
        final, stays, came = advanced(own, at, sizes, start, penalty, True)
        label = np.where(after[some] >= 0, after[some], final.argmax(axis=1)).astype(np.int16)
        for step in range(int(sizes[0]) - 1, -1, -1):
            n = int(np.searchsorted(-sizes, -step, side="left"))
            word = at[:n] + step
            path[begins[blocks[0]] + word] = label[:n]
            label[:n] = np.where(stays[word, label[:n]], label[:n], came[word])
    return path


def label_texts(texts: pa.Array, model: dict, penalty: float) -> tuple[list, np.ndarray, list]:
    """Language, score and spans (begin and end word, language) of each text."""
    # each text stands between spaces, so its neighbours in a batch do not matter
    words, langs = Words(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text_array(texts), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))), len(model["names"])
    n = len(words)
    if not langs or not len(words.starts):
        return ["und"] * n, np.zeros(n), [[] for _ in range(n)]
    path = viterbi(lambda a, b: word_scores(words, model, a, b), words.first, penalty, langs)
    weight = np.add.reduceat(letter_bytes()[words.data].astype(np.int64), words.starts)
    text = words.text_of_word()
    totals = np.bincount(text * langs + path, weights=weight, minlength=n * langs).reshape(n, langs)
    top, whole = totals.argmax(axis=1), totals.sum(axis=1)
    known = whole > 0
    ascii_letters = np.zeros(n, bool)
    ascii_letters[text[np.add.reduceat(((words.data | 32) >= 97) & ((words.data | 32) <= 122), words.starts) > 0]] = True
    for i in np.flatnonzero(known & ~ascii_letters):  # whether other scripts' bytes are letters
        known[i] = bool(has_letter(texts.slice(int(i), 1))[0])
    score = np.where(known, totals[np.arange(n), top] / np.maximum(whole, 1), 0.0)
    begins = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (text[1:] != text[:-1])]))
    stops = np.concatenate([begins[1:], [len(path)]])
    spans = [[] for _ in range(n)]
    for b, e in zip(begins.tolist(), stops.tolist(), strict=True):
        t = int(text[b])
        spans[t].append((b - int(words.first[t]), e - int(words.first[t]), model["names"][path[b]]))
    return [model["names"][k] if ok else "und" for k, ok in zip(top, known, strict=True)], score, spans


def count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, slot, n in count_grams(batch.column("text"), batch.column("lang").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot), pa.array(n)], names=["lang", "slot", "n"])


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, training: DataFrame, penalty: float = 8.0, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (id, lang_pred, score, spans). training: rows whose texts and languages may be learned."""
    spark = docs.sparkSession
    known = training.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    picked = bounded_sample(known, lang_col, id_col, per_language)  # per_language ids a language
    rows = known.join(F.broadcast(picked), [lang_col, id_col], "left_semi").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sums = rows.mapInArrow(count_task, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(sums.column("lang").unique().to_pylist())
    number = pc.index_in(sums.column("lang"), pa.array(names, pa.string())).to_numpy()
    model = spark.sparkContext.broadcast(fit_languages(names, number, sums.column("slot").to_numpy(), sums.column("n").to_numpy()))
    size = max(1 << 15, min(SLICE_BYTES, SLICE_BYTES * TILE // max(len(names), 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "text", size):
                lang, score, spans = label_texts(part.column("text"), model.value, penalty)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.array(spans, SPANS)], names=[id_col, "lang_pred", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, spans array<struct<begin:bigint,end:bigint,lang:string>>")
