"""Language of every word and of the whole text, with a linear-chain conditional random field.

A word is a run of letters. Its features are its character n-grams with word boundaries (those at
a boundary are its affixes) and the word itself (the lexicon); all are hashed into one weight
table. Learned transition scores tie neighbours together. Forward-backward gives each word its
probability of every language, so code-switched text is labelled word by word; the text gets the
language with the largest expected number of letters.

Training uses a bounded sample: at most ``docs_per_lang`` texts of each language (chosen by hash) and
a stretch of some ``words_per_doc`` words of each. Half of the training sequences are spliced from texts of two
languages, which is where the transitions between languages are learned. Prediction covers
all words of all texts. A text of any length is walked in blocks of words: products of
transition matrices per block, one pass over the blocks, then all blocks at once.

Edge cases: null text or text without a letter gives ``und`` and score 0; without any labelled row
every text gives ``und``; rows that repeat are predicted each; other columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.codes import doc_of, mix, runs, span_hash, text_slices
from fleetlens.llm.registry import query, table

SLOTS = 1 << 18
ORDERS = (1, 2, 3, 4)
STEPS = 32
OUT = "doc_id long, lang_pred string, score double, n_words long, n_switches long, shares map<string,double>"
_TABLES: dict[str, np.ndarray] = {}


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # SLOTS x labels
    start: np.ndarray
    moves: np.ndarray  # labels x labels, log scores


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters or marks, and their lower case, for all of Unicode."""
    if not _TABLES:
        points = [chr(c) for c in range(sys.maxunicode + 1)]
        _TABLES["letter"] = np.array([unicodedata.category(c)[0] in "LM" for c in points])
        _TABLES["low"] = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in points], np.uint32)
    return _TABLES["letter"], _TABLES["low"]


def word_features(points: np.ndarray, bounds: np.ndarray):
    """Word starts and ends, and per word the slots of its features: (starts, ends, slots, word of each slot)."""
    letter, low = _letters()
    starts, ends = runs(letter[points], bounds)
    # Words end to end, each between two boundary marks.
    size = ends - starts + 2
    stops = np.cumsum(size)
    flat = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint64)
    inside = np.arange(len(flat)) - np.repeat(stops - size, size)
    word = np.repeat(np.arange(len(starts)), size)
    body = (inside > 0) & (inside < size[word] - 1)
    flat[body] = low[points[(starts[word] + inside - 1)[body]]]
    return starts, ends, flat, word


def emissions(points: np.ndarray, bounds: np.ndarray, weights: np.ndarray):
    """Starts and ends of the words and their summed scores per label."""
    starts, ends, flat, word = word_features(points, bounds)
    labels = weights.shape[1]
    scores = np.zeros((len(starts), labels))
    if not len(starts):
        return starts, ends, scores
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    places = np.zeros((len(flat), labels), np.float32)
    for slots, _ in _slots(flat, word):
        places[: len(slots)] += np.take(weights, slots, axis=0)
    scores += np.add.reduceat(places, first, axis=0)
    _, low = _letters()
    scores += weights[_lexicon(low[points], starts, ends)]
    return starts, ends, scores


def _slots(flat: np.ndarray, word: np.ndarray):
    """Per order: the slot of the n-gram at each place (slot 0, of weight 0, where it leaves its word)."""
    rolling = np.zeros(len(flat), np.uint64)
    for n in ORDERS:
        rolling = rolling[: len(flat) - n + 1] * np.uint64(0x100000001B3) + flat[n - 1 :]
        slots = ((mix(rolling + np.uint64(n)) >> np.uint64(46)) | np.uint64(1)).astype(np.int64)
        slots[word[n - 1 :] != word[: len(flat) - n + 1]] = 0
        if n == 1:
            slots[flat == 0] = 0
        yield slots, n


def _lexicon(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ((span_hash(low, starts, ends) >> np.uint64(46)) | np.uint64(1)).astype(np.int64)


def forward_backward(scores: np.ndarray, texts: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of every label for every word; ``texts`` numbers the sequence of each word, in order."""
    n, labels = scores.shape
    if not n:
        return scores
    local = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(moves - moves.max())
    first = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]]))
    length = np.diff(np.append(first, n))
    per = -(-length // STEPS)
    # Words in a grid: a row per block of STEPS words, blocks of a sequence in order.
    block_of_text = np.concatenate([[0], np.cumsum(per)])
    place = np.arange(n) - np.repeat(first, length)
    row = np.repeat(block_of_text[:-1], length) + place // STEPS
    column = place % STEPS
    blocks = int(block_of_text[-1])
    grid = np.ones((STEPS, blocks, labels))
    live = np.zeros((STEPS, blocks), bool)
    grid[column, row], live[column, row] = local, True
    opening = np.zeros(blocks, bool)
    opening[block_of_text[:-1]] = True

    # What a block does to the message that enters it, from either side.
    into = np.broadcast_to(np.eye(labels), (blocks, labels, labels)).copy()
    for t in range(STEPS):
        on = live[t]
        moved = (into[on].reshape(-1, labels) @ step).reshape(-1, labels, labels) * grid[t, on][:, None, :]
        into[on] = moved / moved.max((1, 2), keepdims=True)
    begin = np.exp(start - start.max())
    enter = np.ones((blocks, labels))  # the first block of a sequence has no message before it
    leave = np.ones((blocks, labels))
    for k in range(1, int(per.max())):
        has = block_of_text[:-1][per > k] + k
        out = np.einsum("bi,bij->bj", enter[has - 1], into[has - 1]) if k > 1 else _first_block(grid, live, has - 1, begin, step)
        enter[has] = out / out.max(1, keepdims=True)
    for k in range(int(per.max()) - 1, 0, -1):
        has = block_of_text[:-1][per > k] + k
        back = np.einsum("bij,bj->bi", into[has], leave[has])
        leave[has - 1] = back / back.max(1, keepdims=True)

    ahead = np.empty((STEPS, blocks, labels))
    message = enter.copy()
    for t in range(STEPS):
        moved = message @ step
        if t == 0:
            moved = np.where(opening[:, None], begin, moved)
        moved = moved * grid[t]
        message = np.where(live[t][:, None], moved / moved.max(1, keepdims=True), message)
        ahead[t] = message
    message = leave.copy()
    for t in range(STEPS - 1, -1, -1):
        ahead[t] *= message
        back = (message * grid[t]) @ step.T
        message = np.where(live[t][:, None], back / back.max(1, keepdims=True), message)
    out = ahead[column, row]
    return out / out.sum(1, keepdims=True)


def _first_block(grid, live, rows, begin, step):
    """The message that leaves the first block of a sequence: its first word has the start scores."""
    message = begin[None, :] * grid[0, rows]
    for t in range(1, STEPS):
        on = live[t, rows][:, None]
        moved = (message @ step) * grid[t, rows]
        message = np.where(on, moved / moved.max(1, keepdims=True), message)
    return message


def train(texts: list[str], langs: list[str], words_per_doc: int = 200, span: int = 40, rounds: int = 4, seed: int = 7) -> Crf:
    """Fits all weights by stochastic gradient ascent (AdaGrad) on the conditional likelihood."""
    labels = sorted(set(langs))
    number = {x: i for i, x in enumerate(labels)}
    count = len(labels)
    rng = np.random.default_rng(seed)
    weights = np.zeros((SLOTS, count), np.float32)
    start, moves = np.zeros(count), np.zeros((count, count))
    slots, firsts, owners = [], [], []
    _, low = _letters()
    for text, lang in zip(texts, langs, strict=True):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.array([0, len(points)])
        starts, ends, flat, word = word_features(points, bounds)
        keep = min(len(starts), words_per_doc)
        if not keep:
            continue
        mine: list[list[np.ndarray]] = [[] for _ in range(keep)]
        for found, n in _slots(flat, word):
            at = np.flatnonzero(found)
            at = at[word[at] < keep]
            for w, part in zip(*_split(word[at], found[at]), strict=True):
                mine[w].append(part)
        lexicon = _lexicon(low[points], starts[:keep], ends[:keep])
        slots.append([np.append(np.concatenate(m), x) if m else np.array([x]) for m, x in zip(mine, lexicon.tolist(), strict=True)])
        owners.append(number[lang])
    if not slots:
        return Crf([], weights, start, moves)
    by_label = [[i for i, o in enumerate(owners) if o == k] for k in range(count)]
    squares = np.full((SLOTS, count), 1e-3, np.float32)
    squares_start, squares_moves = np.full(count, 1e-3), np.full((count, count), 1e-3)
    # Spans of a text; half of them are followed by a span of a text in another language.
    spans = [(i, a) for i, words in enumerate(slots) for a in range(0, len(words), span)]
    for r in range(rounds):
        rng.shuffle(spans)
        rate = 0.3 / (1 + r)
        for k in range(0, len(spans), 64):
            words, gold, text = [], [], []
            for s, (i, a) in enumerate(spans[k : k + 64]):
                own = slots[i][a : a + span]
                words += own
                gold += [owners[i]] * len(own)
                text += [s] * len(own)
                if rng.random() < 0.5:
                    j = int(rng.choice(by_label[int(rng.integers(count))]))
                    b = int(rng.integers(len(slots[j])))
                    more = slots[j][b : b + int(rng.integers(1, span))]
                    words += more
                    gold += [owners[j]] * len(more)
                    text += [s] * len(more)
            flat = np.concatenate(words)
            owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
            scores = np.zeros((len(words), count))
            np.add.at(scores, owner, weights[flat])
            gold, text = np.array(gold), np.array(text)
            marginal, pairs, opening = _expected(scores, text, start, moves)
            delta = -marginal
            delta[np.arange(len(gold)), gold] += 1
            wanted = np.zeros((count, count))
            inner = text[1:] == text[:-1]
            np.add.at(wanted, (gold[:-1][inner], gold[1:][inner]), 1)
            used, back = np.unique(flat, return_inverse=True)
            gradient = np.zeros((len(used), count), np.float32)
            np.add.at(gradient, back, delta[owner].astype(np.float32))
            gradient -= 0.02 * weights[used]
            squares[used] += gradient**2
            weights[used] += rate * gradient / np.sqrt(squares[used])
            first = np.flatnonzero(np.concatenate([[True], ~inner]))
            for value, square, g in ((moves, squares_moves, wanted - pairs), (start, squares_start, np.bincount(gold[first], minlength=count) - opening)):
                g = g - 0.02 * value
                square += g**2
                value += rate * g / np.sqrt(square)
    return Crf(labels, weights, start, moves)


def _split(owner: np.ndarray, values: np.ndarray):
    cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    heads = np.concatenate([[0], cut]) if len(owner) else np.empty(0, np.int64)
    return owner[heads].tolist(), np.split(values, cut) if len(owner) else []


def _expected(scores: np.ndarray, text: np.ndarray, start: np.ndarray, moves: np.ndarray):
    """Expected labels, label pairs and first labels of short sequences."""
    n, labels = scores.shape
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    local = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(moves)
    alpha, beta = np.empty((n, labels)), np.ones((n, labels))
    steps = int(length[0])
    live = [int((length > t).sum()) for t in range(steps)]
    for t in range(steps):
        at = first[: live[t]] + t
        message = np.exp(start)[None, :] if t == 0 else alpha[at - 1] @ step
        value = message * local[at]
        alpha[at] = value / value.sum(1, keepdims=True)
    pairs = np.zeros((labels, labels))
    for t in range(steps - 1, 0, -1):
        at = first[: live[t]] + t
        onward = local[at] * beta[at]
        joint = alpha[at - 1][:, :, None] * step[None] * onward[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        back = onward @ step.T
        beta[at - 1] = back / back.sum(1, keepdims=True)
    marginal = alpha * beta
    marginal /= marginal.sum(1, keepdims=True)
    return marginal, pairs, marginal[first].sum(0)


def _predict(batches, model):
    crf: Crf = model.value
    for batch in batches:
        for part, points, bounds in text_slices(batch, "text"):
            n = part.num_rows
            if crf.labels:
                starts, ends, scores = emissions(points, bounds, crf.weights)
                text = doc_of(starts, bounds)
                chance = forward_backward(scores, text, crf.start, crf.moves)
            else:
                starts, ends, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 1))
                text, chance = starts, scores
            letters = ends - starts
            shares = np.stack([np.bincount(text, chance[:, k] * letters, minlength=n) for k in range(chance.shape[1])], 1)
            total = np.bincount(text, letters, minlength=n)
            shares = shares / np.maximum(total, 1)[:, None]
            best = shares.argmax(1)
            label = chance.argmax(1) if len(chance) else text
            turn = (text[1:] == text[:-1]) & (label[1:] != label[:-1])
            some = total > 0
            names = np.array([*crf.labels, "und"], object)
            score = np.minimum(np.where(some, shares[np.arange(n), best], 0.0), 1.0)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names[np.where(some, best, len(crf.labels))], pa.string()), pa.array(score), pa.array(np.bincount(text, minlength=n)),
                 pa.array(np.bincount(text[1:][turn], minlength=n)),
                 pa.array([list(zip(crf.labels, s, strict=True)) if ok and crf.labels else [] for s, ok in zip(shares.tolist(), some.tolist(), strict=True)], pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "lang_pred", "score", "n_words", "n_switches", "shares"],
            )


def learnable() -> F.Column:
    """Documents that training may see: two thirds, by crc32 of the doc_id as text."""
    return F.col("lang").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1)


def train_on(docs: DataFrame, docs_per_lang: int = 200, words_per_doc: int = 200) -> Crf:
    """Fits the model on a bounded sample of ``docs`` (text, lang); labels are counted first, so that a
    rare language gives all it has and a common one no more than the bound."""
    docs = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    lot = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    share = F.lit(0.0)
    for lang, count in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.2 * docs_per_lang / count + 1e-6))).otherwise(share)
    # Of a long text the sample takes a stretch at a place chosen by hash, so its size stays bounded.
    size = F.lit(12 * words_per_doc)
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - size, F.lit(0)) + 1).cast("int") + 1
    rows = docs.filter(lot < share).select("lang", F.substr("text", place, size).alias("text"), F.xxhash64("doc_id").alias("h")).orderBy("h", "text").limit(2 * docs_per_lang * max(1, len(counts))).collect()
    kept: dict[str, list[str]] = {}
    for r in rows:
        if len(kept.setdefault(r["lang"], [])) < docs_per_lang:
            kept[r["lang"]].append(r["text"])
    pairs = [(t, lang) for lang in sorted(kept) for t in kept[lang]]
    return train([t for t, _ in pairs], [x for _, x in pairs], words_per_doc)


def predict(docs: DataFrame, crf: Crf) -> DataFrame:
    """doc_id, lang_pred, score, n_words, n_switches and shares of each language, per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(crf)  # fixed size: SLOTS x labels
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _predict(it, model), OUT)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train_on(docs.filter(learnable())))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_words", "n_switches", "shares")
