"""Toxicity scores over text restored by a noisy-channel decoder.

**Restoring.** A token with signs inside or beside letters, with a letter three
or more times in a row, or a run of four or more single letters, is a lattice:
each sign may stand for the letters it resembles, or be noise; a letter equal
to the one before may be a repetition. Viterbi finds the cheapest reading under
a character bigram model counted over all texts. Other tokens have one reading
and stay.

**Scoring.** Words and word beginnings of the restored text that are much more
frequent in toxic texts form a lexicon with log-odds weights, by how often they
occur in a text (once, twice, more). A logistic model over the strongest
weight, the sum, and number and share of such words gives the score. Lexicon
and model are learned on different halves of a sample of labelled rows, which
``FIT_TOXIC`` and ``FIT_CLEAN`` bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm.arrays import ALNUM, SPACES, Words, mix, pieces
from slotwise.llm.language_id import held_out
from slotwise.llm.tables import read, without

FIT_TOXIC, FIT_CLEAN = 6000, 12000
LEAST_SHARE, LEAST_RATIO = 0.01, 6.0
PREFIXES = (3, 4, 5, 6, 7, 8)
LEVELS = 3
MAP_BITS = 22
THRESHOLD = 0.7
OUT = ("score", "predicted")

# The letters a sign may stand for in a disguised word.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "#": "h", "*": "aeiou",
}
STATES = 28  # 0: edge of a word, 1-26: letters, 27: any other letter
SIGN_COST, NOISE_COST, INNER_NOISE_COST, DIGIT_NOISE_COST, REPEAT_COST = 1.0, 3.0, 6.0, 9.0, 2.0


def _letter_states() -> np.ndarray:
    """State of each byte; -1 for the inner bytes of a longer letter."""
    state = np.zeros(256, np.int64)
    state[0x61:0x7B] = np.arange(1, 27)
    state[0x41:0x5B] = np.arange(1, 27)
    state[0xC0:] = 27
    state[0x80:0xC0] = -1
    return state


def _bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of neighbouring character states over all texts of a task."""
    table, total = _letter_states(), np.zeros(STATES * STATES, np.int64)
    for batch in pieces(batches, "text"):
        state = table[Words(batch.column("text"), SPACES).bytes]
        state = state[state >= 0]
        total += np.bincount(state[:-1] * STATES + state[1:], minlength=STATES * STATES)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(STATES * STATES)), pa.array(total)], ["cell", "n"])


def character_costs(docs: DataFrame) -> np.ndarray:
    """Negative log probabilities of the next character state, from all texts."""
    rows = docs.select("text").mapInArrow(_bigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.full(STATES * STATES, 0.5)
    for cell, n in rows.collect():  # 784 rows, whatever the input
        counts[cell] += n
    counts = counts.reshape(STATES, STATES)
    return -np.log(counts / counts.sum(1, keepdims=True))


def _readings() -> tuple[np.ndarray, np.ndarray]:
    """States a byte may be read as, -1 beyond the last, and what such a reading costs."""
    state = _letter_states()
    states = np.full((256, 5), -1)
    states[state > 0, 0] = state[state > 0]
    cost = np.zeros(256)
    for sign, letters in LOOKALIKES.items():
        states[ord(sign), : len(letters)] = [ord(letter) - 96 for letter in letters]
        cost[ord(sign)] = SIGN_COST
    return states, cost


def decode(tokens: list[bytes], costs: np.ndarray) -> list[bytes]:
    """Cheapest reading of each token; tokens of like length are decoded together."""
    (readings, reading_cost), letter = _readings(), _letter_states()
    towards = np.ascontiguousarray(costs.T)
    may_read = np.zeros(256, bool)
    may_read[[ord(c) for c in LOOKALIKES]] = True
    out: list[bytes] = [b""] * len(tokens)
    order = sorted(range(len(tokens)), key=lambda i: len(tokens[i]))
    at = 0
    while at < len(order):
        # at most a million cells of back pointers at once
        end, longest = at, 0
        while end < len(order) and (end == at or len(tokens[order[end]]) * (end + 1 - at) * STATES <= 2**20):
            end += 1
        group = order[at:end]
        at = end
        longest = max(len(tokens[i]) for i in group)
        n = len(group)
        text = np.zeros((n, longest), np.uint8)
        size = np.array([len(tokens[i]) for i in group])
        for r, i in enumerate(group):
            text[r, : size[r]] = np.frombuffer(tokens[i], np.uint8)
        is_letter = letter[text] > 0
        letters_after = np.cumsum(is_letter[:, ::-1], 1)[:, ::-1] - is_letter
        best = np.full((n, STATES), np.inf)
        best[:, 0] = 0.0
        back = np.zeros((longest, n, STATES), np.int8)  # previous state, or STATES for one that stays
        for p in range(longest):
            byte = text[:, p]
            moved = np.full((n, STATES), np.inf)
            previous = np.zeros((n, STATES), np.int8)
            for k in range(readings.shape[1]):
                to = readings[byte, k]
                own = np.flatnonzero((to >= 0) & (p < size))
                if len(own) == 0:
                    break
                step = best[own] + towards[to[own]]
                came = step.argmin(1)
                moved[own, to[own]] = step[np.arange(len(own)), came] + reading_cost[byte[own]]
                previous[own, to[own]] = came
            # the byte may also say nothing: a sign as noise, a letter as a repetition, an inner byte
            stay = np.full((n, STATES), np.inf)
            sign = letter[byte] == 0
            stay[sign] = NOISE_COST
            stay[may_read[byte] & (letters_after[:, p] > 0)] = INNER_NOISE_COST
            stay[(byte >= 0x30) & (byte <= 0x39)] = DIGIT_NOISE_COST
            stay[letter[byte] == -1] = 0.0
            rows = np.flatnonzero(letter[byte] > 0)
            if p:
                rows = rows[text[rows, p - 1] == byte[rows]]
                stay[rows, letter[byte[rows]]] = REPEAT_COST
            stayed = best + stay
            use = stayed < moved
            new = np.where(use, stayed, moved)
            live = p < size
            back[p] = np.where(use, STATES, previous)
            best = np.where(live[:, None], new, best)
        final = (best + costs[:, 0][None]).argmin(1)
        keep = np.zeros((n, longest), bool)
        chars = text.copy()
        state = final.copy()
        for p in range(longest - 1, -1, -1):
            live = p < size
            came = back[p, np.arange(n), state]
            move = live & (came != STATES)
            keep[move, p] = True
            plain = move & (state < 27)
            chars[plain, p] = state[plain] + 96
            state = np.where(move, came, state)
        inner = letter[text] == -1
        for p in range(1, longest):
            keep[:, p] |= inner[:, p] & keep[:, p - 1]
        for r, i in enumerate(group):
            out[i] = chars[r, : size[r]][keep[r, : size[r]]].tobytes()
    return out


def _running(marks: np.ndarray) -> np.ndarray:
    """How many of ``marks`` are set before each; a piece holds too few bytes for more than 32 bits."""
    out = np.zeros(len(marks) + 1, np.int32 if len(marks) < 2**31 else np.int64)
    np.cumsum(marks, dtype=out.dtype, out=out[1:])
    return out


def restore(column: pa.Array, costs: np.ndarray) -> pa.Array:
    """Lower-cased texts with their disguised tokens restored."""
    lowered = pc.utf8_lower(column.fill_null(""))
    words = Words(lowered, SPACES)
    if len(words) == 0:
        return lowered
    data = words.bytes
    signs = np.zeros(256, bool)
    signs[[ord(c) for c in LOOKALIKES]] = True
    joints = signs.copy()
    joints[[ord(c) for c in ".-_~^`'/\\,;:=&%"]] = True
    state = _letter_states().astype(np.int8)[data]
    is_letter = (state > 0) | (state == -1)
    sums = [_running(x) for x in (is_letter, joints[data])]
    letters, joined = (s[words.end] - s[words.start] for s in sums)
    # a sign between letters, or at the edge of a word
    between = np.zeros(len(data), bool)
    between[1:-1] = joints[data[1:-1]] & is_letter[:-2] & is_letter[2:]
    edge = signs[data]
    triple = np.zeros(len(data), bool)
    triple[2:] = is_letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & (state[2:] > 0)
    flag = _running(between | triple | edge)
    flagged = ((flag[words.end] - flag[words.start]) > 0) & (letters > 0)
    # one sign at the end of a word is punctuation
    last = data[words.end - 1]
    flagged &= ~((joined == 1) & signs[last] & ~triple[words.end - 1] & (flag[words.end] - flag[words.start] == 1))
    # runs of single letters of any script; signs between them belong to the run
    begins = _running((data & 0xC0) != 0x80)
    single = (begins[words.end] - begins[words.start] == 1) & (is_letter[words.start] | signs[data[words.start]])
    change = np.flatnonzero(np.diff(single.astype(np.int8), prepend=0, append=0))
    spans = []
    for a, b in zip(change[::2], change[1::2], strict=True):
        for c, d in _inside_rows(words, a, b):
            # one letter said over and over spells nothing
            if d - c >= 3 and is_letter[words.start[c:d]].any() and len(np.unique(words.hash[c:d])) > 1:
                spans.append((c, d))
    for i in np.flatnonzero(flagged & ~single):
        spans.append((int(i), int(i) + 1))
    if not spans:
        return lowered
    raw = data.tobytes()
    tokens = [
        b"".join([raw[words.start[k] : words.end[k]] for k in range(a, b)]) for a, b in spans
    ]
    distinct = sorted(set(tokens))
    found = dict(zip(distinct, decode(distinct, costs), strict=True))
    texts = lowered.to_pylist()
    by_row: dict[int, list] = {}
    for (a, b), token in zip(spans, tokens, strict=True):
        new = found[token]
        if b - a > 1:
            # a run may begin with a word of one letter: both readings are given
            new = new + b" " + new.decode(errors="ignore")[1:].encode()
        by_row.setdefault(int(words.doc[a]), []).append((int(words.start[a]), int(words.end[b - 1]), new))
    for row, cuts in by_row.items():
        base, end = int(words.offsets[row]), int(words.offsets[row + 1]) - 1
        parts, at = [], base
        for a, b, new in sorted(cuts):
            parts += [raw[at:a], new]
            at = b
        parts.append(raw[at:end])
        texts[row] = b"".join(parts).decode(errors="replace")
    return pa.array(texts, pa.string())


def _inside_rows(words: Words, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The run ``a`` to ``b`` of words, cut where a text ends."""
    while a < b:
        end = min(b, int(words.first[words.doc[a] + 1]))
        yield a, end
        a = end


LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes of all words and word beginnings, with the number of the word."""
    words = Words(texts, LETTERS)
    hashes, place = [words.hash], [np.arange(len(words))]
    for size in PREFIXES:
        long = np.flatnonzero(words.end - words.start > size)
        start = words.start[long]
        hashes.append(mix(words.heads(start, size) ^ mix(np.full(1, 1000 + size, np.uint64))))
        place.append(long)
    return np.concatenate(hashes), np.concatenate(place), words


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _levels(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) with the number of occurrences, at most ``LEVELS``."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    first = np.flatnonzero(new)
    return r[first], h[first], np.minimum(np.diff(np.append(first, len(h))), LEVELS)


def _feature_counts(
    batches: Iterator[pa.RecordBatch], costs: np.ndarray, wanted: np.ndarray | None
) -> Iterator[pa.RecordBatch]:
    """Texts with each feature at each level, by label, summed over the task's batch."""
    for batch in pieces(batches, "text"):
        hashes, place, words = features(restore(batch.column("text"), costs))
        if wanted is not None:
            use = wanted[_slots(hashes)]
            hashes, place = hashes[use], place[use]
        rows, hashes, level = _levels(hashes, words.doc[place])
        label = batch.column("toxic").to_numpy(zero_copy_only=False)[rows].astype(np.uint64)
        for k in range(1, LEVELS + 1):
            use = level >= k
            both = np.stack([hashes[use], label[use]])
            order = np.lexsort(both[::-1])
            both = both[:, order]
            new = np.ones(both.shape[1], bool)
            new[1:] = (both[:, 1:] != both[:, :-1]).any(0)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, both.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(both[0, first].view(np.int64)), pa.array(np.full(len(first), k)),
                    pa.array(both[1, first].astype(np.int64)), pa.array(count.astype(np.int64)),
                ],
                ["h", "level", "toxic", "n"],
            )


@dataclass
class ToxicityModel:
    """Character costs, lexicon (sorted hashes with a weight per level) and logistic weights."""

    costs: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray
    wanted: np.ndarray
    logistic: np.ndarray


def evidence(texts: pa.Array, model: ToxicityModel) -> np.ndarray:
    """What the logistic model sees of each text."""
    hashes, place, words = features(texts)
    rows = len(texts)
    use = model.wanted[_slots(hashes)]
    hashes, place = hashes[use], place[use]
    at = np.minimum(np.searchsorted(model.hashes, hashes), max(len(model.hashes) - 1, 0))
    if len(model.hashes):
        use = model.hashes[at] == hashes
        place, at = place[use], at[use]
    else:
        place, at = place[:0], at[:0]
    doc = words.doc[place]
    width = max(len(model.hashes), 1)
    cell, number, many = np.unique(doc * width + at, return_inverse=True, return_counts=True)
    weight = model.weights[cell % width, np.minimum(many, LEVELS) - 1] if len(cell) else np.zeros(0)
    strongest = np.zeros(rows)
    np.maximum.at(strongest, cell // width, weight)
    # a word counts with the strongest of its features
    per_word = np.zeros(len(words))
    np.maximum.at(per_word, place, weight[number])
    total = np.bincount(words.doc, per_word, rows)
    marked = np.bincount(words.doc[per_word > 0], minlength=rows)
    size = np.bincount(words.doc, minlength=rows)
    return np.stack(
        [strongest, np.log1p(total), np.log1p(marked), marked / np.maximum(size, 1), np.log1p(size), np.ones(rows)], 1
    )


def _evidence_rows(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        x = evidence(restore(batch.column("text"), model.costs), model)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(x), pa.list_(pa.float64())), batch.column("toxic").cast(pa.int64())], ["x", "toxic"]
        )


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps of a logistic regression, both labels weighing alike."""
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(y) ** 0.5)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labelled: DataFrame) -> ToxicityModel:
    """Model from ``labelled`` (``doc_id``, ``toxic``) and the texts of ``docs``.

    Rows without label, id or text teach nothing. Without any label the lexicon
    is empty and every score is the same.
    """
    spark = docs.sparkSession
    costs = character_costs(docs)
    known = labelled.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.when(F.col("toxic") == 1, sizes.get(1, 1)).otherwise(sizes.get(0, 1)))
    sample = known.where("toxic in (0, 1)").where(place < F.when(F.col("toxic") == 1, FIT_TOXIC).otherwise(FIT_CLEAN))
    sample = sample.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the bound of the sample is that of the broadcast: 18,000 ids
    texts = (
        docs.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id")
        .withColumn("half", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(2)))
    )
    words_half, model_half = texts.where("half = 0").select("text", "toxic"), texts.where("half = 1").select("text", "toxic")
    n = {r["toxic"]: r["n"] for r in words_half.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    least = LEAST_SHARE * n.get(1, 0)

    def counted(rows: DataFrame, wanted: np.ndarray | None) -> DataFrame:
        out = rows.mapInArrow(lambda b: _feature_counts(b, costs, wanted), "h long, level long, toxic long, n long")
        return out.groupBy("h", "level").agg(
            F.sum(F.col("n") * F.col("toxic")).alias("t"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("c")
        )

    # features that enough toxic texts have; only those are counted in the clean ones
    slots = (
        counted(words_half.where("toxic = 1"), None).where(F.col("t") >= least)
        .select(F.shiftrightunsigned("h", 64 - MAP_BITS).alias("slot")).distinct()
    )
    wanted = np.zeros(2**MAP_BITS, bool)
    for (slot,) in slots.toLocalIterator():  # at most 2^22 slots
        wanted[slot] = True
    odds = F.log((F.col("t") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("c") + 0.5) / (n.get(0, 0) + 1))
    # odds that hold after one standard error, so that few sightings prove nothing at any size
    doubt = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    chosen = counted(words_half, wanted).withColumn("w", odds).where(
        (F.col("t") >= least) & (F.col("w") - doubt >= float(np.log(LEAST_RATIO)))
    )
    # the sample bounds the features: each is in a hundredth of at most FIT_TOXIC texts
    rows = chosen.select("h", "level", "w").collect()
    hashes = np.unique(np.array([r["h"] for r in rows], np.int64).view(np.uint64))
    weights = np.zeros((max(len(hashes), 1), LEVELS))
    for r in rows:
        i = np.searchsorted(hashes, np.array([r["h"]], np.int64).view(np.uint64)[0])
        weights[i, r["level"] - 1 :] = np.maximum(weights[i, r["level"] - 1 :], r["w"])
    wanted = np.zeros(2**MAP_BITS, bool)
    wanted[_slots(hashes)] = True
    model = ToxicityModel(costs, hashes, weights, wanted, np.zeros(6))
    shared = spark.sparkContext.broadcast(vars(model))
    seen = model_half.mapInArrow(lambda b: _evidence_rows(b, ToxicityModel(**shared.value)), "x array<double>, toxic long").collect()
    if seen:
        model.logistic = logistic_fit(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float))
    return model


def _scored(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        x = evidence(restore(batch.column("text"), model.costs), model)
        score = 1 / (1 + np.exp(-np.clip(x @ model.logistic, -30, 30)))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
            [*batch.schema.names, *OUT],
        )


def score(docs: DataFrame, model: ToxicityModel, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 from 0.7).

    A null text is scored as an empty one. Equal texts get equal scores; input
    columns with those names give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # 4 MB, whatever the input
    base = without(docs, *OUT)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
    out = base.mapInArrow(lambda b: _scored(b, ToxicityModel(**shared.value)), ", ".join([*fields, "score double, predicted int"]))
    return out if keep_text else out.drop("text")


def learned(spark: SparkSession, docs: DataFrame, sf_dir: str) -> ToxicityModel:
    """Model from the labelled rows that are not held out."""
    labels = read(spark, sf_dir, "labels").where(~held_out(3, 1))
    return fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: score and prediction; learned from the rows not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learned(spark, docs, sf_dir), keep_text=False)
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
