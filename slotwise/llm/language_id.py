"""Language identification by nearest centroid.

A text is a vector of hashed byte 1-, 2- and 3-grams of its letters, weighted
by 1 + log count and inverse document frequency over all learning texts, of
length one. Each language has several centroids, found by spherical k-means on
a bounded sample of its learning texts; a text takes the language of the
nearest centroid by cosine. It is rejected when it lies farther from that
centroid than nearly all texts the centroid was made of.

The sample is ``fit_rows`` texts per language (about; a hash of id and text
decides). Document frequencies use every learning text, predictions every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm.arrays import mix, pieces, text_buffers
from slotwise.llm.tables import read, without

CELLS, BLOCK_ROWS = 4096, 256
FIT_ROWS, CENTROIDS, ROUNDS = 3000, 4, 20
REJECT_QUANTILE = 0.001
OUT = ("lang_pred", "score", "rejected")


def gram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams per text (at most ``BLOCK_ROWS`` texts), and whether it has a letter."""
    rows = len(texts)
    data, offsets = text_buffers(pc.utf8_lower(texts))
    data = data.copy()
    ascii_letter = (data >= 0x61) & (data <= 0x7A)
    wide = data >= 0x80
    data[~(ascii_letter | wide)] = 0
    row = np.repeat(np.arange(rows), np.diff(offsets))
    plain = np.bincount(row[ascii_letter], minlength=rows) > 0
    letters = plain.copy()
    for i in np.flatnonzero(~plain & (np.bincount(row[wide], minlength=rows) > 0)):
        letters[i] = any(c.isalpha() for c in texts[i].as_py())
    counts = np.zeros(rows * CELLS, np.int64)
    code = data.astype(np.uint64)
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, 4):
        if len(code) < n:
            break
        stop = len(code) - n + 1
        gram = gram[:stop] << np.uint64(8) | code[n - 1 :]
        use = gram > 0
        if n > 1:
            use &= row[:stop] == row[n - 1 :]
        cell = (mix(gram[use] * np.uint64(4) + np.uint64(n)) >> np.uint64(50)).astype(np.int64) % CELLS
        counts += np.bincount(row[:stop][use] * CELLS + cell, minlength=rows * CELLS)
    return counts.reshape(rows, CELLS), letters


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            yield batch.slice(at, BLOCK_ROWS)


def _column(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text").fill_null("")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each cell, for all texts of a task."""
    total, n = np.zeros(CELLS, np.int64), 0
    for block in _blocks(batches):
        counts, letters = gram_counts(_column(block))
        total += (counts[letters] > 0).sum(0)
        n += int(letters.sum())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(CELLS + 1)), pa.array(np.append(total, n))], ["cell", "df"]
    )


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts.astype(np.float32))
    vectors *= idf
    size = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.where(size > 0, size, 1)[:, None]


def spherical_means(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one, and per centroid the cosine few of its own texts stay under."""
    first = vectors.mean(0)
    centers = [first / max(np.linalg.norm(first), 1e-12)]
    nearest = vectors @ centers[0]
    while len(centers) < min(k, len(vectors)):
        # the text farthest from all centers so far
        centers.append(vectors[np.argmin(nearest)])
        nearest = np.maximum(nearest, vectors @ centers[-1])
    centers = np.stack(centers)
    for _ in range(ROUNDS):
        own = np.argmax(vectors @ centers.T, 1)
        for c in range(len(centers)):
            mine = vectors[own == c]
            if len(mine):
                mean = mine.mean(0)
                centers[c] = mean / max(np.linalg.norm(mean), 1e-12)
    cosine = vectors @ centers.T
    own = np.argmax(cosine, 1)
    radius = [
        float(np.quantile(cosine[own == c, c], REJECT_QUANTILE)) if (own == c).any() else 1.0
        for c in range(len(centers))
    ]
    return centers, np.array(radius)


@dataclass
class Languages:
    """Fitted centroids: one row each, with language and rejection cosine."""

    names: list[str]
    centers: np.ndarray
    radius: np.ndarray
    idf: np.ndarray


def fit(learning: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Languages:
    """Centroids from ``learning`` (``text``, ``lang``); rows without language or letter teach nothing."""
    rows = learning.where("lang is not null and text is not null").select("text", "lang")
    counted = rows.select("text").mapInArrow(_frequencies, "cell long, df long").groupBy("cell").agg(F.sum("df").alias("df"))
    df = np.zeros(CELLS + 1)
    for cell, n in counted.collect():  # 4,097 rows, whatever the input
        df[cell] = n
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + 1

    def centers(table: pa.Table) -> pa.Table:
        vectors = []
        for block in _blocks(iter(table.combine_chunks().to_batches())):
            counts, letters = gram_counts(_column(block))
            vectors.append(unit_vectors(counts[letters], idf))
        vectors = np.concatenate(vectors)
        if len(vectors) == 0:
            return pa.table({"lang": pa.array([], pa.string()), "radius": pa.array([], pa.float64()), "center": pa.array([], pa.list_(pa.float32()))})
        found, radius = spherical_means(vectors, centroids)
        return pa.table(
            {
                "lang": pa.array([table.column("lang")[0].as_py()] * len(found)), "radius": pa.array(radius),
                "center": pa.array([c.astype(np.float32) for c in found], pa.list_(pa.float32())),
            }
        )

    sizes = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    # a row per language, as the model itself
    sample = rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("text"), F.col("_n")) < fit_rows).select("text", "lang")
    # copies of a text fall on the same side of the bound, so they are taken once
    model = sample.distinct().groupBy("lang").applyInArrow(centers, "lang string, radius double, center array<float>")
    found = sorted(model.collect(), key=lambda r: (r["lang"], r["radius"]))  # a few rows per language
    matrix = np.array([r["center"] for r in found], np.float32).reshape(-1, CELLS)
    return Languages([r["lang"] for r in found], matrix, np.array([r["radius"] for r in found]), idf)


def _predict(batches: Iterator[pa.RecordBatch], model: Languages) -> Iterator[pa.RecordBatch]:
    names, place = np.unique(model.names, return_inverse=True) if model.names else (np.array([]), np.array([]))
    for block in _blocks(batches):
        counts, letters = gram_counts(_column(block))
        if len(names):
            cosine = unit_vectors(counts, model.idf) @ model.centers.T
            # languages in order, so that the first of equal ones is taken
            best = np.argmax(cosine, 1)
            score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
            pred = names[place[best]].astype(object)
            far = score < model.radius[best]
        else:
            pred, score, far = np.full(block.num_rows, "und", object), np.zeros(block.num_rows), np.ones(block.num_rows, bool)
        pred[~letters], score[~letters], far[~letters] = "und", 0.0, True
        yield pa.RecordBatch.from_arrays(
            [*block.columns, pa.array(pred, pa.string()), pa.array(score.astype(np.float64)), pa.array(far)],
            [*block.schema.names, *OUT],
        )


def identify(docs: DataFrame, model: Languages, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine to the nearest centroid, 0 to 1) and ``rejected``.

    A text that is null, empty or without a letter is ``und`` with score 0 and
    rejected; so is every text if no language was learned. A text too far from
    its centroid keeps the nearest language and is marked rejected. Equal texts
    get equal results; input columns with those names give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # 64 KB per language
    base = without(docs, *OUT)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
    out = base.mapInArrow(
        lambda b: _predict(b, Languages(**shared.value)), ", ".join([*fields, "lang_pred string, score double, rejected boolean"])
    )
    return out if keep_text else out.drop("text")


def held_out(modulus: int, rest: int):
    """Whether a row is kept from learning: crc32 of its id as text (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == rest


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: predicted language and score; learned from the rows not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(4, 2)))
    found = identify(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")
