"""Benchmark decontamination by winnowing.

Of every text the 7-word hashes are taken, and of each 7 consecutive ones the
smallest is kept (the rightmost of equals). Two texts that share 13 words share
such a fingerprint, whatever stands around. Fingerprints of documents are
joined with those of the items; around each hit the 13-word windows are
compared with the windows of the items by 128-bit hashes. An item of fewer
words is one window and its own fingerprint.

Only a bit map of the items' fingerprints goes to the tasks, of a fixed 8 MB
whatever the benchmark's size: it drops document fingerprints before the
shuffle that no item can have, and the joins decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm.arrays import ALNUM, BASE_1, BASE_2, Words, mix, pieces
from slotwise.llm.tables import numbered, read, without, write_out

WINDOW, GRAM = 13, 7
MAP_BITS = 26
OUT = ("n_words", "n_hit", "n_items", "items", "contaminated")
WINDOW_TYPE = "array<struct<fp:long,first:long,size:long,h1:long,h2:long>>"


def winnow(values: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Positions of the minimum of each ``width`` consecutive values of a row, rightmost of equals.

    A row of fewer values gives its own minimum.
    """
    n = len(values)
    if n == 0:
        return np.zeros(0, np.int64)
    best = np.arange(n)
    for step in range(1, width):
        # best[i]: the smallest of i..i+step, as far as the row goes
        nxt = np.minimum(np.arange(n) + step, n - 1)
        better = (row[nxt] == row) & (values[nxt] <= values[best])
        best = np.where(better, nxt, best)
    last = np.minimum(np.arange(n) + width - 1, n - 1)
    full = (row[last] == row) & (np.arange(n) + width - 1 < n)
    begin = np.ones(n, bool)
    begin[1:] = row[1:] != row[:-1]
    return np.unique(best[full | begin])


def _keys(words: Words, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    salt = np.uint64(size)
    return mix(words.rolling(size, BASE_1, at) + salt), mix(words.rolling(size, BASE_2, at) + salt)


def _item_windows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Per item: its windows (size, two hashes) and its fingerprints."""
    for batch in pieces(batches, "text"):
        words = Words(batch.column("text"), ALNUM, lower=True)
        rows, sizes, h1, h2, fps = [], [], [], [], [[] for _ in range(batch.num_rows)]
        at = words.windows(gram)
        value = mix(words.rolling(gram, BASE_1, at))
        for p in winnow(value, words.doc[at], window - gram + 1):
            fps[words.doc[at[p]]].append(value[p].view(np.int64))
        for size in np.unique(np.minimum(words.count[words.count > 0], window)).tolist():
            own = words.windows(size)
            if size < window:
                own = own[words.count[words.doc[own]] == size]
            else:
                own = own[words.count[words.doc[own]] >= size]
            a, b = _keys(words, own, size)
            rows.append(words.doc[own])
            sizes.append(np.full(len(own), size))
            h1.append(a.view(np.int64))
            h2.append(b.view(np.int64))
            if size < window:
                for r, f in zip(words.doc[own], a.view(np.int64), strict=True):
                    fps[r] = [f]
        for r in np.flatnonzero(words.count == 0):
            fps[r] = []
        if not rows:
            continue
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32))
        windows = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(x)[order], pa.int64()) for x in (sizes, h1, h2)], ["size", "h1", "h2"]
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("item_id"), pa.ListArray.from_arrays(offsets, windows), pa.array([[int(x) for x in f] for f in fps], pa.list_(pa.int64()))],
            ["item_id", "_windows", "_fps"],
        )


def _document_windows(
    batches: Iterator[pa.RecordBatch], bits: np.ndarray, short: list[int], window: int, gram: int
) -> Iterator[pa.RecordBatch]:
    """Per document: number of words, and the windows around fingerprints an item may have."""

    def may(value: np.ndarray) -> np.ndarray:
        slot = value >> np.uint64(64 - MAP_BITS)
        return bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 > 0

    for batch in pieces(batches, "text"):
        words = Words(batch.column("text"), ALNUM, lower=True)
        at = words.windows(gram)
        value = mix(words.rolling(gram, BASE_1, at))
        picked = winnow(value, words.doc[at], window - gram + 1)
        picked = picked[may(value[picked])]
        # windows of 13 words that hold the picked 7
        start = (at[picked][:, None] - np.arange(window - gram + 1)).ravel()
        fp = np.repeat(value[picked], window - gram + 1)
        doc = np.repeat(words.doc[at[picked]], window - gram + 1)
        inside = (start >= words.first[doc]) & (start + window <= words.first[doc + 1])
        start, fp = start[inside], fp[inside]
        h1, h2 = _keys(words, start, window)
        found = [(start, fp, np.full(len(start), window), h1, h2)]
        for size in short:
            start = words.windows(size)
            h1 = mix(words.rolling(size, BASE_1, start) + np.uint64(size))
            start = start[may(h1)]
            h1, h2 = _keys(words, start, size)
            found.append((start, h1, np.full(len(start), size), h1, h2))
        start, fp, size, h1, h2 = (np.concatenate(x) for x in zip(*found, strict=True))
        row = words.doc[start] if len(start) else start
        order = np.argsort(row, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
        first = start - words.first[row] if len(start) else start
        parts = [pa.array(x[order].astype(np.uint64).view(np.int64)) for x in (fp, first, size, h1, h2)]
        lists = pa.ListArray.from_arrays(
            pa.array(offsets), pa.StructArray.from_arrays(parts, ["fp", "first", "size", "h1", "h2"])
        )
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(words.count, pa.int64()), lists],
            [*batch.schema.names, "n_words", "_found"],
        )


def fingerprint_map(fingerprints: DataFrame) -> np.ndarray:
    """Bit map of the fingerprints: 2^26 bits whatever their number, folded on the executors."""
    slots = fingerprints.select(F.shiftrightunsigned("_fp", 64 - MAP_BITS).alias("_slot"))
    words = slots.groupBy((F.col("_slot") / 64).cast("long").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_slot % 64 as int))")).alias("_bits")
    )
    bits = np.zeros(2 ** (MAP_BITS - 6), np.int64)
    for word, value in words.toLocalIterator():
        bits[word] = value
    return bits.view(np.uint8)


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5, keep_text: bool = True
) -> DataFrame:
    """``docs`` with the benchmark items whose windows they hold.

    Adds ``n_words``, ``n_hit`` (words inside any occurrence of a window),
    ``n_items``, ``items`` (ids as text, sorted) and ``contaminated`` (hit words
    reach ``percent`` of all). Words are lower-cased A-Z, digits and everything
    beyond ASCII. An item of fewer words than ``window`` is one window.

    A null or empty text has no words and is clean; an item without words is
    never met; an item without id counts as one nameless item, which ``items``
    leaves out. Repeated rows each get their result. Input columns with those
    names give way. Either table may be empty.
    """
    spark = docs.sparkSession
    items = write_out(
        benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
        .mapInArrow(
            lambda b: _item_windows(b, window, GRAM),
            "item_id string, _windows array<struct<size:long,h1:long,h2:long>>, _fps array<long>",
        )
    )
    windows = items.select("item_id", F.explode("_windows").alias("_w")).select("item_id", "_w.size", "_w.h1", "_w.h2").distinct()
    prints = items.select(F.explode("_fps").alias("_fp")).distinct()
    short = [r[0] for r in windows.where(F.col("size") < window).select("size").distinct().sort("size").collect()]
    shared = spark.sparkContext.broadcast(fingerprint_map(prints))  # 8 MB, whatever the benchmark's size

    base = without(docs, *OUT)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
    scanned = base.mapInArrow(
        lambda b: _document_windows(b, shared.value, short, window, GRAM),
        ", ".join([*fields, f"n_words long, _found {WINDOW_TYPE}"]),
    )
    rows = numbered(scanned if keep_text else scanned.drop("text"), "_rid")
    hits = (
        rows.select("_rid", F.explode("_found").alias("_x")).select("_rid", "_x.*")
        .join(prints.withColumnRenamed("_fp", "fp"), "fp", "left_semi")
        .select("_rid", "first", "size", "h1", "h2").distinct()
        .join(windows.select("size", "h1", "h2").distinct(), ["size", "h1", "h2"], "left_semi")
    )
    hits = write_out(hits)
    # words covered: a window adds what lies beyond the ends of the windows before it
    ordered = F.sort_array(F.collect_list(F.struct("first", "size")))
    covered = hits.groupBy("_rid").agg(ordered.alias("_s")).select(
        "_rid",
        F.expr(
            "aggregate(_s, struct(0L as n, 0L as e), (a, x) -> struct("
            "a.n + greatest(0L, x.first + x.size - greatest(a.e, x.first)) as n,"
            "greatest(a.e, x.first + x.size) as e), a -> a.n)"
        ).alias("n_hit"),
    )
    named = (
        hits.select("_rid", "size", "h1", "h2").distinct().join(windows, ["size", "h1", "h2"])
        .groupBy("_rid").agg(
            F.collect_set("item_id").alias("_ids"),
            F.max(F.col("item_id").isNull().cast("long")).alias("_nameless"),
        )
    )
    return (
        rows.drop("_found").join(covered, "_rid", "left").join(named, "_rid", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        .withColumn("items", F.coalesce(F.sort_array("_ids"), F.array().cast("array<string>")))
        .withColumn("n_items", F.size("items").cast("long") + F.coalesce("_nameless", F.lit(0).cast("long")))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))
        .drop("_rid", "_ids", "_nameless")
    )


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words inside benchmark windows, the items met."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, read(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


SQL_2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS k,
    list_aggregate(ws[i : i + least(len(ws), 13) - 1], 'string_agg', ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, k, i, list_aggregate(ws[i : i + k - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes WHERE len(ws) >= k)
), met AS (
  SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id
)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
