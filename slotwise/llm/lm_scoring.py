"""Stupid-backoff language-model scores from counts of the whole corpus.

Count tables of all n-grams up to three words are partitioned by hash. A chunk
of about four megabytes of documents sends each partition one row with the
distinct n-grams it has there and their counts; the partition adds up and
answers with the corpus count of each. The chunk, read again from the same
exchange, looks its n-grams up and sums the scores of each document.

A document is scored by the other documents: its own occurrences are taken off
all counts, else every n-gram would be known. So words and pairs go first, and a
longer n-gram is sent only if both n-grams that it extends occur in another
document; one that is not sent can't occur there either. N-grams are told apart
by 48 bits of hash within a partition and the partition's own bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm.arrays import BASE_1, SPACES, Words, distinct as _distinct, mix, pieces
from slotwise.llm.tables import BUCKET_BYTES, chunk_of, read, shares, text_bytes, without

ORDER, BACKOFF = 3, 0.4
CHUNK_BYTES = 4_000_000
OUT = ("n_words", "log_score", "mean_log_score", "n_known")
TOTAL_KEY = np.uint64(0x5DEECE66D1234567)
SENT = "_chunk long, _part long, _hashes binary, _counts binary, _large binary"


def _deflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the exchange that all steps read."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in pieces(batches, "text"):
        texts = pa.array([pack((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [*batch.drop_columns(["text"]).columns, texts], [*batch.drop_columns(["text"]).schema.names, "_packed"]
        )


def _words(docs: pa.Table) -> Words:
    unpack = zstandard.ZstdDecompressor().decompress
    return Words(pa.array([unpack(t) for t in docs.column("_packed").to_pylist()], pa.binary()), SPACES, lower=True)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a key: the whole part of parts * key / 2^64, so in the order of the keys."""
    n, half = np.uint64(parts), np.uint64(32)
    return (((keys >> half) * n + ((keys & np.uint64(0xFFFFFFFF)) * n >> half)) >> half).astype(np.int64)


def _within(keys: np.ndarray, parts: int) -> np.ndarray:
    """48 bits of a key's place in its partition, in the order of the keys."""
    return keys * np.uint64(parts) >> np.uint64(16)


def _packed_keys(places: np.ndarray) -> bytes:
    """Sorted 48-bit numbers: their highest bytes deflated, the others as they are."""
    raw = places.astype("<u8").view(np.uint8).reshape(-1, 8)
    top = zlib.compress(raw[:, 5].tobytes(), 6)
    return len(top).to_bytes(4, "little") + top + raw[:, :5].tobytes()


def _unpacked_keys(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(blob, np.uint8, offset=4 + size).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    wide[:, 5] = np.frombuffer(zlib.decompress(blob[4 : 4 + size]), np.uint8)
    return wide.view("<u8").ravel()


def _packed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as single bytes, deflated; those of 255 and more follow in full."""
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), 6), counts[counts >= 255].astype(np.int64).tobytes()


def _unpacked(small: bytes, large: bytes) -> np.ndarray:
    counts = np.frombuffer(zlib.decompress(small), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(large, np.int64)
    return counts


def _rows(chunk: list, part: list, hashes: list[bytes], counts: list[np.ndarray]) -> pa.Table:
    packed = [_packed(c) for c in counts]
    return pa.table(
        {
            "_chunk": pa.array(chunk, pa.int64()), "_part": pa.array(part, pa.int64()),
            "_hashes": pa.array(hashes, pa.binary()),
            "_counts": pa.array([p[0] for p in packed], pa.binary()), "_large": pa.array([p[1] for p in packed], pa.binary()),
        }
    )


def _sent(chunk: int, distinct: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """One row per partition with its keys, in their order."""
    part = _part(distinct, parts)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)
    places = _within(distinct, parts)
    spans = list(zip(bounds[:-1], bounds[1:], strict=True))
    return _rows(
        [chunk] * len(spans), part[bounds[:-1]].tolist(), [_packed_keys(places[a:b]) for a, b in spans], [counts[a:b] for a, b in spans]
    )


def _levels(words: Words, order: int, totals: list[np.ndarray]):
    """Counts in other documents, as far as ``totals`` reach, and the keys to be counted next.

    The first level holds words and pairs, each further one the next longer
    n-grams. Counts are arrays by first word, zero where there is no n-gram.
    """
    others: dict[int, np.ndarray] = {}
    all_words = 0
    for level in range(max(1, order - 1)):
        sizes = range(1, min(2, order) + 1) if level == 0 else [level + 2]
        places = []
        for n in sizes:
            at = words.windows(n)
            if level:
                at = at[(others[n - 1][at] > 0) & (others[n - 1][at + 1] > 0)]
            places.append(at)
        keys = np.concatenate([mix(words.rolling(n, BASE_1, at) + np.uint64(n)) for n, at in zip(sizes, places, strict=True)])
        distinct, number, counts = _distinct(keys)
        if level == len(totals):
            if level == 0:
                at = int(np.searchsorted(distinct, TOTAL_KEY))
                return others, 0, (np.insert(distinct, at, TOTAL_KEY), np.insert(counts, at, len(words)))
            return others, all_words, (distinct, counts)
        elsewhere = totals[level]
        if level == 0:
            at = int(np.searchsorted(distinct, TOTAL_KEY))
            all_words, elsewhere = int(elsewhere[at]) + len(words), np.delete(elsewhere, at)
        # own occurrences: one, but where the chunk has more and the document is to be asked
        own = np.ones(len(keys), np.int64)
        often = np.flatnonzero(counts[number] > 1)
        doc = np.concatenate([words.doc[at] for at in places])
        _, same, many = _distinct((doc[often] * np.int64(max(len(distinct), 1)) + number[often]).view(np.uint64))
        own[often] = many[same]
        found = (elsewhere + counts)[number] - own
        begin = 0
        for n, at in zip(sizes, places, strict=True):
            others[n] = np.zeros(len(words) + 1, np.int64)
            others[n][at] = found[begin : begin + len(at)]
            begin += len(at)
    return others, all_words, None


def _totals(replies: pa.Table) -> list[np.ndarray]:
    """Counts in other chunks, by level: what the chunk kept of earlier ones, and the answers, by partition."""
    kept, new = [], []
    for part, hashes, small, large in zip(
        *(replies.sort_by("_part").column(c).to_pylist() for c in ("_part", "_hashes", "_counts", "_large")), strict=True
    ):
        counts = _unpacked(small, large)
        if part < 0:
            kept = np.split(counts, np.cumsum(np.frombuffer(hashes, np.int64))[:-1])
        else:
            new.append(counts)
    return [*kept, np.concatenate(new) if new else np.zeros(0, np.int64)]


def _send(docs: pa.Table, replies: pa.Table | None, order: int, parts: int) -> pa.Table:
    """The next level's keys of a chunk; what earlier levels found goes along, to the chunk itself."""
    words = _words(docs)
    chunk = docs.column("_chunk")[0].as_py()
    totals = [] if replies is None else _totals(replies)
    _, _, (distinct, counts) = _levels(words, order, totals)
    out = _sent(chunk, distinct, counts, parts)
    if not totals:
        return out
    sizes = np.array([len(t) for t in totals], np.int64)
    return pa.concat_tables([out, _rows([chunk], [-1 - chunk], [sizes.tobytes()], [np.concatenate(totals)])])


def _count(rows: pa.Table) -> pa.Table:
    """Counts in other chunks of what was sent to this partition, in the order it was sent."""
    if rows.column("_part")[0].as_py() < 0:
        return rows
    sent = rows.column("_hashes").to_pylist()
    keys = np.concatenate([_unpacked_keys(blob) for blob in sent])
    counts = [
        _unpacked(small, large)
        for small, large in zip(rows.column("_counts").to_pylist(), rows.column("_large").to_pylist(), strict=True)
    ]
    _, number, _ = _distinct(keys)
    sums = np.zeros(int(number.max()) + 1, np.int64)
    own = np.concatenate(counts)
    np.add.at(sums, number, own)
    answers = np.split(sums[number] - own, np.cumsum([len(c) for c in counts])[:-1])
    return _rows(rows.column("_chunk").to_pylist(), rows.column("_part").to_pylist(), [b""] * len(sent), answers)


def _score(docs: pa.Table, replies: pa.Table, order: int, backoff: float) -> pa.Table:
    words = _words(docs)
    others, all_words, _ = _levels(words, order, _totals(replies))
    n = len(words)
    score, done = np.zeros(n), np.zeros(n, bool)
    known = np.zeros(docs.num_rows, np.int64)
    rest = (all_words - words.count)[words.doc]
    for size in range(order, 0, -1):
        start = words.windows(size)
        end = start + size - 1
        here = others[size][start]
        below = others[size - 1][start] if size > 1 else rest[end]
        use = (here > 0) & ~done[end]
        score[end[use]] += np.log(here[use] / below[use])
        done[end[use]] = True
        if size == order and n:
            known = np.bincount(words.doc[end[use]], minlength=docs.num_rows)
        if size > 1:
            score[end[~done[end]]] += np.log(backoff)
    score[~done] -= np.log(rest[~done] + 1.0)
    sums = np.bincount(words.doc, score, docs.num_rows)
    mean = sums / np.maximum(words.count, 1)
    return (
        docs.drop_columns(["_chunk", "_packed"])
        .append_column("n_words", pa.array(words.count, pa.int64()))
        .append_column("log_score", pa.array(sums, mask=words.count == 0))
        .append_column("mean_log_score", pa.array(mean, mask=words.count == 0))
        .append_column("n_known", pa.array(known, pa.int64()))
    )


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """Each document's score under the n-gram counts of all other documents.

    A word takes the longest n-gram ending in it that occurs in another
    document: its count over that of its first words, times ``backoff`` for
    each order given up; a word of no other document takes one over one more
    than the words of the others. Words are lower-cased (A-Z) and split at
    ASCII white space; an n-gram lies in one document.

    Returns the columns of ``docs`` but ``text``, and ``n_words``,
    ``log_score`` (sum of natural logarithms), ``mean_log_score`` and
    ``n_known`` (words whose n-gram of full order is known). A text without
    words, or null, has null scores. Repeated rows are different documents and
    know each other. Input columns with those names give way.
    """
    total = text_bytes(docs)
    chunks, parts = shares(total, CHUNK_BYTES), shares(total, BUCKET_BYTES)
    base = without(docs, *OUT, "_chunk", "_packed")
    keys = [c for c in base.columns if c in ("doc_id", "text")]
    dealt = base.withColumn("_chunk", chunk_of(chunks, *keys))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text"]
    by_chunk = dealt.mapInArrow(_deflated, ", ".join([*kept, "_chunk long, _packed binary"])).groupBy("_chunk")
    replies = by_chunk.applyInArrow(lambda t: _send(t, None, order, parts), SENT).groupBy("_part").applyInArrow(_count, SENT)
    for _ in range(3, order + 1):
        replies = (
            by_chunk.cogroup(replies.groupBy("_chunk"))
            .applyInArrow(lambda t, found: _send(t, found, order, parts), SENT)
            .groupBy("_part").applyInArrow(_count, SENT)
        )
    schema = ", ".join([*kept, "n_words long, log_score double, mean_log_score double, n_known long"])
    return by_chunk.cogroup(replies.groupBy("_chunk")).applyInArrow(
        lambda t, found: _score(t, found, order, backoff), schema
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words of known trigrams, and score, rounded to six places."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs).select(
        "doc_id", "n_words", "n_known",
        F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"),
    )


SQL_9 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), p AS (
  SELECT doc_id, i, ws[i] AS w1, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS w2,
    CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS w3,
    CASE WHEN i > 1 THEN ws[i - 1] END AS c2,
    CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] END AS c3
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), g AS (
  SELECT doc_id, w1 AS k FROM p UNION ALL SELECT doc_id, w2 FROM p WHERE w2 IS NOT NULL
  UNION ALL SELECT doc_id, w3 FROM p WHERE w3 IS NOT NULL
), own AS (
  SELECT doc_id, k, count(*) AS n FROM g GROUP BY ALL
), other AS (
  SELECT doc_id, k, (sum(n) OVER (PARTITION BY k) - n)::BIGINT AS n FROM own
), size AS (
  SELECT doc_id, len(ws) AS n, (sum(len(ws)) OVER () - len(ws))::BIGINT AS rest FROM w
), s AS (
  SELECT p.doc_id, o3.n > 0 AS known,
    CASE WHEN o3.n > 0 THEN ln(o3.n / x3.n)
         WHEN o2.n > 0 THEN ln(o2.n / x2.n) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
         WHEN o1.n > 0 THEN ln(o1.n / rest) + least(i - 1, 2) * ln(0.4)
         ELSE least(i - 1, 2) * ln(0.4) - ln(rest + 1) END AS score
  FROM p JOIN size USING (doc_id)
  LEFT JOIN other o3 ON o3.doc_id = p.doc_id AND o3.k = w3
  LEFT JOIN other x3 ON x3.doc_id = p.doc_id AND x3.k = c3
  LEFT JOIN other o2 ON o2.doc_id = p.doc_id AND o2.k = w2
  LEFT JOIN other x2 ON x2.doc_id = p.doc_id AND x2.k = c2
  LEFT JOIN other o1 ON o1.doc_id = p.doc_id AND o1.k = w1
), sums AS (
  SELECT doc_id, sum(score) AS score, count(*) FILTER (WHERE known) AS n_known FROM s GROUP BY doc_id
)
SELECT doc_id, n AS n_words, coalesce(n_known, 0) AS n_known, round(score, 4) AS log_score,
  round(score / n, 6) AS mean_log_score
FROM size LEFT JOIN sums USING (doc_id)
"""
