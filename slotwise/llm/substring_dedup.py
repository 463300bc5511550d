"""Removal of repeated passages: fixed-block anchors, extended to exact repeats.

Any 35 consecutive words hold one whole block of 18 words that starts at a
multiple of 18 in its document. Those blocks are the index; every rolling
window of 18 words of every document probes it. Where a block is met a second
time, the 35-word windows around the hit are compared over the whole corpus by
128-bit hashes, and every word of a window that occurs again goes, so that what
goes is the union of the maximal exact repeats of at least 35 words.

Documents are dealt into chunks of about two megabytes by a hash. A chunk sends
each bucket of the hash space one row: the distinct hashes it has there. The
bucket answers with one bit per hash. A passage that a third of all documents
share so costs a bucket one entry per chunk, and no task ever sees a list of
the places of a passage. The three steps that read a chunk share one exchange
of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from slotwise.llm.arrays import BASE_1, BASE_2, SPACES, Words, binary_rows, cover, give_back, joined
from slotwise.llm.tables import BUCKET_BYTES, CHUNK_BYTES, chunk_of, shares, text_bytes, without

WINDOW = 35
PROBE = "_chunk long, _bucket long, _size int, _hashes binary, _flags binary"
REPLY = "_chunk long, _bucket long, _bits binary"


def _anchor_keys(words: Words, block: int, buckets: int):
    """Positions of all windows of ``block`` words and their key: bucket and 32 bits of hash."""
    at = words.windows(block)
    h = words.rolling(block, BASE_1, at)
    return at, ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _window_keys(words: Words, at: np.ndarray, window: int, buckets: int) -> np.ndarray:
    """Bucket and 128-bit hash of windows, as sortable rows."""
    h1, h2 = words.rolling(window, BASE_1, at), words.rolling(window, BASE_2, at)
    keys = np.empty(len(at), [("b", np.int64), ("h1", np.uint64), ("h2", np.uint64)])
    keys["b"], keys["h1"], keys["h2"] = (h1 >> np.uint64(20)) % np.uint64(buckets), h1, h2
    return keys


def _distinct(*columns: np.ndarray):
    """Order of the distinct rows: first places, number of each row, copies of each."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
    new = np.ones(n, bool)
    new[1:] = False
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    number = np.cumsum(new) - 1
    inverse = np.empty(n, np.int64)
    inverse[order] = number
    return order[new], inverse, np.bincount(number)


def _rows(chunk: int, bucket: np.ndarray, hashes: np.ndarray, width: int, flags: np.ndarray) -> pa.Table:
    """One row per bucket from entries in the order of their bucket."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    bounds = np.concatenate([[0], edges, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    n = len(bounds) - 1
    packed = [np.packbits(flags[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table(
        {
            "_chunk": pa.array(np.full(n, chunk, np.int64)),
            "_bucket": pa.array(bucket[bounds[:-1]].astype(np.int64)),
            "_size": pa.array(np.diff(bounds).astype(np.int32)),
            "_hashes": binary_rows(hashes, bounds * width),
            "_flags": pa.array(packed, pa.binary()),
        }
    )


def _probes(docs: pa.Table, block: int, buckets: int) -> pa.Table:
    """What a chunk sends: 4 bytes per distinct window, and which are blocks or repeat here."""
    words = Words(docs.column("text"), SPACES)
    at, keys = _anchor_keys(words, block, buckets)
    first, number, copies = _distinct(keys)
    indexed = (at - words.first[words.doc[at]]) % block == 0
    is_block = np.zeros(len(first), bool)
    is_block[number[indexed]] = True
    distinct = keys[first]
    chunk = docs.column("_chunk")[0].as_py()
    flags = np.stack([is_block, copies > 1], axis=1).astype(np.uint8)
    return _rows(chunk, distinct >> np.uint64(32), distinct.astype(np.uint32), 1, flags)


def _answer(rows: pa.Table, width: int) -> pa.Table:
    """One bit per hash sent to this bucket: met twice or more (and, if flagged so, a block)."""
    sizes = rows.column("_size").to_numpy()
    ends = np.cumsum(sizes)
    flags = [
        np.unpackbits(np.frombuffer(f, np.uint8), count=n * (2 if width == 1 else 1)).reshape(n, -1)
        for f, n in zip(rows.column("_flags").to_pylist(), sizes, strict=True)
    ]
    flags = np.concatenate(flags).astype(bool)
    raw = b"".join(rows.column("_hashes").to_pylist())
    if width == 1:
        _, number, copies = _distinct(np.frombuffer(raw, np.uint32))
        block = np.zeros(len(copies), bool)
        block[number[flags[:, 0]]] = True
    else:
        pairs = np.frombuffer(raw, np.uint64).reshape(-1, 2)
        _, number, copies = _distinct(pairs[:, 0], pairs[:, 1])
        block = np.ones(len(copies), bool)
    many = copies > 1
    many[number[flags[:, -1]]] = True
    bits = (many & block)[number]
    return pa.table(
        {
            "_chunk": rows.column("_chunk"),
            "_bucket": rows.column("_bucket"),
            "_bits": pa.array([np.packbits(b).tobytes() for b in np.split(bits, ends[:-1])], pa.binary()),
        }
    )


def _answers(rows: pa.Table) -> pa.Table:
    return _answer(rows, 1)


def _verdicts(rows: pa.Table) -> pa.Table:
    """Answers on 35-word windows; the marks that a chunk sends to itself pass through."""
    if rows.column("_bucket")[0].as_py() >= 0:
        return _answer(rows, 4)
    return pa.table(
        {"_chunk": rows.column("_chunk"), "_bucket": rows.column("_bucket"), "_bits": rows.column("_flags")}
    )


def _bits(replies: pa.Table, sizes: dict[int, int]) -> np.ndarray:
    """Answers in the order of the buckets."""
    found = dict(zip(replies.column("_bucket").to_pylist(), replies.column("_bits").to_pylist(), strict=True))
    parts = [np.unpackbits(np.frombuffer(found[b], np.uint8), count=n) for b, n in sizes.items()]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _sizes(bucket: np.ndarray) -> dict[int, int]:
    values, counts = np.unique(bucket, return_counts=True)
    return dict(zip(values.tolist(), counts.tolist(), strict=True))


def _in_order(docs: pa.Table) -> pa.Table:
    """The chunk's rows in the order of their texts: an exchange may give them in another order each time it is read."""
    return docs.take(pc.sort_indices(docs.column("text")))


def _candidates(docs: pa.Table, replies: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    """Windows around anchor hits, for comparison, and the marks of where they start."""
    docs = _in_order(docs)
    words = Words(docs.column("text"), SPACES)
    at, keys = _anchor_keys(words, block, buckets)
    first, number, _ = _distinct(keys)
    hit = _bits(replies, _sizes(keys[first] >> np.uint64(32)))
    starts = words.windows(window)
    sums = np.zeros(len(words) + 1, np.int64)
    anchored = np.zeros(len(words), np.int64)
    anchored[at] = hit[number] if len(number) else 0
    np.cumsum(anchored, out=sums[1:])
    near = sums[starts + window - block + 1] > sums[starts]
    marks = np.zeros(len(words), np.uint8)
    marks[starts[near]] = 1
    chunk = docs.column("_chunk")[0].as_py()
    window_keys = _window_keys(words, starts[near], window, buckets)
    first, _, copies = _distinct(window_keys["b"], window_keys["h1"], window_keys["h2"])
    distinct = window_keys[first]
    hashes = np.stack([distinct["h1"], distinct["h2"]], axis=1).ravel()
    out = _rows(chunk, distinct["b"], hashes, 2, (copies > 1).astype(np.uint8))
    own = pa.table(
        {
            "_chunk": pa.array([chunk], pa.int64()), "_bucket": pa.array([-1 - chunk], pa.int64()),
            "_size": pa.array([0], pa.int32()), "_hashes": pa.array([b""], pa.binary()),
            "_flags": pa.array([np.packbits(marks).tobytes()], pa.binary()),
        }
    )
    return pa.concat_tables([out, own])


def _without(words: Words, texts: pa.ChunkedArray, gone: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Texts less the bytes from each removed run to the next word, or back to the word before a last run."""
    out, raw = {}, words.bytes.tobytes()
    first, offsets = words.first, words.offsets
    row = words.doc[begin] if len(begin) else np.zeros(0, np.int64)
    for i in np.unique(row).tolist():
        at, kept = int(offsets[i]), []
        end = int(offsets[i + 1]) - 1
        for b, e in zip(begin[row == i].tolist(), stop[row == i].tolist(), strict=True):
            if e < first[i + 1]:
                kept.append(raw[at : words.start[b]])
                at = int(words.start[e])
            else:
                kept.append(raw[at : words.end[b - 1]] if b > first[i] else b"")
                at = end
        out[i] = b"".join([*kept, raw[at:end]]).decode()
    changed = np.zeros(len(texts), bool)
    changed[list(out)] = True
    return pc.replace_with_mask(texts.combine_chunks(), pa.array(changed), pa.array(list(out.values()), pa.string()))


def _cut(docs: pa.Table, replies: pa.Table, window: int, buckets: int, cut_text: bool) -> pa.Table:
    """The chunk's documents without the words of repeated windows."""
    docs = _in_order(docs)  # that of the marks
    words = Words(docs.column("text"), SPACES)
    chunk = docs.column("_chunk")[0].as_py()
    marks = next(
        b for k, b in zip(replies.column("_bucket").to_pylist(), replies.column("_bits").to_pylist(), strict=True)
        if k == -1 - chunk
    )
    starts = np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8), count=len(words)))
    keys = _window_keys(words, starts, window, buckets)
    first, number, _ = _distinct(keys["b"], keys["h1"], keys["h2"])
    again = _bits(replies, _sizes(keys["b"][first]))
    gone = cover(starts[again[number]] if len(starts) else starts, window, len(words))
    removed = np.bincount(words.doc[gone], minlength=docs.num_rows)
    edges = np.diff(gone.astype(np.int8), prepend=0, append=0)
    # runs of removed words, cut where a document ends
    begin = np.flatnonzero(edges == 1)
    stop = np.flatnonzero(edges == -1)
    inner = words.first[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(words))])
    both = inner[gone[inner] & gone[inner - 1]] if len(words) else inner
    begin, stop = np.sort(np.concatenate([begin, both])), np.sort(np.concatenate([stop, both]))
    row = words.doc[begin] if len(begin) else np.zeros(0, np.int64)
    base = words.first[row]
    spans = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=docs.num_rows))]).astype(np.int32)),
        pa.StructArray.from_arrays(
            [pa.array(begin - base, pa.int64()), pa.array(stop - base, pa.int64())], ["first", "end"]
        ),
    )
    out = (
        docs.drop_columns(["_chunk", "text"])
        .append_column("kept_text", joined(words, ~gone))
        .append_column("n_words", pa.array(words.count, pa.int64()))
        .append_column("n_removed", pa.array(removed, pa.int64()))
        .append_column("removed_spans", spans)
    )
    return out.append_column("cut_text", _without(words, docs.column("text"), gone, begin, stop)) if cut_text else out


def remove_repeats(docs: DataFrame, window: int = WINDOW, cut_text: bool = False) -> DataFrame:
    """Each document without the words of any ``window``-word passage that occurs elsewhere.

    Words are runs of bytes other than space, tab and line ends. Returns the
    columns of ``docs`` but ``text``, and ``kept_text`` (kept words joined by
    one space), ``n_words``, ``n_removed`` and ``removed_spans`` (word numbers
    first and end, end excluded). With ``cut_text`` also a column of that name: the
    text as it was, less each removed run of words and the space after it; a text
    that loses nothing stays byte for byte, and a null stays null. Input columns
    with those names give way.

    A null or empty text has no words and an empty ``kept_text``. A repeated
    row is another document: its windows occur elsewhere and go. Null ids and
    an empty table are allowed. Windows that overlap their own repetition in
    one document count as well.
    """
    block = (window + 1) // 2
    total = text_bytes(docs)
    chunks, buckets = shares(total, CHUNK_BYTES), shares(total, BUCKET_BYTES)
    names = ("_chunk", "kept_text", "n_words", "n_removed", "removed_spans", *(["cut_text"] if cut_text else []))
    dealt = without(docs, *names)
    dealt = dealt.withColumn("_chunk", chunk_of(chunks, "text", *([c for c in dealt.columns if c == "doc_id"])))
    by_chunk = dealt.groupBy("_chunk")

    def probes(table: pa.Table) -> pa.Table:
        give_back()
        return _probes(table, block, buckets)

    def candidates(table: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        return _candidates(table, replies, window, block, buckets)

    def cut(table: pa.Table, replies: pa.Table) -> pa.Table:
        give_back()
        return _cut(table, replies, window, buckets, cut_text)

    anchors = by_chunk.applyInArrow(probes, PROBE).groupBy("_bucket").applyInArrow(_answers, REPLY)
    compared = (
        by_chunk.cogroup(anchors.groupBy("_chunk")).applyInArrow(candidates, PROBE)
        .groupBy("_bucket").applyInArrow(_verdicts, REPLY)
    )
    kept = [f for f in dealt.schema.fields if f.name not in ("_chunk", "text")]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
        + ["kept_text string, n_words long, n_removed long, removed_spans array<struct<first:long,end:long>>"]
        + (["cut_text string"] if cut_text else [])
    )
    return by_chunk.cogroup(compared.groupBy("_chunk")).applyInArrow(cut, schema)


def op1_substring_dedup(spark, sf_dir):
    """Per document: words, words removed, digest of the words kept, and those words."""
    from slotwise.llm.tables import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text"
    )


SQL_1 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), n AS (
  SELECT doc_id, ws, len(ws) AS n_words FROM w
), starts AS (
  SELECT doc_id, s, list_aggregate(ws[s : s + 34], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, n_words - 33)) AS s FROM n WHERE n_words >= 35)
), hit AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY md5(win)) AS c FROM starts) WHERE c > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM hit
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, n_words + 1)) AS p FROM n
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS k
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT n.doc_id, n_words, n_words - coalesce(k, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256,
  coalesce(kept, '') AS kept_text
FROM n LEFT JOIN kept ON n.doc_id = kept.doc_id
"""
