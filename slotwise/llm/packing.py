"""Packing of documents into training sequences along a space-filling curve.

Word counts hashed to 256 cells are a document's vector; four fixed random
directions project it, and the four coordinates, cut into 4096 steps each, give
a place on a Hilbert curve. Documents are range sorted by that place, and each
range is one run of tokens cut every 4096: neighbours on the curve share
sequences, and only the last sequence of a range is padded.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm.arrays import SPACES, Words, pieces
from slotwise.llm.tables import read, shares, text_bytes, without, write_out

LENGTH, END_ID = 4096, 2
AXES, STEPS, CELLS = 4, 12, 256
RANGE_BYTES = 8_000_000
KEPT_WORDS = 200_000
OUT = ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def hilbert(points: np.ndarray, steps: int) -> np.ndarray:
    """Place on the Hilbert curve of points with ``steps`` bits per axis."""
    x = points.astype(np.uint64).copy()
    axes = x.shape[1]
    one, top = np.uint64(1), 1 << (steps - 1)
    q = top
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(axes):
            upper = (x[:, i] & np.uint64(q)) > 0
            swap = (x[:, 0] ^ x[:, i]) & low
            x[:, 0] = np.where(upper, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] = np.where(upper, x[:, i], x[:, i] ^ swap)
        q >>= 1
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    q = top
    while q > 1:
        turn = np.where((x[:, axes - 1] & np.uint64(q)) > 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    x ^= turn[:, None]
    place = np.zeros(len(x), np.uint64)
    for bit in range(steps - 1, -1, -1):
        for i in range(axes):
            place = (place << one) | ((x[:, i] >> np.uint64(bit)) & one)
    return place.astype(np.int64)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    directions = np.random.default_rng(7).standard_normal((CELLS, AXES))
    for batch in pieces(batches, "text"):
        words = Words(batch.column("text"), SPACES, lower=True)
        rows = batch.num_rows
        cell = words.doc * CELLS + (words.hash >> np.uint64(40)).astype(np.int64) % CELLS
        vectors = np.sqrt(np.bincount(cell, minlength=rows * CELLS).reshape(rows, CELLS))
        size = np.linalg.norm(vectors, axis=1, keepdims=True)
        vectors = vectors / np.where(size > 0, size, 1)
        points = vectors @ directions
        steps = 1 / (1 + np.exp(-2 * points)) * (2**STEPS - 1)
        place = hilbert(steps.astype(np.int64), STEPS)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(place)], [*batch.schema.names, "_place"]
        )


class _Kept(dict):
    """Results of ``make``; the ones before it, if asked for again, are taken over."""

    def __init__(self, make, before: dict):
        super().__init__()
        self.make, self.before = make, before

    def __missing__(self, key: str) -> bytes:
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def turned(self, most: int) -> _Kept:
        """Itself, or an empty one after it if it holds over ``most``: two at once, so that frequent words stay."""
        if len(self) <= most:
            return self
        self.before = {}
        return _Kept(self.make, self)


class WordIds:
    """Token ids of texts, word by word.

    The tokenizer splits at white space first, so a text is the sum of its
    words and an id list once made serves all later places of a word. Words
    of ASCII and Latin letters go straight to the model; all others take the
    library's whole way. Words are kept between the tasks of a worker, up to
    a number that bounds the memory and changes no result.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.parts = re.compile(
            "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+"
        )
        self.plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]*\Z")
        # the byte alphabet of the model: printable bytes stand for themselves
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(hidden)})
        self.words = _Kept(self._word, {})

    @classmethod
    def kept(cls, path: str) -> WordIds:
        """That of this worker, which outlives its tasks: reading the tokenizer takes as long as 500 texts."""
        here = tokenizers.__dict__.setdefault("_slotwise_words", {})
        if path not in here:
            here[path] = cls(path)
        return here[path]

    def _piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself
        raw = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet)
        ids = [t.id for t in self.tokenize(raw)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        if word.isascii():
            if word.isalpha():  # one piece
                return self._piece(word) if word.islower() else self.words[word.lower()]
            head, last = word[:-1], word[-1:]
            if head.isalpha() and "!" <= last <= "~" and not last.isalnum():  # and a sign after it
                return self.words[head.lower()] + self.words[last]
        if self.plain.match(word) and "<|" not in word:
            parts = self.parts.findall(word.lower())
            return self._piece(parts[0]) if parts == [word] else b"".join([self.words[p] for p in parts])
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        out = b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        self.words = self.words.turned(KEPT_WORDS)
        return out


def _sequences(
    batches: Iterator[pa.RecordBatch], path: str, length: int, end_id: int
) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents of one range, in its order."""
    encoder = WordIds.kept(path)
    last = np.array([end_id], "<u4").tobytes()
    sequence, used = TaskContext.get().partitionId() << 32, 0
    for batch in pieces(batches, "text"):
        rows, starts, blobs, totals, sequences, offsets = [], [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            ids = encoder.ids(text or "") + last
            total, at = len(ids) // 4, 0
            while at < total:
                n = min(total - at, length - used)
                rows.append(i)
                starts.append(at)
                blobs.append(ids[4 * at : 4 * (at + n)])
                totals.append(total)
                sequences.append(sequence)
                offsets.append(used)
                at, used = at + n, used + n
                if used == length:
                    sequence, used = sequence + 1, 0
        kept = batch.drop_columns(["text", "_place", "_tie"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [
                *kept.columns, pa.array(starts, pa.int64()), pa.array([len(b) // 4 for b in blobs], pa.int64()),
                pa.array(blobs, pa.binary()), pa.array(totals, pa.int64()),
                pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()),
            ],
            [*kept.schema.names, *OUT],
        )


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents, packed into sequences of ``length`` tokens.

    A document is its token ids and ``end_id``; a null or empty text is that
    id alone. Returns the columns of ``docs`` but ``text``, and per piece:
    ``start`` and ``length`` in the document, ``ids`` (unsigned little-endian
    32-bit), ``doc_tokens``, ``sequence_id`` and ``offset`` in the sequence.
    Input columns with those names give way. Repeated rows are packed as often
    as they come. Rows of one place are told apart by a hash of their id and
    text, so that a large group of copies spreads over many ranges.
    """
    base = without(docs, *OUT, "_place", "_tie")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
    placed = write_out(base.mapInArrow(_places, ", ".join([*fields, "_place long"])))
    keys = [c for c in base.columns if c in ("doc_id", "text")]
    ranges = shares(text_bytes(placed), RANGE_BYTES)
    ordered = (
        placed.withColumn("_tie", F.xxhash64(*keys))
        .repartitionByRange(ranges, "_place", "_tie")
        .sortWithinPartitions("_place", "_tie")
    )
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text"]
    schema = ", ".join(
        [*kept, "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"]
    )
    return ordered.mapInArrow(lambda b: _sequences(b, tokenizer_path, length, end_id), schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece: its place in document and sequence, and the checksum of its ids."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
