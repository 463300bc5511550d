"""Alignment of two tokenizers' tokens, with corpus-wide counts of linked ids.

A text is cut into units, each a space and what follows it up to the next space
between two visible characters. Neither tokenizer joins bytes across that place,
so a unit is encoded once per chunk however often it occurs, and tokens, groups
and links of a text are those of its units in turn.

A first pass aligns every document and leaves, per chunk, each linked pair of
ids with its number of links there. The distinct pairs, dealt by their second id,
get a minimal perfect hash per bucket (bit levels: a key that meets no other key
in a level is placed there, the rest go on to the next; its number is the count
of set bits before its own). Counts are dense vectors indexed by that hash: one
per bucket and group of chunks, summed as a tree. The keys are kept in the
order of the hash, so every look-up is verified. A second pass aligns the
documents again and takes the counts that their chunk asked for.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm.arrays import BASE_1, BASE_2, binary_rows, mix, powers, text_buffers
from slotwise.llm.tables import BUCKET_BYTES, arrow_rows, read, shares, text_bytes, without, write_out

CHUNK_BYTES = 3_000_000
ARROW_ROWS = 2000
OUT_ROWS = 64
BATCH = 1024
FAN = 32
GROUP_CHUNKS = 700
BUCKETS = 4096  # buckets hold whole second ids, of which there are a few ten thousand
OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
ENTRIES = "_chunk long, _bucket long, _group long, _keys binary, _counts binary"
VECTOR = "_bucket long, _group long, _keys binary"
HASH = "_bucket long, _sizes array<long>, _bits binary, _keys binary"
SUMS = "_bucket long, _group long, _sums binary"
TABLE = f"{HASH}, _sums binary, _best binary"

UNIT = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Texts with a space at an end or next to other white space; in all others every space begins a unit.
ODD_SPACE = f"^ | $|{_SPACE} | {_SPACE}"
#: Units for the fast encoder: Latin letters, no white space at either end.
PLAIN = re.compile("(?!\\s)[\x00-ɏ]{1,1000}(?<!\\s)")
#: Fixed value: how byte_bpe_50k splits text before its merges.
SPLITS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoders:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            special = {t["id"] for t in json.load(f)["added_tokens"]}
        # the byte alphabet of the vocabulary: printable bytes stand for themselves
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = entry.encode() if i in special else bytes(letters[c] for c in entry)
        ranks = {b: i for i, b in enumerate(self.bytes_a) if i not in special}
        self.fast = tiktoken.Encoding("a", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(self.b.vocab_size())
        ]
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])

    def encode(self, plain: list[str], rest: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers for all units, their spaces included, and how many each unit has."""
        parts = [([], [], [], [])]
        for start in range(0, len(plain), BATCH):
            units = plain[start : start + BATCH]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(units)), np.int64)
            ends = np.searchsorted(np.cumsum(self.size_a[ids]), np.cumsum(byte_sizes(units))) + 1
            parts.append((ids, np.diff(ends, prepend=0), *_flat(self.b.encode(units, num_threads=1))))
        for start in range(0, len(rest), BATCH):
            units = rest[start : start + BATCH]
            found = self.a.encode_batch([" " + u for u in units], add_special_tokens=False)
            parts.append((*_flat([e.ids for e in found]), *_flat(self.b.encode(units, num_threads=1))))
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, n.sum()), n


def byte_sizes(units: list[str]) -> np.ndarray:
    """Bytes of each unit with its space."""
    return np.fromiter(map(len, map(str.encode, units)), np.int64, len(units)) + 1


def split_units(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Units of all texts in a row, without their space, and where each text's begin; an empty one has none."""
    texts = pc.fill_null(texts, "").combine_chunks()
    odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False).astype(bool)
    usual = ~odd & (pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0)
    lists = pc.split_pattern(texts.filter(pa.array(usual)), " ")
    rows = [UNIT.split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
    values = pa.concat_arrays([lists.flatten(), pa.array(chain.from_iterable(rows), pa.string())])
    n = np.zeros(len(texts), np.int64)
    n[usual], n[odd] = lists.value_lengths().to_numpy(), [len(r) for r in rows]
    first = np.concatenate([[0], np.cumsum(n)])
    # the values hold the usual texts' units first
    start = np.empty(len(texts), np.int64)
    start[usual], start[odd] = np.cumsum(n[usual]) - n[usual], n[usual].sum() + np.cumsum(n[odd]) - n[odd]
    if odd.any():
        values = values.take(pa.array(np.repeat(start - first[:-1], n) + np.arange(first[-1])))
    return values, first


def encoders(paths: tuple[str, str]) -> Encoders:
    """The tokenizers of a worker, loaded once; this module is new to every task, the library is not."""
    kept = tokenizers.__dict__.setdefault("_slotwise_encoders", {})
    if paths not in kept:
        kept[paths] = Encoders(*paths)
    return kept[paths]


class Aligned:
    """Units of some texts, their tokens and links; ``valid`` tells which texts have tokens."""

    def __init__(self, texts: pa.ChunkedArray, paths: tuple[str, str]):
        codes = encoders(paths)
        values, self.first = split_units(texts)
        coded = values.dictionary_encode()
        distinct, found = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        is_plain = np.fromiter(map(bool, map(PLAIN.fullmatch, distinct)), bool, len(distinct))
        plain, rest = list(compress(distinct, is_plain)), list(compress(distinct, ~is_plain))
        place = np.where(is_plain, np.cumsum(is_plain) - 1, len(plain) + np.cumsum(~is_plain) - 1)
        self.units = place[found] if len(found) else np.zeros(0, np.int64)
        del values, coded, distinct, found
        self.a, self.n_a, self.b, self.n_b = codes.encode(plain, rest)
        same = self._same(plain, rest, codes)
        if not same.all():
            self.a, self.b = self.a[np.repeat(same, self.n_a)], self.b[np.repeat(same, self.n_b)]
            self.n_a, self.n_b = np.where(same, self.n_a, 0), np.where(same, self.n_b, 0)
        self.end_a, self.end_b = np.cumsum(codes.size_a[self.a]), np.cumsum(codes.size_b[self.b])
        self.valid = (self.sums(~same) == 0) & (np.diff(self.first) > 0)
        self._links(codes)

    def _same(self, plain: list[str], rest: list[str], codes: Encoders) -> np.ndarray:
        """Which units both tokenizers give back byte for byte.

        Plain units have no letter that the second one writes as a space, so
        equal lengths tell; the others are compared.
        """
        same = np.ones(len(plain) + len(rest), bool)
        wanted = byte_sizes(plain)
        for ids, n, parts, size in (
            (self.a, self.n_a, codes.bytes_a, codes.size_a), (self.b, self.n_b, codes.bytes_b, codes.size_b),
        ):
            last = np.cumsum(n)
            sums = np.concatenate([[0], np.cumsum(size[ids])])
            same[: len(plain)] &= np.diff(sums[last[: len(plain)]], prepend=0) == wanted
            first = (last - n).tolist()
            for i, unit in enumerate(rest, len(plain)):
                same[i] &= b"".join([parts[x] for x in ids[first[i] : last[i]].tolist()]) == b" " + unit.encode()
        return same

    def _links(self, codes: Encoders) -> None:
        start_a, start_b = self.end_a - codes.size_a[self.a], self.end_b - codes.size_b[self.b]
        low = np.searchsorted(self.end_b, start_a, side="right")
        many = np.searchsorted(start_b, self.end_a, side="left") - low
        before = np.cumsum(many) - many
        at = np.repeat(low - before, many) + np.arange(many.sum())
        self.link_unit = np.repeat(np.repeat(np.arange(len(self.n_a)), self.n_a), many)
        self.link_key = (self.b[at] << 32) | np.repeat(self.a, many)
        self.cuts = np.intersect1d(self.end_a, self.end_b, assume_unique=True)
        unit_ends = np.concatenate([[0], self.end_a])[np.cumsum(self.n_a)]
        self.group_ends = np.searchsorted(self.cuts, unit_ends, side="right")

    def sums(self, of_unit: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value over its units."""
        total = np.concatenate([[0], np.cumsum(of_unit.astype(np.int64)[self.units])])
        return total[self.first[1:]] - total[self.first[:-1]]

    def per_unit(self, of_link: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n_a), np.int64)
        np.add.at(out, self.link_unit, of_link)
        return out

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs (second id above the first id) and their links in the valid texts."""
        counted = np.repeat(self.valid, np.diff(self.first))
        times = np.bincount(self.units[counted], minlength=len(self.n_a))
        keys, number = np.unique(self.link_key, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, number, times[self.link_unit])
        return keys[counts > 0], counts[counts > 0]

    def group_texts(self) -> Iterator[str]:
        """Per text, its groups as ``a1,a2|b1;a3|b2,b3``; each distinct group is written once."""
        to_a, to_b = np.searchsorted(self.end_a, self.cuts) + 1, np.searchsorted(self.end_b, self.cuts) + 1
        from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
        keys = [
            mix(_runs(self.a, from_a, to_a, base) + np.uint64(3) * _runs(self.b, from_b, to_b, base))
            for base in (BASE_1, BASE_2)
        ]
        order = np.lexsort(keys)
        new = np.ones(len(order), bool)
        new[1:] = (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        written = [
            ",".join(map(str, self.a[i:j].tolist())) + "|" + ",".join(map(str, self.b[k:m].tolist()))
            for i, j, k, m in zip(*(x[order[new]].tolist() for x in (from_a, to_a, from_b, to_b)), strict=True)
        ]
        # the groups of each text in turn, unit by unit
        many = np.diff(self.group_ends, prepend=0)
        each = many[self.units]
        before = np.cumsum(each) - each
        at = np.repeat((self.group_ends - many)[self.units] - before, each) + np.arange(each.sum())
        groups = number[at]
        ends = np.concatenate([[0], np.cumsum(each)])[self.first].tolist()
        for ok, i, j in zip(self.valid, ends[:-1], ends[1:], strict=True):
            yield ";".join(map(written.__getitem__, groups[i:j].tolist())) if ok else ""


def _runs(ids: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of ``ids[start[i]:end[i]]``."""
    up, down = powers(base, len(ids))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.view(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


class BitLevels:
    """A minimal perfect hash of distinct longs."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits) - 1

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        spread = mix(keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level + 1))
        return (spread % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> BitLevels:
        sizes, parts, left = [], [], keys
        while len(left):
            size = -(-2 * len(left) // 8) * 8
            at = cls.place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Numbers from 0 of the keys hashed; -1 or any number for others."""
        out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self.place(keys[left], level, size)
            here = self.bits[at]
            out[left[here]] = self.rank[at[here]]
            left, base = left[~here], base + size
        return out


def _longs(rows: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in rows.column(name).to_pylist()]


def _blob(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


def _dealt(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Number the chunks of a partition: about ``size`` bytes of text in a row."""
    chunk, used = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        _, offsets = text_buffers(batch.column("text"))
        before = used + offsets[:-1]
        used += int(offsets[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(chunk + before // size)], [*batch.schema.names, "_chunk"]
        )


def _entries(
    batches: Iterator[pa.RecordBatch], paths: tuple[str, str], buckets: int, groups: int
) -> Iterator[pa.RecordBatch]:
    """First pass: the pairs of each chunk, one row per bucket."""
    for batch in batches:
        chunks = batch.column("_chunk").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if start == end:
                continue
            pa.default_memory_pool().release_unused()  # the allocator keeps what earlier chunks freed
            keys, counts = Aligned(pa.chunked_array([batch.column("text").slice(start, end - start)]), paths).pair_counts()
            bucket = (mix(keys.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order], bucket[order]
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            n = len(bounds) - 1
            chunk = int(chunks[start])
            group = int(mix(np.array([chunk], np.uint64))[0]) % groups
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, chunk)), pa.array(bucket[bounds[:-1]]), pa.array(np.full(n, group)),
                    binary_rows(keys, bounds), binary_rows(counts, bounds),
                ],
                ["_chunk", "_bucket", "_group", "_keys", "_counts"],
            )


def _union(rows: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate(_longs(rows, "_keys")))
    return pa.table({"_bucket": rows.column("_bucket")[:1], "_group": rows.column("_group")[:1], "_keys": _blob(keys)})


def _hashed(rows: pa.Table) -> pa.Table:
    """The minimal perfect hash of one bucket's keys, and the keys in its order."""
    keys = np.concatenate(_longs(rows, "_keys"))
    levels = BitLevels.build(keys)
    ordered = np.empty_like(keys)
    ordered[levels.index(keys)] = keys
    return pa.table(
        {
            "_bucket": rows.column("_bucket")[:1], "_sizes": pa.array([levels.sizes], pa.list_(pa.int64())),
            "_bits": pa.array([np.packbits(levels.bits).tobytes()], pa.binary()), "_keys": _blob(ordered),
        }
    )


def _levels(rows: pa.Table) -> tuple[BitLevels, np.ndarray]:
    sizes = rows.column("_sizes")[0].as_py()
    bits = np.unpackbits(np.frombuffer(rows.column("_bits")[0].as_py(), np.uint8), count=sum(sizes)).astype(bool)
    return BitLevels(sizes, bits), _longs(rows, "_keys")[0]


def _verified(levels: BitLevels, ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = levels.index(keys)
    if (at < 0).any() or (ordered[at] != keys).any():
        raise ValueError("a pair of the corpus is missing from the hash")
    return at


def _counted(rows: pa.Table, hashed: pa.Table) -> pa.Table:
    """One dense vector: the counts of a bucket over a group of chunks, in the order of the hash."""
    if rows.num_rows == 0:  # no chunk of this group has a pair in the bucket
        return pa.table({"_bucket": rows.column("_bucket"), "_group": rows.column("_group"), "_sums": pa.array([], pa.binary())})
    levels, ordered = _levels(hashed)
    sums = np.zeros(len(ordered), np.int64)
    np.add.at(
        sums, _verified(levels, ordered, np.concatenate(_longs(rows, "_keys"))), np.concatenate(_longs(rows, "_counts"))
    )
    return pa.table({"_bucket": rows.column("_bucket")[:1], "_group": rows.column("_group")[:1], "_sums": _blob(sums)})


def _added(rows: pa.Table) -> pa.Table:
    return pa.table(
        {
            "_bucket": rows.column("_bucket")[:1], "_group": rows.column("_group")[:1],
            "_sums": _blob(np.sum(_longs(rows, "_sums"), axis=0)),
        }
    )


def _finished(hashed: pa.Table, sums: pa.Table) -> pa.Table:
    """Add the highest count of each pair's second id; a bucket holds all pairs of an id."""
    keys, counts = _longs(hashed, "_keys")[0], _longs(sums, "_sums")[0]
    _, number = np.unique(keys >> 32, return_inverse=True)
    best = np.zeros(number.max() + 1, np.int64)
    np.maximum.at(best, number, counts)
    return hashed.append_column("_sums", sums.column("_sums")).append_column("_best", _blob(best[number]))


def _answers(rows: pa.Table, table: pa.Table) -> pa.Table:
    """Counts of the pairs that the chunks of a group asked for."""
    counts, best = [], []
    if rows.num_rows:
        levels, ordered = _levels(table)
        all_counts, all_best = _longs(table, "_sums")[0], _longs(table, "_best")[0]
        for keys in _longs(rows, "_keys"):
            at = _verified(levels, ordered, keys)
            counts.append(all_counts[at].tobytes())
            best.append((all_counts[at] == all_best[at]).tobytes())
    return pa.table(
        {
            "_chunk": rows.column("_chunk"), "_keys": rows.column("_keys"),
            "_counts": pa.array(counts, pa.binary()), "_top": pa.array(best, pa.binary()),
        }
    )


def _scored(docs: pa.Table, answers: pa.Table, paths: tuple[str, str], digest: bool = False) -> pa.Table:
    """Second pass: the chunk's documents aligned again, with the counts of their links."""
    pa.default_memory_pool().release_unused()  # the allocator keeps what earlier chunks freed
    aligned = Aligned(docs.column("text"), paths)
    keys = np.concatenate([np.zeros(0, np.int64), *_longs(answers, "_keys")])
    counts = np.concatenate([np.zeros(0, np.int64), *_longs(answers, "_counts")])
    top = np.frombuffer(b"".join(answers.column("_top").to_pylist()), bool)
    order = np.argsort(keys)
    keys, counts, top = keys[order], counts[order], top[order]
    # links of texts without tokens were not counted; they may be absent here and are not summed
    at = np.minimum(np.searchsorted(keys, aligned.link_key), max(len(keys) - 1, 0))
    known = keys[at] == aligned.link_key if len(keys) else np.zeros(len(aligned.link_key), bool)
    link_count = np.zeros(len(known), np.int64)
    link_top = np.zeros(len(known), np.int64)
    link_count[known], link_top[known] = counts[at[known]], top[at[known]]
    values = [
        aligned.n_a, aligned.n_b, np.diff(aligned.group_ends, prepend=0),
        aligned.per_unit(np.ones(len(known), np.int64)), aligned.per_unit(link_top), aligned.per_unit(link_count),
    ]
    del keys, counts, top, at, known, link_count, link_top, aligned.link_key, aligned.link_unit
    out = docs.drop_columns(["_chunk", "text"])
    for name, of_unit in zip(OUT, values, strict=False):
        out = out.append_column(name, pa.array(np.where(aligned.valid, aligned.sums(of_unit), 0)))
    if digest:
        hashes = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in aligned.group_texts()]
        return out.append_column("groups_sha256", pa.array(hashes, pa.string()))
    out = out.append_column("groups", pa.array(list(aligned.group_texts()), pa.string()))
    return pa.Table.from_batches(out.to_batches(max_chunksize=OUT_ROWS), out.schema)


def tree(rows: DataFrame, groups: int, step, schema: str) -> DataFrame:
    """Combine the groups of each bucket by ``step``, at most ``FAN`` at a time, until one is left."""
    while groups > 1:
        rows = rows.withColumn("_group", F.floor(F.col("_group") / FAN))
        rows = rows.groupBy("_bucket", "_group").applyInArrow(step, schema)
        groups = -(-groups // FAN)
    return rows


def pair_table(entries: DataFrame, groups: int) -> DataFrame:
    """Per bucket: hash levels, keys in hash order, corpus-wide counts and the best of each second id."""
    asked = entries.select("_bucket", "_group", "_keys")
    distinct = asked.groupBy("_bucket", "_group").applyInArrow(_union, VECTOR)
    hashes = write_out(
        tree(distinct, groups, _union, VECTOR).groupBy("_bucket").applyInArrow(_hashed, HASH)
    )
    vectors = (
        entries.groupBy("_bucket", "_group").cogroup(_for_groups(hashes, groups).groupBy("_bucket", "_group"))
        .applyInArrow(_counted, SUMS)
    )
    sums = tree(vectors, groups, _added, SUMS)
    return hashes.groupBy("_bucket").cogroup(sums.groupBy("_bucket")).applyInArrow(_finished, TABLE)


def _for_groups(table: DataFrame, groups: int) -> DataFrame:
    return table.withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))


def align(
    docs: DataFrame, path_a: str, path_b: str, digest: bool = False, chunk_bytes: int = CHUNK_BYTES,
    group_chunks: int = GROUP_CHUNKS,
) -> DataFrame:
    """Each document with its tokens of both tokenizers aligned and counted.

    ``path_a`` is a byte-level BPE file (encodes a space and the text), ``path_b``
    a sentencepiece model (adds the space itself). Places where tokens of both
    end cut a text into groups; two tokens are linked if their bytes overlap.
    Returns the columns of ``docs`` but ``text``, and ``n_a``, ``n_b``,
    ``n_groups``, ``n_links``, ``n_best`` (links whose corpus-wide count is the
    highest of their second id, ties included), ``count_sum`` (those counts
    over all links) and ``groups`` (``a1,a2|b1;a3|b2,b3`` in order), or with
    ``digest`` their ``groups_sha256`` instead, which spares moving texts several
    times as long as the documents.

    A null or empty text, or one that either tokenizer does not give back byte
    for byte, has no tokens: zeros and an empty ``groups`` (and digest); its links count
    nowhere. A repeated row counts as often as it comes. Null ids and an empty
    table are allowed. Input columns with those names give way; others may have
    any name but ``_chunk``, which gives way too.
    """
    paths = (path_a, path_b)
    base = without(docs, *OUT, "groups_sha256", "_chunk")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        dealt = write_out(base.mapInArrow(lambda b: _dealt(b, chunk_bytes), ", ".join([*fields, "_chunk long"])))
    total = text_bytes(dealt)
    # a chunk asks for about 130 kilobytes of pairs
    buckets, groups = min(shares(total, 16 * BUCKET_BYTES), BUCKETS), shares(total, chunk_bytes * group_chunks)
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        entries = write_out(
            dealt.select("_chunk", "text").mapInArrow(lambda b: _entries(b, paths, buckets, groups), ENTRIES)
        )
    table = write_out(pair_table(entries, groups))
    answers = (
        entries.groupBy("_bucket", "_group").cogroup(_for_groups(table, groups).groupBy("_bucket", "_group"))
        .applyInArrow(_answers, "_chunk long, _keys binary, _counts binary, _top binary")
    )
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "text"]
    last = "groups_sha256 string" if digest else "groups string"
    schema = ", ".join([*kept, *[f"{n} long" for n in OUT[:-1]], last])

    def scored(rows: pa.Table, replies: pa.Table) -> pa.Table:
        return _scored(rows, replies, paths, digest)

    # a chunk without any pair has no answers; a reply alone cannot be
    return dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(scored, schema)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, groups and links of both tokenizers, and their corpus-wide counts."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(docs, *paths, digest=True).select("doc_id", *OUT[:-1], "groups_sha256")
