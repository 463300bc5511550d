"""Near-duplicate documents: one-permutation MinHash, banded buckets, star edges.

A document's set is its distinct 5-word shingles (64-bit hashes). One hash of
each shingle gives bin and value; a bin without shingles takes the value of the
first occupied bin in a fixed random order of its own (optimal densification),
so that any bin of two sets agrees with the probability of their Jaccard
similarity. Five bins make a band; a pair at 0.75 misses all 51 bands once in a
million.

Documents with the same set are one class, whose smallest row stands for it. In
each bucket the least rows in eight fixed orders are centers; every member tries
the four centers that it shares most bands with, and such a link counts when the
full sets confirm it. In buckets whose members then still lie in different
components a link may have been missed; rows of those are joined on their rarest
shingles, of which a similar pair must share one, across components only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from slotwise.llm.arrays import BASE_1, SPACES, Words, binary_rows, mix, pieces
from slotwise.llm.tables import numbered, read, without, write_out

SHINGLE, BANDS, ROWS = 5, 51, 5
STARS, TRIED = 8, 4
CELLS = 2**18
MAP_BITS = 1024
OUT = ("n_shingles", "component_id", "kept", "first_row")


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all rows, and where each row's begin."""
    at = words.windows(size)
    hashes, rows = words.rolling(size, BASE_1, at), words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    for n in np.unique(words.count[short]):
        own = short[words.count[short] == n]
        hashes = np.concatenate([hashes, words.rolling(int(n), BASE_1, words.first[own]) + np.uint64(n)])
        rows = np.concatenate([rows, own])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(words.count) + 1))


def one_permutation(hashes: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """Signatures of the non-empty sets among ``bounds``, densified."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))
    # sorted hashes with the bin in the top bits: the first of each bin is its minimum
    bin_of = ((hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    cell = row * bins + bin_of
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    signature = np.zeros(n * bins, np.uint64)
    full = np.zeros(n * bins, bool)
    signature[cell[first]], full[cell[first]] = mix(hashes[first]), True
    empty = np.flatnonzero(~full & np.repeat(np.diff(bounds) > 0, bins))
    turn = 0
    out = signature.copy()
    while len(empty):
        turn += 1
        own = (empty % bins).astype(np.uint64)
        other = (mix(own * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn)) % np.uint64(bins)).astype(np.int64)
        source = empty - empty % bins + other
        found = full[source]
        out[empty[found]] = signature[source[found]] + np.uint64(turn * 0x2545F4914F6CDD1D % 2**64)
        empty = empty[~found]
    return out.reshape(n, bins)


def parity_maps(hashes: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    """Per set, which of ``bits`` cells hold an odd number of its items, as longs.

    Where the maps of two sets differ, so do the sets: the number of differing
    cells is at most that of the items in one set only.
    """
    n = len(bounds) - 1
    cell = np.repeat(np.arange(n), np.diff(bounds)) * bits + (mix(hashes) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, bits // 64)


def _signatures(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        words = Words(batch.column("text"), SPACES, lower=True)
        hashes, bounds = shingle_sets(words, size)
        n = np.diff(bounds)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)])
        cross = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(7)), dtype=np.uint64)])
        signature = one_permutation(hashes, bounds, bands * rows).reshape(-1, bands, rows)
        keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), signature.shape[:2]).copy()
        for i in range(rows):
            keys = mix(keys * np.uint64(0xD1342543DE82EF95) + signature[:, :, i])
        keys = keys[n > 0].ravel().view(np.int64)
        counts = np.where(n > 0, bands, 0)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(keys)
        )
        maps = parity_maps(hashes, bounds, MAP_BITS)
        maps = pa.ListArray.from_arrays(
            pa.array(np.arange(len(n) + 1, dtype=np.int32) * maps.shape[1]), pa.array(maps.ravel())
        )
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns, pa.array(n, pa.int64()),
                pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)),
                pa.array((cross[bounds[1:]] - cross[bounds[:-1]]).view(np.int64)), lists, maps,
            ],
            [*batch.schema.names, "n_shingles", "_d1", "_d2", "_keys", "_map"],
        )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        hashes, bounds = shingle_sets(Words(batch.column("text"), SPACES, lower=True), size)
        yield pa.RecordBatch.from_arrays([batch.column("_rid"), binary_rows(hashes, bounds)], ["_rid", "_set"])


def _confirmed(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach ``share`` percent of their union."""
    for batch in batches:
        keep = []
        left, right = batch.column("_set_a"), batch.column("_set_b")
        for i in range(batch.num_rows):
            a, b = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
            common = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * common >= share * (len(a) + len(b) - common))
        yield batch.select(["_a", "_b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs ``_a``, ``_b`` whose sets are similar enough."""
    both = (
        pairs.join(sets.select(F.col("_rid").alias("_a"), F.col("_set").alias("_set_a")), "_a")
        .join(sets.select(F.col("_rid").alias("_b"), F.col("_set").alias("_set_b")), "_b")
        .select("_a", "_b", "_set_a", "_set_b")
    )
    return both.mapInArrow(lambda batches: _confirmed(batches, share), "_a long, _b long")


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``links`` (columns ``_a``, ``_b``).

    Rounds of the large-star and small-star steps, each written, until the
    links no longer change.
    """
    links = links.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).where("_a > _b").distinct()
    links = write_out(links)
    before = None
    while True:
        both = links.union(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        least = both.groupBy("_a").agg(F.min("_b").alias("_m")).withColumn("_m", F.least("_m", "_a"))
        large = both.join(least, "_a").where("_b > _a").select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
        large = large.where("_a > _b").distinct()
        least = large.groupBy("_a").agg(F.min("_b").alias("_m"))
        small = large.join(least, "_a")
        links = write_out(
            small.select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
            .union(small.select("_a", F.col("_m").alias("_b")))
            .where("_a > _b").distinct()
        )
        row = links.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)")).alias("h")
        ).first()
        state = (row["n"], row["h"])
        if state == before:
            return links.groupBy(F.col("_a").alias("_rid")).agg(F.min("_b").alias("_root"))
        before = state


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many sets hold an item of each cell, summed over a task."""
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for items in batch.column("_set"):
            counts += np.bincount(cell_of(np.frombuffer(items.as_buffer(), np.uint64)), minlength=CELLS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["_cell", "_n"])


def cell_of(items: np.ndarray) -> np.ndarray:
    return (mix(items ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(CELLS)).astype(np.int64)


def _prefixes(batches: Iterator[pa.RecordBatch], often: np.ndarray, share: int) -> Iterator[pa.RecordBatch]:
    """The rarest items of each set, as many as a similar set must meet one of."""
    for batch in batches:
        items, rows, places, sizes = [], [], [], []
        for i, blob in enumerate(batch.column("_set")):
            own = np.frombuffer(blob.as_buffer(), np.uint64)
            n = len(own) - -(-share * len(own) // 100) + 1
            items.append(own[np.lexsort((own, often[cell_of(own)]))[:n]])
            rows.append(np.full(len(items[-1]), i))
            places.append(np.arange(len(items[-1])))
            sizes.append(np.full(len(items[-1]), len(own)))
        if not rows:
            continue
        kept = batch.drop_columns(["_set"]).take(pa.array(np.concatenate(rows)))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, *[pa.array(np.concatenate(x).view(np.int64)) for x in (items, places, sizes)]],
            [*kept.schema.names, "_item", "_at", "_n"],
        )


def open_pairs(members: DataFrame, maps: DataFrame, sets: DataFrame, roots: DataFrame, share: int) -> DataFrame:
    """Pairs of different components among the rows of open buckets that may be similar enough.

    A bucket is open while its members lie in different components. Two sets of
    that similarity share one of their rarest items: in any fixed order of all
    items, the first of each that remain when ``share`` percent are left out,
    and one. The order is by how often an item's cell occurs in the open
    buckets, so documents on one template, which share only what all have, do
    not meet. Where they meet, the rows of the component most common there are
    paired with the others only. Sizes, the item's place in both orders and
    parity maps drop pairs that cannot have enough in common; no step loses a pair.
    """
    placed = members.select("_key", "_rid").join(roots, "_rid", "left").withColumn("_root", F.coalesce("_root", "_rid"))
    mixed = placed.groupBy("_key").agg(F.min("_root").alias("_l"), F.max("_root").alias("_g")).where("_l < _g")
    rows = placed.join(mixed.select("_key"), "_key", "left_semi").select("_rid", "_root").distinct()
    rows = write_out(rows.join(sets, "_rid"))
    often = np.zeros(CELLS, np.int32)
    counts = rows.select("_set").mapInArrow(_cells, "_cell long, _n long").groupBy("_cell").agg(F.sum("_n").alias("n"))
    counts = counts.toArrow()  # CELLS rows at most
    often[counts.column("_cell").to_numpy()] = np.minimum(counts.column("n").to_numpy(), 2**31 - 1)
    met = rows.mapInArrow(
        lambda batches: _prefixes(batches, often, share), "_rid long, _root long, _item long, _at long, _n long"
    )
    met = write_out(met)
    several = met.groupBy("_item").agg(F.min("_root").alias("_l"), F.max("_root").alias("_g")).where("_l < _g")
    met = write_out(met.join(several.select("_item"), "_item", "left_semi").join(maps.select("_rid", "_map"), "_rid"))
    by_root = met.groupBy("_item", "_root").agg(F.count("*").alias("n"))
    main = by_root.groupBy("_item").agg(F.max_by("_root", F.struct("n", "_root")).alias("_main"))
    left = met.join(main, "_item")
    right = left.where("_root <> _main").select("_item", *[F.col(c).alias(f"{c}_b") for c in ("_rid", "_root", "_at", "_n", "_map")])
    least = f"ceil({share} * (_n + _n_b) / {100 + share})"  # items in common that the pair needs
    return (
        left.join(right, "_item")
        .where(
            "_root <> _root_b and (_root = _main or _rid > _rid_b)"
            f" and 100 * least(_n, _n_b) >= {share} * greatest(_n, _n_b)"
            f" and _at <= _n - {least} and _at_b <= _n_b - {least}"
            f" and {100 + share} * aggregate(zip_with(_map, _map_b, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"
            f" <= {100 - share} * (_n + _n_b)"
        )
        .select(F.greatest("_rid", "_rid_b").alias("_a"), F.least("_rid", "_rid_b").alias("_b")).distinct()
    )


def link_classes(spark: SparkSession, nodes: DataFrame, sets_of, share: int) -> DataFrame:
    """Root of every linked row of ``nodes`` (``_rid``, ``n_shingles``, ``_keys``, ``_map``)."""
    rows = nodes.select("_rid", F.explode("_keys").alias("_key"))
    shared = rows.groupBy("_key").agg(F.count("*").alias("_k")).where("_k > 1").select("_key")
    members = write_out(
        rows.join(shared, "_key", "left_semi").join(nodes.select("_rid", "n_shingles"), "_rid")
    )
    # the least row of a bucket in each of several orders is the center of a star
    order = [F.col("_rid"), *[F.xxhash64(F.lit(i), "_rid") for i in range(1, STARS)]]
    centers = members.groupBy("_key").agg(
        *[F.min(F.struct(o.alias("o"), "_rid", "n_shingles")).alias(f"_c{i}") for i, o in enumerate(order)]
    ).select(
        "_key",
        F.array_distinct(F.array(*[F.struct(f"_c{i}._rid", f"_c{i}.n_shingles") for i in range(STARS)])).alias("_centers"),
    )
    sets = write_out(sets_of(members.select("_rid").distinct()))
    # of its centers, at most STARS a band, a row tries those it shares most bands with
    met = (
        members.join(centers, "_key").select("_rid", "n_shingles", F.explode("_centers").alias("_c"))
        .where(f"_rid <> _c._rid and 100 * least(n_shingles, _c.n_shingles) >= {share} * greatest(n_shingles, _c.n_shingles)")
        .groupBy("_rid", F.col("_c._rid").alias("_center")).agg(F.count("*").alias("_bands"))
    )
    tried = met.groupBy("_rid").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("_bands")).alias("m"), "_center"))), 1, TRIED).alias("_best")
    )
    pairs = (
        tried.select("_rid", F.explode("_best._center").alias("_center"))
        .select(F.greatest("_rid", "_center").alias("_a"), F.least("_rid", "_center").alias("_b")).distinct()
    )
    links = write_out(confirm(pairs, sets, share))
    roots = write_out(components(links))
    more = confirm(open_pairs(members, nodes.select("_rid", "_map"), sets, roots, share), sets, share)
    more = write_out(more)
    if more.isEmpty():
        return roots
    return components(roots.select(F.col("_rid").alias("_a"), F.col("_root").alias("_b")).union(more))


def near_duplicates(docs: DataFrame, share: int = 75, size: int = SHINGLE) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked when ``100 * intersection >= share * union`` of their
    shingle sets. A text with fewer words than a shingle has one item, its
    whole word sequence; a null or empty text, or one of separators only, has
    none and is linked with nothing. ``component_id`` is the smallest
    ``doc_id`` reachable (null only where all are null), ``kept`` whether the
    row has that id, ``first_row`` true for one row of each component, the one
    to keep: repeated rows may share the smallest id. Input columns with those
    names give way; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = without(docs, *OUT)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
    schema = ", ".join([*fields, "n_shingles long, _d1 long, _d2 long, _keys array<long>, _map array<long>"])
    signed = base.mapInArrow(lambda batches: _signatures(batches, size, BANDS, ROWS), schema)
    rows = numbered(signed, "_rid")
    narrow = rows.where("n_shingles > 0")
    same = ["n_shingles", "_d1", "_d2"]
    # what rows are joined with is written first, so that a large class or component can be split
    classes = write_out(
        narrow.groupBy(*same).agg(F.min("_rid").alias("_stand"), F.count("*").alias("_k")).where("_k > 1").drop("_k")
    )
    stand = write_out(
        narrow.select("_rid", *same).join(classes, same).select("_rid", "_stand")
    )
    doubles = stand.where("_rid <> _stand").select("_rid")
    nodes = narrow.select("_rid", "n_shingles", "_keys", "_map").join(doubles, "_rid", "left_anti")

    def sets_of(rids: DataFrame) -> DataFrame:
        texts = rows.select("_rid", "text").join(rids, "_rid", "left_semi")
        return texts.mapInArrow(lambda batches: _sets(batches, size), "_rid long, _set binary")

    roots = link_classes(spark, nodes, sets_of, share)
    roots = write_out(roots)
    # a copy takes the root of the row that stands for it
    of_copy = (
        stand.join(roots.withColumnRenamed("_rid", "_stand"), "_stand", "left")
        .select("_rid", F.coalesce("_root", "_stand").alias("_root"))
    )
    linked = roots.union(roots.select(F.col("_root").alias("_rid"), "_root").distinct())
    placed = of_copy.union(linked.join(stand, "_rid", "left_anti").select("_rid", "_root"))
    named = write_out(
        rows.select("_rid", "doc_id").join(placed, "_rid")
    )
    # the smallest id, nulls last, then the smallest row
    best = write_out(named.groupBy("_root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id").alias("id"), F.col("_rid").alias("rid"))).alias("_best")
    ))
    placed = named.select("_rid", "_root").join(best, "_root").select(
        "_rid", F.lit(True).alias("_in"), F.col("_best.id").alias("_least"), F.col("_best.rid").alias("_row")
    )
    alone = F.col("_in").isNull()
    return (
        rows.drop("_d1", "_d2", "_keys", "_map").join(placed, "_rid", "left")
        .withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("_least")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        .withColumn("first_row", alone | (F.col("_rid") == F.col("_row")))
        .drop("_rid", "_in", "_least", "_row")
    )


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: size of its set, its component, and whether it stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


SQL_8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(list_aggregate(ws[i : i + 4], 'string_agg', ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.k + y.k - c)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT edge.b, reach.root FROM reach JOIN edge ON reach.doc_id = edge.a WHERE reach.root < edge.b
), least AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id
"""
