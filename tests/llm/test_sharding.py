"""Shards against a plain version, the curve, and what the files allow readers to skip."""

import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from slotwise.llm import sharding as sh
from slotwise.llm.packing import hilbert

TYPE = "doc_id long, text string, lang string, source string, Shard string"


def text_hash(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - 2**64 if h >= 2**63 else h


def plain_cells(values, cells):
    known = sorted(v for v in values if v is not None)
    less = {v: sum(u < v for u in known) for v in set(known)}
    used = sorted({less[v] * cells // len(known) for v in less}) if known else []
    # cells are numbered in order of use: a cell no value falls into is skipped
    return [0 if v is None else used.index(less[v] * cells // len(known)) for v in values]


def plain_order(rows, bits):
    """Rows (doc_id, text, lang, source) in the order of the curve."""
    sizes = [len((r[1] or "").encode()) + 1 for r in rows]
    cells = [plain_cells(v, 2**bits) for v in ([r[2] for r in rows], [r[3] for r in rows], sizes)]
    place = hilbert(np.array(cells).T.reshape(len(rows), 3), bits)
    key = [
        (int(p), text_hash(r[1] or ""), r[0] is None, r[0] or 0) for p, r in zip(place, rows, strict=True)
    ]
    return [rows[i] for i in sorted(range(len(rows)), key=key.__getitem__)]


def by_place(found):
    return [(r["doc_id"], r["text"]) for r in sorted(found, key=lambda r: (r["shard"], r["slot"]))]


@pytest.fixture(scope="module")
def many():
    rng = np.random.default_rng(8)
    rows = [
        (i, "x" * int(rng.lognormal(3, 1)) + str(i), ["de", "en", None][rng.integers(3)], f"s{rng.integers(40):02d}")
        for i in range(900)
    ]
    rows += [(2000 + i, "one text that a third of all rows hold", "en", "hot") for i in range(450)]
    return rows


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("dims", [1, 2, 3])
def test_curve_equals_the_transform_of_whole_arrays(spark, bits, dims):
    axes = [f"x{i}" for i in range(dims)]
    side = spark.range(1 << bits)
    points = side.select(F.col("id").alias("x0"))
    for axis in axes[1:]:
        points = points.crossJoin(side.select(F.col("id").alias(axis)))
    points = points.select(*axes, *[F.col(a).alias(f"at{a}") for a in axes])
    found = sorted((r["place"], *[r[f"at{a}"] for a in axes]) for r in sh.on_curve(points, axes, bits, "place").collect())
    path = np.array([f[1:] for f in found])
    assert [f[0] for f in found] == list(range(len(found))) == hilbert(path, bits).tolist()
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("shards", [7])
def test_rows_law_equals_the_plain_version(spark, many, shards):
    docs = spark.createDataFrame([(*r, "clash") for r in many], TYPE).repartition(9)
    found = sh.shard(docs, shards, range_rows=100).collect()
    assert by_place(found) == [r[:2] for r in plain_order(many, sh.BITS)]
    counts = np.bincount([r["shard"] for r in found], minlength=shards)
    assert counts.max() - counts.min() <= 1
    for k in range(shards):
        assert sorted(r["slot"] for r in found if r["shard"] == k) == list(range(counts[k]))
    assert all(r["size"] == len(r["text"].encode()) + 1 for r in found)


def test_bytes_law_makes_sizes_near_equal(spark, many):
    docs = spark.createDataFrame([(*r, "clash") for r in many], TYPE)
    found = sh.shard(docs, 5, law="bytes", range_rows=200).collect()
    assert by_place(found) == [r[:2] for r in plain_order(many, sh.BITS)]
    sizes = np.bincount([r["shard"] for r in found], weights=[r["size"] for r in found])
    assert len(sizes) == 5 and sizes.max() - sizes.min() <= 2 * max(r["size"] for r in found)
    for k in range(5):
        slots = sorted(r["slot"] for r in found if r["shard"] == k)
        assert slots == list(range(len(slots)))
    with pytest.raises(ValueError):
        sh.shard(docs, law="other")


def test_odd_rows(spark, corpus):
    docs = spark.createDataFrame([(i, t, None, c, "clash") for i, t, _, c in corpus], TYPE).repartition(3)
    found = sh.shard(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["text"] is None) for r in found) == sorted(
        (i is None, i or 0, t or "", t is None) for i, t, *_ in corpus
    )
    assert len({(r["shard"], r["slot"]) for r in found}) == len(corpus)
    assert by_place(found) == [r[:2] for r in plain_order([(i, t, None, c) for i, t, _, c in corpus], sh.BITS)] or (
        # null and empty texts share a place, and so do repeated rows
        [(i, t or "") for i, t in by_place(found)]
        == [(i, t or "") for i, t, *_ in plain_order([(i, t, None, c) for i, t, _, c in corpus], sh.BITS)]
    )
    for few in ([], corpus[:3]):
        docs = spark.createDataFrame([(*r, "clash") for r in few], TYPE)
        assert sorted(r["shard"] for r in sh.shard(docs).collect()) == list(range(len(few)))
        assert sh.shard(docs, law="bytes").count() == len(few)
    bare = spark.createDataFrame([("a",), ("a",), (None,)], "text string")
    assert {(r["shard"], r["slot"]) for r in sh.shard(bare, 2, dimensions=("size",)).collect()} == {(0, 0), (0, 1), (1, 0)}
    odd = docs.withColumn("_row", F.lit(1)).withColumn("lang", F.lit(3.5))
    assert sh.shard(odd).columns == ["doc_id", "text", "lang", "source", "size", "shard", "slot"]


def test_files_cover_small_boxes(spark, many, tmp_path):
    docs = spark.createDataFrame([(*r, "clash") for r in many], TYPE)
    sh.write_shards(sh.shard(docs), str(tmp_path / "out"), file_rows=60)
    files = spark.read.parquet(str(tmp_path / "out")).withColumn("f", F.input_file_name())
    boxes = files.groupBy("f").agg(
        F.min("source").alias("a"), F.max("source").alias("b"), F.min("lang").alias("l"), F.max("lang").alias("m"), F.count("*").alias("n")
    ).collect()
    assert sum(r["n"] for r in boxes) == len(many) and len(boxes) >= 20
    sources = [f"s{i:02d}" for i in range(40)]
    read = np.mean([sum(r["n"] for r in boxes if r["a"] <= s <= r["b"]) for s in sources]) / len(many)
    assert read < 0.3  # dealt at random, a file holds nearly every source


def test_no_python_in_the_plan(spark, sf_dir):
    plan = sh.op12_sharding(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_the_query(spark, sf_dir):
    found = sh.op12_sharding(spark, sf_dir)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    order = plain_order([tuple(r) for r in raw], sh.BITS)
    rows = found.collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))] == [r[0] for r in order]
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in raw}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]])) for r in rows)
    counts = np.bincount([r["shard"] for r in rows], minlength=8)
    assert counts.max() - counts.min() <= 1 and {r["grown_shard"] for r in rows} == {None}
