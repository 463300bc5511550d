"""The pipeline's stages against plain versions, and its entry."""

import re

import corpus_pipeline as cp
import pytest

from slotwise.llm import decontamination, minhash_dedup, toxicity
from slotwise.llm.tables import read, write_out
from test_near_duplicates import plain_components
from test_repeats_and_benchmark import plain_contamination, plain_removal

SF = "/root/testdata/sf0.001"


def words_of(text):
    return " ".join(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def raw(spark):
    return read(spark, SF, "documents")


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]


def test_each_stage_does_its_work_on_its_input(spark, raw):
    docs = raw
    columns = raw.columns
    model = toxicity.learned(spark, raw, SF)
    kept = write_out(cp.drop_toxic(spark, docs, SF))
    bad = {r[0] for r in toxicity.score(raw, model).where("predicted = 1").select("doc_id").collect()}
    assert kept.columns == columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in raw.select("doc_id").collect()} - bad

    rows = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    single = write_out(cp.drop_near_duplicates(spark, kept, SF))
    assert {r[0] for r in single.select("doc_id").collect()} == {c[0] for c in plain_components(rows) if c[3]}

    rows = {r["doc_id"]: r["text"] for r in single.collect()}
    cut = write_out(cp.cut_repeats(spark, single, SF))
    wanted = dict(zip(rows, (w[2] for w in plain_removal(list(rows.values()), 35)), strict=True))
    found = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert {i: " ".join(t.split(" ")) if t == rows[i] else words_of(t) for i, t in found.items()} == {
        i: rows[i] if words_of(rows[i]) == w else w for i, w in wanted.items()
    }
    assert cut.where("n_chars <> length(text)").count() == 0 and cut.columns == columns

    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    clean = write_out(cp.drop_contaminated(spark, cut, SF))
    assert clean.columns == columns
    assert {r[0] for r in clean.select("doc_id").collect()} == {i for i, t in wanted.items() if not plain_contamination(t, items)[-1]}

    packed = cp.pack_sequences(spark, clean, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r[0] for r in clean.select("doc_id").collect()}


def test_run_returns_the_packed_pieces(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0


def test_stages_on_no_documents(spark, raw):
    docs = raw.limit(0)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0 and docs.columns == raw.columns


def test_stage_handles_odd_rows(spark, raw):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "xx", "s", 7)]
    docs = spark.createDataFrame(rows, raw.schema)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 4 or stage is cp.pack_sequences


def test_operators_used():
    assert decontamination.WINDOW == 13 and minhash_dedup.SHINGLE == 5
