"""MinHash near-dedup against all pairs of full sets."""

import re

import numpy as np
import pytest

from conftest_llm import rows_of
from slotwise.llm import minhash_dedup as md


def plain_components(rows, share=75, size=5):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [
        (doc_id, len(sets[i]), least.get(find(i)), doc_id == least.get(find(i))) for i, (doc_id, _) in enumerate(rows)
    ]


def test_components_are_those_of_all_pairs(docs, corpus):
    found = rows_of(md.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert found == sorted(plain_components([r[:2] for r in corpus]), key=repr)


def test_one_row_of_each_component_is_first(docs):
    out = md.near_duplicates(docs).where("first_row").select("component_id").collect()
    ids = [r[0] for r in out if r[0] is not None]
    assert len(ids) == len(set(ids))
    assert set(ids) == {r[0] for r in md.near_duplicates(docs).select("component_id").collect()} - {None}


@pytest.mark.parametrize("edits", [1, 4])
def test_families_of_edited_copies(spark, edits):
    """Chains and large families, in which links hang on pairs close to the bound."""
    rng = np.random.default_rng(edits)
    rows, number = [], 0
    for _ in range(12):
        text = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(20, 90)))]
        for _ in range(int(rng.integers(2, 25))):
            rows.append((int(number), " ".join(text)))
            number += 1
            for place in rng.integers(0, len(text), edits):
                text[place] = f"w{rng.integers(0, 5000)}"
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = rows_of(md.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert found == sorted(plain_components(rows), key=repr)


def test_links_that_stars_miss_are_found_by_rare_shingles(spark, monkeypatch):
    """Without any confirmed star, the exact second step alone must give the same components."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 900, 60)]
    rows = []
    for i in range(30):
        copy = list(base)
        for place in rng.integers(0, 60, 2):
            copy[place] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(copy)))
    confirm, calls = md.confirm, []

    def no_stars(pairs, sets, share):
        calls.append(1)
        return confirm(pairs.limit(0) if len(calls) == 1 else pairs, sets, share)

    monkeypatch.setattr(md, "confirm", no_stars)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = rows_of(md.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert len(calls) == 2
    assert found == sorted(plain_components(rows), key=repr)


def counted(spark, monkeypatch, rows):
    """Rows of near_duplicates, the links found, and the pairs the exact step compares."""
    found = {}
    confirm, linked = md.confirm, md.components

    def pairs_in(pairs, sets, share):
        pairs = md.write_out(pairs)
        found.setdefault("pairs", []).append(pairs.count())
        return confirm(pairs, sets, share)

    def links_in(links):
        found.setdefault("links", []).append(links.distinct().count())
        return linked(links)

    monkeypatch.setattr(md, "confirm", pairs_in)
    monkeypatch.setattr(md, "components", links_in)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = rows_of(md.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    return out, found


def test_links_and_pairs_of_a_large_group_grow_with_its_rows(spark, monkeypatch):
    """Near copies have a few links each, and unlinked documents on one template meet nowhere."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    for n in (300, 600):
        near = []
        for i in range(n):
            copy = list(base)
            for place in rng.choice(120, 1):
                copy[place] = f"e{i}x{place}"
            near.append((i, " ".join(copy)))
        out, found = counted(spark, monkeypatch, near)
        monkeypatch.undo()
        assert {r[2] for r in out} == {0}
        assert found["links"][0] <= 4 * n and sum(found["pairs"]) <= 5 * n
        apart = []
        for i in range(n):
            copy = list(base)
            for place in rng.choice(24, 7, replace=False) * 5:
                copy[place] = f"e{i}x{place}"
            apart.append((i, " ".join(copy)))
        out, found = counted(spark, monkeypatch, apart)
        monkeypatch.undo()
        assert out == sorted(plain_components(apart), key=repr) or n > 300
        assert all(r[3] for r in out) and sum(found["pairs"]) <= 5 * n


def test_bins_agree_as_often_as_sets(spark):
    """Densified signatures estimate the Jaccard similarity, also of sets smaller than the bins."""
    rng = np.random.default_rng(1)
    for n in (4, 40, 400):
        pool = np.unique(rng.integers(0, 2**63, 4 * n).astype(np.uint64))
        a, b = np.sort(pool[: 2 * n]), np.sort(pool[n // 2 : 2 * n])
        both = np.concatenate([a, b])
        signature = md.one_permutation(both, np.array([0, len(a), len(both)]), 4080)
        assert abs((signature[0] == signature[1]).mean() - 0.75) < 0.28 / n**0.5 + 0.03


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (100, 95)], "_a long, _b long")
    found = {r["_rid"]: r["_root"] for r in md.components(links).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 95: 90, 100: 90}


def test_no_documents(no_docs):
    assert md.near_duplicates(no_docs).count() == 0
