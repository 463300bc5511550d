"""Fingerprints, licence scan and language-model scores against plain Python."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest_llm import digest, rows_of
from slotwise.llm import fingerprints as fp, license_scan as ls, lm_scoring as lm


@pytest.fixture(scope="module")
def printed(docs):
    return fp.fingerprints(docs).cache()


def test_edited_texts_follow_descending_ids(printed, corpus):
    order = {}
    for doc_id, text, *_ in corpus:
        order.setdefault((doc_id, text or ""), None)
    found = {(r["doc_id"], r["n_chars"]): r["edited_sha256"] for r in printed.collect()}
    assert printed.count() == len(corpus)
    rows = sorted((k for k in order if k[0] is not None), key=lambda k: -k[0])
    for (doc_id, text), (_, after) in zip(rows, rows[1:], strict=False):
        m = len(text) // 3
        assert found[(doc_id, len(text))] == digest(text[: len(text) - m] + after[:m])


def test_fingerprints_equal_plain_winnowing(spark, printed, corpus):
    texts = {(i, t or "") for i, t, *_ in corpus if i is not None}
    words = {t: re.findall(r"[^ \t\n\x0b\f\r]{1,12}", t) for _, t in texts}
    every = sorted({w for ws in words.values() for w in ws})
    hashed = spark.createDataFrame([(w,) for w in every], "w string").select("w", F.xxhash64("w")).collect()
    of = {w: h for w, h in hashed}
    grams = sorted({tuple(of[w] for w in ws[i : i + 4]) for ws in words.values() for i in range(max(1, len(ws) - 3)) if ws})
    by_size = {}
    for g in grams:
        by_size.setdefault(len(g), []).append(g)
    value = {}
    for size, group in by_size.items():
        df = spark.createDataFrame(group, ", ".join(f"c{i} long" for i in range(size)))
        for row in df.select(*df.columns, F.xxhash64(*df.columns)).collect():
            value[tuple(row[:size])] = row[size]
    found = {(r["doc_id"], r["n_chars"]): r["fingerprint"] for r in printed.collect()}
    for doc_id, text in texts:
        own = [of[w] for w in words[text]]
        hashes = [(value[tuple(own[i : i + 4])] >> 24) for i in range(max(1, len(own) - 3))] if own else []
        kept = []
        for i in range(max(1, len(hashes) - 7) if hashes else 0):
            window = range(i, min(i + 8, len(hashes)))
            least = min(hashes[p] for p in window)
            place = max(p for p in window if hashes[p] == least)
            if place not in kept:
                kept.append(place)
        wanted = " ".join(f"{hashes[p] % 2**40:010X}:{p}" for p in kept)
        assert found[(doc_id, len(text))] == wanted


def test_likeness_is_that_of_the_hash_sets(printed):
    for r in printed.collect():
        a, b = ({x.split(":")[0] for x in r[c].split()} for c in ("fingerprint", "edited_fingerprint"))
        assert r["near_edited"] == (len(a & b) / len(a | b) if a | b else 1.0)
        assert 0 <= r["near_next"] <= 1


def test_equal_texts_have_equal_fingerprints_and_one_row_follows_itself(spark, printed, no_docs):
    by_text = {}
    for r in printed.where("doc_id is not null").collect():
        by_text.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    alone = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    row = fp.fingerprints(alone).first()
    assert row["edited_sha256"] == digest("one two three four" + "one two t") and row["near_next"] == 1.0
    assert fp.fingerprints(no_docs).count() == 0


def test_order_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    rows = [(i, f"text {i} of many") for i in range(100)]
    out = {r["doc_id"]: r["edited_sha256"] for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        after, m = rows[i - 1][1], len(text) // 3
        assert out[i] == digest(text[: len(text) - m] + after[:m])


def test_licence_forms_are_equal(spark, no_docs):
    known = spark.createDataFrame([("A", "Licensed under the A Licence, Version 2.0."), ("B", "One line\nof two."), ("C", "")], "license string, text string")
    texts = [
        (1, "some words\n  licensed under the a LICENSE version 2.0  \nmore"), (2, "Copyright 2020 X\nOne  line\n(c) Y\nof two!!"),
        (3, "before\n\nOne line\nof two\n\nafter\n\nLicensed under the A License, v2.0"), (4, None), (5, ""), (6, "Copyright only"),
        (7, "One line of three"), (1, "some words\n  licensed under the a LICENSE version 2.0  \nmore"), (None, "One line of two"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in texts], "doc_id long, text string, Licenses string")
    out = ls.scan(docs, known)
    found = rows_of(out, "doc_id", "licenses", "n_license_units", "whole_license")
    assert found == sorted(
        [
            (1, ["A"], 1, None), (1, ["A"], 1, None), (2, ["B"], 1, "B"), (3, ["A", "B"], 2, None), (4, [], 0, None),
            (5, [], 0, None), (6, [], 0, None), (7, [], 0, None), (None, ["B"], 1, "B"),
        ],
        key=repr,
    )
    assert ls.scan(no_docs, known).count() == 0
    assert ls.scan(docs, known.limit(0)).where("n_license_units > 0").count() == 0


def plain_scores(texts, order=3, backoff=0.4):
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    grams = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in words]
    total, size = sum(grams, Counter()), sum(map(len, words))
    out = []
    for w, own in zip(words, grams, strict=True):
        known = score = 0
        rest = size - len(w)
        for i in range(len(w)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if total[gram] > own[gram]:
                    below = total[gram[:-1]] - own[gram[:-1]] if n > 1 else rest
                    score += math.log((total[gram] - own[gram]) / below)
                    known += n == order
                    break
                score += math.log(backoff) if n > 1 else -math.log(rest + 1)
        out.append((len(w), score if w else None, known))
    return out


def test_scores_are_those_of_plain_counts(spark, docs, corpus, no_docs, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 9000)
    monkeypatch.setattr(lm, "BUCKET_BYTES", 5000)
    found = rows_of(lm.lm_scores(docs), "doc_id", "n_words", "log_score", "n_known")
    wanted = sorted(((r[0], *s) for r, s in zip(corpus, plain_scores([r[1] for r in corpus]), strict=True)), key=repr)
    key = lambda r: (repr(r[0]), r[1], r[3], round(r[2] or 0, 6))
    for a, b in zip(sorted(found, key=key), sorted(wanted, key=key), strict=True):
        assert (a[0], a[1], a[3]) == (b[0], b[1], b[3])
        assert a[2] == b[2] is None or a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-9)
    assert lm.lm_scores(no_docs).count() == 0


def test_counts_beyond_a_byte(spark):
    rows = [(i, "the same words") for i in range(600)] + [(600, "the same other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(tuple(r) for r in lm.lm_scores(docs).select("doc_id", "log_score", "n_known").collect())
    wanted = [(i, s, k) for i, (_, s, k) in enumerate(plain_scores([t for _, t in rows]))]
    for a, b in zip(found, wanted, strict=True):
        assert a == pytest.approx(b)
