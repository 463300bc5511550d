"""Learned operators: held-out results on the given tables, and defined edge cases."""

import numpy as np
import pyarrow as pa
import pytest

from conftest_llm import rows_of
from slotwise.llm import language_id as li, toxicity as tx
from slotwise.llm.tables import read

BIG = "/root/testdata/sf0.1"


def test_held_out_languages(spark):
    found = li.op3_language_id(spark, "/root/testdata/sf0.01")
    true = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    rows = found.join(true, "doc_id").where("held_out").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def languages(spark):
    rows = [("the cat and the dog of the house " * 3, "en"), ("le chat et la maison du père élève " * 3, "fr")] * 5
    rows += [(None, "en"), ("1234 !!", "en"), ("nobody knows", None)]
    return li.fit(spark.createDataFrame(rows, "text string, lang string"))


def test_texts_without_letters_are_undetermined(spark, languages):
    rows = [(1, None), (2, ""), (3, "123 $$$ \n"), (4, "日本語"), (5, "the dog and the cat of the house"), (6, "la maison du père"), (None, "×÷")]
    out = li.identify(spark.createDataFrame(rows, "doc_id long, text string"), languages)
    found = {r["doc_id"]: (r["lang_pred"], r["score"] > 0, r["rejected"]) for r in out.collect()}
    for i in (1, 2, 3, None):
        assert found[i] == ("und", False, True)
    assert found[5][:2] == ("en", True) and found[6][:2] == ("fr", True)
    assert found[4][0] in ("en", "fr") and found[4][2]


def test_nothing_learned_and_clashing_columns(spark, docs, no_docs, languages):
    empty = li.fit(no_docs.select("text", "lang"))
    out = li.identify(docs.withColumnRenamed("lang", "Score"), empty)
    assert {r[0] for r in out.select("lang_pred").collect()} == {"und"}
    assert [c.lower() for c in out.columns].count("score") == 1
    assert li.identify(no_docs, languages).count() == 0


def test_grams_equal_plain_counts():
    texts = ["Été 12 a-b", "", "zz"]
    counts, letters = li.gram_counts(pa.array(texts))
    assert letters.tolist() == [True, False, True]
    for text, row in zip(texts, counts, strict=True):
        data = bytes(b if 97 <= b <= 122 or b >= 128 else 0 for b in text.lower().encode())
        grams = [data[i : i + n] for n in (1, 2, 3) for i in range(len(data) - n + 1)]
        assert row.sum() == sum(any(g) for g in grams)
    assert sorted(counts[2][counts[2] > 0].tolist()) == [1, 2]


def test_held_out_toxicity(spark):
    docs = read(spark, BIG, "documents").select("doc_id", "text")
    found = tx.score(docs, tx.learned(spark, docs, BIG), keep_text=False).withColumn("held_out", tx.held_out(3, 1))
    rows = found.join(read(spark, BIG, "labels"), "doc_id").where("held_out").select("toxic", "score", "predicted").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)


@pytest.fixture(scope="module")
def costs(spark):
    return tx.character_costs(read(spark, BIG, "documents"))


def test_disguised_words_are_restored(costs):
    for raw, clean in (
        ("1d10t", "idiot"), ("stuuupid", "stupid"), ("l0s3r", "loser"), ("m0r0n!!", "moron"), ("p@thetic", "pathetic"),
        ("w.o.r.t.h.l.e.s.s", "worthless"), ("tr@$h", "trash"), ("cl0wn", "clown"),
    ):
        assert tx.decode([raw.encode()], costs) == [clean.encode()]


def test_plain_text_stays_and_runs_are_joined(costs):
    texts = ["A plain text, with (brackets) and 2024 numbers!", None, "", "s t u p i d", "été", "x " * 3]
    found = tx.restore(pa.array(texts), costs).to_pylist()
    assert found[0].startswith("a plain text, with") and "2024" in found[0]
    assert found[1] == found[2] == ""
    assert "stupid" in found[3].split()
    assert found[4:] == ["été", "x x x "]


def test_runs_of_letters_of_any_script_and_of_three(costs):
    found = tx.restore(pa.array(["so b l ö d ist", "e s t ú p i d o", "b a d", "é c o l e", "a b", "o o o o"]), costs).to_pylist()
    for text, word in zip(found, ("blöd", "estúpido", "bad", "école"), strict=False):
        assert word in text.split()
    assert found[4:] == ["a b", "o o o o"]


def plain_decode(token, costs):
    """All readings of a short token, compared one by one."""
    (states, cost), letter = tx._readings(), tx._letter_states()
    after = [any(letter[b] > 0 for b in token[p + 1 :]) for p in range(len(token))]
    best = (np.inf, b"")

    def walk(p, state, total, out):
        nonlocal best
        if p == len(token):
            best = min(best, (total + costs[state, 0], bytes(out)))
            return
        b = token[p]
        for s in states[b]:
            if s >= 0:
                walk(p + 1, s, total + costs[state, s] + cost[b], [*out, s + 96])
        if letter[b] == 0:
            noise = 9.0 if 48 <= b <= 57 else 6.0 if chr(b) in tx.LOOKALIKES and after[p] else 3.0
            walk(p + 1, state, total + noise, out)
        elif p and token[p - 1] == b and state == letter[b]:
            walk(p + 1, state, total + 2.0, out)

    walk(0, 0, 0.0, [])
    return best[1]


def test_viterbi_finds_the_cheapest_reading(costs):
    rng = np.random.default_rng(4)
    tokens = ["".join(rng.choice(list("aaboo01$!*.35t"), int(rng.integers(1, 8)))).encode() for _ in range(200)]
    assert tx.decode(tokens, costs) == [plain_decode(t, costs) for t in tokens]


def test_scores_without_labels_and_of_edge_rows(spark, docs, no_docs):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit(docs.select("doc_id", "text"), no_labels)
    out = tx.score(docs.withColumnRenamed("lang", "Predicted"), model)
    assert {r[0] for r in out.select("score").collect()} == {0.5}
    assert out.count() == docs.count() and [c.lower() for c in out.columns].count("predicted") == 1
    assert tx.score(no_docs, model).count() == 0
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    found = rows_of(tx.score(docs, tx.fit(docs.select("doc_id", "text"), labels)), "score")
    assert len(found) == docs.count()


def test_features_need_little_memory():
    import tracemalloc

    text = "abcdefghijklmnopqrstuvwxy " * 40_000
    tx.features(pa.array(["what is loaded at first use"]))
    column = pa.array([text])
    tracemalloc.start()
    tx.features(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(text)  # 35 when powers of a base for every byte were made
