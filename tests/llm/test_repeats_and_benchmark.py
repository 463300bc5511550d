"""Substring dedup and decontamination against plain Python."""

import random
import re
from collections import Counter

from conftest_llm import rows_of
from slotwise.llm.decontamination import contamination, winnow
from slotwise.llm.substring_dedup import remove_repeats


def plain_removal(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone), sorted(gone)))
    return out


def test_repeats_are_those_of_a_full_comparison(docs, corpus):
    for window in (35, 8):
        found = rows_of(remove_repeats(docs, window), "doc_id", "n_words", "n_removed", "kept_text")
        wanted = plain_removal([r[1] for r in corpus], window)
        assert found == sorted(((r[0], *w[:3]) for r, w in zip(corpus, wanted, strict=True)), key=repr)


def test_spans_are_the_removed_words(docs, corpus):
    wanted = {r[0]: w[3] for r, w in zip(corpus, plain_removal([r[1] for r in corpus], 35), strict=True)}
    for doc_id, spans in remove_repeats(docs).select("doc_id", "removed_spans").collect():
        if doc_id is not None:
            assert [p for s in spans for p in range(s["first"], s["end"])] == wanted[doc_id]


def test_cut_texts_hold_the_kept_words_and_all_else_stays(docs, corpus):
    texts = {r[0]: r[1] for r in corpus}
    for r in remove_repeats(docs, cut_text=True).collect():
        cut = r["cut_text"]
        assert " ".join(re.findall(r"[^\x20\x09-\x0D]+", cut or "")) == r["kept_text"]
        if r["doc_id"] is not None and not r["n_removed"]:
            assert cut == texts[r["doc_id"]]
        elif r["doc_id"] is not None and cut:
            # what is left are pieces of the text, in order, with their own space
            lines = texts[r["doc_id"]].count("\n")
            assert cut.count("\n") <= lines and cut[0] == texts[r["doc_id"]][0] or r["removed_spans"][0]["first"] == 0


def test_a_removed_line_leaves_the_others_alone(spark):
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"one  two\n{line}\n\tthree\nfour "), (2, f"{line} five"), (3, f" six {line}"), (4, line), (5, None), (6, " a  b\n")]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), cut_text=True).collect()
    assert {r["doc_id"]: r["cut_text"] for r in found} == {
        1: "one  two\nthree\nfour ", 2: "five", 3: " six", 4: "", 5: None, 6: " a  b\n",
    }


def test_repeats_of_many_chunks(spark, corpus, monkeypatch):
    from slotwise.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 700)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 900)
    docs = spark.createDataFrame([r[:2] for r in corpus], "doc_id long, text string")
    found = rows_of(remove_repeats(docs), "doc_id", "n_removed", "kept_text")
    wanted = plain_removal([r[1] for r in corpus], 35)
    assert found == sorted(((r[0], *w[1:3]) for r, w in zip(corpus, wanted, strict=True)), key=repr)


def test_rows_of_a_chunk_may_come_in_another_order_each_time(corpus):
    """An exchange read twice may give a chunk's rows in two orders; what is cut may not follow from that."""
    import pyarrow as pa
    from slotwise.llm import substring_dedup as s

    texts = [r[1] for r in corpus]
    docs = pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string()), "_chunk": pa.array([0] * len(texts))})

    def by_bucket(rows, answer):
        buckets = sorted(set(rows.column("_bucket").to_pylist()))
        return pa.concat_tables([answer(rows.filter(pa.array([b == x for x in rows.column("_bucket").to_pylist()]))) for b in buckets])

    wanted = plain_removal(texts, 35)
    for seed in range(3):
        first, second, third = (docs.take(random.Random(9 * seed + k).sample(range(len(texts)), len(texts))) for k in range(3))
        anchors = by_bucket(s._probes(first, 18, 2), s._answers)
        marks = by_bucket(s._candidates(second, anchors, 35, 18, 2), s._verdicts)
        found = s._cut(third, marks, 35, 2, False).sort_by("doc_id").to_pylist()
        assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in found] == [w[:3] for w in wanted]


def test_regular_long_words_stay_apart(spark):
    """Thue-Morse words and their opposites: powers modulo 2^64 give both one hash from 1,024 bytes on."""
    rows = []
    for size in (1024, 4096):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(size))
        other = word.translate(str.maketrans("ab", "ba"))
        around = [f"w{size}n{i}" for i in range(34)]
        rows += [" ".join([*around, word, f"left{size}"]), " ".join([*around, other, f"right{size}"])]
        rows += [" ".join([*around[::-1], word]), " ".join([*around[::-1], word])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = rows_of(remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_text")
    assert found == sorted(((i, *w[:3]) for i, w in enumerate(plain_removal(rows, 35))), key=repr)


def test_word_hashes_need_little_memory_and_no_slice_changes_them(monkeypatch):
    import tracemalloc

    import pyarrow as pa
    from slotwise.llm import arrays

    texts = pa.array(["", None, "a", "bc a " * 60_000, "d" * 300_000 + " a", " \n"])
    whole = arrays.Words(texts, arrays.SPACES)
    monkeypatch.setattr(arrays, "HASHED_BYTES", 1000)
    tracemalloc.start()
    sliced = arrays.Words(texts, arrays.SPACES)
    assert (whole.hash == sliced.hash).all() and len(set(sliced.hash.tolist())) == 3
    long = pa.array(["some words of a long text " * 80_000])
    tracemalloc.reset_peak()
    arrays.Words(long, arrays.SPACES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(long[0].as_py())  # 37 when all bytes were hashed at once


def test_word_hashes_tell_words_of_any_length_apart():
    import pyarrow as pa
    from slotwise.llm import arrays

    rng = random.Random(3)
    words = {"".join(rng.choices("ab\x00é", k=n)) for n in [*range(1, 40), 100] for _ in range(30)}
    words |= {"a" * n for n in range(1, 80)}
    words = sorted(w for w in words if w)
    found = arrays.Words(pa.array([" ".join(words), *words]), arrays.SPACES).hash
    assert len(set(found.tolist())) == len(words) and (found[: len(words)] == found[len(words) :]).all()


def test_distinct_keys_are_those_of_a_plain_sort():
    import numpy as np
    from slotwise.llm.arrays import distinct

    rng = np.random.default_rng(4)
    top = np.uint64(2**64 - 1)
    for keys in (
        rng.integers(0, 50, 1000).astype(np.uint64), rng.integers(0, 2**48, 3000).astype(np.uint64),
        top - rng.integers(0, 40, 1000).astype(np.uint64),  # apart in the lowest bits alone
        np.zeros(5, np.uint64), np.zeros(0, np.uint64), np.full(1, top),
    ):
        wanted = np.unique(keys, return_inverse=True, return_counts=True)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(distinct(keys), wanted, strict=True))


def test_repeats_of_nothing_and_clashing_columns(docs, no_docs):
    assert remove_repeats(no_docs).count() == 0
    out = remove_repeats(docs)
    assert out.columns == ["doc_id", "lang", "kept_text", "n_words", "n_removed", "removed_spans"]


def plain_contamination(text, items, window=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, met = cut(text), set(), set()
    for item, body in items:
        own = cut(body)
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1 if own else 0):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                met.add(item)
    return len(words), len(hit), len(met), sorted(str(m) for m in met if m is not None), bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_is_that_of_a_full_comparison(spark, docs, corpus):
    texts = {r[0]: r[1] for r in corpus if r[0] is not None and r[1]}
    long = max(texts.values(), key=len).split()
    items = [
        (1, " ".join(long[100:140])), (2, "X " + " ".join(long[139:152]).upper() + " y"), (3, "été, École!"),
        (4, "again"), (5, None), (6, ""), (7, " ".join(long[300:312])), (8, " ".join(long[300:311])), (9, "not in any text"),
        (None, " ".join(long[500:520])), (10, " ".join(long[100:140])), (10, "!!"),
    ]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_items int")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    found = rows_of(contamination(docs, benchmark, keep_text=False), *columns)
    assert found == sorted(((r[0], *plain_contamination(r[1], items)) for r in corpus), key=repr)
    assert any(r[-1] for r in found)


def test_contamination_with_empty_tables(spark, docs, no_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    out = contamination(docs, nothing)
    assert out.where("contaminated or n_hit > 0 or n_items > 0").count() == 0
    assert out.count() == docs.count()
    assert "text" in out.columns
    assert contamination(no_docs, nothing).count() == 0


def test_winnowing_takes_the_rightmost_minimum_of_each_window():
    import numpy as np

    rng = np.random.default_rng(3)
    values = rng.integers(0, 6, 300).astype(np.uint64)
    rows = np.repeat(np.arange(7), [1, 2, 3, 4, 90, 100, 100])
    wanted = set()
    for row in range(7):
        own = np.flatnonzero(rows == row)
        for i in range(max(1, len(own) - 3)):
            window = own[i : i + 4]
            wanted.add(max(p for p in window if values[p] == values[window].min()))
    assert winnow(values, rows, 4).tolist() == sorted(wanted)
