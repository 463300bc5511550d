"""Packing: exact round trip through the library's tokenizer, and the curve."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from slotwise.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_sequences_hold_every_id_once(docs, corpus):
    length = 512
    pieces = packing.pack(docs, PATH, length=length).collect()
    sequences, by_doc = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], ids))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    wanted = {}
    for doc_id, text, *_ in corpus:
        ids = plain_ids(text)
        wanted.setdefault((doc_id, len(ids)), []).append(ids)
    assert set(by_doc) == set(wanted)
    for key, texts in wanted.items():
        found = sorted((s, i.tolist()) for s, i in by_doc[key])
        if len({tuple(t) for t in texts}) == 1 and len(texts) == 1:
            assert [x for _, part in found for x in part] == texts[0]
        else:  # a repeated row is packed as often as it comes
            assert sum(len(part) for _, part in found) == sum(map(len, texts))


@pytest.mark.parametrize(
    "text",
    [
        "It's 42, isn't it?  ''s  don't WE'LL I'D", "Été NAÏVE straße ÿ × ÷ ª µ º", "<|endoftext|> x<|startoftext|>y", "Σίσυφος ΟΔΟΣ İstanbul",
        "日本語 テキスト 한국어", "éä Å", "tab\there\r\nline\x0b\x0c\x1c\x85\xa0 　end", "a\x00b \x7f ﻿", "🙂👍🏽 ok!!!???", "$$$ %%% ###",
    ],
)
def test_words_give_the_ids_of_the_whole_text(text):
    found = np.frombuffer(packing.WordIds(PATH).ids(text), "<u4").tolist()
    assert found == plain_ids(text)[:-1]


def test_words_kept_are_bounded_and_outlive_a_task(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 20)
    assert packing.WordIds.kept(PATH) is packing.WordIds.kept(PATH)
    encoder = packing.WordIds(PATH)
    for i in range(60):
        text = f"the The, word{i} n{i}! 'tis it's été Été. {i} , '' ' the"
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == plain_ids(text)[:-1]
        assert len(encoder.words) + len(encoder.words.before) <= 2 * (20 + 20) and not getattr(encoder.words.before, "before", {})


def test_hilbert_visits_neighbours():
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    place = packing.hilbert(grid, 3)
    assert sorted(place) == list(range(512))
    path = grid[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_like_documents_come_near_each_other(spark):
    rng = np.random.default_rng(2)
    rows = []
    for topic in range(4):
        vocabulary = [f"t{topic}w{i}" for i in range(30)]
        rows += [(4 * i + topic, " ".join(rng.choice(vocabulary, 200))) for i in range(25)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    order = [r["doc_id"] % 4 for r in pieces.where("start = 0").orderBy("sequence_id", "offset").collect()]
    changes = sum(a != b for a, b in zip(order, order[1:], strict=False))
    assert changes < 25  # at random, three of four neighbours differ


def test_no_documents(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0
