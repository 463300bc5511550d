"""Alignment against whole texts through the tokenizers' own libraries, link by link."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest_llm import digest
from tokenizers import Tokenizer

from slotwise.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def plain():
    """Tokens of a whole text as (id, bytes) lists, by the libraries alone."""
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown}
    back.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        e = first.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(back[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        b = [(i, piece(i)) for i in second.encode(text)]
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return [], []
        return a, b

    return tokens


def plain_alignment(texts, tokens):
    """Rows of the contract by comparing the byte ranges of all tokens."""
    places, counts = [], Counter()
    for text in texts:
        sides = []
        for side in tokens(text):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            sides.append(out)
        a, b = sides
        links, k = [], 0
        for i, s, e in a:
            while b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                links.append((i, b[j][0]))
                j += 1
        counts.update(links)
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append(
                ",".join(str(i) for i, _, e in a if low < e <= cut) + "|" + ",".join(str(i) for i, _, e in b if low < e <= cut)
            ) if len(a) < 3000 else groups.append("")
            low = cut
        places.append((len(a), len(b), groups, links))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [
        (
            n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links),
            sum(counts[x] for x in links), ";".join(groups),
        )
        for n_a, n_b, groups, links in places
    ]


ODD = [
    "", " ", "  two  spaces ", "\n x\n\n y \t", "tabs\tand\r\nlines", "<|endoftext|> <s> </s> <unk>", "a ▁ b", "ends in ▁",
    "日本語 テキスト 한국어 العربية हिन्दी", "🙂👍🏽 ok!!! ???", "naïve café straße ÿ Ω ЖЗ", "a b  c \u0085 d", "\x1c x \x1f y \x00z \x00",
    "it's we'll I'd '' 's", "1234567890 3.14 1,000", "x" * 5000, "^" * 3000 + " " * 500 + "end", "é combining ​ zero ﻿",
    "\x07 bell", "tail space ", " lead", "İı ǅ ʼn", "a  b", "a \n b", "many" + " word" * 300,
]


def test_every_number_equals_the_plain_alignment(spark, plain, corpus):
    texts = [*ODD, *(t for _, t, *_ in corpus if t is None or len(t) < 20_000)]
    rows = [(i, t, 5, "c") for i, t in enumerate(texts)] + [(None, "no id", 6, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_A int, `odd name` string").repartition(3)
    found = ta.align(docs, A, B, chunk_bytes=3000, group_chunks=2)  # many chunks, groups and rounds of the tree
    assert found.columns == ["doc_id", "odd name", *ta.OUT]
    wanted = plain_alignment([*texts, "no id"], plain)
    got = {r["doc_id"]: tuple(r[c] for c in [*COLUMNS, "groups"]) for r in found.collect()}
    assert len(got) == len(wanted)
    for i, row in enumerate(wanted):
        mine = got[i if i < len(texts) else None]
        assert mine[:6] == row[:6], repr(([*texts, "no id"][i] or "")[:60])
        assert row[0] >= 3000 or mine[6] == row[6]
    assert got[ODD.index("a ▁ b")] == (0, 0, 0, 0, 0, 0, "") and got[0][0] == 0


def test_units_encode_as_whole_texts(plain):
    rng = random.Random(11)
    letters = list("aeio  bcd.,'19\n\t éßΩ日  \x1c🙂-_") + ["the", "'s", " \n", "  ", "ing"]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(2500)]
    aligned = ta.Aligned(pa.chunked_array([texts[:7], texts[7:]]), (A, B))
    starts_a, starts_b = (np.cumsum([0, *n.tolist()]) for n in (aligned.n_a, aligned.n_b))
    for row, text in enumerate(texts):
        units = aligned.units[aligned.first[row] : aligned.first[row + 1]]
        a, b = plain(text)
        assert [x for u in units for x in aligned.a[starts_a[u] : starts_a[u + 1]]] == [i for i, _ in a], repr(text)
        assert [x for u in units for x in aligned.b[starts_b[u] : starts_b[u + 1]]] == [i for i, _ in b], repr(text)


def test_the_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 9, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**45, n))
        levels = ta.BitLevels.build(keys)
        assert sorted(levels.index(keys).tolist()) == list(range(len(keys)))
        assert levels.bits.sum() == len(keys)
    other = np.setdiff1d(rng.integers(0, 2**45, 1000), keys)
    with pytest.raises(ValueError):
        ta._verified(levels, np.sort(keys), other)


def test_no_documents_and_documents_without_tokens(spark, no_docs):
    assert ta.align(no_docs, A, B).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁"), (None, None)], "doc_id long, text string")
    found = ta.align(docs, A, B).collect()
    assert sorted(((r["doc_id"] or 0), r["n_a"], r["n_links"], r["groups"]) for r in found) == [(i, 0, 0, "") for i in (0, 1, 2, 3)]


def test_one_text_held_by_a_third_of_all_rows(spark, plain):
    texts = ["the same words again, and again"] * 200 + [f"document {i} says {i * 7}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    wanted = plain_alignment(texts, plain)
    for r in ta.align(docs, A, B, chunk_bytes=2000, group_chunks=3).collect():
        assert tuple(r[c] for c in [*COLUMNS, "groups"]) == wanted[r["doc_id"]]


def test_the_query(spark, sf_dir, plain):
    found = ta.op11_cross_tokenizer_alignment(spark, sf_dir)
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    wanted = dict(zip(texts, plain_alignment(list(texts.values()), plain), strict=True))
    rows = found.collect()
    assert found.columns == ["doc_id", *COLUMNS, "groups_sha256"] and len(rows) == len(texts)
    for r in rows:
        row = wanted[r["doc_id"]]
        assert tuple(r[c] for c in COLUMNS) == row[:6]
        assert row[0] >= 3000 or r["groups_sha256"] == (digest(row[6]) if row[0] else "")
