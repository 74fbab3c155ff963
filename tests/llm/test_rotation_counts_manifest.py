"""Fill-in-middle, token counts and the Merkle manifest against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from breakwater.llm import fill_middle, merkle, queries, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "é", "ab<P>cd", "<<S>", "<P", "S>", "<M><S>", "ab  cd", " lead", "trail ", "x▁y ▁ z", "\x00\t\r　﻿", "no" * 5000, "日本語 テキスト\n\n次", "<s> hi </s>", "a\n" * 300, "w " * 3000]
ALPHABET = "ab Z<>PSM\n\té中\U0001f600́"


def _random(seed, k):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(k)]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _moved(doc, text):
    """The contract, by lists of tokens."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    x = _sha(f"1:{'' if doc is None else doc}")
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD + _random(1, 400))]
    rows += [rows[4], (None, "without an id", "y"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    got = fill_middle.restored(fill_middle.fill_in_middle(df)).collect()
    want = sorted(((i, *_moved(i, t), t or "") for i, t, _ in rows), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.restored(fill_middle.fill_in_middle(df.limit(0))).count() == 0


def test_rotations_of_every_length():
    for n in range(0, 12):
        for split in range(n + 1):
            block = bytearray(range(n))
            fill_middle.rotate(block, 0, split, n)
            assert bytes(block) == bytes(range(split, n)) + bytes(range(split))
    long = bytearray(np.random.default_rng(0).integers(0, 256, 400_001, np.uint8).tobytes())
    whole = bytes(long)
    fill_middle.rotate(long, 5, 170_000, len(long))
    assert bytes(long) == whole[:5] + whole[170_000:] + whole[5:170_000]
    text = ("é<" * 150_000).encode()
    for form in ("psm", "spm"):
        assert fill_middle.restore(bytes(fill_middle.arrange(text, 3, 200_001, form)), form) == text


def test_token_counts(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ODD + _random(2, 300) + ["the quick brown fox " * 400] * 3
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(0, None, 1), (None, "no id here", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long").repartition(3)
    for share in (token_counts.FREQUENT, 0.05, 1.0):
        got = token_counts.token_counts(df, MODEL, share=share).collect()
        want = [(i, len((t or "").encode()), k := len(model.encode(t or "")), k > 4096) for i, t, _ in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(df.limit(0), MODEL).count() == 0


def test_tiers_agree_with_the_library(monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    for most in (400_000, 3):  # a cache of three entries starts anew all the time
        monkeypatch.setattr(token_counts, "CACHE", most)
        tiers = token_counts.Lengths(MODEL, "▁the \n fox", bytes([1, 1, len(model.encode("\nfox")) - 2]))
        for _ in range(2000):
            text = "".join(rng.choice(["the", " ", "  ", "\n", "fox", "▁", "é", "̀", chr(rng.randrange(32, 0xD7FF)), "<s>"]) for _ in range(rng.randrange(12)))
            assert tiers.count(text) == len(model.encode(text)), text
    monkeypatch.setattr(token_counts, "LONG", 10)
    assert token_counts.Lengths(MODEL, "", b"").count("one two  three\nfour ") == len(model.encode("one two  three\nfour "))


def test_frequent_tokens_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COUNTED", 50)
    df = spark.createDataFrame([(i, "often " * 50 + " ".join(f"rare{i}x{k}" for k in range(40))) for i in range(60)], "doc_id long, text string").repartition(4)
    tokens, lengths = token_counts.table_of(df, MODEL, share=0.01)
    assert tokens.split(" ") == ["▁often"] and list(lengths) == [1]


def test_other_vocabularies_are_refused():
    with pytest.raises(Exception):
        token_counts.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _halved(nodes):
    """All levels of a tree, from its leaves."""
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [_h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def _leaf(row, more=0):
    doc, source, lang, n, text = row[:5]
    n = None if n is None else n + more
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)])


def _manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
        levels[lang] = _halved([_leaf(r) for r in trees[lang]])
    top = _halved([levels[x][-1][0] for x in langs])
    out = []
    for at, lang in enumerate(langs):
        for i, r in enumerate(trees[lang]):
            way = []
            for nodes, k in [(lv, i >> n) for n, lv in enumerate(levels[lang][:-1])] + [(lv, at >> n) for n, lv in enumerate(top[:-1])]:
                way.append((k, nodes[k ^ 1] if k ^ 1 < len(nodes) else None))
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = _leaf(r, 1 if bad else 0)
            for k, other in way:
                node = _h(node) if other is None else _h(other, node) if k & 1 else _h(node, other)
            out.append((r[0], _leaf(r), levels[lang][-1][0], top[-1][0], _h(*[o for _, o in way if o]), node, node == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree string"


@pytest.mark.parametrize("sizes,bits", [((1,), 2), ((37, 16, 1, 2, 5, 64), 2), ((300, 9), 1), ((700,), 8), ((3, 257), 8)])
def test_merkle(spark, sizes, bits):
    langs = ["de", None, "", "ü", "en", "x" * 300]
    rng = random.Random(sum(sizes))
    rows = [(rng.randrange(10_000), rng.choice([None, "", "web"]), langs[k], rng.choice([None, 3]), rng.choice([None, "", "ä" * 9, "text"]), "l", "t") for k, n in enumerate(sizes) for _ in range(n)]
    if len(sizes) > 2:
        rows += [rows[3], rows[3], (None, None, None, None, None, None, None), (None, "s", "de", 1, "t", "", "")]
    got = merkle.proofs(spark.createDataFrame(rows, SCHEMA).repartition(5), bits).collect()
    assert sorted(map(tuple, got), key=str) == _manifest(rows)
    if len(rows) > 100:
        assert {r.verified for r in got} == {True, False}


def test_merkle_of_nothing(spark):
    assert merkle.proofs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_closed_form_places():
    """Every node stands in the log where its level and number say."""
    for n in range(1, 40):
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
        for levels in range(merkle.height(n), merkle.height(n) + 3):
            log = np.frombuffer(merkle.append_log(leaves, levels), np.uint8).reshape(-1, merkle.SIZE)
            nodes, seen = leaves, []
            for level in range(levels + 1):
                places = merkle.place(level, np.arange(len(nodes)), n)
                assert [log[p].tobytes() for p in places] == nodes
                seen += places.tolist()
                nodes = [merkle.digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            assert sorted(seen) == list(range(len(log)))


def test_queries_are_registered():
    assert {"op11_fill_middle", "op12_token_counts", "op13_merkle_manifest"} <= set(queries.QUERIES)
