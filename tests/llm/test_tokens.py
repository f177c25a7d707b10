"""Packing, token counts and wavelet files against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalloom.llm import packing, tokens, wavelet
from signalloom.llm.token_counts import count_tokens, frequent_pretokens

pytest.importorskip("public_tokenizers")
BYTES, WORDS = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("word_bpe_49k.json")
BY_ID, COUNTS = tokens.ByteLevelIds(BYTES, 50), tokens.WordEndCounts(WORDS, {"the": 1}, 50)


def library_ids(text):
    return tokens.library(BYTES).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=" \n\t'stredlmvA.,!9é\u0130ſ日\xa0<|>", max_size=20) | st.text(max_size=8))
def test_ids_and_counts_are_the_librarys(text):
    assert np.frombuffer(BY_ID.encode(text), "<u4").tolist() == library_ids(text)
    assert COUNTS.count(text) == len(tokens.library(WORDS).encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "Foo", " ", "\n", "\n\n", "\t", "\r", ".", ",", "'s", "é", "12", "!", "-"]), max_size=10).map("".join))
def test_lines_are_the_librarys(text):
    assert np.frombuffer(BY_ID.encode(text), "<u4").tolist() == library_ids(text)


def test_first_fit_equals_a_plain_scan():
    rng = random.Random(1)
    lengths = [rng.randint(1, 99) for _ in range(500)] + [50] * 40
    bins, want = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, used in enumerate(bins) if used + lengths[i] <= 100), None)
        if at is None:
            bins.append(0)
            at = len(bins) - 1
        want[i] = (at, bins[at])
        bins[at] += lengths[i]
    assert packing.pack_group(lengths, 100) == want
    assert packing.pack_group([], 100) == []


def test_packing_places_every_id_once(docs, rows, none):
    capacity = 64
    out = packing.pack_documents(docs.withColumnRenamed("lang", "sequence_id"), BYTES, capacity, 1, group_size=40).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc_id, text, *_ in rows:
        if doc_id is None:
            continue
        ids = np.array([*library_ids(text), 1], "<u4")
        own = sorted(pieces[doc_id], key=lambda r: r.start)
        assert [r.start for r in own] == list(range(0, len(ids), capacity))
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    assert len(pieces[None]) == 2
    for own in sequences.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity and own[0].padded_length == (end if end & (end - 1) == 0 else capacity)
    assert sum(len(s) > 1 for s in sequences.values()) > 10
    assert packing.pack_documents(none, BYTES).count() == 0


def test_token_counts(docs, rows, none):
    want = sorted(
        (str(d), len((t or "").encode()), n := len(tokens.library(WORDS).encode(t or "", add_special_tokens=False).ids), n > 100)
        for d, t, *_ in rows
    )
    extra = docs.withColumnRenamed("lang", "n_tokens")
    got = count_tokens(extra, WORDS, 100, table_size=40).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert count_tokens(none, WORDS).count() == 0


def test_frequent_table_merges_in_a_tree(docs):
    table = frequent_pretokens(docs.repartition(9), WORDS, 30, fan_in=2)
    assert 0 < len(table) <= 30 and all(COUNTS.word(w) == n for w, n in table.items())


@pytest.mark.parametrize("n, most", [(0, 5), (1, 1), (700, 3), (5000, 50257)])
def test_wavelet_matrix(n, most):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), most).astype(np.uint32)
    found = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert found.to_array().tolist() == ids.tolist()
    for i in rng.integers(0, n, min(n, 60)):
        assert found.access(int(i)) == ids[i]
        value, end = int(ids[i]), int(rng.integers(0, n + 1))
        assert found.count(value, end) == int((ids[:end] == value).sum())
        k = int((ids[:i] == value).sum())
        assert found.locate(value, k) == i
    assert found.count(60000) == 0
    with pytest.raises(IndexError):
        found.access(n)
    with pytest.raises(IndexError):
        found.locate(1, n + 1)


def test_files_round_trip(spark, docs, rows, none, tmp_path):
    want, at = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = np.array([*library_ids(text), 0], "<u4")
        if doc_id is not None:
            want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    wavelet.write_shards(docs, str(tmp_path / "shards"), BYTES, 0, shard_ids=3000)
    got = wavelet.read_shards(spark, str(tmp_path / "shards")).where("doc_id is not null").collect()
    assert sorted(tuple(r) for r in got) == want
    assert wavelet.encoded_documents(none, BYTES).count() == 0
