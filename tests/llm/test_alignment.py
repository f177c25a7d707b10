"""Alignment of two tokenizers against a plain version over the libraries' own output."""

import hashlib
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from signalloom.llm import alignment
from signalloom.llm.tokens import LETTERS, public_path

A, B = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "<|endoftext|>", "x <|endoftext|> y", "<s> </s><unk>", "<0x41>", "▁", "a▁b"]
ODD += ["日本語 の文", "é İ ﬁ ①", "\x00\x01", "\t\r\n \n\n  z", "naïve café", "1234567 89", "don't won't", "🙂🙂 👩‍👩‍👧", " x　y"]


def plain_sides(text):
    """(ids, byte ranges) of both sides, or nothing."""
    if not text:
        return None
    line = (" " + text).encode()
    byte = {x: b for b, x in LETTERS.items()}
    tok = plain_sides.__dict__.setdefault("tok", Tokenizer.from_file(A))
    tok.encode_special_tokens = True
    sp = plain_sides.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=B))
    out = []
    ids = tok.encode(" " + text, add_special_tokens=False).ids
    out.append((ids, [bytes(byte[x] for x in tok.id_to_token(i)) for i in ids]))
    ids = sp.encode(text)
    names = [sp.id_to_piece(i) for i in ids]
    out.append((ids, [bytes([int(n[3:5], 16)]) if len(n) == 6 and n.startswith("<0x") else n.replace("▁", " ").encode() for n in names]))
    if any(b"".join(spelled) != line for _, spelled in out):
        return None
    ranges = []
    for ids, spelled in out:
        at, of = 0, []
        for i, s in zip(ids, spelled, strict=True):
            of.append((i, at, at + len(s)))
            at += len(s)
        ranges.append(of)
    return ranges


def plain_statistics(rows):
    linked, groups, sizes = [], [], []
    for _, text in rows:
        sides = plain_sides(text)
        if not sides:
            linked.append([])
            groups.append(None)
            sizes.append((0, 0))
            continue
        a, b = sides
        linked.append([(i, j) for i, x, y in a for j, u, v in b if x < v and u < y])
        cuts = [0, *sorted({y for _, _, y in a} & {v for _, _, v in b})]
        part = lambda of, x, y: ",".join(str(i) for i, u, v in of if x <= u and v <= y)
        groups.append([f"{part(a, x, y)}|{part(b, x, y)}" for x, y in zip(cuts, cuts[1:], strict=False)])
        sizes.append((len(a), len(b)))
    count = Counter(p for links in linked for p in set(links))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (doc_id, _), links, group, (n_a, n_b) in zip(rows, linked, groups, sizes, strict=True):
        digest = hashlib.sha256(";".join(group).encode()).hexdigest() if group else ""
        best = sum(count[p] == most[p[0]] for p in links)
        out.append((doc_id, n_a, n_b, len(group or []), len(links), best, sum(count[p] for p in links), digest))
    return out


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_statistics_equal_plain(spark, rows, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 3000)
    texts = [r[1] for r in rows if len(r[1] or "") < 1500] + ODD + ["long " * 700 + "end", "bébé " * 300]
    some = [(2**60 + 1 + i if i % 7 else None, t) for i, t in enumerate(texts + texts[:5])]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in some], "doc_id long, text string, batch int, pairs int").repartition(5)
    got = alignment.alignment_statistics(frame, A, B)
    assert sorted(got.columns) == sorted(NAMES)
    assert sorted((tuple(r[n] for n in NAMES) for r in got.collect()), key=str) == sorted(plain_statistics(some), key=str)
    assert alignment.alignment_statistics(frame.limit(0), A, B).collect() == []
    assert {r.n_links for r in alignment.alignment_statistics(frame.where("text is null"), A, B).collect()} == {0}


def test_lists_equal_plain(spark):
    rows = list(enumerate([*ODD, "The naïve café, twice. The naïve café"]))
    got = {r.doc_id: r for r in alignment.aligned_tokens(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    for doc_id, text in rows:
        sides, row = plain_sides(text), got[doc_id]
        if not sides:
            assert row.a_ids == row.b_ids == row.links == row.groups == []
            continue
        a, b = sides
        assert (row.a_ids, row.b_ids) == ([i for i, _, _ in a], [i for i, _, _ in b])
        assert [tuple(x) for x in row.links] == [(i, j) for i, (_, x, y) in enumerate(a) for j, (_, u, v) in enumerate(b) if x < v and u < y]
        assert [(a[x - 1][2]) for x, _ in row.groups] == [(b[y - 1][2]) for _, y in row.groups] == sorted({y for _, _, y in a} & {v for _, _, v in b})


def test_chunks_one_by_one_equal_the_libraries():
    rng = random.Random(5)
    both = alignment.Encoders(A, B, cache_size=50)
    assert both.by_chunk
    for letters in (" \nabcdeéß.,0'<>|ſ", " \n\tabdeé日🙂.,0'<>|\r" + "▁\u0301", " \n a1'."):
        for _ in range(3000):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))
            a, b = (list(memoryview(x).cast("I")) for x in both.encode([text])[0])
            want = both._ids(text)
            assert (a, b) == (([], []) if "▁" in text else want), repr(text)
