import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from switchback.llm import packing as P
from switchback.llm.tokens import PieceEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "don't we'll 'S ¼½ 12 \x1c a\x85b\xa0c", "İstanbul ſ K ΑΣ́ é x<|endoftext|>y", "!'s ''t a's", "漢字 Ελλάς ΟΔΟΣ", "ÀÉÎ ß µª º\n\n", "x" * 3000, "​ zero", "ŉ Ĳ"]


def test_ids_are_those_of_the_tokenizer(prose):
    texts = ODD + [prose(k, 50) + random.Random(k).choice(["!", ", ", " 'll ", "…"]) for k in range(40)]
    tokenizer, encoder = Tokenizer.from_file(PATH), PieceEncoder(PATH)
    for _ in range(2):
        assert [e.tolist() for e in encoder.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def pieces_cover(rows, ids):
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc, want in ids.items():
        at = 0
        for r in sorted(by.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want)
            assert zlib.crc32(np.array(want[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(want)
    assert not by
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append(r)
    for window in windows.values():
        at = 0
        for r in sorted(window, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0  # a power of two: nothing is padded


def test_pieces(spark, docs_of, prose):
    texts = [*ODD, None, *[prose(k, 3 * k) for k in range(60)], prose(5, 9000)]
    tokenizer = Tokenizer.from_file(PATH)
    rows = P.pack_documents(docs_of(texts), PATH, emit_ids=True).collect()
    pieces_cover(rows, {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)})
    assert all(len(r["ids"]) == r["length"] for r in rows)


def test_chunks(spark, docs_of, prose):
    texts = [prose(k, 40 + 7 * k) for k in range(80)]
    tokenizer = Tokenizer.from_file(PATH)
    pieces_cover(P.pack_documents(docs_of(texts), PATH, chunk_tokens=3000).collect(), {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(texts)})


def test_repeated_null_and_no_rows(spark, docs_of):
    rows = P.pack_documents(docs_of([(None, "a b"), (4, "c"), (4, "c")]), PATH).collect()
    assert sum(r["length"] for r in rows) == 3 + 2 + 2
    assert P.pack_documents(docs_of(["x"]).limit(0), PATH).count() == 0


def test_packing_prefers_whole_documents():
    windows, left = P.pack([(0, 0, 4000), (1, 0, 96), (2, 0, 500), (3, 0, 12), (4, 0, 9000)])
    assert windows == [[(4, 0, 4096)], [(4, 4096, 4096)], [(0, 0, 4000), (1, 0, 96)], [(4, 8192, 808), (3, 0, 12), (2, 0, 204)]]
    assert left == [(2, 204, 296)]


def test_step_groups_are_even():
    windows = [[(k, 0, 4096)] for k in range(20)] + [[(k, 0, 128)] * 4 for k in range(64)]
    groups = P.step_groups(windows, 16 * 1024)
    tokens = [sum(sum(p[2] for p in w) for w, g in zip(windows, groups, strict=True) if g == k) for k in range(max(groups) + 1)]
    assert max(tokens) - min(tokens) <= 4096
