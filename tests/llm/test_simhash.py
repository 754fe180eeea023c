import random
import re

import numpy as np
import pytest
import xxhash

from switchback.llm import simhash as H

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    parts = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(codes, radius=4):
    up = list(range(len(codes)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(codes)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= radius:
                up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(codes))]


def test_fingerprint():
    for text in ("", None, "one", "a b c", "A b\tC d\x0be É x É", "w " * 70000, "x\x1cy z \x85 q r s t"):
        assert H.fingerprint(text) == slow_fingerprint(text)


def test_tree_groups_match_brute_force():
    r = random.Random(3)
    codes = {r.getrandbits(64) for _ in range(150)}
    for c in list(codes)[:60]:
        for _ in range(6):
            for _ in range(r.randint(1, 5)):
                c ^= 1 << r.randrange(64)
            codes.add(c)
    codes = sorted(codes)
    tree = H.BKTree(np.array(codes, np.uint64))
    assert tree.groups(4).tolist() == classes(codes)
    plain = H.BKTree(np.array(codes, np.uint64))
    a, b = plain.near(np.arange(len(codes)), 4)
    assert sorted(zip(b.tolist(), a.tolist(), strict=True)) == [(x, y) for x in range(len(codes)) for y in range(x + 1, len(codes)) if (codes[x] ^ codes[y]).bit_count() <= 4]
    assert 0 < tree.visits < plain.visits < len(codes) ** 2 / 2  # groups and edges outside the radius are passed by
    for node in range(1, len(codes)):
        assert tree.key[node] == (codes[node] ^ codes[tree.parent[node]]).bit_count() and tree.parent[node] < node


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_given_tables_are_searched_by_trees(spark, sf, monkeypatch):
    """Every shard of two fingerprints or more is a tree whose nodes are visited."""
    texts = [r[0] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect()]
    codes = np.unique(np.array([H.fingerprint(t) for t in texts[: 4000 if sf == "sf0.1" else None]], np.uint64))
    trees = []
    plain = H.BKTree
    monkeypatch.setattr(H, "BKTree", lambda some: trees.append(plain(some)) or trees[-1])
    masks = [np.uint64(m % (1 << 64)) for m in H.block_masks(len(codes))]
    linked = set()
    for mask in masks:
        for value in np.unique(codes & mask):
            u, v = H.shard_links(codes[codes & mask == value])
            linked |= set(zip(u.tolist(), v.tolist(), strict=True))
    assert sum(t.visits for t in trees) > len(codes) and all(t.visits for t in trees if len(t.codes) > 1)
    assert max(len(t.codes) for t in trees) >= min(len(codes), H.TREE_ROWS // 4) and sum(len(t.levels) > 3 for t in trees)
    label = H._united(np.arange(len(codes)), *(np.searchsorted(codes, np.array(x, np.uint64)) for x in zip(*linked, strict=True)))
    assert label.tolist() == H.BKTree(codes).groups(4).tolist()


@pytest.mark.parametrize("n", [1, 2])
def test_least_trees(n):
    assert H.BKTree(np.arange(n, dtype=np.uint64)).groups(4).tolist() == [0] * n


def test_components(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(H, "SHARD_ROWS", 16)  # hot shards are split
    monkeypatch.setattr(H, "TREE_ROWS", 4)
    texts = []
    for k in range(12):
        words = prose(k, 400).split()
        for n in range(8):
            copy = list(words)
            for j in range(n // 2):
                copy[(j * 37 + n) % len(copy)] = "changed"
            texts.append(" ".join(copy))
    texts += [None, "", "  ", "one two", "One TWO", texts[0]]
    docs = docs_of(texts)
    got = {r["doc_id"]: r for r in H.near_duplicates(docs).collect()}
    codes = [slow_fingerprint(t) for t in texts]
    assert [got[k]["fp"] & (1 << 64) - 1 for k in range(len(texts))] == codes
    assert [got[k]["component_id"] for k in range(len(texts))] == classes(codes)


def similar_classes(texts):
    sets, up = [H.shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if H.similarity(sets[a], sets[b]) >= H.LEAST_SIMILARITY:
                up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(texts))]


def test_shingles():
    assert H.shingles(None) == set() == H.shingles(" \n") and H.shingles("A b") == {b"a b"} and H.shingles("a b c d e F") == {b"a b c d e", b"b c d e f"}
    assert H.similarity(set(), set()) == 1.0 and H.similarity(set(), {b"a"}) == 0.0
    low, high = H.wide_fingerprint("one two three four five")
    bits = xxhash.xxh3_128_digest(b"one two three four five")
    assert np.array([low, high], np.int64).tobytes() == bits and H.wide_fingerprint(None) == (0, 0)


@pytest.mark.parametrize("small", [1, 1 << 9])
def test_one_of_each_group_of_similar_texts(spark, docs_of, prose, monkeypatch, small):
    """Copies with some words changed, in groups and alone, against all pairs."""
    monkeypatch.setattr(H, "SIMILAR_TREE_ROWS", small)  # with many tables, and with one
    r, texts = random.Random(8), []
    for k in range(40):
        words = prose(k, 150).split()
        for n in range(1 + k % 4):
            copy = list(words)
            for _ in range(n):
                copy[r.randrange(len(copy))] = f"changed{n}"
            texts.append(" ".join(copy))
    texts += [None, "", "  ", "one two", "One TWO", texts[0], texts[0].upper()]
    docs = docs_of(texts)
    kept = H.keep_one_of_each(docs)
    want = set(similar_classes(texts))
    got = {row["doc_id"] for row in kept.collect()}
    assert kept.columns == docs.columns and want <= got and len(got - want) <= (2 if small == 1 else 0)


def test_tables_find_similar_pairs():
    """Of pairs at the least similarity, sampled bits and both radii miss few."""
    r = np.random.default_rng(2)
    share = H.differing(H.LEAST_SIMILARITY)
    flip = np.packbits(r.random((4000, 128)) < share, axis=1).view(np.uint64)
    far = np.bitwise_count(flip)
    near = (far[:, 0] <= H._spread(share, 64)) & (far.sum(axis=1) <= H._spread(share, 128))
    for rows in (1, 10**5, 10**7):
        masks = np.array([[m % (1 << 64) for m in pair] for pair in H.sampled_masks(rows)], np.uint64)
        met = ((flip[:, None, :] & masks[None, :, :]) == 0).all(axis=2).any(axis=1)
        assert (met & near).mean() > 0.93, rows


def test_repeated_and_null_ids(spark, docs_of, prose):
    a, b = prose(1), prose(2)
    docs = docs_of([(5, a), (5, a), (None, a), (None, b), (None, b), (7, None)])
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in H.near_duplicates(docs).collect() if r["component_id"] is not None)
    assert got == [("5", 5), ("5", 5), ("7", 7), ("None", 5)]
    assert sorted(str(r["doc_id"]) for r in H.keep_one_of_each(docs).collect()) == ["5", "7", "None"]


def test_empty_table_and_block_numbers(spark, docs_of):
    empty = docs_of(["x"]).limit(0)
    assert H.near_duplicates(empty).count() == 0 and H.keep_one_of_each(empty).count() == 0
    for rows, blocks in ((10, 6), (1 << 24, 6), (1 << 30, 7), (1 << 40, 8)):
        masks = H.block_masks(rows)
        r = random.Random(rows)
        for _ in range(200):
            x, y = (c := r.getrandbits(64)), c
            for _ in range(4):
                y ^= 1 << r.randrange(64)
            assert any((x ^ y) & (m & (1 << 64) - 1) == 0 for m in masks), blocks


def edited(prose, n, most, seed=4, words=130):
    """Copies of a text, each with up to ``most`` of its words changed."""
    r, base = random.Random(seed), prose(seed, words).split()
    texts = []
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randint(1, most)):
            copy[r.randrange(words)] = f"changed{r.getrandbits(40)}"
        texts.append(" ".join(copy))
    return texts


def test_no_link_is_left_out(spark, docs_of, prose, monkeypatch):
    """Pairs at exactly the least similarity, and a large group of copies in blocks that are dealt as pairs of parts."""
    monkeypatch.setattr(H, "SIMILAR_TREE_ROWS", 1)
    monkeypatch.setattr(H, "BLOCK_SHINGLES", 1500, raising=False)
    texts = edited(prose, 150, 7) + [t.upper() for t in edited(prose, 20, 7, 5)] + ["", None]
    for k in range(200):
        words = prose(1000 + k, 130).split()
        copy = list(words)
        for at in (20, 24, 90):  # 14 of 126 shingles
            copy[at] = "changed"
        texts += [" ".join(words), " ".join(copy)]
    assert H.similarity(*map(H.shingles, texts[-2:])) == H.LEAST_SIMILARITY
    assert {r["doc_id"] for r in H.keep_one_of_each(docs_of(texts)).collect()} == set(similar_classes(texts))


@pytest.mark.parametrize("trees", [True, False])
def test_groups_of_a_block(prose, monkeypatch, trees):
    """Exact with trees and without, also where fingerprints say nothing; few pairs of a group are compared."""
    texts = edited(prose, 250, 6) + edited(prose, 60, 3, 9, 12) + ["", "one two", "one TWO"]
    digests = [H._digests(t) for t in texts]
    if not trees:
        monkeypatch.setattr(H._Block, "by_trees", lambda *_: None)
    sets, blocks, plain = [H._hashes(x) for x in digests], [], H._Block
    monkeypatch.setattr(H, "_Block", lambda some: blocks.append(plain(some)) or blocks[-1])
    for halves in (np.array([H._halves(x) for x in digests]), np.zeros((len(texts), 2), np.int64)):
        root = H.similar_groups(sets, halves, 64)
        firsts = {}
        assert [firsts.setdefault(x, k) for k, x in enumerate(root.tolist())] == similar_classes(texts)
    close = edited(prose, 600, 2)  # nearly all pairs are similar
    H.similar_groups([H._hashes(H._digests(t)) for t in close], np.array([H.wide_fingerprint(t) for t in close]))
    assert blocks[-1].compared < 20 * len(close)


def test_similar_sets_share_a_first_shingle():
    r = random.Random(6)
    for _ in range(2000):
        n = r.randint(1, 60)
        a = set(r.sample(range(200), n))
        b = set(r.sample(sorted(a), n - r.randint(0, n // 6))) | set(r.sample(range(200, 400), r.randint(0, n // 6)))
        if H.similarity(a, b) >= H.LEAST_SIMILARITY:
            order = r.sample(range(400), 400)
            firsts = [set(sorted(x, key=order.index)[: H.prefix_length(np.array([len(x)]))[0]]) for x in (a, b)]
            assert firsts[0] & firsts[1]


def test_runs_across_batches():
    rows = [(1, 10, 5), (1, 10, 6), (1, 11, 7), (1, 30, 8), (1, 31, 9), (2, 31, 9), (2, 31, 9), (2, 33, 4), (3, 0, 1), (3, 0, 2), (3, 1, 3)]
    want = {(5, 10, 6, 10), (5, 10, 7, 11), (8, 30, 9, 31), (9, 31, 4, 33), (1, 0, 2, 0)}
    for step in (1, 2, 3, 20):
        batches = [H.pa.RecordBatch.from_arrays([H.pa.array(c, "int64") for c in zip(*rows[k : k + step], strict=True)], ["shingle", "size", "th"]) for k in range(0, len(rows), step)]
        assert {tuple(r.values()) for b in H._chained(iter(batches)) for r in b.to_pylist()} == want


def test_table_of_counts(spark, docs_of, prose):
    """Cells of shingles that many texts have are higher, and copies in a task count once."""
    line = "a line that all of them have"
    texts = docs_of([prose(k) + " " + line for k in range(40)]).selectExpr("xxhash64(text) th", "text")
    rarity = H._rarity(texts)
    common, rare = (rarity[H._cells(H._hashes(H._digests(t)))] for t in (line, prose(3)))
    assert len(rarity) == H.CELLS and common.min() > 60 and np.median(rare) == 12 and (rarity > 0).sum() > 2000


def test_chance_shingles_do_not_chain_texts(spark, docs_of, prose, monkeypatch):
    """Texts that share a shingle each with the next, where counts tell nothing as in the cells of a very large input."""
    monkeypatch.setattr(H, "_rarity", lambda texts: np.zeros(H.CELLS, np.uint8))
    chains, plain = [], H.materialize
    monkeypatch.setattr(H, "materialize", lambda df, label: (made := plain(df, label), label == "chains" and chains.append(made.count()))[0])
    texts = [f"{prose(k, 60)} link{k} two three four five {prose(1000 + k, 60)} link{k + 1} two three four five" for k in range(300)]
    texts += [t.replace("link", "Link") + " more" for t in texts[:5]]
    got = {r["doc_id"] for r in H.keep_one_of_each(docs_of(texts)).collect()}
    assert got == set(range(300)) == set(similar_classes(texts))
    assert chains == [5]


def test_similar_sets_share_more_first_shingles():
    r, met = random.Random(7), []
    for _ in range(3000):
        n = r.randint(1, 60)
        a = set(r.sample(range(200), n))
        b = set(r.sample(sorted(a), n - r.randint(0, n // 6))) | set(r.sample(range(200, 400), r.randint(0, n // 6)))
        if H.similarity(a, b) >= H.LEAST_SIMILARITY:
            order = r.sample(range(400), 400)
            sizes = np.array([len(a), len(b)])
            firsts = [set(sorted(x, key=order.index)[:p]) for x, p in zip((a, b), H.prefix_length(sizes, H.SHARED), strict=True)]
            met.append(len(firsts[0] & firsts[1]))
            assert met[-1] >= H.least_shared(sizes, H.SHARED).min()
    assert min(met) < H.SHARED and len(met) > 1000


def test_pairs_of_runs_across_batches(monkeypatch):
    monkeypatch.setattr(H, "RUN_TEXTS", 3)
    rows = [(1, 10, 5), (1, 10, 5), (1, 12, 6), (1, 15, 7), (1, 30, 8), (1, 31, 9), (2, 10, 1), (2, 10, 2), (2, 10, 2), (2, 12, 3), (2, 14, 4), (2, 17, 5), (3, 0, 1), (3, 0, 2), (3, 1, 3), (3, 1, 4)]
    want = [(1, 10, 2, 10, 0), (1, 10, 3, 12, 0), (1, 10, 4, 14, 0), (1, 10, 5, 17, 0), (1, 0, 2, 0, 0), (3, 1, 4, 1, 1), (5, 10, 6, 12, 4), (6, 12, 7, 15, 4), (8, 30, 9, 31, 4)]
    for step in (1, 2, 3, 5, 20):
        batches = [H.pa.RecordBatch.from_arrays([H.pa.array(c, "int64") for c in zip(*rows[k : k + step], strict=True)], ["shingle", "size", "th"]) for k in range(0, len(rows), step)]
        got = [tuple(r.values()) for b in H._paired(iter(batches)) for r in b.to_pylist()]
        assert set(got) == set(want) and sorted(x for x in got if x[4]) == want[5:]  # counted pairs come once
