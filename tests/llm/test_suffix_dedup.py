import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from switchback.llm import suffix_dedup as X


def brute(texts, length=200):
    raws, seen = [(t or "").encode() for t in texts], {}
    flags = [np.zeros(len(r), bool) for r in raws]
    for d, r in enumerate(raws):
        for p in range(len(r) - length + 1):
            if (first := seen.setdefault(r[p : p + length], (d, p))) != (d, p):
                flags[first[0]][first[1] : first[1] + length] = flags[d][p : p + length] = True
    out = []
    for r, f in zip(raws, flags, strict=True):
        kept = np.frombuffer(r, np.uint8)[~f].tobytes()
        out.append((len(r), int(f.sum()), int((np.diff(np.concatenate([[0], f.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def check(docs, texts):
    got = sorted(tuple(r) for r in X.repeated_spans(docs).collect())
    assert got == sorted((k, *row) for k, row in enumerate(brute(texts)))


def corpus(prose):
    r, texts = random.Random(5), []
    passages = [prose(k, 60) for k in range(4)]
    for k in range(25):
        parts = [prose(100 + k, r.randint(1, 60)) for _ in range(3)]
        parts.insert(1, r.choice(passages)[r.randint(0, 50) : r.randint(150, 400)])
        texts.append("é".join(parts))
    near = texts[3][:300] + "#" + texts[3][300:]
    return texts + [texts[0], near, None, "", "a" * 199, "b" * 201, "c" * 900, "ab" * 150, "xyz" * 2000, prose(7, 50)[:200], prose(9, 50)[:200] + prose(9, 50)[:200]]


def test_against_brute_force(spark, docs_of, prose):
    texts = corpus(prose)
    check(docs_of(texts), texts)


def test_hot_keys(spark, docs_of, prose, monkeypatch):
    texts = corpus(prose)
    for most in (1, 5):  # parts of up to one place, and of a share of the windows of a place
        monkeypatch.setattr(X, "HOT_SEGMENTS", most)
        check(docs_of(texts), texts)
    passage = prose(1, 60)
    texts = [f"{prose(k, 20)} {passage} {prose(1000 + k, 20)}" for k in range(220)]
    monkeypatch.setattr(X, "HOT_SEGMENTS", 1)
    check(docs_of(texts), texts)


#: Two texts of 200 bytes with one polynomial fingerprint modulo 2^64; none of their bytes may go.
TWINS = [
    "secvfcafebstnnhixbotstfbkkdfpmrgrdcjvjkuuusrfjjiujrxvpbfjcxwjebmodqqyeolgcvxfynsmqgynjhcfnchrbxjmtbfjjgbgvgonjqngddwwpdxxbfyhkmhngnfuwrbfywuckpgrnuejgffqxuitunltwoshyonyiqmvbyusrbiiyxeuqgtjhouhxlilhso",
    "secvfcafebstnnhiwcnsrufcljcgqnshrddkwijvuvsqfjijtjryvqcejdyvjfanpeprydplfcwwexntmqhznihcemciqayjlscejkfbhwhonkqohdexxoewxbexilnhnfoguxscfyxvckpfsntfigfgqxtitumltvprhxnozjqlucyttqcijxxeuqgukhouhylhliso",
]


def test_texts_of_one_fingerprint_stay(spark, docs_of):
    got = X.repeated_spans(docs_of(TWINS)).collect()
    assert [r["n_removed"] for r in got] == [0, 0]
    check(docs_of([*TWINS, "x" + TWINS[0]]), [*TWINS, "x" + TWINS[0]])


def test_pieces_with_one_digest_are_told_apart(monkeypatch):
    monkeypatch.setattr(X, "digest", lambda body: bytes(16))
    task = X._Task()
    task.add(1, 0, b"a" * 200, 1)
    with pytest.raises(ValueError):
        task.add(1, 0, b"b" * 200, 1)


def test_small_blocks_of_a_long_text(prose, monkeypatch):
    text = prose(1, 400).encode() + b"q" * 700 + prose(1, 300).encode()
    for block in (300, 1 << 20):
        monkeypatch.setattr(X, "BLOCK", block)
        monkeypatch.setattr(X, "RUN", 97)
        batch = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([text.decode(), "short"])], ["uid", "text"])
        rows = [row for out in X._emit_segments([batch]) for row in out.to_pylist()]
        at = [p for row in rows for p in range(row["start"], row["start"] + row["windows"])]
        assert at == list(range(len(text) - 199)) and {row["uid"] for row in rows} == {7}
        windows: dict[bytes, set] = {}
        within: dict[tuple, set] = {}
        for n, row in enumerate(rows):
            for p in range(row["start"], row["start"] + row["windows"]):
                windows.setdefault(text[p : p + 200], set()).add(row["key"])
                within.setdefault((n, text[p : p + 200]), set()).add(p)
        assert all(len(keys) == 1 for keys in windows.values())
        assert all(rows[n]["repeats"] for (n, _), places in within.items() if len(places) > 1)


def test_suffix_array_is_sorted_and_complete():
    r = random.Random(4)
    texts = [bytes(r.choices(b"a\x00\xff", k=r.randint(200, 420))) for _ in range(12)] + [b"\x00" * 260, b"\xff" * 230]
    windows = [t[i : i + 200] for t in texts for i in range(len(t) - 199)]
    array, rank = X.SuffixArray.build(texts)
    listed = [windows[row] for row in array.rows]
    assert listed == sorted(set(windows)) and [listed[k] for k in rank] == windows
    other, _ = X.SuffixArray.build(texts[5:] + [b"\x00" * 220 + b"\xff" * 40], len(windows))
    more = [t[i : i + 200] for t in texts[5:] + [b"\x00" * 220 + b"\xff" * 40] for i in range(len(t) - 199)]
    place = array.find(other)
    assert [listed[p] if p >= 0 else None for p in place] == [w if w in set(windows) else None for w in sorted(set(more))]
    both, equal = array.merged(other)
    assert [(windows + more)[row] for row in both.rows] == sorted({*windows, *more})
    assert {(windows + more)[row] for row in equal} == set(windows) & set(more) and len(equal) == 2 * len(set(windows) & set(more))


def test_levels_are_geometric_and_exact():
    r = random.Random(0)
    texts = [bytes(r.choices(b"ab\x00", k=r.randint(200, 700))) for _ in range(90)]
    texts += [t[20 : 20 + r.randint(200, 400)] for t in texts[:40] if len(t) > 420] + [b"c" * 900]
    family, rows = X.LevelFamily(), []
    for k in range(0, len(texts), 4):
        family.add(texts[k : k + 4])
        rows += [t[i : i + 200] for t in texts[k : k + 4] for i in range(len(t) - 199)]
    n = Counter(rows)
    assert family.matched.tolist() == [n[w] > 1 for w in rows]
    sizes = [len(level) for level in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False)) and family.scans > 15 and family.merges > 10


def test_every_candidate_goes_through_the_levels(monkeypatch, prose):
    monkeypatch.setattr(X, "BATCH_WINDOWS", 300)
    monkeypatch.setattr(X, "FAMILY_WINDOWS", 3000)
    bodies = [prose(k % 30, 60).encode() for k in range(60)]
    rows = sorted((k % 5, 0, body) for k, body in enumerate(bodies))
    seen = []
    plain = X.LevelFamily.add
    monkeypatch.setattr(X.LevelFamily, "add", lambda self, texts: seen.extend(texts) or plain(self, texts))
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows]), pa.array([1] * 60)], ["key", "part", "body", "n"])
    out = [row for b in X._match([batch]) for row in b.to_pylist()]
    assert sorted(seen) == sorted(set(bodies)) and len(out) == 30
    assert all(row["n"] == 2 and row["spans"][0]["start"] == 0 for row in out)


def test_the_last_batch_of_a_family_is_scanned_for_but_not_merged(monkeypatch, prose):
    monkeypatch.setattr(X, "BATCH_WINDOWS", 300)
    merges, plain = [], X.SuffixArray.merged
    monkeypatch.setattr(X.SuffixArray, "merged", lambda self, other: merges.append(len(other)) or plain(self, other))
    a, b, c = (prose(k, 90).encode()[:360] for k in range(3))
    rows = [(1, 0, a), (2, 0, b), (3, 0, c), (4, 0, a[20:])]  # batches of two
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)] + [pa.array([1] * 4)], ["key", "part", "body", "n"])
    out = {row["name"]: row["spans"] for found in X._match([batch]) for row in found.to_pylist()}
    assert out == {X.name_of(1, 0, a): [{"start": 20, "end": 360}], X.name_of(4, 0, a[20:]): [{"start": 0, "end": 340}]}
    assert not merges


def test_suffix_array_of_over_two_million_places():
    text = bytes(random.Random(6).choices(b"\x00b", k=(1 << 21) + 100))
    array, rank = X.SuffixArray.build([text], length=16)
    windows = [text[i : i + 16] for i in range(len(text) - 15)]
    listed = sorted(set(windows))
    assert [windows[row] for row in array.rows] == listed and [listed[k] for k in rank.tolist()] == windows


def test_repeated_rows_spans_and_empty(spark, docs_of, prose):
    text = prose(1, 60)
    got = X.repeated_spans(docs_of([(1, text), (1, text), (None, text), (2, "short")]), emit_kept=True).collect()
    by = sorted((str(r["doc"]), r["n_removed"], r["kept"] and bytes(r["kept"])) for r in got)
    n = len(text.encode())
    assert [b[:2] for b in by] == [("1", n), ("1", n), ("2", 0), ("None", n)]
    assert X.repeated_spans(docs_of(["x"]).limit(0)).count() == 0
