import hashlib
import random
import re

from switchback.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    cut = [(str(i), words(t)) for i, t in items if i is not None]
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, v in cut:
            n = min(window, len(v))
            pieces = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in pieces:
                    hit |= set(range(p, p + n))
                    found.add(item)
        ids = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs_of, docs, items):
    table = docs_of([(d, t) for d, t in docs]) if docs else docs_of([(0, "x")]).limit(0)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.contamination(table, bench).collect()
    rows = [(r["doc"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in got]
    assert sorted(rows, key=str) == brute(docs, items)
    return table, bench


def test_against_brute_force(spark, docs_of, prose):
    items = [(k, prose(k, 4 + 5 * k, "abc")) for k in range(8)] + [(9, "One"), (10, "two Words"), (11, None), (12, "  ,. "), (None, "a b c"), (3, prose(3, 19, "abc"))]
    r = random.Random(1)
    docs = []
    for k in range(40):
        parts = [prose(100 + k, 30, "abc")]
        for _ in range(r.randint(0, 3)):
            text = r.choice(items)[1] or ""
            w = text.split()
            a = r.randint(0, max(0, len(w) - 10))
            parts += [" ".join(w[a : a + r.randint(5, 25)]).upper() if r.random() < 0.3 else text, prose(k, 7, "abc")]
        docs.append((k, "; ".join(parts)))
    docs += [(50, None), (51, ""), (52, "one"), (52, "one"), (53, "É one"), (None, "two words"), (54, ("one " * 5000) + prose(7, 39, "abc"))]
    table, bench = check(spark, docs_of, docs, items)
    kept = D.remove_contaminated(table, bench)
    assert kept.columns == table.columns
    clean = [d for d, *rest in brute(docs, items) if rest[1] == 0]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_sides(spark, docs_of):
    check(spark, docs_of, [(1, "a b c")], [])
    check(spark, docs_of, [], [(1, "a b c")])


def test_blocks_give_the_same(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", 7)
    items = [(k, prose(k, 30)) for k in range(3)]
    check(spark, docs_of, [(k, prose(9, 20) + " " + prose(k % 4, 30)) for k in range(6)], items)
