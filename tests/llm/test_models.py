import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa

from switchback.llm import langid, linear, maxent, toxicity
from switchback.llm.features import char_ngrams, letters_and_spaces, word_features

ALPHABETS = {"en": "abcdefgh", "fr": "ijklmnéà", "de": "opqrstüß"}


def labelled(prose):
    rows = [(k, prose(k, 60, ALPHABETS[lang]), lang) for k, lang in enumerate(list(ALPHABETS) * 60)]
    return rows + [(500, None, "en"), (501, "", "en"), (502, "123 !?", "fr"), (503, prose(1, 50, ALPHABETS["de"]), None), (None, prose(2, 50, ALPHABETS["fr"]), None), (503, prose(1, 50, ALPHABETS["de"]), None), (504, prose(3, 20000, ALPHABETS["en"]), None)]


def test_languages(spark, docs_of, prose):
    docs = docs_of(labelled(prose))
    model = langid.fit(docs.where(langid.fold("doc_id", 4) != 2), "text", "lang", "doc_id")
    got = langid.identify(docs, model, "text", [docs.doc_id, docs.lang]).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (500, 501, 502):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["lang"]:
            assert r["lang_pred"] == r["lang"] and r["score"] > 0.8
    assert {r["lang_pred"] for r in got if r["doc_id"] == 503} == {"de"}
    kept = langid.reject_unidentified(docs)
    assert kept.columns == docs.columns and {500, 501, 502} == {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()}


def test_without_labels_or_rows(spark, docs_of):
    docs = docs_of([(1, "abc", None)])
    assert [r["lang_pred"] for r in langid.identify(docs, langid.fit(docs, "text", "lang", "doc_id")).collect()] == ["und"]
    empty = docs.limit(0)
    assert langid.identify(empty, langid.fit(empty, "text", "lang", "doc_id")).count() == 0


def test_hold_out_fold(spark):
    ids = list(range(50)) + [-7, 10**15]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    got = {r["doc_id"]: r["f"] for r in rows.select("doc_id", langid.fold("doc_id", 3).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in ids}


def test_training_separates_and_calibrates():
    r = np.random.default_rng(0)
    rows = [(np.array([k % 2, 2 + int(r.integers(20))]), np.ones(2)) for k in range(200)]
    y = np.eye(2)[[k % 2 for k in range(200)]]
    w, b = linear.train(rows, y, 22)
    assert (linear.logits(rows, w, b).argmax(1) == y.argmax(1)).all()
    scores = np.log(np.array([[0.7, 0.3]] * 100)) * 3
    assert abs(linear.temperature(scores, np.array([[0.7, 0.3]] * 100)) - 3) < 0.1


def test_features():
    x = letters_and_spaces("Ab, ab 12 É")
    assert bytes(x.astype("<u4")).decode("utf-32-le") == " ab ab é "
    assert len(char_ngrams(x, (1, 2), 15)) == 9 + 8 and len(char_ngrams(letters_and_spaces(None), (3,), 8)) == 0
    a, b = word_features(letters_and_spaces("spams"), (3,), 10), word_features(letters_and_spaces("spam, spaxx"), (3,), 10)
    assert len(a) == 2 and len(b) == 3 and len(set(a) & set(b)) == 1  # the prefix
    assert len(word_features(letters_and_spaces("..."), (3,), 10)) == 0


def test_toxicity(spark, docs_of, prose):
    bad = ["grumbo", "snortle", "vexil", "krudd"]
    rows, labels = [], []
    for k in range(300):
        toxic = k % 5 == 0
        words = prose(k, 60).split()
        for n in range(2 if toxic else 0):
            words.insert(7 * n + k % 11, bad[(k // 5 + n) % 4] + ("xyz" if k % 2 else ""))
        rows.append((k, " ".join(words)))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, int(toxic)))
    rows += [(900, None), (901, ""), (902, prose(1, 4000)), (902, prose(1, 4000)), (None, "what an idiot")]
    docs = docs_of(rows)
    told = spark.createDataFrame([*labels, (0, 1), (7, None), (12345, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs.where(langid.fold("doc_id", 3) != 1), told.where(langid.fold("doc_id", 3) != 1))
    got = toxicity.score(docs, model, "text", [docs.doc_id]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = sum((r["score"] >= 0.7) == (r["doc_id"] % 5 == 0) for r in held)
    assert right / len(held) > 0.95
    assert all(r["score"] < 0.5 for r in got if r["doc_id"] in (900, 901, 902))


def test_mined_features_count_texts_and_have_no_cap(spark, docs_of, prose):
    many = [" ".join(f"bad{''.join(chr(97 + int(c)) for c in str(10000 + k))}" for k in range(9000)) + " " + prose(n, 20) for n in range(5)]
    rows = [*many, *["copied once"] * 6, *[prose(100 + k, 20) for k in range(60)]]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(k, int(k < 11)) for k in range(len(rows))], "doc_id bigint, toxic int")
    groups = toxicity.fit(docs, labels).voters.groups
    bucket = lambda word: word_features(letters_and_spaces(word), (), toxicity.BITS)
    assert (groups[: 1 << toxicity.BITS] >= 0).sum() > 8192
    assert groups[bucket("copied")][0] < 0


def test_label_model_parameters():
    """With labels that are always right, rates are smoothed counts and only dependent voters lean on each other."""
    r = np.random.default_rng(3)
    y = (r.random(40000) < 0.3).astype(int)
    a = r.random(40000) < np.where(y, 0.8, 0.1)
    b = np.where(r.random(40000) < 0.9, a, ~a)  # mostly what the first says
    c = r.random(40000) < np.where(y, 0.6, 0.2)
    rows = pd.DataFrame({"bits": a + 2 * b + 4 * c, "gold": y}).groupby(["bits", "gold"]).size().rename("n").reset_index()
    model = toxicity.LabelModel(rows, 3)
    assert model.leans[2] == 2 and sorted((model.leans[0], model.leans[1])) in ([0, 0], [1, 1])
    child = 1 if model.leans[1] == 0 else 0
    for label in (0, 1):
        some = y == label
        assert abs(model.rate[label, 0, 2] - c[some].mean()) < 0.01
        for v in (0, 1):
            given, own = (a, b) if child == 1 else (b, a)
            assert abs(model.rate[label, v, child] - own[some & (given == v)].mean()) < 0.02
    none = np.full(8, -1)
    got = model.posterior(np.arange(8), none)
    for bits in range(8):
        same = (a == bits & 1) & (b == bits >> 1 & 1) & (c == bits >> 2 & 1)
        assert abs(got[bits] - y[same].mean()) < 0.05


def test_samples_are_bounded(spark, docs_of, monkeypatch):
    """A third of all rows without an id, and rows that repeat, still give a bounded sample."""
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 20)
    sizes = []
    plain = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, *more, **named: sizes.append(len(rows)) or plain(rows, *more, **named))
    docs = docs_of([(None, "what an idiot")] * 100 + [(7, "plain words here")] * 100 + [(k, f"stupid trash {k}") for k in range(100)])
    toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int"))
    assert sizes[0] <= 40


def test_registered_model_queries(spark, docs_of, prose, tmp_path):
    rows = [(k, prose(k, 30, ALPHABETS[lang]) + (" idiot trash" if k % 9 == 0 else ""), lang, f"s{k}") for k, lang in enumerate(list(ALPHABETS) * 30)] + [(900, None, None, None), (901, "", "en", "s")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 9 == 0)) for k in range(0, 90, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    remainder = lambda i, n: zlib.crc32(str(i).encode()) % n
    kinds = {"op6_weak_toxicity": (toxicity, 3, 1, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}), "op7_maxent_lm": (maxent, 7, 2, {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}), "op9_ftrl_langid": (langid, 4, 2, {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})}
    for name, (module, parts, held, columns) in kinds.items():
        out = module.QUERIES[name](spark, str(tmp_path))
        assert dict(out.dtypes) == columns, name
        got = out.collect()
        assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
        assert all(r["held_out"] == (remainder(r["doc_id"], parts) == held) for r in got)
        if "predicted" in columns:
            assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    docs = docs_of([(1, "a plain text"), (2, "such an idiot, such trash, stupid moron")])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none), "text", [docs.doc_id]).collect()}
    assert got[2] >= got[1]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_tokens():
    texts = [" a\tB\x0bc\x0cd\re\x1cf\x85g  h ", "", None, "É X\x00y", "w " * 70000]
    token = maxent.Tokens(pa.array(texts, pa.string()))
    words = token.words.to_pylist()
    got = [[words[c] for c in token.codes[a:b]] for a, b in zip([0, *token.ends[:-1]], token.ends, strict=True)]
    assert got == [[w.decode() for w in (t or "").encode().lower().split()] + [maxent.END] for t in texts]
    parts = [t.words.to_pylist()[c] for _, t in maxent._slices([pa.RecordBatch.from_arrays([pa.array(texts * 40, pa.string())], ["t"])], 0) for c in t.codes]
    assert parts == [w for _ in range(40) for g in got for w in g]


def test_word_hashes_and_pairs():
    words = pa.array(["xx", "a", "é", "abc", "ab", "b a".replace(" ", ""), "z" * 300, " "])[1:]
    hashes = maxent.word_hashes(words)
    assert len(set(hashes.tolist())) == len(words) == len(maxent.word_hashes(words[:0])) + 7
    assert (maxent.word_hashes(pa.concat_arrays([words, words]))[:7] == hashes).all()
    buckets, sizes = maxent.pair_buckets(words)
    at = 0
    for word, n in zip(words.to_pylist(), sizes.tolist(), strict=True):
        raw = b"\n" + word.encode() + b"\n"
        assert buckets[at : at + n].tolist() == [((a << 8 | b) * 0x9E3779B1 % (1 << 32) >> 20) % maxent.PAIRS for a, b in zip(raw, raw[1:])]
        at += n


def slow_score(model, counts, text):
    """The log10 probability of a text, word by word."""
    token = maxent.Tokens(pa.array([text], pa.string()))
    hashes = maxent.word_hashes(token.words)
    places = model.shape.of(token.words, hashes)
    classes, slots, features = maxent._features(token, hashes, places, model.rows)
    out = 0.0
    for t, code in enumerate(token.codes):
        x = model.class_bias + sum(model.class_weights[r] for r in maxent._rows_of(features[t : t + 1], model.rows)[0])
        y = model.slot_bias[classes[t]]
        if classes[t] % maxent.PER_GROUP != maxent.PER_GROUP - 1:
            y = y + sum(model.slot_weights[r] for r in maxent._rows_of(features[t : t + 1], model.rows, classes[t : t + 1])[0])
        out += math.log10(math.exp(x[classes[t]]) / np.exp(x).sum()) + math.log10(math.exp(y[slots[t]]) / np.exp(y).sum())
        word, place = token.words[int(code)].as_py(), places[code]
        if place // maxent.SLOTS % maxent.PER_GROUP == maxent.PER_GROUP - 1:
            n, kinds = model.totals[place]
            out += math.log10((counts[word] - model.discount if word in counts else model.discount * kinds if n else 1.0) / max(n, 1))
    return out


def test_language_model(spark, docs_of, prose, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 40)  # most counts take the joined path
    monkeypatch.setattr(maxent, "SHAPED", 12)
    texts = [" ".join(["the cat sat on the mat", "LE chat\x0bdort"][k % 2] for _ in range(4)) + " " + prose(k, 6) for k in range(120)]
    rows = [*enumerate(texts), (500, None), (501, ""), (502, "the unseen wörd"), (503, "the cat"), (503, "the cat"), (None, "le chat")]
    docs = docs_of(rows)
    train = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 != 2
    tokens = [((t or "").encode().lower().split() + [b" "]) for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    model, counts = maxent.fit(docs.where(langid.fold("doc_id", 7) != 2))
    assert {r["word"].encode(): r["c"] for r in counts.collect()} == dict(c)
    got = maxent.score(docs, model, counts, langid.fold("doc_id", 7) == 2).collect()
    plain = {w.decode(): k for w, k in c.items()}
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6), round(slow_score(model, plain, t), 3)) for (i, t), ws in zip(rows, tokens, strict=True))
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 3)) for r in got)
    assert [f[:4] for f in found] == [w[:4] for w in want] and np.allclose([f[4] for f in found], [w[4] for w in want], atol=0.01)
    assert {r["train_tokens"] for r in got} == {n}
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_sums_to_one(spark, docs_of, prose):
    """Over all known words and what each shared slot holds for unseen ones, the probabilities after a context sum to one."""
    docs = docs_of(["a b a b c d d e " + prose(k, 20) for k in range(5)])
    model, counts = maxent.fit(docs)
    known = {r["word"]: r["c"] for r in counts.collect()}
    token = maxent.Tokens(pa.array(["b a"], pa.string()))
    hashes = maxent.word_hashes(token.words)
    _, _, features = maxent._features(token, hashes, model.shape.of(token.words, hashes), model.rows)
    p = maxent._softmax(model.class_weights, model.class_bias, maxent._rows_of(features[2:3], model.rows))[0]
    total = 0.0
    words = pa.array(list(known), pa.string())
    places = model.shape.of(words, maxent.word_hashes(words))
    tokens, held = model.shares()
    for k in range(maxent.CLASSES):
        q = model.slot_shares()[k] if maxent.shared(np.array([k]))[0] else model.slots_of(features[2:3], np.array([k]))[0]
        assert abs(q.sum() - 1) < 1e-5
        for s in range(maxent.SLOTS):
            place = k * maxent.SLOTS + s
            own = [known[w] for w, at in zip(words.to_pylist(), places, strict=True) if at == place]
            shared = k % maxent.PER_GROUP == maxent.PER_GROUP - 1
            inside = sum(c - model.discount for c in own) / 10 ** tokens[place] + 10 ** (held[place] - tokens[place]) if shared else 1.0
            assert abs(inside - 1) < 1e-6 and (shared or len(own) <= 1)
            total += p[k] * q[s] * inside
    assert abs(total - 1) < 1e-4


def test_language_model_steps_move_all_families(spark, docs_of):
    texts = [" ".join(f"w{k}" for k in range(40))] * 3
    docs = docs_of(texts)
    model, _ = maxent.fit(docs)
    model.class_weights[:], model.slot_weights[:] = 0, 0
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    (out,) = maxent._update(model)([batch])
    moved = {}
    for block, w in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True):
        kind, at = divmod(block, model.rows // maxent.BLOCK)
        moved[kind] = moved.get(kind, set()) | {at * maxent.BLOCK + k for k in np.flatnonzero(np.frombuffer(w, np.float16).reshape(maxent.BLOCK, -1).any(axis=1)).tolist()}
    token = maxent.Tokens(pa.array(texts))
    hashes = maxent.word_hashes(token.words)
    classes, _, features = maxent._features(token, hashes, model.shape.of(token.words, hashes), model.rows)
    own = ~maxent.shared(classes)
    assert own.mean() > 0.5
    for kind, rows in enumerate((maxent._rows_of(features, model.rows), maxent._rows_of(features[own], model.rows, classes[own]))):
        assert rows.shape[1] == 5 and all(set(rows[:, family].tolist()) <= moved[kind] for family in range(5))


def test_language_model_grows_with_the_input():
    for tokens, rows in ((0, maxent.LEAST_ROWS), (10**8, 1 << 14), (10**9, 1 << 17), (10**12, maxent.MOST_ROWS)):
        totals = np.zeros((maxent.CLASSES * maxent.SLOTS, 2))
        totals[5, 0] = tokens
        assert maxent.Model(maxent.shape_of([], np.empty(0), np.empty((0, maxent.BESIDE))), totals, ([], np.empty(0)), 0.5).rows == rows


def test_language_model_without_rows(spark, docs_of):
    docs = docs_of(["a b"])
    model, counts = maxent.fit(docs.limit(0))
    row = maxent.score(docs, model, counts, langid.fold("doc_id", 7) == 2).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert maxent.score(docs.limit(0), model, counts, langid.fold("doc_id", 7) == 2).count() == 0


def test_words_beyond_the_slots_keep_their_group():
    """Words grouped by what stands beside them share the slots of that group, whatever their letters say."""
    words = [f"{'ab'[k * 7 % 3 % 2]}{k}" for k in range(400)]
    near = np.zeros((len(words), maxent.BESIDE))
    near[np.arange(len(words)), np.arange(len(words)) % maxent.GROUPS] = 400.0 - np.arange(len(words))
    label = maxent.grouped(near)
    shape = maxent.shape_of(words, np.arange(400, 0, -1), near)
    place = shape.of(pa.array(words), maxent.word_hashes(pa.array(words)))
    assert (place // maxent.SLOTS // maxent.PER_GROUP == label).all() and maxent.shared(place // maxent.SLOTS).sum() == 400 - maxent.GROUPS * (maxent.PER_GROUP - 1) * maxent.SLOTS
