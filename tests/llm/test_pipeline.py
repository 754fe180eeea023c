import sys

import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
import corpus_pipeline
from switchback.llm.packing import pack_documents
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import classes, slow_fingerprint


@pytest.fixture
def folder(spark, docs_of, prose, tmp_path):
    items = [(k, prose(900 + k, 30)) for k in range(3)]
    rows = [(k, prose(k, 60), "en", f"s{k % 4}") for k in range(40)]
    rows += [(100 + k, rows[k][1].upper(), "en", "s") for k in range(5)] + [(200 + k, prose(50 + k, 20) + " " + items[k][1], "en", "s") for k in range(3)]
    rows += [(300, "1234 !!", "en", "s"), (301, None, "en", "s"), (302, prose(77, 40) + " password=ownownownown99", "en", "s"), (None, prose(78, 40), None, None), (303, prose(79, 9000), "en", "s")]
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, items


def test_stages_against_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r[0]: r[1] for r in rows if r[0] not in (300, 301)}
    want = [set(kept)]
    ids = sorted(kept, key=lambda i: (i is None, i or 0))
    label = classes([slow_fingerprint(kept[i]) for i in ids])
    firsts = {ids[c] for c in label}
    want.append(firsts)
    clean = {d for d, _, hit, *_ in brute([(i, kept[i]) for i in firsts], items) if not hit}
    want += [clean, clean]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(got) == ids and out.count() == len(ids), name
        docs = out
    assert got[302].endswith(" [SECRET]") and all(got[i] == kept[i] for i in got if i != 302)
    packed = corpus_pipeline.run(spark, path)
    assert {r["doc_id"] for r in packed.collect()} == clean
    assert packed.columns == pack_documents(docs, "").columns


def test_empty_documents(spark, folder, tmp_path):
    path, *_ = folder
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
