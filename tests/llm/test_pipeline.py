"""The pipeline's stages against plain versions of them, on a small corpus with planted cases."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from brindle.llm import decontam, pii  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, out = random.Random(5), tmp_path_factory.mktemp("tables")
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(800)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = text(30)
    docs, labels = [], []
    for i in range(300):
        y = int(i % 5 == 0)
        docs.append([i, text(60) + (" zugnak you brofel trindop zugnak" if y else ""), "en", "s", 0])
        if i < 260:
            labels.append((i, 1, y))
    docs += [[1000, docs[1][1], "en", "s", 0], [1001, docs[2][1] + " tail", "en", "s", 0], [1002, text(20) + " " + item + " " + text(20), "en", "s", 0], [1003, text(40) + " ann@mail.example.com " + text(5), "en", "s", 0], [1004, None, None, None, None], [1005, "", "en", "s", 0]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), docs


def test_stages(spark, folder):
    path, docs = folder
    texts = {d[0]: d[1] for d in docs}
    frame, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "pieces"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, path)
        assert tuple(frame.columns) == corpus_pipeline.COLUMNS
        kept[name] = {r["doc_id"]: r["text"] for r in frame.collect()}
    assert set(kept["toxicity"]) == {i for i in texts if not ("zugnak" in (texts[i] or ""))}
    assert set(kept["near_duplicates"]) == set(kept["toxicity"]) - {1000, 1001}
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - {1002}
    assert set(kept["personal_data"]) == set(kept["decontamination"]) and "[EMAIL]" in kept["personal_data"][1003]
    assert all(kept["personal_data"][i] == t for i, t in kept["decontamination"].items() if not pii.base_spans(t or ""))
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} == set(kept["personal_data"]) and all(r["round_trip"] and r["ids"][-1] == 2 and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert decontam.GAP > 10


def test_empty(spark, folder):
    path, _ = folder
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{path}/documents.parquet").limit(0), path).collect() == []


def test_odd_rows(spark, folder):
    """Nulls, long texts, repeated rows, and columns with the names that the operators use for themselves."""
    path, docs = folder
    long = " ".join(f"w{k}x{k * 7 % 1000}" for k in range(120_000)) + " bob@mail.example.com"
    odd = [(1, docs[1][1], "en", "s", 0), (1, docs[1][1], "en", "s", 0), (2, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (None, docs[4][1], None, "s", 1), (4, long, "en", "s", 1), (5, long + " tail", "en", "s", 1)]
    clash = "row string, key int, spans string, doc int, _row string, score double, hit string, ids int"
    frame = spark.createDataFrame([(*r, "r", 1, "s", 2, "q", 0.5, "h", 9) for r in odd], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, path)
        assert tuple(frame.columns) == corpus_pipeline.COLUMNS
    rows = frame.collect()
    # the copy of document 1, the repeated row of 3 and the near copy of 4 go; a row without an id is in no group
    assert sorted((r["doc_id"] for r in rows), key=str) == [1, 2, 3, 4, None]
    text = {r["doc_id"]: r["text"] for r in rows}
    assert text[2] is None and text[3] == "" and text[4].endswith("[EMAIL]") and text[None] == docs[4][1]
    last = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(rows, frame.schema).selectExpr("*", "1 as key", "2 as ids"), path).collect()
    assert len(last) == 5 and all(r["round_trip"] for r in last)
