from __future__ import annotations

import numpy as np
from helpers import table, written
from test_operators import brute_classes

import corpus_pipeline
from ledgerflow.llm import decontamination, line_dedup, packing, quality_classifier, token_ids, words


def corpus(spark, tmp_path):
    rng = np.random.default_rng(9)
    vocabulary = [f"word{i}" for i in range(2000)]
    speak = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(i, speak(25)) for i in range(3)]
    docs, labels = [], []
    common = "This very line stands in many documents."
    for i in range(160):
        good = i % 4 != 0
        text = "\n".join(f"{speak(12).capitalize()}." for _ in range(6)) if good else " ".join(f"{w}{'#$%&'[k % 4] * 3}" for k, w in enumerate(speak(70).split()))
        docs.append((i, text + "\n" + common if i % 3 == 0 else text))
        labels.append((i, int(good), 0))
    docs += [(500, docs[1][1]), (501, docs[2][1].replace("word1", "edited", 1)), (502, speak(40) + " " + items[0][1] + " " + speak(40) + "."), (503, None), (504, ""), (505, common)]
    sf = written(spark, tmp_path, documents=table(spark, docs), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    return sf, docs, items


def rows(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_stages_by_brute_force(spark, tmp_path):
    sf, docs, items = corpus(spark, tmp_path)
    start = spark.read.parquet(f"{sf}/documents.parquet")

    first = corpus_pipeline.quality(spark, start, sf)
    kept = rows(first)
    assert not {i for i in range(0, 160, 4)} & set(kept)
    assert {i for i in range(160) if i % 4} <= set(kept)
    scored = {r["id"]: r["predicted"] for r in quality_classifier.quality_scores(start, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(kept) == {d for d, p in scored.items() if p}

    second = rows(corpus_pipeline.lines(spark, first, sf))
    holders: dict[str, list[int]] = {}
    key = lambda x: x.strip(line_dedup.BLANKS).lower()
    for d, t in kept.items():
        for line in set((t or "").split("\n")):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), []).append(d)
    want = {}
    for d, t in kept.items():
        left = [x for x in (t or "").split("\n") if not (len(holders.get(key(x), ())) > 1 and d > min(holders[key(x)]))]
        want[d] = "\n".join(left)
    assert second == want

    third = rows(corpus_pipeline.near_duplicates(spark, table(spark, sorted(second.items())), sf))
    classes = brute_classes(sorted(second.items()))
    assert set(third) == set(classes.values())
    twice = corpus_pipeline.near_duplicates(spark, table(spark, [*sorted(second.items()), (1, "a text of its own under an id that is there before, and it stays")]), sf)
    assert sorted(r["doc_id"] for r in twice.collect()) == sorted([*third, 1])

    fourth = rows(corpus_pipeline.decontaminated(spark, table(spark, sorted(third.items())), sf))
    assert set(third) - set(fourth) == {502}

    last = corpus_pipeline.packed(spark, table(spark, sorted(fourth.items())), sf).toPandas()
    ids = token_ids.Encoder("word_bpe_49k.json").whole([fourth[d] or "" for d in sorted(fourth)])
    assert last["length"].sum() == sum(len(x) // 4 + 1 for x in ids)
    assert set(last["doc_id"]) == set(fourth)
    whole = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(map(tuple, whole[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist())) == sorted(map(tuple, last[["doc_id", "piece", "start", "length", "ids_crc32"]].values.tolist()))
    assert packing.PLACED.split(", ")[0] == "doc_id long" and decontamination.LEAST_EQUAL == 13


def test_stages_of_empty_tables(spark, tmp_path):
    sf, _, _ = corpus(spark, tmp_path)
    docs = table(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_columns(spark, tmp_path):
    sf, docs, _ = corpus(spark, tmp_path)
    frame = table(spark, docs[:20]).selectExpr("*", "1 AS id", "2 AS kept_text")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, sf).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_a_worker_drops_what_it_remembers(spark):
    token_ids.encoder("word_bpe_49k.json")(["some words of a text"])
    words.hashes.of([b"some", b"words"])
    words.forget()
    assert not token_ids._encoders and not words.hashes
