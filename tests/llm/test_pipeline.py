"""The pipeline's stages on a small table, each held against brute force on its own input."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from codeloom.llm.common import Scratch

from .test_llm import groups_by_hand, lines_by_hand, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("n", "st", "l", "rt")]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [text(rng.randint(40, 200)) for _ in range(60)]
    near = docs[0].split()
    near[5] = "changed"
    docs += [docs[1], " ".join(near * 1), "bad $$$ %%% ### " * 30, "short"]
    docs += [f"shared footer line of all of these\n{text(60)}" for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(docs)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = Scratch(spark).save(stage(spark, docs, folder), name)
        if name != "packing":
            assert docs.columns == columns
        seen[name] = (before, docs.collect())
    before, after = seen["quality_rules"]
    ids = {r["doc_id"] for r in after}
    assert {62, 63}.isdisjoint(ids) and set(range(60)) <= ids
    before, after = seen["line_dedup"]
    want = lines_by_hand([(r["doc_id"], r["text"]) for r in before], 10, "first")
    assert {r["doc_id"]: r["text"] for r in after} == {i: w[0] for i, w in want.items()} and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["minhash_dedup"]
    want = groups_by_hand([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, w in want.items() if w[2]) and len(after) < len(before)
    before, after = seen["source_mix"]
    texts, n = {r["doc_id"]: r["text"] for r in before}, Counter(r["doc_id"] for r in after)
    assert all(r["text"] == texts[r["doc_id"]] for r in after) and max(n.values()) <= 2
    total = sum(len(words(t)) for t in texts.values())
    assert sum(len(words(r["text"])) for r in after) == pytest.approx(1.5 * total, rel=0.05)
    before, after = seen["packing"]
    assert sum(r["length"] for r in after if r["start"] == 0) <= sum(r["length"] for r in after) == sum({(r["doc_id"]): r["doc_tokens"] for r in after}[i] * k for i, k in n.items())


def test_run(spark, folder):
    rows = pipeline.run(spark, folder)
    assert rows.count() > 0 and rows.select("sequence_id").distinct().count() == rows.count()
    assert [name for name, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "source_mix", "packing"]
    assert not re.search("try:|except", open(pipeline.__file__).read())
