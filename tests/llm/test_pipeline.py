"""The pipeline on a small corpus with planted cases, and the registered queries over empty tables."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from crashmart.llm import line_dedup, near_duplicates, packing, piece_offsets, private_data, queries, separator_scan

from .test_text_operators import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghilmnorst") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts, toxic = {}, {}
    for i in range(400):
        own = make(rng.randint(30, 90)).split()
        toxic[i] = int(i % 5 == 0)
        for _ in range(3 * toxic[i]):
            own.insert(rng.randrange(len(own)), rng.choice(["vile", "nasty"]))
        texts[i] = " ".join(own)
    for i in range(401, 440):                               # a menu line on a tenth of the pages of each host
        texts[i] = f"home about contact\n{make(40)}"
    for i in range(440, 460):                               # copies, exact and near
        own = texts[411].split("\n")[1].split()
        if i % 2:
            own[rng.randrange(len(own))] = "changed"
        texts[i] = " ".join(own)
    texts[460] = f"{make(20)} write to someone@site.example.com or call +1 (377) 555-0271 now"
    texts[461], texts[462] = "", None
    rows = [(i, t, "en", f"h{i % 2}", len(t or "")) for i, t in texts.items()] + [(460, texts[460], "en", "h0", 1)]
    where = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in toxic.items()], "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, texts, toxic


def test_each_stage_does_its_part(spark, corpus):
    where, texts, toxic = corpus
    docs, after = spark.read.parquet(f"{where}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, where), name)
        after[name] = docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: [r["doc_id"] for r in d.collect()] for name, d in after.items()}
    assert sorted(ids["toxicity"]) == sorted([i for i in texts if not toxic.get(i)] + [460])
    lines = {r["doc_id"]: r["text"] for r in after["line_dedup"].collect()}
    assert sorted(ids["line_dedup"]) == sorted(ids["toxicity"])
    assert not any("home about contact" in (t or "") for t in lines.values())
    assert all(lines[i] == texts[i] for i in lines if i < 400 or i >= 440)
    lines = dict(sorted(lines.items()))                     # the smallest id of a group is the first of its positions
    groups = brute_components(list(lines.values()), list(lines), 5, 80)
    assert sorted(ids["near_duplicates"]) == sorted(i for i, (_, c) in groups.items() if c == i)
    kept = {r["doc_id"]: r for r in after["private_data"].collect()}
    assert kept[460]["text"].endswith("write to <EMAIL> or call <PHONE> now") and kept[460]["n_chars"] == len(kept[460]["text"])
    assert all(kept[i]["text"] == lines[i] for i in kept if i != 460)
    used = defaultdict(list)
    for r in after["packing"].collect():
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(ids["packing"]) == set(kept)
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_of_empty_tables(spark, corpus):
    where = corpus[0]
    docs = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, where)
        assert out.count() == 0
        docs = out if out.columns == corpus_pipeline.COLUMNS else docs


def test_every_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert [m.__doc__ is not None for m in (line_dedup, near_duplicates, packing, piece_offsets, private_data, separator_scan)] == [True] * 6
