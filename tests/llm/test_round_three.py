"""Importance resampling, exact dedup and tokenizer alignment against plain Python, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crashmart.llm import alignment, exact_dedup, importance, line_dedup, near_duplicates, tree_search
from crashmart.llm.frames import components, numbered
from crashmart.llm.word_tokens import byte_letters

from .test_text_operators import LONG, brute_components, documents, sample

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " \n ", "one", "One", LONG, "a b c d e", "a b c d e", "é 日本 🙂 ▁ x", None, "don't  stop,\n\nit's <s> <0x41> </s>\tnow ", "<|endoftext|> x y　z \x00  ",
       "É ß İ ǅ K", "x" * 3000, "a\nb\n c\r\nd"]
IDS = [0, 1, 2, 3, 4, 5, 6, 6, None, 9, 10, 11, 12, 13, 14]


# Importance resampling

def brute_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_importance(rows, target, buckets, longest, percent, least):
    def features(text):
        w = brute_words(text)
        return [crc32(" ".join(w[i: i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own, goal = Counter(x for _, t in rows for x in features(t)), Counter(x for t in target for x in features(t))
    s, t = sum(own.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for at, (i, text) in enumerate(rows):
        f = features(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(brute_words(text)) >= least])
    fit = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(fit[: percent * len(fit) // 100], 1):
        x[4] = rank
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize(("longest", "percent", "least"), [(1, 10, 20), (2, 50, 3), (3, 100, 0)])
def test_importance_matches_plain_python(spark, longest, percent, least):
    rows = list(enumerate(sample(5, 120))) + list(zip(IDS, ODD, strict=True))
    target = [*sample(6, 20), None, "", "one One"]
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    goal = spark.createDataFrame([(t, "b", 1) for t in target], "text string, bucket string, n long")
    found = importance.importance(docs, goal, 500, longest, percent, least).collect()
    assert Counter(tuple(r) for r in found) == brute_importance(rows, target, 500, longest, percent, least)


def test_importance_of_empty_tables(spark):
    docs, goal = documents(spark, ODD, IDS), spark.createDataFrame([("one two",)], "text string")
    assert importance.importance(docs.limit(0), goal).count() == 0
    flat = importance.importance(docs, goal.limit(0), least=0, percent=100)
    assert sorted(r["rank"] for r in flat.collect()) == list(range(1, len(ODD) + 1))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ9 é\n.-日\x00 "), max_size=12), max_size=4))
def test_words_of_chunks_are_the_words_of_the_text(texts):
    one = importance.Splitter(97)
    for text, (words, marks) in zip(texts, one.features(texts, 1), strict=True):
        assert words == len(brute_words(text))
        assert np.frombuffer(marks, "<u4").tolist() == [crc32(w.encode()) % 97 for w in brute_words(text)]
        lowered = importance.lower_ascii(text)
        assert [lowered[s:e] for s, e in one._placed(lowered.split(" "))] == brute_words(text)


def test_places_of_equal_rows(spark):
    rows = spark.range(3000).select(F.lit(7).alias("x"), F.col("id").alias("row"))
    found = numbered(rows.repartition(9), [F.col("x").asc(), F.col("row").desc()], "place").collect()
    assert all(r["place"] == 3000 - r["row"] for r in found) and len(found) == 3000


# Exact duplicates

def brute_exact(rows):
    groups = defaultdict(list)
    for at, (i, text) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), i is None, i or 0, at))
    out = Counter()
    for body, members in groups.items():
        best = min(members)
        for m in members:
            out[(rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(body.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_dedup_matches_plain_python(spark, monkeypatch, batches):
    monkeypatch.setattr(exact_dedup, "KEYS", 64)
    rng = random.Random(3)
    texts = sample(8, 150)
    texts += [t.replace(" ", rng.choice([" ", "  ", "\n", "\t \x0b"])) for t in texts[:90]] + texts[:40] + ["same old  text"] * 200 + ["\x0c", "a b", "ab", "a b", "a\x1cb"]
    rows = list(enumerate(texts)) + list(zip(IDS, ODD, strict=True)) + [(7, texts[7])] * 3
    docs = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    found = exact_dedup.exact_dedup(docs, batches=batches).collect()
    assert Counter(tuple(r)[:5] for r in found) == brute_exact(rows)
    assert exact_dedup.exact_dedup(docs.limit(0), batches=batches).count() == 0


def test_one_snapshot_holds_what_the_next_batch_repeats(spark):
    """A batch column of the caller's: all of batch 1 is known, so no row of it stays unless it is longer."""
    rows = [(i, f"text {i}", 0) for i in range(50)] + [(100 + i, f"text  {i}" if i % 2 else f"text{i}", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    kept = {r["doc_id"] for r in exact_dedup.exact_dedup(docs, F.col("part")).where("kept").collect()}
    assert kept == {i for i in range(50) if i % 2 == 0} | {100 + i for i in range(50) if i % 2}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 500, 8192, 60_000])
def test_filters_hold_all_their_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    made = exact_dedup.build(keys)
    assert made.contains(keys).all()
    assert made.contains(rng.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() < 0.006
    assert len(made.prints) < 1.6 * n + 64


def test_equal_keys_are_told_apart_by_bytes(spark, monkeypatch):
    """With one key for all digests every class is a candidate of every other; bytes decide."""
    monkeypatch.setattr(exact_dedup, "bucket_key", lambda sha: F.lit(5).cast("long"))
    rows = [(i, f"w{i % 6}", i % 2) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int")
    found = exact_dedup.exact_dedup(docs, F.col("part")).collect()
    assert Counter(tuple(r)[:5] for r in found) == brute_exact([(i, t) for i, t, _ in rows])


# Alignment

@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    letters = {c: b for b, c in byte_letters().items()}
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES), letters


def brute_tokens(text, tokenizers):
    """(id, start, end) of both sides from the whole text, or None."""
    a, b, letters = tokenizers
    if not text:
        return None
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(letters[c] for c in a.id_to_token(i)) for i in a_ids]
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    out = []
    for ids, parts in ((a_ids, a_bytes), (b_ids, b_bytes)):
        ends = np.cumsum([len(p) for p in parts]).tolist()
        out.append([(i, e - len(p), e) for i, p, e in zip(ids, parts, ends, strict=True)])
    return out


def brute_alignment(rows, tokenizers):
    parts, count = [], Counter()
    for i, text in rows:
        both = brute_tokens(text, tokenizers)
        if both is None:
            parts.append((i, None, []))
            continue
        ends = {e: a for a, _, e in both[0]}
        links = [(ends[e], b) for b, _, e in both[1] if e in ends]
        count.update(links)
        parts.append((i, both, links))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = Counter()
    for i, both, links in parts:
        if both is None:
            out[(i, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        common = sorted({e for _, _, e in both[0]} & {e for _, _, e in both[1]})
        groups = [";".join([])] if not common else []
        start = 0
        for end in common:
            groups.append("|".join(",".join(str(t) for t, _, e in side if start < e <= end) for side in both))
            start = end
        out[(i, len(both[0]), len(both[1]), len(common), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("block", [alignment.BLOCK, 50])
def test_alignment_matches_plain_python(spark, monkeypatch, tokenizers, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows = list(enumerate(sample(9, 60))) + list(zip(IDS, [t and t[:5000] for t in ODD], strict=True))
    found = alignment.alignment(documents(spark, [t for _, t in rows], [i for i, _ in rows]), BYTES, PIECES)
    assert Counter(tuple(r) for r in found.collect()) == brute_alignment(rows, tokenizers)
    assert alignment.alignment(documents(spark, ["x"]).limit(0), BYTES, PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abÉé'st19.,-_ \n\n\t\r   　日🙂▁<>|\x00ǅ×"), max_size=40))
def test_tokens_of_chunks_are_the_tokens_of_the_text(tokenizers, text):
    one, want = alignment.pair(BYTES, PIECES), brute_tokens(text, tokenizers)
    got = one.encode([text])[0]
    assert (got is None) == (want is None)
    if got:
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[i for i, _, _ in side] for side in want]


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abcdefgh lmnorst'1é日"), min_size=1, max_size=60))
def test_overlaps_are_all_pairs_that_share_a_byte(tokenizers, text):
    one, both = alignment.pair(BYTES, PIECES), brute_tokens(text, tokenizers)
    ids = [np.array([i for i, _, _ in side]) for side in both]
    found = alignment.overlaps(*ids, one.a_size, one.b_size)
    want = [(i, j) for i, (_, s, e) in enumerate(both[0]) for j, (_, t, f) in enumerate(both[1]) if s < f and t < e]
    assert sorted(zip(found.a.tolist(), found.b.tolist(), strict=True)) == sorted(want)


# Links of groups of copies, and columns that are named like the operators' own

@pytest.mark.parametrize("percent", [80, 85])
def test_links_of_near_copies_grow_with_the_rows(spark, monkeypatch, percent):
    """Near copies of one text: links that enter and leave the label rounds are a small multiple of the copies."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghilmnorst") for _ in range(6)) for _ in range(800)]
    base = [rng.choice(words) for _ in range(150)]
    seen = []
    real = near_duplicates.components

    def counted(nodes, links):
        seen.append(links.distinct().count())
        return real(nodes, links)

    monkeypatch.setattr(near_duplicates, "components", counted)
    per_copy = []
    for n in (200, 400):
        texts = []
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randint(1, 9)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
        seen.clear()
        found = near_duplicates.near_duplicates(documents(spark, texts), 3, percent).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == {i: c for i, (_, c) in brute_components(texts, list(range(n)), 3, percent).items()}
        per_copy.append(max(seen) / n)
    assert max(per_copy) < 12 and per_copy[1] < 1.5 * per_copy[0] + 1


def test_components_of_chains_stars_and_cliques(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 80)] + [(i, j) for i in range(300, 320) for j in range(300, i)] + [(5, 5)]
    names = list(range(400))
    rng.shuffle(names)
    links = spark.createDataFrame([(names[a], names[b]) if rng.random() < 0.5 else (names[b], names[a]) for a, b in edges], "a long, b long")
    got = {r["node"]: r["label"] for r in components(spark.range(400).withColumnRenamed("id", "node"), links).collect()}
    for part in ([*range(100, 161)], [*range(200, 280)], [*range(300, 320)]):
        assert {got[names[i]] for i in part} == {min(names[i] for i in part)}
    assert all(got[names[i]] == names[i] for i in [*range(100), *range(161, 200), *range(280, 300), *range(320, 400)])
    assert components(spark.range(3).withColumnRenamed("id", "node"), links.limit(0)).count() == 3


def test_columns_named_like_the_operators_own_stay(spark):
    names = ["a", "b", "row_a", "row_b", "__a", "__b", "__cut", "cut", "whole", "line", "host", "page"]
    rows = [(i, "menu\nown line %d of this page" % i, "s", *range(len(names))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    cut = line_dedup.drop_lines(docs, ratio=0.5)
    assert cut.columns == docs.columns and {tuple(r)[3:] for r in cut.collect()} == {tuple(range(len(names)))}
    assert all(r["text"] == f"own line {r['doc_id']} of this page" for r in cut.collect())
    one = near_duplicates.one_of_each(docs)
    assert one.columns == docs.columns and {tuple(r)[3:] for r in one.collect()} == {tuple(range(len(names)))}


# Tree search

def _vectors(spark, x, ids):
    return spark.createDataFrame([(int(i), [float(c) for c in v], -1, "x") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, least int, leaf string")


def test_tree_search_skips_most_rows(spark):
    """Recall of at least 0.9 with under half of the rows scored; columns named like the operator's own do not disturb."""
    rng = np.random.default_rng(17)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 16))).astype(np.float32)
    got = defaultdict(dict)
    rows = tree_search.nearest_by_tree(_vectors(spark, x, range(4000))).collect()
    for r in rows:
        got[r["query_id"]][r["rank"]] = r
    wide, hits = x.astype(float), 0
    for i in range(0, 4000, 20):
        scores = wide @ wide[i]
        scores[i] = -np.inf
        assert sorted(got[i]) == list(range(1, 21))
        order = [(-r["score"], r["vec_id"]) for _, r in sorted(got[i].items())]
        assert order == sorted(order)
        assert all(abs(r["score"] - scores[r["vec_id"]]) < 1e-9 for r in got[i].values())
        hits += len({r["vec_id"] for r in got[i].values()} & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (20 * 200) >= 0.9
    assert np.mean([r["scored"] for r in rows]) < 0.5 * 4000


def test_tree_search_by_length(spark):
    """Vectors of each length meet their own kind only; few rows are all found, in order."""
    x = [[1.0, 0.0], [0.5, 0.5], [0.0, 1.0], [2.0], [1.0], [-1.0], [3.0, 0.0, 0.0]]
    got = tree_search.nearest_by_tree(_vectors(spark, x, [0, 1, 2, 20, 21, 22, 23]), k=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 1, 0.5), (0, 2, 2, 0.0), (20, 1, 21, 2.0), (20, 2, 22, -2.0)]


@pytest.mark.parametrize(("sample", "width"), [(1500, 200), (100, 16)])
def test_tree_search_sends_few_rows(spark, monkeypatch, sample, width):
    """A round sends a few times k rows for each query, however many pages or large leaves there are; none of the nearest is lost."""
    sent, meet = [], tree_search.meet

    def counted(*args):
        found = meet(*args)
        sent.append(found.count())
        return found

    for name, value in (("meet", counted), ("ROWS", 16), ("SAMPLE", sample)):
        monkeypatch.setattr(tree_search, name, value)
    x, k = np.random.default_rng(23).normal(size=(6000, width)), 5      # without clusters, so that many leaves are visited
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    got = defaultdict(dict)
    for r in tree_search.nearest_by_tree(_vectors(spark, x, range(6000)), every=60, k=k, recall=1.0).collect():
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    wide = x.astype(float)
    for i in range(0, 6000, 60):
        scores = wide @ wide[i]
        scores[i] = -np.inf
        assert [got[i][n] for n in range(1, k)] == np.argsort(-scores)[:k - 1].tolist()      # the calibration counts the query itself among its k
    assert sent[0] <= 4 * tree_search.STEP * (k + 1) * 100, sent
    assert max(sent[1:]) <= tree_search.STEP * (k + 1) * 100, sent


def test_page_sends_no_ties_that_come_later():
    """Rows level with the bound and of a higher id are of no use to the query."""
    left = pd.DataFrame({"id": [100, 200], "v": [np.array([1.0, 0.0])] * 2, "leaves": [np.array([0, 1])] * 2, "least": [1.0, -np.inf], "least_id": [5, 2**63 - 1]})
    right = pd.DataFrame({"id": [3, 4, 7, 8, 9], "v": [np.array([v, 1.0]) for v in (1.0, 0.5, 1.0, 2.0, 1.0)], "leaf": [0, 0, 0, 1, 1]})
    got = tree_search.best_of_page(left, right, 4)
    assert got[got["query"] == 100]["id"].tolist() == [8, 3]
    assert got[got["query"] == 200]["id"].tolist() == [8, 3, 7, 9]


@pytest.mark.parametrize(("first", "visits", "rows"), [(1, 1, 1.0), (8, 8, 5000.0), (13, 3534, 6.6), (8, 2500, 20_000.0), (3, 4, 0.5)])
def test_rounds_hold_every_leaf_and_share_once(first, visits, rows):
    seen = Counter()
    for since, until, low, high, shares in tree_search.rounds(first, visits, rows, 21):
        seen.update((leaf, share / shares) for leaf in range(since, until) for share in range(low, high))
    assert set(seen.values()) == {1}
    wide = {leaf: sum(1 for f, _ in seen if f == leaf) for leaf in range(visits)}
    assert set(wide) == {f for f, _ in seen}
    assert all(wide[leaf] == (wide[0] if leaf < first else 1) for leaf in wide)
