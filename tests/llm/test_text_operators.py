"""The text operators on small tables: brute force, round trips, and rows that are null, empty, long, tied or repeated."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crashmart.llm import licenses, line_dedup, near_duplicates, packing, piece_offsets, private_data, segment_search, separator_scan, toxicity, tree_search, vectors
from crashmart.llm.word_tokens import chunks

PIECES, WORDS, RANKS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, node long, label long, length long"
LONG = "alpha beta gamma " * 8000


def documents(spark, texts, ids=None, source="a"):
    """Documents with further columns whose names the operators use inside."""
    rows = [(i if ids is None else ids[i], t, None, source, None, "x", 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, [None, "", " \n ", "one", "One", LONG, "a b c d e", "a b c d e", "é 日本 🙂 ▁ x", None], [0, 1, 2, 3, 4, 5, 6, 6, None, 9]).cache()


def sample(seed=1, n=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubcdfglmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    for i in range(n // 3):     # copies with a few words changed, from a handful of texts
        words = texts[i % 5].split()
        for _ in range(rng.randint(0, max(1, len(words) // 12))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    return texts


# Near duplicates

def brute_components(texts, ids, words, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[i: i + words]) for i in range(len(w) - words + 1)]))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {ids[i]: (len(sets[i]), ids[find(i)]) for i in range(len(sets))}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, words, percent):
    texts = sample()
    found = near_duplicates.near_duplicates(documents(spark, texts), words, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(texts, list(range(len(texts))), words, percent)
    assert Counter(r["component_id"] for r in found if r["winner"]) == Counter({r["component_id"] for r in found})


def test_near_duplicates_of_odd_rows(spark, odd):
    found = near_duplicates.near_duplicates(odd, 3, 85).collect()
    assert len(found) == 10
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == (0, 2)
    assert got[3] == (1, 3) and got[4] == (1, 3) and got[5] == (3, 5) and got[6] == (3, 6)
    assert got[None][1] is None and got[None][0] > 0
    assert near_duplicates.one_of_each(odd).count() == 8       # 4 is 3's copy, 6 stands twice
    assert near_duplicates.near_duplicates(odd.limit(0), 3, 85).count() == 0


def test_index_finds_every_pair_within_the_bound():
    bound, keys = near_duplicates.plan(0.85, 64)
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 2**16, (1, 64)).astype(np.uint16)
        b = a.copy()
        b[0, rng.choice(64, bound, replace=False)] ^= 1
        assert (near_duplicates.index_keys(a, keys) == near_duplicates.index_keys(b, keys)).any()


def test_whole_fields_and_single_keys_give_the_same(spark, monkeypatch):
    """Comparing a field as a whole and key by key leads to the same components; so do small cells."""
    texts = sample(3, 120)
    monkeypatch.setattr(near_duplicates, "CELL", 16)
    found = near_duplicates.near_duplicates(documents(spark, texts), 3, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(texts, list(range(len(texts))), 3, 85)


# Line dedup

def test_line_dedup_matches_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        lines = [f"own {i} {j}" for j in range(rng.randint(1, 3))] + ["menu", "", "footer"][: rng.randint(0, 3)]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), rng.choice(["a", "b", None])))
    rows += [(200, None, "a"), (201, "", "b"), (202, "menu", "a"), (202, "menu", "a")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, page long")
    pages = defaultdict(set)
    for _, text, host in rows:
        pages[host].add(text or "")
    cut = {host: {line for line in {x for p in own for x in p.split("\n") if x.strip()} if (n := sum(line in p.split("\n") for p in own)) >= 3 and n > 0.2 * len(own)} for host, own in pages.items()}
    want = Counter((i, t if t is None or not cut[h] & set(t.split("\n")) else "\n".join(x for x in t.split("\n") if x not in cut[h]), h, 7) for i, t, h in rows)
    got = line_dedup.drop_lines(docs, ratio=0.2, least=3)
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == want
    assert any(cut.values()) and line_dedup.drop_lines(docs.limit(0)).count() == 0


# Packing

@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), min_size=1, max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece_once(counts):
    entries, sequences = packing.make_plan(counts, 64, (6,))
    placed, ranks = defaultdict(list), Counter()
    for length, first, n, base, each, offset in sorted(entries):
        assert first == ranks[length]
        ranks[length] += n
        for i in range(n):
            placed[base + i // each].append((offset + i % each * length, length))
    assert ranks == Counter(counts) and set(placed) == set(range(sequences))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert -(-sum(k * v for k, v in counts.items()) // 64) <= sequences <= best_fit(counts, 64)


def best_fit(counts, capacity):
    """Sequences of plain best fit by decreasing length, one piece at a time."""
    free, sequences = [], 0
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        at = bisect.bisect_left(free, length)
        sequences += at == len(free)
        bisect.insort(free, (free.pop(at) if at < len(free) else capacity) - length)
    return sequences


def test_plans_against_best_fit_and_the_lower_bound():
    """Lengths of several kinds: never more sequences than best fit, and fewer where grouping helps."""
    rng = np.random.default_rng(29)
    kinds = {"small": rng.exponential(900, 3000), "even": rng.integers(1, 4097, 1500), "middle": rng.normal(1300, 300, 2000), "third": rng.normal(1500, 150, 2000)}
    for kind, lengths in kinds.items():
        counts = dict(Counter(lengths.clip(1, 4096).astype(int).tolist()))
        plain, found = best_fit(counts, 4096), packing.make_plan(counts, 4096, (48,))[1]
        assert -(-sum(k * v for k, v in counts.items()) // 4096) <= found <= plain, kind
        assert found < plain or kind in ("small", "even")
    assert packing.make_plan({}, 4096) == ([], 0)


def test_packing_of_odd_rows(spark, odd):
    cut = packing.pieces(odd, WORDS, 100)
    rows = packing.pack(cut, 100).collect()
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for r in odd.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r["doc_id"], i, s, len(ids[s: s + 100]), zlib.crc32(ids[s: s + 100].tobytes())) for i, s in enumerate(range(0, len(ids), 100)))
    assert Counter(tuple(r)[:5] for r in rows) == want
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in used.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *(n for _, n in sorted(own))])[:-1])
    assert packing.pack(packing.pieces(odd.limit(0), WORDS)).count() == 0


@given(st.text(st.sampled_from("abzAZ éÉßñ.,!'1²ǅİΣ\n\t é日🙂_-"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_chunked_ids_are_the_tokenizers(text):
    encoder = chunks(WORDS)
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


# Pieces

@pytest.fixture(scope="module")
def reference():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@given(text=st.text(st.sampled_from("abcde .,!;\n\t▁é日🙂<>0x'\"()x́\x00"), max_size=200))
@settings(max_examples=400, deadline=None)
def test_pieces_are_the_librarys_and_spans_cover_the_source(reference, text):
    ids, begins, ends, decoded = piece_offsets.encoder(PIECES).encode(text)
    want = reference.encode(text, add_eos=True)
    assert list(map(int, ids.split())) == want and decoded == reference.decode(want)
    raw = text.encode()
    assert list(ends[:-1]) == list(begins[1:]) and (not raw or (begins[0], ends[-1]) == (0, len(raw)))
    for i, a, b in zip(want, begins, ends, strict=False):
        piece = reference.id_to_piece(i)
        if piece.startswith("<0x"):
            assert raw[a:b] == bytes([int(piece[3:5], 16)])
        else:
            assert raw[a:b].decode().replace(" ", "▁") in (piece, piece[1:])


def compiled_map(rules: dict[bytes, bytes]) -> bytes:
    """A double-array trie made the plain way, for tests: each node gets a free place of its own."""
    units, used, strings, at = {0: 0}, {0}, b"", {}
    for new in rules.values():
        at[new] = len(strings)
        strings += new + b"\0"

    def put(place: int, prefix: bytes) -> None:
        nexts = sorted({r[len(prefix)] for r in rules if r.startswith(prefix) and len(r) > len(prefix)})
        leaf = prefix in rules
        base = next(b for b in range(1, 2**16) if not {place ^ b ^ c for c in (nexts + [0] * leaf)} & used)
        used.update(place ^ base ^ c for c in nexts + [0] * leaf)
        units[place] = (units[place] & 0x800000FF) | base << 10 | leaf << 8
        if leaf:
            units[place ^ base] = 0x80000000 | at[rules[prefix]]
        for c in nexts:
            units[place ^ base ^ c] = c
            put(place ^ base ^ c, prefix + bytes([c]))

    put(0, b"")
    flat = np.zeros(max(units) + 1, "<u4")
    for k, v in units.items():
        flat[k] = v
    return len(flat.tobytes()).to_bytes(4, "little") + flat.tobytes() + strings


def test_character_map_takes_the_longest_prefix_and_keeps_places():
    rules = {b"ab": b"X", b"abc": b"YY", "é".encode(): b"e", b"\t": b" "}
    encoder = piece_offsets.Encoder(PIECES)
    encoder.map = piece_offsets.CharacterMap(compiled_map(rules))
    assert encoder.map.longest(b"abcd", 0) == (3, b"YY") and encoder.map.longest(b"abd", 0) == (2, b"X") and encoder.map.longest(b"b", 0) is None
    normal, source = encoder.normalise("zabcé\tab")
    assert normal == "▁zYYe▁X"
    assert source.tolist() == [0, 0, 0, 0, 1, 1, 4, 6, 6, 6, 7, 9]
    ids, begins, ends, decoded = encoder.encode("zabcé\tab")
    assert decoded == "zYYe X" and ends[-1] == 9 and list(begins[1:]) == list(ends[:-1])


def test_piece_rows(spark, odd, reference):
    rows = piece_offsets.encode(odd, PIECES).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter({(i, tuple(reference.encode(t, add_eos=True))): n for (i, t), n in texts.items()} | {})
    short = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in piece_offsets.digests(odd, PIECES).collect()}
    assert short == {(r["doc_id"], len(r["ids"]), hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()) for r in rows}
    assert piece_offsets.digests(odd.limit(0), PIECES).count() == 0


# Toxicity

def test_maximal_segments_match_the_definition():
    rng = random.Random(5)
    for _ in range(300):
        scores = np.array([rng.choice([-2, -1, 1, 3, 4]) for _ in range(rng.randint(0, 14))], float)

        def split(a, b):
            """The best segment (shortest of equal ones), then the same left and right of it."""
            options = [(scores[i:j].sum(), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            if not options or max(options)[0] <= 0:
                return []
            *_, i, j = max(options)
            return split(a, i) + [i, j][0:0] + [(float(scores[i:j].sum()), i, j)] + split(j, b)

        got = toxicity.maximal_segments(scores)
        assert sum(s for s, *_ in got) == pytest.approx(sum(s for s, *_ in split(0, len(scores))))
        assert all(scores[a:b].sum() == pytest.approx(s) and s > 0 for s, a, b in got)
        assert max((s for s, *_ in got), default=0) == max((s for s, *_ in split(0, len(scores))), default=0)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, marks = [], []
    for i in range(900):
        own = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        bad = rng.random() < 0.15
        for _ in range(3 * bad):
            own.insert(rng.randrange(len(own)), rng.choice(["vile", "nasty"]))
        texts.append(" ".join(own))
        marks.append((i, int(bad)))
    docs = documents(spark, [*texts, None, ""])
    labels = spark.createDataFrame([*marks, (None, 1), (5000, None)], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(i, bad) for i, bad in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((found[i]["score"] >= 0.7) == bool(bad) for i, bad in held)
    assert 0 <= found[900]["score"] < 0.7 and found[901]["n_passages"] == 0
    nothing = toxicity.toxicity(docs, labels.limit(0)).agg(F.min("score"), F.max("score")).first()
    assert 0 <= nothing[0] == nothing[1] < 0.7
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


# Personal data

def plain_base(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda d=digits: 12 <= len(d) <= 19 and private_data.luhn(d),
                    "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]():
                out.append((*m.span(), kind))
    return private_data.ordered(out)


@given(st.text(st.sampled_from("ab1@.-+ (%9 4٠é\n"), max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert private_data.ordered(private_data.base_spans(text)) == plain_base(text)


def test_field_adds_spans_and_keeps_base_ones(spark):
    rng = random.Random(7)
    hexa = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f"mail me at user{i}@site{i % 9}.example.com now" for i in range(60)] + [f'set token = "{hexa()}" in {rng.randint(1900, 2030)} or so' for _ in range(60)]
    texts += [f"call +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} soon" for _ in range(60)] + [f"it was {rng.randint(1, 99)} of {rng.randint(1900, 2030)}" for _ in range(60)]
    field = private_data.fit(documents(spark, texts))
    new = [f'token = "{hexa()}" and x9@y.example.org', "in 1984 there were 12", None, "", "9" * 5000, "a@" * 3000]
    rows = private_data.private_data(documents(spark, new), field).orderBy("doc_id").collect()
    assert [s["kind"] for s in rows[0]["spans"]] == ["secret", "email"]
    assert all(not r["spans"] for r in rows[1:4])
    assert all({tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]} for r in rows)
    assert private_data.masked(new[0], field) == 'token = "<SECRET>" and <EMAIL>'
    masked = private_data.mask(documents(spark, new), field)
    assert masked.where("text is null").count() == 1 and masked.columns[:2] == ["doc_id", "text"]
    assert private_data.private_data(documents(spark, new).limit(0), private_data.fit(documents(spark, []))).count() == 0


def test_windows_cut_no_run():
    long = "a" * 70 + "7" + "b" * 90
    assert [f"x {long} y"[a:b] for a, b in private_data.windows(f"x {long} y")] == [f"x {long} y"[2:-2]]
    two = "c" * 60 + "1" + "d" * 100 + "2" + "e" * 60        # windows that meet become one
    assert private_data.windows(two) == [(0, len(two))]
    assert private_data.windows("1" + " ." * 100 + "2") == [(0, 41), (161, 202)]
    assert private_data.windows("") == private_data.windows("no mark") == []


def test_decoding_finds_the_best_segmentation():
    rng = np.random.default_rng(8)
    text = "a1 b2 c3 44 x@ d5"
    tokens = [m.span() for m in private_data.TOKEN.finditer(text)]
    spans = private_data.candidates(text, tokens)
    for _ in range(20):
        names = sorted({f for i, j in spans for f in private_data.features(text, tokens[i][0], tokens[j - 1][1])})
        field = private_data.Field({n: i for i, n in enumerate(names)}, rng.normal(size=(len(names), len(private_data.KINDS))))
        value = {(i, j): float(field.scores(text, tokens[i][0], tokens[j - 1][1]).max()) for i, j in spans}

        def top(at):
            return 0.0 if at == len(tokens) else max([top(at + 1), *(v + top(j) for (i, j), v in value.items() if i == at)])

        got = field.decode(text)
        places = {(tokens[i][0], tokens[j - 1][1]): (i, j) for i, j in spans}
        assert sum(value[places[s[:2]]] for s in got) == pytest.approx(top(0))


# Vectors

def rows_of(spark, x, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_exact_search_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 20)).astype(np.float32)
    x[100:160] = x[7]
    monkeypatch.setattr(segment_search, "ROWS", 64)
    bad = [None, [], [float("nan")] * 20, [float("inf")] * 20, [None] * 20]
    rows = segment_search.whole_numbers(rows_of(spark, [*x.tolist(), *bad]))
    got = segment_search.top_k(rows.where("id % 10 = 0"), rows, 5)
    whole = np.floor(1024 * x.astype(float)).astype(int)
    want = set()
    for i in range(0, 300, 10):
        order = sorted((-int(whole[i] @ whole[j]), j) for j in range(300) if j != i)[:5]
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(order)}
    assert {tuple(r) for r in got.collect()} == want
    assert segment_search.top_k(rows.limit(0), rows, 5).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(10)
    x = rng.normal(size=(50, 13))
    for n in segment_search.LEVELS:
        m, s = segment_search.segments(x, min(n, 13))
        assert (m @ m.T + s @ s.T >= x @ x.T - 1e-9).all()


def test_tree_search_recall_and_ties(spark):
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + 0.5 * rng.normal(size=(3000, 16)))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[500:1500] = x[3]                        # a third are copies
    x[20] = 0
    rows = rows_of(spark, [*x.tolist(), None, [float("nan")] * 16, [1.0]], [*range(3000), 3000, 3020, 3040])
    got = defaultdict(list)
    for r in tree_search.nearest_by_tree(rows).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids = [i for i in range(0, 3000, 20) if i != 20]
    assert sorted(got) == ids
    wide, hits = x.astype(float), 0
    for i in ids:
        scores = wide @ wide[i]
        scores[[i, 20]] = -np.inf
        truth = np.lexsort((np.arange(3000), -np.round(scores, 9)))[:20]
        assert [n for n, *_ in sorted(got[i])] == list(range(1, 21))
        hits += len({v for _, v, _ in got[i]} & set(truth.tolist()))
    assert hits / (20 * len(ids)) >= 0.9
    assert [v for _, v, _ in sorted(got[500])] == [3, *range(501, 520)]
    assert tree_search.nearest_by_tree(rows.limit(0)).count() == 0


def test_lowest_of_each(spark):
    rows = spark.range(500).select("id", F.lit(1).alias("v"), (F.col("id") % 2).alias("a"), F.lit(0).alias("b"))
    assert sorted(r["id"] for r in vectors.lowest_of_each(rows, 3).collect()) == [0, 1, 2, 3, 4, 5]


def test_repeated_rows_take_no_places(spark):
    """Every row twice and one 30 times: the same neighbours as without repeats."""
    rows = spark.range(500).select("id", F.lit(1).alias("v"), (F.col("id") % 2).alias("a"), F.lit(0).alias("b"))
    repeated = rows.union(rows).union(rows.where("id = 0").crossJoin(spark.range(28).select()))
    assert sorted(r["id"] for r in vectors.lowest_of_each(repeated, 3).collect()) == [0, 1, 2, 3, 4, 5]
    rng = np.random.default_rng(13)
    x = rng.normal(size=(20, 8))[rng.integers(0, 20, 1500)] + 0.5 * rng.normal(size=(1500, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = [*range(1500), *range(1500), *[40] * 28]
    got = defaultdict(set)
    for r in tree_search.nearest_by_tree(rows_of(spark, x[ids].tolist(), ids)).collect():
        got[r["query_id"]].add(r["vec_id"])
    wide, hits = x.astype(float), 0
    for i in range(0, 1500, 20):
        scores = wide @ wide[i]
        scores[i] = -np.inf
        assert len(got[i]) == 20
        hits += len(got[i] & set(np.lexsort((np.arange(1500), -scores))[:20].tolist()))
    assert hits / (20 * 75) >= 0.95


# Separator scan

def test_counts_over_block_edges(spark, monkeypatch):
    rng, end = random.Random(12), 9
    monkeypatch.setattr(separator_scan, "GROUP", 3)
    files, want = [], set()
    for file in range(4):
        tokens = [rng.choice([1, 2, 3, 4, 5, 9]) if file else 1 for _ in range(rng.randint(0, 90))]
        starts, no = 0, 0
        for at, t in enumerate(tokens):
            if t == end:
                want.add((file, no, starts, at - starts, True))
                starts, no = at + 1, no + 1
        if starts < len(tokens):
            want.add((file, no, starts, len(tokens) - starts, False))
        raw = np.array(tokens, "<u2")
        files += [(file, b, raw[8 * b: 8 * b + 8].tobytes(), None) for b in range(-(-len(raw) // 8))]
    blocks = spark.createDataFrame(files, "file int, block long, payload binary, doc_ids array<long>")
    got = separator_scan.token_counts(blocks, end)
    assert {(r["file"], r["doc_no"], r["start"], r["n_tokens"], r["ended"]) for r in got.collect()} == want
    assert separator_scan.token_counts(blocks.limit(0), end).count() == 0


def test_counts_of_documents_and_of_files(spark, odd, tmp_path):
    encoding = separator_scan._encoding(RANKS)
    texts = Counter((r["doc_id"], len(encoding.encode_ordinary(r["text"] or ""))) for r in odd.collect())
    got = separator_scan.token_counts(separator_scan.token_files(odd, RANKS, block=1000))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == texts
    np.array([1, 2, separator_scan.END, separator_scan.END, 3], "<u2").tofile(tmp_path / "shard.bin")
    flat = separator_scan.token_counts(separator_scan.read_token_files(spark, str(tmp_path), block=2))
    assert sorted((r["doc_no"], r["start"], r["n_tokens"], r["ended"]) for r in flat.collect()) == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]


# Licences

def test_rules_need_their_sentences_in_order(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."
    notice = "The above copyright notice and this permission notice shall be included in all copies."
    texts = [f"Hello.\n{grant}\n{notice} Bye", f"{notice} {grant}", "Licensed under the Apache License, Version 2.0.", "x. Released under the MIT License. Licensed under CC BY-NC 4.0. y",
             None, "", "nothing here", "Redistribution and use in source and binary forms are permitted. Redistributions of source code must retain this. Redistributions in binary form must reproduce it. Neither the name of X may be used."]
    got = {r["doc_id"]: (r["n_sentences"], r["licences"]) for r in licenses.scan(documents(spark, texts)).collect()}
    assert got == {0: (2, "MIT"), 1: (2, ""), 2: (1, "Apache-2.0"), 3: (2, "MIT,CC-BY-NC"), 4: (0, ""), 5: (0, ""), 6: (0, ""), 7: (4, "BSD-3-Clause")}


MIT = """MIT License
Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version
2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the
GNU {}General Public License for more details.

You should have received a copy of the GNU {}General Public License
along with this program. If not, see <https://www.gnu.org/licenses/>.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_hard_wrapped_licence_texts(spark):
    whole = [MIT, BSD, APACHE, GPL.format("", "", ""), GPL.format("Lesser ", "Lesser ", "Lesser "), MPL]
    names = ["MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0"]
    comments = ["".join(f" * {line}\n" for line in t.splitlines()) for t in whole]
    unwrapped = [re.sub(r"(?<!\n)\n *(?![\n0-9])", " ", t.replace("MIT License\n", "")) for t in whole]
    crlf = [t.replace("\n", "\r\n") for t in whole]
    title = ["GNU GENERAL PUBLIC LICENSE\n      Version 3, 29 June 2007\n", "Text under CC BY-SA\nCopyright 2020 X\nAll rights reserved"]
    texts = [*whole, *comments, *unwrapped, *crlf, *title]
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licenses.scan(documents(spark, texts)).collect()}
    assert [got[i][1] for i in range(len(texts))] == [*names * 4, "GPL-3.0", "CC-BY-SA,All-Rights-Reserved"]
    assert got[0][0] == "- Copyright - MitGrant MitNotice AsIs -"
    assert "GplThree GplNone - GplCopy" in got[3][0]
