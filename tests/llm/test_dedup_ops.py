"""Near-duplicates and substring dedup against brute force, with the defined edge cases."""

import hashlib
import math
import random
import re

import pyarrow as pa
import pytest
from algoscape.llm import near_duplicates as N
from algoscape.llm import substring_dedup as S
from algoscape.llm.graph import connected_components
from algoscape.llm.scratch import Scratch
from pyspark.sql import functions as F
from test_models_and_tables import letters


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def brute_near(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, n, vocab=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.6:
            words = r.choice(out).split()
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                if words:
                    j = r.randrange(len(words))
                    words[j : j + r.randint(0, 2)] = [f"v{r.randrange(vocab)}"]
        else:
            words = [f"v{r.randrange(vocab)}" for _ in range(r.choice([1, 3, 4, 5, 40, 80, 200]))]
        out.append(" ".join(words))
    return out


def hot(n):
    """One text with single edits: many different near copies, in and out of reach of each other."""
    r = random.Random(9)
    base = [f"h{i}" for i in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for j in r.sample(range(120), r.randint(0, 5)):
            w[j] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_match_brute_force(spark):
    texts = [None, "", " \n", "One TWO three", "one two  three", "a b c d", "a b c d e", *corpus(1, 220), *hot(90), "long " + " ".join(f"w{i}" for i in range(20000))]
    random.Random(2).shuffle(texts)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, component_id string, id int")
    for k in (4, 5):
        want = brute_near(rows, k)
        got = N.near_duplicates(df, k=k).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
    kept = N.remove_near_duplicates(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in brute_near(rows, 5).items() if x[2]}


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, None), (9, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df).collect())
    assert got == [(0, 2, None, True), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True), (9, 2, 5, False)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 500), (3, 3), (7000, 7001), (7000, 7001)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark, "t"), "cc").collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 1000: 500, 7000: 7000, 7001: 7000}


def brute_repeats(rows, window=50):
    first = {}
    cut = {i: (t or "").encode().split() for i, t in rows}
    cut = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for i, t in rows}
    for i, w in sorted(cut.items()):
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = {}
    for i, w in cut.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone |= set(range(j, j + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed, n):
    r = random.Random(seed)
    shared = [[f"p{k}.{i}" for i in range(r.choice([49, 50, 51, 60, 130]))] for k in range(6)] + [["same"] * 120, ["x", "y"] * 60]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(1, 4)):
            if r.random() < 0.5:
                p = r.choice(shared)
                a = r.randrange(0, 20)
                parts += p[a:] if r.random() < 0.4 else p
            else:
                parts += [f"u{r.randrange(10**9)}" for _ in range(r.randint(1, 80))]
        docs.append(r.choice([" ", "\n", "  "]).join(parts))
        if r.random() < 0.2:
            docs.append(r.choice(docs))
    return docs


@pytest.mark.parametrize("batches", [1, 5])
def test_substring_dedup_matches_brute_force(spark, batches):
    texts = [None, "", *passages(3, 150), "é " * 60, "É " * 60, "é " * 55, " ".join(f"l{i}" for i in range(30000))]
    random.Random(4).shuffle(texts)
    rows = [(i * 2 + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id long, text string, id int, first string")
    got = S.remove_repeated_passages(df, batches=batches).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got} == brute_repeats(rows)


def test_index_is_opened_again_compacts_and_does_not_shuffle_history(spark, tmp_path):
    texts = passages(5, 120)[:120]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("version", F.xxhash64("text"))
    got, levels = {}, []
    for b in range(6):
        index = S.FingerprintIndex(spark, str(tmp_path))  # knows earlier batches by the manifest alone
        mine = docs.where(f"id >= {b * 20} and id < {b * 20 + 20}")
        if b == 4:
            plan = index.known(index.runs()[-1])._jdf.queryExecution().toString()
            plan = plan[plan.index("== Physical Plan ==") :]
            # runs are merged in the order of their files
            assert plan.count("SortMergeJoin") == len(index.runs()) > 1 and "Exchange" not in plan and "Sort [" not in plan
        out = index.ingest(mine, docs.where(f"id < {b * 20 + 20}"))
        got |= {r.id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect()}
        levels.append([len(x) for x in index.levels])
    assert got == brute_repeats(rows)
    assert levels == [[1], [2], [0, 1], [1, 1], [2, 1], [0, 2]]


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_substring_dedup_of_a_hot_passage(spark, monkeypatch, rows):
    monkeypatch.setattr(S, "BROADCAST_ROWS", rows)  # joined by shuffles, or sent to all tasks
    p = [f"q{i}" for i in range(90)]
    r = random.Random(8)
    texts = [" ".join([*(f"u{i}.{j}" for j in range(r.randrange(9))), *p[r.choice([0, 0, 0, 7]) :], f"v{i}"]) for i in range(300)]
    rows = list(enumerate(texts))
    got = S.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {x.doc_id: (x.n_words, x.n_removed, hashlib.sha256(x.kept_text.encode()).hexdigest()) for x in got} == brute_repeats(rows)


def test_only_equal_words_are_removed(spark):
    a, b = letters()
    p = [f"q{i}" for i in range(60)]
    rows = [(1, " ".join([*p, a, *p[::-1]])), (2, " ".join([*p[20:], b, *p[:20]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in S.remove_repeated_passages(df).collect()}
    assert got == brute_repeats(rows) and got[2][1] == 0
    # a stretch that hashes call equal, but whose words differ, stays
    stretch = [{"first": f, "n": n, "digest": hashlib.sha256(w).digest()} for f, n, w in [(0, 2, b"x z"), (2, 1, b"z")]]
    batch = pa.RecordBatch.from_pylist([{"id": 1, "text": "x y z", "stretches": stretch}])
    assert [r for b in S._apply(iter([batch])) for r in b.to_pylist()] == [{"id": 1, "n_words": 3, "n_removed": 1, "kept_text": "x y"}]


def test_substring_dedup_edges(spark):
    p = " ".join(f"q{i}" for i in range(60))
    df = spark.createDataFrame([(None, p), (4, p), (4, p), (6, p), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in S.remove_repeated_passages(df).collect())
    assert got == [(0, 60, 0), (4, 60, 0), (4, 60, 0), (6, 60, 60), (8, 0, 0)]
    assert S.remove_repeated_passages(df.limit(0)).count() == 0


def test_exact_join_of_a_template_makes_no_pairs(spark):
    """Texts of one template, each with a word of its own, are close but not linked: rows grow with the texts alone."""
    base = [f"t{i}" for i in range(22)]
    sets = spark.createDataFrame([(i, [*range(16), *(1000 + 4 * i + j for j in range(4))]) for i in range(3000)], "id long, shingles array<long>")
    members = sets.selectExpr("id", "id as c")
    pairs = N._prefix_pairs(members, sets, 80, Scratch(spark, "t"))
    assert pairs.count() == 0
    a, b = N._prefix_sides(members, sets, 80, Scratch(spark, "t"))
    assert a.join(b, N.MEET).count() == 0 and b.count() == 3000
    rows = [(i, " ".join([*base[:11], f"own{i}", *base[11:]])) for i in range(400)] + [(400, " ".join([*base[:11], "own5", *base[11:], "more"]))]
    got = {r.doc_id: r.component_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == {**{i: i for i in range(400)}, 400: 5}


def test_exact_join_finds_every_pair(spark):
    r = random.Random(3)
    rows = []
    for i in range(160):
        near = set(r.choice(rows)[1]) if rows and r.random() < 0.8 else set(r.sample(range(300), r.randint(1, 60)))
        for _ in range(r.randint(0, 4)):
            near.add(r.randrange(300))
            if len(near) > 1:
                near.discard(r.choice(sorted(near)))
        rows.append((i, sorted(near)))
    members = spark.createDataFrame([(i, i % 7 if i % 2 else 0) for i, _ in rows], "id long, c long")
    got = {tuple(x) for x in N._prefix_pairs(members, spark.createDataFrame(rows, "id long, shingles array<long>"), 80, Scratch(spark, "t")).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y)) and (a % 7 if a % 2 else 0) != (b % 7 if b % 2 else 0)}
    assert len(want) > 50 and want <= got


def test_links_are_confirmed_on_words(spark):
    a, b = letters()
    rows = [(i, f"x y z {w}") for i, w in enumerate((a, b, a))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(df, k=4).collect()} == brute_near(rows, 4)
    batch = pa.RecordBatch.from_pylist([{"a": 1, "b": 2, "text_a": "a b c d e", "text_b": "a  b c D e"}, {"a": 1, "b": 3, "text_a": "a b c d e", "text_b": "a b c d f"}, {"a": 4, "b": 5, "text_a": "one", "text_b": "ONE"}])
    assert [tuple(r.values()) for x in N._confirm(4, 80)(iter([batch])) for r in x.to_pylist()] == [(1, 2), (4, 5)]


def test_share_of_links_found(spark):
    """Texts right at the threshold and above: every true link is found, the expected misses are 1e-7 of them."""
    r = random.Random(11)
    rows = []
    for g in range(150):
        words = [f"g{g}w{i}" for i in range(r.choice([30, 60, 120]))]
        rows.append(words)
        for _ in range(2):
            near = list(words)
            for _ in range(max(1, len(words) // r.choice([40, 45, 60]))):
                near[r.randrange(len(near))] = f"e{r.randrange(10**9)}"
            rows.append(near)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    r.shuffle(rows)
    want = brute_near(rows, 4)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    linked = [i for i in want if not want[i][2]]
    assert len(linked) > 50 and got == want


def test_checks_before_the_sets_fail_pairs_with_a_known_probability(spark):
    def tail(n, p, k):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))

    rows = [(i, ((1 << i) - 1, 0, 0)) for i in range(63)]
    df = spark.createDataFrame([(i, bits, (0, 0, 0)) for i, bits in rows], "i int, a struct<s0: long, s1: long, s2: long>, b struct<s0: long, s1: long, s2: long>")
    most = max(r.i for r in df.where(N._near_bits("a", "b", 80)).collect())
    assert tail(192, 0.1, most) <= 1e-9 < tail(192, 0.1, most - 1)
    assert tail(200, 0.2, N._most(200, 0.2)) <= 1e-9 < tail(200, 0.2, N._most(200, 0.2) - 1)
