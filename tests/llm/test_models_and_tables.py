"""URL filter, line dedup, resampling, toxicity, quality rules, mixing and the pipeline on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from algoscape.llm import line_dedup, mixing, quality_rules, resampling, toxicity, url_filter
from algoscape.llm.scratch import Scratch
from pyspark.sql import functions as F


# ---- urls
def test_rules_and_list(spark):
    urls = {
        1: ("https://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("http://example.net/fr/1", "example.net", "/fr/1", "net/", "block"),
        3: ("http://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
        4: ("http://m.example.com/de/", "m.example.com", "/de/", "example.com/de/", "block"),
        5: ("http://x.org/fr/a://b", "x.org", "/fr/a://b", "org/fr/", "allow"),
        6: ("http://x.net", "x.net", "", None, "allow"),
        7: (None, "", "", None, "allow"),
        8: ("no scheme/net/", "", "", None, "allow"),
        9: ("http://www.listed.com/a/?utm_source=q&b=1#f", "www.listed.com", "/a/", None, "block"),
        10: ("https://listed.com:443/a?b=1&ref=2", "listed.com:443", "/a", None, "block"),
        11: ("https://listed.com/a?b=2", "listed.com", "/a", None, "allow"),
        12: ("", "", "", None, "allow"),
        13: ("http://net/", "net", "/", "net/", "block"),
        14: ("http://listed.net?en=/en/", "listed.net", "", None, "allow"),
        15: ("http://Ünet.ORG/fr/", "Ünet.org", "/fr/", "org/fr/", "allow"),
    }
    pages = spark.createDataFrame([(i, u[0], "h", "z") for i, u in urls.items()] + [(9, urls[9][0], "h", "z"), (None, urls[2][0], None, None)], "page_id long, url string, html string, rule string")
    listed = spark.createDataFrame([("http://listed.com/a?b=1",), ("http://listed.com/a?b=1",), (None,), ("nothing",)], "url string")
    rows = [tuple(r) for r in url_filter.filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict").collect()]
    want = [(i, *u[1:]) for i, u in urls.items()] + [(9, *urls[9][1:]), (None, *urls[2][1:])]
    assert sorted(rows, key=str) == sorted(want, key=str)
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0)).where("listed").count() == 0


def test_bloom_filter_has_no_false_negatives(spark, monkeypatch):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    for broadcast in (10**6, 0):
        monkeypatch.setattr(url_filter, "MAX_BROADCAST_BLOCKS", broadcast)
        asked = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
        got = url_filter.BloomFilter(keys, "k", Scratch(spark, "t")).possible(asked, "k").where("__possible")
        assert got.where("id < 5000").count() == 5000
        assert got.where("id >= 5000").count() < 300


# ---- lines
def brute_lines(rows, least):
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            k = line.strip(" \t\x0b\x0c\r")
            if k and site is not None:
                sites.setdefault(k, set()).add(site)
    common = {k for k, s in sites.items() if len(s) >= least}
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip(" \t\x0b\x0c\r") not in common]
        out.append((i, sum(x != "" for x in lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def letters(n=1024):
    """Two words of n letters that hashes by powers of an odd base cannot tell apart."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bound", [10**6, 0])
def test_line_dedup_matches_brute_force(spark, bound):
    r = random.Random(5)
    pool = [f"line {i} é" for i in range(25)]
    rows = [(None, "a\nb", None), (-1, None, "s1"), (-2, "", "s1"), (-3, "\n\n", "s2"), (-4, "x" * 200000 + "\n" + pool[0], "s3")]
    for i in range(300):
        lines = [r.choice([pool[min(24, int(r.expovariate(0.2)))], f"own {i} {j}", "", "  ", f"  {pool[0]}\t"]) for j in range(r.randint(1, 6))]
        rows.append((i, "\n".join(lines) + r.choice(["", "\n"]), r.choice([None, *(f"s{k}" for k in range(14))])))
    rows.append(rows[-1])
    # twelve sites hold one of two lines, no line stands on more than six
    rows += [(1000 + i, f"{letters()[i % 2]} x\nafter", f"s{i}") for i in range(12)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, source string, k1 long, site string")
    got = line_dedup.cut_lines(df, max_keys=bound, max_bytes=bound).select("doc_id", "__n_lines", "__n_removed", F.sha2(F.coalesce("text", F.lit("")), 256)).collect()
    want = brute_lines(rows, line_dedup.MIN_SITES)
    assert any(x[2] for x in want)
    assert sorted(map(tuple, got), key=str) == want
    assert line_dedup.cut_lines(df.limit(0)).count() == 0


# ---- resampling
def corpus(n, seed):
    r = random.Random(seed)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}!!" for i in range(300)]
    rows = []
    for i in range(n):
        y = r.random() < 0.85
        rows.append((i, " ".join(r.choices(good if y else bad, k=r.randint(5, 200))), int(y)))
    return rows


def test_resampling_prefers_target_text(spark):
    rows = corpus(400, 1)
    extra = [(1000, None, None), (1001, "", None), (1002, rows[0][1], None), (1002, rows[0][1], None), (None, "g1", None)]
    df = spark.createDataFrame([(a, b, 7, 8.0) for a, b, _ in rows + extra], "doc_id long, text string, good int, key double")
    good = spark.createDataFrame([(a,) for a, _, y in rows if y and a % 2 == 0] + [(None,)], "doc_id long")
    got = resampling.resample(df, good, keep=0.8).collect()
    assert len(got) == len(rows) + len(extra)
    y = {a: q for a, _, q in rows}
    kept = {1: [], 0: []}
    for r in got:
        if r.doc_id in y:
            kept[y[r.doc_id]].append(r.kept)
    assert np.mean(kept[1]) > 0.9 and np.mean(kept[0]) < 0.2
    # exactly the largest keys, ties together
    keys = sorted((round(r.key * 1e6) for r in got), reverse=True)
    limit = keys[int(np.ceil(0.8 * len(got))) - 1]
    assert all(r.kept == (round(r.key * 1e6) >= limit) for r in got)
    ratios = resampling.log_ratios(df, good)
    again = {r.doc_id: r.log_weight for r in got}
    import pyarrow as pa

    at, _, _ = resampling.ngrams(pa.array([rows[3][1]]))
    assert again[3] == pytest.approx(resampling.SHARPNESS * ratios[at].mean(), abs=1e-6)
    assert resampling.resample(df.limit(0), good, keep=0.8).count() == 0
    assert {r.log_weight for r in resampling.resample(df, good.limit(0), keep=0.8).collect()} == {0.0}


def test_log_weights_equal_plain_counts(spark):
    """Weights, Gumbel numbers and the sample from words counted in plain dictionaries."""
    import math

    import pyarrow as pa

    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["alpha", "Beta", "gamma", "delta"], k=r.randint(1, 30)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    grams = lambda t: (w := t.lower().split()) + list(zip(w, w[1:], strict=False))
    every = {g for _, t in rows for g in grams(t)}
    bucket = {}
    for g in every:
        at, _, _ = resampling.ngrams(pa.array([" ".join(g) if isinstance(g, tuple) else g]))
        bucket[g] = int(at[-1])
    assert len(set(bucket.values())) == len(every)  # no two share a bucket here
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i < 20:
            target.update(grams(t))
    b = resampling.BUCKETS
    ratio = {g: math.log((target[g] + 1) / (target.total() + b)) - math.log((raw[g] + 1) / (raw.total() + b)) for g in every}
    got = {x.doc_id: x for x in resampling.resample(df, df.where("doc_id < 20").select("doc_id"), keep=0.25).collect()}
    draw = {x.doc_id: x.h for x in df.select("doc_id", F.xxhash64("doc_id", "text", F.lit(11)).alias("h")).collect()}
    for i, t in rows:
        want = resampling.SHARPNESS * np.mean([ratio[g] for g in grams(t)])
        assert got[i].log_weight == pytest.approx(want, abs=1e-6)
        u = (((draw[i] % 2**64) >> 12) + 0.5) / 2**52
        assert got[i].key == pytest.approx(want - math.log(-math.log(u)), abs=1e-6)
    best = sorted(got, key=lambda i: -got[i].key)[:15]
    assert {i for i in got if got[i].kept} == set(best)


def test_share_to_keep(spark):
    q = spark.createDataFrame([(1,), (1,), (0,), (1,)], "q int")
    assert resampling.good_share(q) == pytest.approx(0.75 + resampling.MARGIN)
    assert resampling.good_share(q.limit(0)) == 1.0


def test_log_ratios_count_every_word(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "b c"), (3, None)], "doc_id long, text string")
    got = resampling.log_ratios(df, spark.createDataFrame([(1,)], "doc_id long"))
    import pyarrow as pa

    raw, target = np.ones(resampling.BUCKETS), np.ones(resampling.BUCKETS)
    for i, t in ((1, "a b"), (2, "b c")):
        at, _, _ = resampling.ngrams(pa.array([t]))
        np.add.at(raw, at, 1)
        if i == 1:
            np.add.at(target, at, 1)
    assert np.allclose(got, np.log(target / target.sum()) - np.log(raw / raw.sum()))


# ---- toxicity
def test_toxicity_held_out_accuracy(spark):
    r = random.Random(3)
    vocab = [f"v{i}{'abc'[i % 3] * 3}" for i in range(800)]
    rows = []
    for i in range(2500):
        y = int(r.random() < 0.15)
        w = r.choices(vocab, k=r.randint(20, 120))
        for _ in range(3 * y):
            w[r.randrange(len(w))] = r.choice(["nastyfool", "nastyone", "vilething"])
        rows.append((i, " ".join(w).capitalize(), y))
    edge = [(9000, None, None), (9001, "", None), (9002, rows[0][1], None), (9002, rows[0][1], None), (9003, "nastyfool " * 30000, None)]
    df = spark.createDataFrame([(a, b, "x", 0.0) for a, b, _ in rows + edge], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(a, y) for a, _, y in rows] + [(3, rows[3][2]), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_tables(df, labels)
    got = {x.doc_id: (x.score, x.h) for x in toxicity.score(df, model).withColumn("h", toxicity.held_out()).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, (_, h) in got.items())
    held = [(got[i][0] >= 0.3, y) for i, _, y in rows if got[i][1]]
    assert np.mean([p == bool(y) for p, y in held]) > 0.97
    assert got[9000][0] == got[9001][0] < 0.3 <= got[9003][0] <= 1
    kept = toxicity.remove_toxic(df, model)
    assert kept.columns == df.columns and kept.where("doc_id = 9003").count() == 0
    # held-out labels are never read
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit_tables(df, flipped)
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias
    none = toxicity.score(df, toxicity.fit_tables(df, labels.limit(0))).collect()
    assert all(x.score < 1e-9 for x in none)
    assert toxicity.score(df.limit(0), model).count() == 0


def plain_ftrl(rows, epochs, alpha=0.5, beta=1.0, l1=3.0, l2=1.0):
    """Weights of features after the published per-coordinate rule, one feature at a time."""
    import math

    z, n, bias, bias_n = {}, {}, 0.0, 0.0

    def weight(f):
        v = z.get(f, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((beta + math.sqrt(n.get(f, 0.0))) / alpha + l2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            found, y = rows[i]
            w = {f: weight(f) for f in found}
            g = 1 / (1 + math.exp(-min(30, max(-30, sum(w.values()) + bias)))) - y
            for f in found:
                old = n.get(f, 0.0)
                n[f] = old + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(old)) / alpha * w[f]
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    return {f: weight(f) for f in z if weight(f)}, bias


def test_ftrl_equals_a_plain_one():
    import pyarrow as pa

    r = random.Random(2)
    texts = [" ".join(r.choices(["Foo", "bar", "bazinga", "qux!", "été", "longerword"], k=r.randint(0, 9))) for _ in range(300)]
    label = [int("bazinga" in t) for t in texts]
    sets, names = [], {}
    for t in texts:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        own = {("w", x) for x in w} | {("s", x.encode()[:k]) for x in w for k in toxicity.STEMS if len(x.encode()) >= k}
        sets.append(own | {(g, w[i], w[i + g]) for g in (1, 2) for i in range(len(w) - g)})
    for t, own in zip(texts, sets, strict=True):
        at, _ = toxicity.features(pa.array([t]))
        assert len(set(at.tolist())) == len(own)
        names[t] = own
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(label)], names=["text", "y"])
    got = next(iter(toxicity._train("text", "y")(iter([batch])))).to_pydict()
    weights, bias = plain_ftrl(list(zip(sets, label, strict=True)), toxicity.EPOCHS)
    assert got["bucket"][-1] == -1 and got["weight"][-1] == pytest.approx(bias)
    assert sorted(got["weight"][:-1]) == pytest.approx(sorted(weights.values())) and len(weights) > 2


# ---- quality rules
def brute_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_counts_and_verdicts(spark):
    r = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "do", "ré", "mi", "so") for b in ("la", "ti", "fu", "ße", "n,")]
    rows = []
    for i in range(500):
        w = r.choices(words, k=r.randint(55, 300))
        kind = i % 10
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        if kind == 1:
            w = [x + "$$$" for x in w]
        rows.append((i, r.choice([" ", "  "]).join(w).replace("n, ", "n,\n"), int(kind > 1)))
    edge = [None, "", " \n ", "a\na\n a\na \n\na", "x y z " * 40, "x y z x y z", "w " * 49, "é" * 10, "a b\u00a0c\u2028d \x0b e", "q" * 300000, "a\n" * 3000]
    rows += [(1000 + i, t, None) for i, t in enumerate(edge)] + [(1000, None, None), (None, "null id", None)]
    df = spark.createDataFrame([(a, b, 1) for a, b, _ in rows], "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([(a, y) for a, _, y in rows if a is not None], "doc_id long, quality int")
    stats = quality_rules.statistics(df)
    got = quality_rules.judge(stats, *quality_rules.fit(stats, labels)).collect()
    assert len(got) == len(rows)
    want = sorted([(a if a is not None else -1, *brute_counts(b)) for a, b, _ in rows])
    assert sorted([(x.doc_id if x.doc_id is not None else -1, *(x[c] for c in quality_rules.COUNTS)) for x in got]) == want
    assert all(x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words) for x in got)
    assert not any(x.kept for x in got if x.base_failed)
    y = {a: q for a, _, q in rows if q is not None}
    passed = [(x.kept, y[x.doc_id]) for x in got if x.doc_id in y and not x.base_failed]
    assert np.mean([k for k, q in passed if q]) > 0.98
    assert np.mean([k for k, q in passed if not q]) < 0.3
    forest, limit = quality_rules.fit(stats, labels.limit(0))
    assert all(x.kept != x.base_failed for x in quality_rules.judge(stats, forest, limit).collect())
    none = quality_rules.statistics(df.limit(0))
    assert quality_rules.judge(none, *quality_rules.fit(none, labels.limit(0))).count() == 0


def plain_paths(rows, low, high, sample, rng, x):
    """Path length of x in one tree, by walking down with the rows that remain."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))

    def build(rows, low, high, level):
        if level < limit and len(rows) > 1 and any(h > a for a, h in zip(low, high, strict=True)):
            f = int(rng.choice([i for i in range(len(low)) if high[i] > low[i]]))
            c = float(rng.uniform(low[f], high[f]))
            left = build([r for r in rows if r[f] <= c], low, [c if i == f else h for i, h in enumerate(high)], level + 1)
            return f, c, left, build([r for r in rows if r[f] > c], [c if i == f else a for i, a in enumerate(low)], high, level + 1)
        n = len(rows)
        return level + (0 if n <= 1 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n)

    tree = build(rows, low, high, 0)
    out = []
    for p in x:
        at = tree
        while isinstance(at, tuple):
            at = at[2] if p[at[0]] <= at[1] else at[3]
        out.append(at)
    return out


def test_forest_equals_a_plain_one():
    r = np.random.default_rng(4)
    rows = np.round(r.random((64, 3)) * (r.random((64, 3)) < 0.3), 2)
    low, high = rows.min(axis=0), np.array([1.0, 1.0, 2.0])
    x = np.array([[0, 0, 0], [0.5, 0, 0], [0, 0, 1.9], [1, 1, 1.0]])
    forest = quality_rules.Forest.grow(rows, low, high, trees=20, sample=32)
    rng = np.random.default_rng(7)
    rng.permutation(len(rows))
    own = [rng.choice(len(rows), 32, replace=False) for _ in range(20)]
    total = np.sum([plain_paths(rows[i].tolist(), low.tolist(), high.tolist(), 32, rng, x.tolist()) for i in own], axis=0)
    assert forest.score(x) == pytest.approx(2.0 ** (-total / 20 / forest.norm))
    # what no row of the sample shows is isolated by the ranges
    assert forest.score(x)[2] > forest.score(x)[1] > forest.score(x)[0]


def test_forest_and_threshold_come_from_all_rows(spark):
    """30,000 rows: more than 100 trees of 256 rows, and more than 20,000 labelled ones."""
    r = np.random.default_rng(9)
    n = 30_000
    x = np.round(r.random((n, len(quality_rules.STATISTICS))) * (r.random((n, len(quality_rules.STATISTICS))) < 0.02), 2)
    good = (x.sum(axis=1) < 0.4) | (r.random(n) < 0.01)
    stats = spark.createDataFrame([(i, i, 100, 500, 0, 0, 0, v) for i, v in enumerate(x.tolist())], "id long, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, x array<double>").repartition(7)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    forest, limit = quality_rules.fit(stats, labels, trees=10, depth=5)
    plan = quality_rules.Forest.plan(x.min(axis=0), x.max(axis=0), 10, 5)
    for root, p in zip(forest.roots, plan.roots, strict=True):
        todo = [(root, p, np.arange(n), 0)]
        while todo:
            k, p, at, level = todo.pop()
            if len(at) <= 1 or plan.feature[p] < 0:
                assert forest.feature[k] < 0 and forest.depth[k] == pytest.approx(level + forest._average_path(len(at)))
                continue
            f, c = plan.feature[p], plan.cut[p]
            todo += [(forest.left[k], plan.left[p], at[x[at, f] <= c], level + 1), (forest.right[k], plan.right[p], at[x[at, f] > c], level + 1)]
    assert forest.norm == forest._average_path(n)
    score = forest.score(x)
    best, want = -1.0, 2.0
    values = sorted(set(score.tolist()), reverse=True)
    for s, below in zip(values, [*values[1:], None], strict=True):
        false, true = (score[good] >= s).mean(), (score[~good] >= s).mean()
        if false <= quality_rules.MAX_FALSE_DROPS and true - false > best + 1e-12:
            best, want = true - false, (s + below) / 2
    assert limit == pytest.approx(want, abs=1e-15)
    got = quality_rules.judge(stats, forest, limit)
    assert got.where("not kept").count() == (score > limit).sum() > 0


def test_samples_are_bounded_and_never_empty(spark):
    """One id on all rows, on half of them, and equal rows."""
    from algoscape.llm.sampling import bounded_rows

    for expr, want in (("7", 100), ("if(id < 1500, 7, id)", 100), ("id", 100)):
        df = spark.range(3000).select(F.expr(expr).alias("i"), F.col("id").alias("t"))
        got = bounded_rows(df, ["i", "t"], 100, 5)
        assert got.count() == want and got.distinct().count() == want
        assert sorted(map(tuple, bounded_rows(df.repartition(3), ["i", "t"], 100, 5).collect())) == sorted(map(tuple, got.collect()))
    same = spark.range(3000).select(F.lit(7).alias("i"), F.lit(None).cast("string").alias("t"))
    assert bounded_rows(same, ["i", "t"], 100, 5).count() == 1
    docs = spark.createDataFrame([(1, " ".join(f"w{j}x{i % 300}" for j in range(80))) for i in range(600)], "doc_id long, text string")
    stats = quality_rules.statistics(docs)
    forest, _ = quality_rules.fit(stats, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), trees=5, sample=20)
    assert len(forest.roots) == 5
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), rows=50)
    assert model.bias > 0


# ---- mixing
def test_period_keeps_pfair_bounds(spark):
    for weights, rest in (({"a": 50, "b": 30, "c": 15}, 5), ({"a": 1}, 2), ({f"s{i}": i + 1 for i in range(12)}, 7)):
        parts, total = mixing.parts_of(weights, rest)
        rows = sorted(mixing.period(spark, parts, total).collect(), key=lambda r: r["__slot"])
        assert [(r["__k"], r["__o"], r["__slot"]) for r in rows] == mixing.plain_schedule(parts, total)
        done = [0] * len(parts)
        for r in rows:
            assert r["__before"] == done
            done[r["__k"]] += 1
            for i, (_, w) in enumerate(parts):
                assert abs(done[i] - (r["__slot"] + 1) * w / total) < 1
        assert done == [w for _, w in parts]


def test_mix_places_every_row(spark):
    r = random.Random(6)
    rows = [(i, r.choices(["a", "b", "c", "z", None, "(rest)", ""], [50, 5, 15, 5, 5, 1, 1])[0]) for i in range(900)] + [(None, "a"), (7, "a"), (7, "a")]
    df = spark.createDataFrame([(i, s, "t", 1) for i, s in rows], "doc_id long, source string, text string, label int")
    for taken in ("block", "__k"):
        with pytest.raises(ValueError, match="columns"):
            mixing.mix(df.withColumnRenamed("label", taken))
    with pytest.raises(ValueError, match="coarser"):
        mixing.mix(df, weights={f"s{i}": 100_003 + i for i in range(40)})
    got = mixing.mix(df, weights={"a": 50, "b": 30, "c": 15}, rest=5, block_rows=4).collect()
    assert sorted(((x.doc_id, x.source) for x in got), key=str) == sorted(rows, key=str)
    name = {"a": "a", "b": "b", "c": "c"}
    weight = {"a": 50, "b": 30, "c": 15, "rest": 5}
    blocks = {}
    for x in got:
        blocks.setdefault((name.get(x.source, "rest"), x.block), []).append(x)
        assert x.release <= x.slot < x.deadline
    count = Counter(name.get(s, "rest") for _, s in rows)
    for (s, j), own in blocks.items():
        assert len({(x.slot, x.position) for x in own}) == 1
        assert sorted(x.row for x in own) == list(range(min(4, count[s] - 4 * (j - 1))))
    order = sorted({(x.slot, x.position, name.get(x.source, "rest")) for x in got})
    assert [p for _, p, _ in order] == list(range(1, len(order) + 1))
    # less than one block off, as long as no source has run out
    had = Counter()
    for slot, _, s in order:
        had[s] += 1
        if all(had[k] < -(-count[k] // 4) for k in weight):
            assert all(abs(had[k] - (slot + 1) * w / 100) < 1 for k, w in weight.items())
    assert mixing.mix(df.limit(0)).count() == 0


def test_long_periods_take_time_in_proportion(spark):
    import time

    took = []
    for d in (4_000, 64_000):
        parts, total = mixing.parts_of({"a": d // 2 + 1, "b": d // 4}, d - d // 2 - 1 - d // 4)
        began = time.time()
        rows = mixing.period(spark, parts, total).orderBy("__slot").collect()
        took.append(time.time() - began)
        assert total == d and [(r["__k"], r["__o"], r["__slot"]) for r in rows] == mixing.plain_schedule(parts, total)
    assert took[1] < 60


def test_hot_ids_and_equal_rows_are_split(spark, monkeypatch):
    """A null id, an id and equal rows on a third of the rows each: positions and rows stay a numbering."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixing, "HOT_ROWS", 60)
    rows = [(None, "a", f"t{i}") for i in range(300)] + [(5, "a", f"t{i}") for i in range(300)] + [(6, "a", "same")] * 300
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    columns = df.columns
    spread = df.where("doc_id is null or doc_id = 5").groupBy("doc_id", mixing.bucket_of(columns, 64)).count()
    assert spread.agg(F.max("count")).first()[0] < 20
    got = mixing.mix(df, weights={"a": 1}, rest=1, block_rows=4).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=str) == sorted(((i, t) for i, _, t in rows), key=str)
    assert sorted((x.block, x.row) for x in got) == [(j + 1, r) for j in range(225) for r in range(4)]
