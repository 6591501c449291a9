"""Decontamination and token counts against brute force, with the defined edge cases."""

import re

import pytest
from algoscape.llm.decontaminate import contamination, remove_contaminated, remove_spans
from algoscape.llm.token_counts import token_counts
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, n_words string, __x string"  # names near those that scans add
PASSAGE = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))


def brute(text, items, n=10):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        b = words(t)
        size = min(n, len(b))
        grams = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                if item is not None:
                    ids.add(str(item))
    return len(w), len(hit), ids


@pytest.fixture(scope="module")
def data(spark):
    long = " ".join(f"w{i % 97}" for i in range(30000)) + " " + PASSAGE
    texts = [None, "", "   ", PASSAGE, f"x {PASSAGE.upper()} y", "tiny one here", "a tiny, ONE!", "Été élan é", long, PASSAGE, "alpha beta gamma delta epsilon zeta eta theta iota"]
    rows = [(i, t, "c", "d") for i, t in enumerate(texts)] + [(3, PASSAGE, "c", "d"), (None, PASSAGE, None, None)]
    items = [(1, PASSAGE), (1, PASSAGE), (2, "Tiny one"), (None, "élan é"), (3, None), (4, ""), (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    return rows, items, spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("shard", [1 << 24, 10])
def test_contamination_matches_brute_force(data, shard, monkeypatch):
    from algoscape.llm import decontaminate

    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    rows, items, docs, bench = data
    got = sorted((r.doc_id or -1, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in contamination(docs, bench).collect())
    want = sorted((i or -1, n, h, sorted(s), h > 0) for i, t, _, _ in rows for n, h, s in [brute(t, items)])
    assert got == want


def test_removal(data, spark):
    rows, items, docs, bench = data
    kept = remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t, _, _ in rows if brute(t, items)[1] == 0}
    cut = {r.doc_id: r.text for r in remove_spans(docs, bench).collect()}
    assert cut[4] == "x  y" and cut[1] == ""
    assert all(brute(t, items[:2])[1] == 0 for t in cut.values())


def test_large_benchmark_on_the_driver(spark):
    """The driver holds a few bytes for each byte of a shard of the benchmark; shards are made by executors."""
    import resource

    from algoscape.llm import decontaminate

    texts = spark.range(0, 4000, 1, 8).select("id", F.expr("array_join(transform(sequence(1, 400), x -> concat('w', hex(hash(id, x)))), ' ')").alias("text"))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    sets = list(decontaminate._shards(texts.withColumnRenamed("id", "item_id"), "item_id", "text", 10))
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 600
    assert len(sets) > 1 and sum(len(x.by_length[10][0]) for x in sets) == 4000 * 391
    doc = texts.where("id = 77").select(F.lit(1).alias("doc_id"), "text")
    got = contamination(doc, texts.withColumnRenamed("id", "item_id")).first()
    assert (got.n_words, got.n_hit, got["items"]) == (400, 400, ["77"])


def test_empty_tables(data, spark):
    _, _, docs, bench = data
    assert contamination(docs.limit(0), bench).count() == 0
    assert contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_pretokens_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With a hash of 6 bits nearly all pre-tokens share one; counts still equal the library's."""
    P = pytest.importorskip("public_tokenizers")
    import numpy as np
    import pyarrow as pa
    from algoscape.llm import token_counts as C
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [" ".join(f"{a}{'xqz' * b}{a}" for a in "abcdefgh" for b in range(1, 14)), "aqx hqxz don't, <|endoftext|>", "word Word WORD"] * 2
    real = C.pretokens

    def weak(column, cased):
        w = real(column, cased)
        w.hash = w.hash & np.uint64(63)
        return w

    monkeypatch.setattr(C, "pretokens", weak)
    rows = [r for f in (C._distinct("text", False),) for b in f(iter([pa.record_batch([pa.array(texts)], names=["text"])])) for r in b.to_pylist()]
    assert len({r["piece"] for r in rows}) == len(rows) and len({r["h"] for r in rows}) < 65
    w = weak(pa.array(texts), False)
    order, head = C.distinct(w, False)
    for i, j in zip(head, [*head[1:], len(order)], strict=True):
        assert len(set(C.pieces(w, order[i:j], False))) == 1
    # workers load the module afresh: hand them a weak hash by way of the table
    monkeypatch.undo()
    full = C.piece_table

    def clash(*args, **names):
        from pyspark.sql import functions as F

        t = full(*args, **names)
        return t.unionByName(t.where("n > 1").withColumns({"piece": F.concat("piece", F.lit("\0").cast("binary")), "n": F.lit(99)}))

    monkeypatch.setattr(C, "piece_table", clash)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for bound in (10**6, 3):
        assert {r.doc_id: r.n_tokens for r in C.token_counts(df, path, max_broadcast=bound).collect()} == want


def test_broadcast_entries_are_bounded(spark):
    from algoscape.llm import token_counts as C

    for f, most in (([1] * 5 + [7] * 3 + [9], 4), ([70_000] * 10, 4), ([1 << 40] * 3 + [70_000] * 9, 5), ([2, 3], 9)):
        df = spark.createDataFrame([(x,) for x in f], "f long")
        least = C._least_frequency(df, most)
        assert sum(x >= least for x in f) <= most
    assert C._least_frequency(spark.createDataFrame([(2,), (3,)], "f long"), 1) == 3


def test_token_counts_equal_the_library(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = [None, "", " \n", "Hello,  WORLD's don't", "x<|endoftext|>y <|startoftext|>", "é́ a b c 　", "İstanbul ΣΑΣ 12345 ½", "z" * 5000, "tok " * 4000, "á̀ ́b", "😀👍🏽 ok", "a.b,c!d don'T !'s x's=\u0338 …!x —a (b) <|ENDOFTEXT|> <|endoftext|>.a A.<|endoftext|> x_y-z [q] 1.5 a\u00a0B, é,è.", "\u00a0 , \u0301"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "null id", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    tok = Tokenizer.from_file(path)
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    for bound in (10**6, 3, 0):
        got = sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in token_counts(df, path, max_broadcast=bound).collect())
        assert got == want
    assert token_counts(df.limit(0), path).count() == 0
