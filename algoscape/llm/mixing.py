"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are dealt into blocks of ``block_rows`` rows, numbered j = 1, 2, ... With target weight w,
block j is released at slot floor((j - 1) / w) and due at slot ceil(j / w); in every slot the released block with the
earliest deadline goes out (ties: the heavier source, then the name). So after any number of slots each source has
had within less than one block of its share, as long as no source has run out.

Weights are whole parts of their sum D, so the schedule repeats after D slots. One period is made by folding over
its D slots in chunks, in time proportional to D; the period table has D rows of one counter a source, ``MAX_COUNTERS`` in
all, and finer weights raise an error. Every block finds its slot by a broadcast join with it: block j of a source of n
parts stands at slot floor((j - 1) / n) * D + slot of block (j - 1) mod n + 1. No row ever goes through one task. Rows are
numbered inside a source by buckets of a hash of all their columns, about ``BUCKET_ROWS`` rows of the table each, with the
count of the buckets before it, so neither a source nor a (null) id with a third of all rows stands in one bucket. Only
rows equal in all columns share one; where they fill a bucket beyond ``HOT_ROWS`` the rows are written with a number, which
splits it.

All of it is DataFrame functions in the JVM; nothing runs in Python.

Nothing is dropped: where a source runs out, its slots stay empty and the others keep their order; ``position``
numbers the blocks that exist without gaps. Sources without a weight, and null sources, form one pool with the
weight ``rest``, ordered like a source of its own.

Defined cases: an empty table gives an empty result; repeated rows are rows of their own; null, empty and very long texts
only enter the hash of their row; null ids come first in their bucket; equal deadlines go to the heavier source, then by
name; documents that already have a column that is added (``ADDED``) raise an error.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, refuse

#: Target parts of the queries: one large source is held to a quarter, the others share the rest evenly.
WEIGHTS = {"src0": 190} | {f"src{i}": 30 for i in range(1, 28)}
#: Parts of the pool of all other sources.
REST = 20
BLOCK_ROWS = 8
#: Rows of the table to one hash bucket, and the least number of buckets.
BUCKET_ROWS, MIN_BUCKETS = 250_000, 64
#: Rows of one source in one bucket beyond which equal rows are split.
HOT_ROWS = 8 * BUCKET_ROWS
#: Slots of a period times sources, at most: 8 bytes each in the broadcast table.
MAX_COUNTERS = 4_000_000
ADDED = ["block", "release", "deadline", "slot", "position", "row"]
_POOL = "(rest)"


def parts_of(weights: dict[str, int], rest: int) -> tuple[list[tuple[str, int]], int]:
    """Sources with their parts in lowest terms, heaviest first, and the period."""
    if any(w <= 0 for w in weights.values()) or rest <= 0:
        raise ValueError("weights must be positive whole numbers")
    pool = _POOL
    while pool in weights:
        pool = f"({pool})"
    both = {**weights, pool: rest}
    by = gcd(*both.values())
    parts = sorted(((s, w // by) for s, w in both.items()), key=lambda x: (-x[1], x[0]))
    return parts, sum(w for _, w in parts)


def bucket_of(columns: list[str], buckets: int):
    """Hash bucket of a row, from all its columns as text; null counts as empty."""
    whole = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.pmod(F.conv(F.substring(F.md5(whole), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def period(spark: SparkSession, parts: list[tuple[str, int]], total: int) -> DataFrame:
    """One period of the schedule: __k (place of the source), __o (0-based block in the period), __slot, __before (blocks
    of each source in earlier slots).

    With d blocks of source i out, its next block is released at floor(d * D / n_i) and due at ceil((d + 1) * D / n_i).
    """
    n = F.array(*(F.lit(w).cast("long") for _, w in parts))
    size = F.lit(total).cast("long")

    def pick(done, slot):
        due = F.transform(
            n,
            lambda w, i: F.struct(
                F.when((F.get(done, i) < w) & (F.floor(F.get(done, i) * size / w) <= slot), F.ceil((F.get(done, i) + 1) * size / w)).otherwise(F.lit(2**62)).alias("due"),
                i.alias("i"),
            ),
        )
        return F.array_min(due)["i"]

    def step(state, slot):
        def with_pick(i):
            row = F.struct(i.alias("k"), F.get(state["done"], i).alias("o"), slot.alias("slot"), state["done"].alias("before"))
            return F.struct(F.transform(state["done"], lambda d, j: F.when(j == i, d + 1).otherwise(d)).alias("done"), F.concat(state["out"], F.array(row)).alias("out"))

        # the pick is bound to a variable, else it would be worked out again wherever it stands
        return F.get(F.transform(F.array(pick(state["done"], slot)), with_pick), F.lit(0))

    none = F.array_repeat(F.lit(0).cast("long"), len(parts))
    empty = F.filter(F.array(F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("o"), F.lit(0).cast("long").alias("slot"), none.alias("before"))), lambda x: F.lit(False))
    chunk = F.lit(max(1, int(total**0.5))).cast("long")

    def chunk_step(state, start):
        # lists grow inside a chunk only, and the list of chunks by one for each
        inner = F.aggregate(F.sequence(start, F.least(start + chunk, size) - 1), F.struct(state["done"].alias("done"), empty.alias("out")), step)
        bound = F.transform(F.array(inner), lambda x: F.struct(x["done"].alias("done"), F.concat(state["out"], F.array(x["out"])).alias("out")))
        return F.get(bound, F.lit(0))

    fold = F.aggregate(F.sequence(F.lit(0).cast("long"), size - 1, chunk), F.struct(none.alias("done"), F.filter(F.array(empty), lambda x: F.lit(False)).alias("out")), chunk_step)
    fold = F.struct(F.flatten(fold["out"]).alias("out"))
    rows = spark.range(1).select(F.explode(fold["out"]).alias("r"))
    return rows.select(F.col("r.k").alias("__k"), F.col("r.o").alias("__o"), F.col("r.slot").alias("__slot"), F.col("r.before").alias("__before"))


def mix(
    documents: DataFrame, *, doc_id: str = "doc_id", source: str = "source", weights: dict[str, int] | None = None, rest: int = REST, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The documents with block (1-based in the source), release, deadline, slot, position of the block in the mixed
    order, and row (0-based in the block). Order by position, row to write the mixture."""
    spark = documents.sparkSession
    weights = WEIGHTS if weights is None else weights
    parts, total = parts_of(weights, rest)
    if total * len(parts) > MAX_COUNTERS:
        raise ValueError(f"weights of {total} parts over {len(parts)} sources make a period of more than {MAX_COUNTERS} counters; take coarser ones")
    refuse(documents, *ADDED, "__k", "__bucket", "__rank", "__offset", "__at", "__j0", "__n", "__q", "__o", "__slot", "__before")
    scratch = Scratch(spark, "mixing")
    place = F.create_map(*(x for i, (s, _) in enumerate(parts) for x in (F.lit(s), F.lit(i))))
    pool = next(i for i, (s, _) in enumerate(parts) if s not in weights)
    base = documents
    named = F.coalesce(F.try_element_at(place, F.when(F.col(source).cast("string").isin(list(weights)), F.col(source).cast("string")).otherwise(F.lit(""))), F.lit(pool))
    buckets = max(MIN_BUCKETS, -(-base.count() // BUCKET_ROWS))
    rows = base.withColumns({"__k": named, "__bucket": bucket_of(base.columns, buckets)})

    # numbers inside a source: rank in the bucket plus the rows of earlier buckets
    counts = scratch.save(rows.groupBy("__k", "__bucket").count(), "counts")
    if (most := counts.agg(F.max("count")).first()[0] or 0) > HOT_ROWS:
        parted = -(-most // BUCKET_ROWS)
        number = F.pmod(F.monotonically_increasing_id(), F.lit(parted)).cast("int")
        rows = scratch.save(rows.withColumn("__bucket", F.col("__bucket") * F.lit(parted).cast("long") + number), "rows")
        counts = scratch.save(rows.groupBy("__k", "__bucket").count(), "counts-parted")
    earlier = Window.partitionBy("__k").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__k", "__bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__offset"))
    # as many rows as there are weights
    blocks = {r["__k"]: -(-r["n"] // block_rows) for r in counts.groupBy("__k").agg(F.sum("count").alias("n")).collect()}
    plan = period(spark, parts, total)

    rank = F.row_number().over(Window.partitionBy("__k", "__bucket").orderBy(F.col(doc_id), F.xxhash64(*[c for c in base.columns if c != doc_id] or [F.lit(0)])))
    numbered = rows.withColumn("__rank", rank).join(F.broadcast(offsets), ["__k", "__bucket"]).withColumn("__at", F.col("__offset") + F.col("__rank") - 1)
    n = F.element_at(F.array(*(F.lit(w).cast("long") for _, w in parts)), F.col("__k") + 1)
    j0 = F.floor(F.col("__at") / block_rows)
    numbered = numbered.withColumns({"__j0": j0, "__n": n}).withColumns({"__q": F.floor(F.col("__j0") / F.col("__n")), "__o": F.col("__j0") % F.col("__n")})
    done = numbered.join(F.broadcast(plan), ["__k", "__o"])
    # blocks of every source before this slot, as far as the source has them
    position = F.lit(1).cast("long")
    for i, (_, w) in enumerate(parts):
        position = position + F.least(F.lit(blocks.get(i, 0)).cast("long"), F.col("__q") * w + F.get("__before", F.lit(i)))
    size = F.lit(total).cast("long")
    return done.select(
        *base.columns,
        (F.col("__j0") + 1).alias("block"),
        F.floor(F.col("__j0") * size / F.col("__n")).alias("release"),
        F.ceil((F.col("__j0") + 1) * size / F.col("__n")).alias("deadline"),
        (F.col("__q") * total + F.col("__slot")).alias("slot"),
        position.alias("position"),
        (F.col("__at") % block_rows).cast("int").alias("row"),
    )


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and the block, release, deadline, slot, position and row of every document."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(d)


def plain_schedule(parts: list[tuple[str, int]], total: int) -> list[tuple[int, int, int]]:
    """(source, block, slot) of one period by stepping through the slots; for tests and the SQL check."""
    done = [0] * len(parts)
    out = []
    for slot in range(total):
        ready = [(-(-(done[i] + 1) * total // w), i) for i, (_, w) in enumerate(parts) if done[i] * total // w <= slot and done[i] < w]
        i = min(ready)[1]
        out.append((i, done[i], slot))
        done[i] += 1
    return out


def _sql() -> str:
    parts, total = parts_of(WEIGHTS, REST)
    pool = next(i for i, (s, _) in enumerate(parts) if s not in WEIGHTS)
    sources = ", ".join(f"('{s}', {i}, {w})" for i, (s, w) in enumerate(parts))
    slots = ", ".join(f"({k}, {o}, {s})" for k, o, s in plain_schedule(parts, total))
    return f"""
WITH parts(name, k, n) AS (VALUES {sources}), plan(k, o, slot) AS (VALUES {slots}),
d AS (SELECT doc_id, source, coalesce(p.k, {pool}) AS k,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(source, '')), 1, 8) AS BIGINT) % greatest({MIN_BUCKETS}, (SELECT CAST(ceil(count(*) / {BUCKET_ROWS}.0) AS BIGINT) FROM documents)) AS b
      FROM documents LEFT JOIN parts p ON p.name = source AND p.k <> {pool}),
numbered AS (SELECT doc_id, source, k, row_number() OVER (PARTITION BY k ORDER BY b, doc_id NULLS FIRST) - 1 AS a FROM d),
blocks AS (SELECT doc_id, source, k, n, a // {BLOCK_ROWS} AS j, a % {BLOCK_ROWS} AS r FROM numbered JOIN parts USING (k)),
slotted AS (SELECT doc_id, source, b.k, n, j, r, (j // n) * {total} + slot AS slot FROM blocks b JOIN plan p ON p.k = b.k AND p.o = j % n),
places AS (SELECT slot, row_number() OVER (ORDER BY slot) AS position FROM (SELECT DISTINCT slot FROM slotted))
SELECT doc_id, source, j + 1 AS block, (j * {total}) // n AS release, ((j + 1) * {total} + n - 1) // n AS deadline, slot, position, CAST(r AS INT) AS row
FROM slotted JOIN places USING (slot)
"""


OP10_SQL = _sql()
