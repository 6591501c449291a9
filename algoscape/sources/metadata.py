"""Metadata tables: reading, missing values, row numbers, cleaning, test views over the star-schema tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.tables import Tables
from ..spec import Roles

log = logging.getLogger(__name__)


class MissingInput(FileNotFoundError):
    """A named input does not exist."""


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header (types inferred) or Parquet, by the path's ending."""
    try:
        if path.endswith(".csv") or path.endswith(".csv.gz"):
            return spark.read.option("header", True).option("inferSchema", True).csv(path)
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise MissingInput(path) from e
        raise


def typed(df: DataFrame, roles: Roles | None = None) -> DataFrame:
    """Label as text, features and performances as doubles with NaN as NULL; other columns dropped."""
    r = roles or Roles.of(df)

    def number(c: str):
        x = F.col(f"`{c}`").cast("double")
        return F.when(~F.isnan(x), x).alias(c)

    out = [F.col(f"`{r.instance}`").cast("string").alias("instances")]
    if r.source:
        out.append(F.col(f"`{r.source}`").cast("string").alias("source"))
    return df.select(*out, *(number(c) for c in [*r.features, *r.algos]))


def with_row_id(df: DataFrame, order_by: str = "instances", name: str = "row_id") -> DataFrame:
    """1-based row numbers in the order of a column, without sorting in one task: places inside range partitions plus
    the rows of the partitions before. Rows that tie in the column are ordered by their hash. The placed rows are written
    first: range partitions come from a sample that a second reading need not draw again."""
    spread = df.withColumn("__h", F.xxhash64(*df.columns)).repartitionByRange(F.col(order_by), F.col("__h")).sortWithinPartitions(order_by, "__h")
    # partition in the upper bits, place in the partition in the lower 33
    placed = Tables(df.sparkSession, "numbers").save(spread.withColumn("__m", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__m", 33)
    counts = {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    offset = F.create_map(*(F.lit(x) for p, n in before.items() for x in (p, n))) if before else None
    number = F.col("__m").bitwiseAND((1 << 33) - 1) + 1 + (F.element_at(offset, part) if offset is not None else F.lit(0))
    return placed.withColumn(name, number.cast("long")).drop("__h", "__m")


def recode_failures(df: DataFrame, algos: list[str]) -> DataFrame:
    """Infinite performance as failure (0), finite as success (1), unknown stays NULL."""
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(c), None).otherwise((F.abs(c) != float("inf")).cast("double")) for c in algos})


def drop_empty(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows with at least one feature and one performance."""
    return df.where(F.coalesce(*roles.features).isNotNull() & F.coalesce(*roles.algos).isNotNull())


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, missing: share of NULLs per column, from one aggregate."""
    one = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("missing")) for c in columns))
    return one.select(F.inline(pairs))


def drop_weak(df: DataFrame, roles: Roles, most: float = 0.20) -> tuple[DataFrame, Roles]:
    """Without features that are missing in a share of ``most`` or more; call after drop_empty."""
    weak = {r["name"] for r in missing_rates(df, roles.features).where(F.col("missing") >= most).collect()}
    kept = [c for c in roles.features if c not in weak]
    if weak:
        log.warning("dropped features with too many missing values: %s", sorted(weak))
    return df.drop(*weak), Roles(roles.instance, roles.source, kept, roles.algos)


def distinct_share(df: DataFrame, features: list[str]) -> DataFrame:
    """rows, distinct_rows and share of distinct feature rows; NULLs count as equal."""
    groups = df.groupBy(*features).agg(F.count("*").alias("__n"))
    return groups.agg(F.sum("__n").alias("rows"), F.count("*").alias("distinct_rows"), F.try_divide(F.count("*"), F.sum("__n")).alias("share"))


def clean(df: DataFrame, roles: Roles) -> tuple[DataFrame, Roles]:
    """Empty rows and weak features removed; warns when most feature rows repeat."""
    df = drop_empty(df, roles)
    df, roles = drop_weak(df, roles)
    share = distinct_share(df, roles.features).first()["share"]
    if share is not None and share < 0.5:
        log.warning("only %.2f of the instances are distinct", share)
    return df, roles


def strip_prefixes(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c[8:] if c.lower().startswith("feature_") else c[5:] for c in df.columns if c.lower().startswith(("feature_", "algo_"))})


def align_algorithms(df: DataFrame, stored: list[str]) -> DataFrame:
    """Algorithms of a model first, NULL where the table lacks one, then the table's further ones; matched by name."""
    have = [c for c in df.columns if c.startswith("algo_")]
    rest = [c for c in df.columns if c not in have]
    return df.select(*rest, *(F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in stored), *(c for c in have if c not in stored))


def to_long(df: DataFrame, columns: list[str], name: str = "algo", value: str = "perf", keep: list[str] | None = None) -> DataFrame:
    """One row per (row, column), as a projection without a shuffle."""
    pairs = F.array(*(F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns))
    return df.select(*(keep or ["instances"]), F.inline(pairs))


# ---- views over the star schema that serve as metadata tables ----

PART_FEATURES = ["size", "price", "qty_mean", "qty_std", "disc_mean", "tax_mean", "lines"]
PART_ALGOS = ["af", "ao", "nf", "no", "rf", "ro"]
USER_FEATURES = ["count", "mean", "std", "median", "most", "hour"]
USER_ALGOS = ["click", "error", "purchase", "signup", "view"]
SUPP_FEATURES = ["acctbal", "qty_mean", "disc_mean", "lines"]
SUPP_ALGOS = ["a", "n", "r"]
VEC_FEATURES = [f"e{i}" for i in range(8)]


def _mean(column: str, where: str | None = None) -> str:
    """Mean of a two-digit amount by whole cents, the same in every engine and order of rows."""
    case = f"CASE WHEN {where} THEN {column} END" if where else column
    return f"CAST(sum(CAST(round({case} * 100, 0) AS BIGINT)) AS DOUBLE) / nullif(count({case}), 0) / 100"


def _cost(flag: str, status: str | None = None) -> str:
    return _mean("l_extendedprice", f"l_returnflag = '{flag.upper()}'" + (f" AND l_linestatus = '{status.upper()}'" if status else ""))


#: name -> SQL that both engines run on the star schema.
VIEWS = {
    "part_meta": f"""
SELECT CAST(p_partkey AS VARCHAR(20)) AS instances, p_brand AS source, CAST(p_size AS DOUBLE) AS feature_size, p_retailprice AS feature_price,
  m.feature_qty_mean, m.feature_qty_std, m.feature_disc_mean, m.feature_tax_mean, CAST(coalesce(m.n, 0) AS DOUBLE) AS feature_lines,
  {", ".join(f"m.algo_{a}" for a in PART_ALGOS)}
FROM part LEFT JOIN (
  SELECT l_partkey, count(*) AS n, {_mean("l_quantity")} AS feature_qty_mean, round(stddev_samp(l_quantity), 6) AS feature_qty_std,
    {_mean("l_discount")} AS feature_disc_mean, {_mean("l_tax")} AS feature_tax_mean,
    {", ".join(f"{_cost(a[0], a[1])} AS algo_{a}" for a in PART_ALGOS)}
  FROM lineitem GROUP BY l_partkey) m ON m.l_partkey = p_partkey""",
    "user_meta": f"""
SELECT CAST(user_id AS VARCHAR(20)) AS instances, CAST(count(*) AS DOUBLE) AS feature_count, {_mean("value")} AS feature_mean,
  round(stddev_samp(value), 6) AS feature_std, median(value) AS feature_median, max(value) AS feature_most,
  CAST(sum(hour(ts)) AS DOUBLE) / count(*) AS feature_hour,
  {", ".join(_mean("value", f"event_type = '{a}'") + f" AS algo_{a}" for a in USER_ALGOS)}
FROM events GROUP BY user_id""",
    "supp_meta": f"""
SELECT CAST(s_suppkey AS VARCHAR(20)) AS instances, n_name AS source, s_acctbal AS feature_acctbal, m.feature_qty_mean, m.feature_disc_mean,
  CAST(coalesce(m.n, 0) AS DOUBLE) AS feature_lines, {", ".join(f"m.algo_{a}" for a in SUPP_ALGOS)}
FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN (
  SELECT l_suppkey, count(*) AS n, {_mean("l_quantity")} AS feature_qty_mean, {_mean("l_discount")} AS feature_disc_mean,
    {", ".join(f"{_cost(a)} AS algo_{a}" for a in SUPP_ALGOS)}
  FROM lineitem GROUP BY l_suppkey) m ON m.l_suppkey = s_suppkey""",
    "vec_meta": f"""
SELECT CAST(vec_id AS VARCHAR(20)) AS instances, CAST(label AS VARCHAR(20)) AS source, {", ".join(f"CAST(embedding[{{i{i}}}] AS DOUBLE) AS feature_e{i}" for i in range(8))}
FROM embeddings""",
}
_TABLES = {"part_meta": ["part", "lineitem"], "user_meta": ["events"], "supp_meta": ["supplier", "nation", "lineitem"], "vec_meta": ["embeddings"]}


def view_sql(name: str, duckdb: bool = False) -> str:
    """SQL of a view; array positions start at 0 in Spark and at 1 in DuckDB."""
    sql = VIEWS[name]
    if name == "vec_meta":
        sql = sql.format(**{f"i{i}": i + (1 if duckdb else 0) for i in range(8)})
    return sql


def star_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A metadata table made from the star-schema tables in sf_dir."""
    from_ = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    text = view_sql(name)
    return spark.sql(_with_frames(text, from_), **from_)


def _with_frames(text: str, frames: dict[str, DataFrame]) -> str:
    """Table names in FROM and JOIN as parameters, so that no view is registered."""
    for t in frames:
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t} ", f"{word} {{{t}}} AS {t} ").replace(f"{word} {t}\n", f"{word} {{{t}}} AS {t}\n")
        if text.endswith(f"FROM {t}"):
            text = text[: -len(t)] + f"{{{t}}} AS {t}"
    return text
