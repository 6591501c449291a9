"""Sinks: labelled CSV tables, colour scales for web views, plot-ready tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with a header each."""
    df.write.mode("overwrite").option("header", True).csv(path)


def vertices(footprints: DataFrame, kind: str, algo: str) -> DataFrame:
    """Row, piece and corner of a footprint's polygons; empty for an empty footprint."""
    some = footprints.where((F.col("kind") == kind) & (F.col("algo") == algo))
    pieces = some.select(F.posexplode("pieces").alias("piece", "corners")).select("piece", F.posexplode("corners").alias("corner", "xy"))
    return pieces.select(F.concat(F.lit("bnd_pnt_"), F.col("piece") + 1, F.lit("_"), F.col("corner") + 1).alias("row"), F.get("xy", F.lit(0)).alias("z_1"), F.get("xy", F.lit(1)).alias("z_2"))


def colour_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column on 0 to 255 between its own least and greatest value; a constant column gives 0."""
    got = df.agg(*(x for c in columns for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}")))).first()
    return df.withColumns({c: _scaled(c, got[f"a_{c}"], got[f"b_{c}"], 255) for c in columns})


def colour_scale_global(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns on 0 to 255 between their common least and greatest value."""
    low, high = _span(df, columns)
    return df.withColumns({c: _scaled(c, low, high, 255) for c in columns})


def _span(df: DataFrame, columns: list[str]) -> tuple[float | None, float | None]:
    both = lambda f, g: f(*(g(c) for c in columns)) if len(columns) > 1 else g(columns[0])
    return tuple(df.agg(both(F.least, F.min), both(F.greatest, F.max)).first())


def _scaled(c: str, low: float | None, high: float | None, top: int | None):
    if low is None:
        return F.lit(None).cast("int" if top else "double")
    width = float(high - low)
    # multiplied before it is divided, so that whole halves stay halves
    share = F.lit(float(top or 1)) * (F.col(c) - F.lit(float(low))) / F.lit(width) if width else F.when(F.col(c).isNotNull(), F.lit(0.0))
    return F.round(share).cast("int") if top else share


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column on 0 to 1."""
    got = df.agg(*(x for c in columns for x in (F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}")))).first()
    return df.withColumns({c: _scaled(c, got[f"a_{c}"], got[f"b_{c}"], None) for c in columns})


def log_global(df: DataFrame, columns: list[str]) -> DataFrame:
    """log10(value + 1), on 0 to 1 over all columns."""
    logs = df.withColumns({c: F.log10(F.when(F.col(c) > -1, F.col(c) + 1)) for c in columns})
    low, high = _span(logs, columns)
    return logs.withColumns({c: _scaled(c, low, high, None) for c in columns})


def log_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """log10(value + 1), each column on 0 to 1."""
    return min_max(df.withColumns({c: F.log10(F.when(F.col(c) > -1, F.col(c) + 1)) for c in columns}), columns)


def axis_extent(df: DataFrame) -> DataFrame:
    """Whole-number axis limits with a margin of one."""
    return df.agg(*(x for z in ("z_1", "z_2") for x in ((F.floor(F.min(z)) - 1).cast("long").alias(f"{z}_low"), (F.ceil(F.max(z)) + 1).cast("long").alias(f"{z}_high"))))


def colour_table(spark: SparkSession, n: int = 256) -> DataFrame:
    """R, G, B of an own palette: straight lines from dark blue over green to yellow."""
    i = F.col("id") / F.lit(float(n - 1))
    down, up = F.greatest(F.lit(0.0), 1 - 2 * i), F.greatest(F.lit(0.0), 2 * i - 1)
    mid = 1 - down - up
    mix = lambda a, b, c: F.round(a * down + b * mid + c * up).cast("int")
    return spark.range(n).select(mix(50, 30, 250).alias("R"), mix(30, 160, 250).alias("G"), mix(160, 140, 20).alias("B"))


def legend(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Classes present in a column of places with their names; 0 is None."""
    name = F.when(F.col("place") == 0, F.lit("None")).otherwise(F.element_at(F.array(*map(F.lit, names)), F.when(F.col("place") > 0, F.col("place"))))
    return df.groupBy(F.coalesce(F.col(column), F.lit(0)).alias("place")).agg(F.count("*").alias("n")).withColumn("name", name)


def plot_points(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table for scatter plots: instances, z_1, z_2, name, value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns))
    return df.select("instances", "z_1", "z_2", F.inline(pairs))


def good_share(df: DataFrame, n_algos: int) -> DataFrame:
    """instances, z_1, z_2, share of good algorithms."""
    return df.select("instances", "z_1", "z_2", (F.col("num_good") / n_algos).alias("share"))


def export_run(run, path: str) -> list[str]:
    """All CSV tables of a trained or scored run; returns their names."""
    d, features, algos = run.rows, run.features, run.algos
    short = lambda cols: [F.col(c).alias(c.split("_", 1)[1] if c.startswith(("algo_", "feature_")) else c) for c in cols]
    # File and column names are fixed by the export format.
    tables = {
        "coordinates": d.select("instances", "z_1", "z_2"),
        "feature_raw": run.raw.select("instances", *short(features)),
        "feature_process": d.select("instances", *short(features)),
        "algorithm_raw": run.raw.select("instances", *short(algos)),
        "algorithm_process": d.select("instances", *short(algos)),
        "algorithm_bin": d.select("instances", *(F.col(f"good_{a[5:]}").cast("int").alias(a[5:]) for a in algos)),
        "good_algos": d.select("instances", F.col("num_good").alias("NumGoodAlgos")),
        "beta_easy": d.select("instances", F.col("beta_easy").cast("int").alias("IsBetaEasy")),
        "portfolio": d.select("instances", F.col("best_algo").alias("Best_Algorithm")),
        "projection_matrix": run.projection,
    }
    if "selection0" in d.columns:
        tables["algorithm_svm"] = d.select("instances", *(F.col(f"hat_good_{a[5:]}").cast("int").alias(a[5:]) for a in algos))
        tables["portfolio_svm"] = d.select("instances", F.col("selection0").alias("Best_Algorithm"))
        tables["svm_table"] = run.prediction
    if run.edge is not None:
        tables |= {"bounds": run.edge, "bounds_prunned": run.pruned}
    if run.footprints is not None:
        from ..operators.footprint import summary

        s = summary(run.footprints)
        tables["footprint_performance"] = s.select("algo", *(F.col(f"{m}_{k}").alias(f"{m.title()}_{k.title()}") for k in ("good", "best") for m in ("area_normalized", "density_normalized", "purity")))
        for r in run.footprints.where("area > 0 and kind in ('good', 'best')").select("kind", "algo").collect():
            tables[f"footprint_{r['algo']}_{r['kind']}"] = vertices(run.footprints, r["kind"], r["algo"])
    if run.options.outputs.web:
        one = lambda df, cols: colour_scale(df, cols).select("instances", *short(cols))
        whole = lambda df, cols: colour_scale_global(df, cols).select("instances", *short(cols))
        tables |= {"color_table": colour_table(d.sparkSession), "feature_raw_color": one(run.raw, features), "feature_process_color": one(d, features), "algorithm_raw_single_color": one(run.raw, algos), "algorithm_process_single_color": one(d, algos), "algorithm_raw_color": whole(run.raw, algos), "algorithm_process_color": whole(d, algos), "good_algos_color": whole(d.withColumn("good_algos", F.col("num_good").cast("double")), ["good_algos"])}
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}.csv")
    return sorted(tables)


def purification(df: DataFrame, verdict: DataFrame, path: str, stem: str, row: str = "row_id") -> None:
    """Four tables of a similarity filter: kept, removed, dissimilar and violating rows."""
    both = df.join(verdict, row)
    for name, where in (("Pur", "not removed"), ("Prec", "removed"), ("Dissimilar", "dissimilar"), ("ViSA", "violates")):
        write_csv(both.where(where).select(*df.columns), f"{path}/{name}_{stem}.csv")
