"""Named queries over the star-schema tables, each with SQL that DuckDB runs on the same tables where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import Tables
from ..operators import bounds, footprint, labels, predict, prep, project, selection, subset
from ..sources import export
from ..sources import metadata as M
from ..sources.model import Model
from ..spec import FeatureSearch, Options, Performance, Prediction, Roles
from ..streaming.scoring import score_stream, write_scores
from . import build

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

PF, PA = [f"feature_{c}" for c in M.PART_FEATURES], [f"algo_{a}" for a in M.PART_ALGOS]
UF, UA = [f"feature_{c}" for c in M.USER_FEATURES], [f"algo_{a}" for a in M.USER_ALGOS]
SF, SA = [f"feature_{c}" for c in M.SUPP_FEATURES], [f"algo_{a}" for a in M.SUPP_ALGOS]
VF = [f"feature_{c}" for c in M.VEC_FEATURES]
UG = [f"good_{a}" for a in M.USER_ALGOS]
UH = [f"hat_{a}" for a in M.USER_ALGOS]
EPS, BETA = 0.2, 0.55
#: A fixed projection of the standardised user features.
FIXED_A = [[0.4, -0.3, 0.2, 0.1, -0.5, 0.6], [-0.2, 0.5, 0.3, -0.4, 0.1, 0.2]]
FIXED_B = [[0.5, -0.2], [-0.4, 0.6], [0.3, 0.3], [0.2, -0.5], [-0.6, 0.1], [0.7, 0.2], [0.1, 0.4], [-0.3, 0.2], [0.2, 0.2], [0.5, 0.5], [-0.1, -0.6]]
POLYGONS = {"low": [(-2.0, -2.0), (0.0, -2.0), (0.5, 0.0), (-1.0, 0.5)], "wide": [(-1.0, -1.0), (2.0, -0.5), (1.5, 1.5), (-0.5, 1.0)], "far": [(40.0, 40.0), (41.0, 40.0), (40.0, 41.0)]}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def view(spark: SparkSession, d: str, name: str) -> DataFrame:
    return M.typed(M.star_view(spark, d, name))


def on(name: str, body: str) -> str:
    """SQL over a metadata view called m; body is a SELECT, or further CTEs that start with a comma."""
    return f"WITH m AS ({M.view_sql(name, duckdb=True)}) {body}"


def rnd(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    names = cols or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in names})


def ints(df: DataFrame) -> DataFrame:
    """Flags as 0 and 1."""
    return df.withColumns({c: F.col(c).cast("int") for c, t in df.dtypes if t == "boolean"})


def r(x: str, places: int = 6) -> str:
    return f"round({x}, {places}) + 0.0"


def both(sep: str, items) -> str:
    return sep.join(items)


# ---- metadata
@query("meta_wide", on("part_meta", "SELECT * FROM m"))
def _(s, d):
    return view(s, d, "part_meta")


@query("meta_long", on("part_meta", both(" UNION ALL ", [f"SELECT instances, '{a}' AS algo, {a} AS perf FROM m" for a in PA])))
def _(s, d):
    return M.to_long(view(s, d, "part_meta"), PA)


@query("role_select", "SELECT * FROM (VALUES " + ", ".join([f"('{c}', 'feature')" for c in PF] + [f"('{c}', 'algo')" for c in PA] + ["('instances', 'instance')", "('source', 'source')"]) + ") t(name, role)")
def _(s, d):
    found = Roles.of(M.star_view(s, d, "part_meta"))
    rows = [(c, "feature") for c in found.features] + [(c, "algo") for c in found.algos] + [(found.instance, "instance"), (found.source, "source")]
    return s.createDataFrame(rows, "name string, role string")


@query("pick_columns", on("part_meta", "SELECT instances, source, feature_size, feature_lines, algo_af, algo_ro FROM m"))
def _(s, d):
    df = M.star_view(s, d, "part_meta")
    return M.typed(df, Roles.of(df).pick(["feature_lines", "feature_size", "feature_none"], ["algo_ro", "algo_af"]))


@query("strip_prefixes", on("supp_meta", "SELECT instances, source, " + ", ".join(f"feature_{c} AS {c}" for c in M.SUPP_FEATURES) + ", " + ", ".join(f"algo_{a} AS {a}" for a in M.SUPP_ALGOS) + " FROM m"))
def _(s, d):
    return M.strip_prefixes(view(s, d, "supp_meta"))


_FULL = f"coalesce({', '.join(PF)}) IS NOT NULL AND coalesce({', '.join(PA)}) IS NOT NULL"


@query("drop_empty", on("part_meta", f"SELECT * FROM m WHERE {_FULL}"))
def _(s, d):
    df = view(s, d, "part_meta")
    return M.drop_empty(df, Roles.of(df))


@query("missing_rate", on("part_meta", both(" UNION ALL ", [f"SELECT '{c}' AS name, {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing FROM m" for c in [*PF, *PA]])))
def _(s, d):
    return rnd(M.missing_rates(view(s, d, "part_meta"), [*PF, *PA]))


_WEAK = [*PF, *(f"CASE WHEN {a} > 50000 THEN NULL ELSE {a} END" for a in PA)]


@query("drop_weak", on("part_meta", both(" UNION ALL ", [f"SELECT '{c}' AS name FROM m HAVING avg(CASE WHEN {e} IS NULL THEN 1.0 ELSE 0.0 END) < 0.2" for c, e in zip([*PF, *PA], _WEAK, strict=True)])))
def _(s, d):
    df = view(s, d, "part_meta").withColumns({a: F.when(F.col(a) <= 50000, F.col(a)) for a in PA})
    _, kept = M.drop_weak(df, Roles("instances", "source", [*PF, *PA], []))
    return s.createDataFrame([(c,) for c in kept.features], "name string")


@query("dup_ratio", on("part_meta", f"SELECT count(*) AS rows, count(DISTINCT ({', '.join(PF[:1])})) + max(CASE WHEN feature_size IS NULL THEN 1 ELSE 0 END) AS distinct_rows, {r('(count(DISTINCT feature_size) + max(CASE WHEN feature_size IS NULL THEN 1 ELSE 0 END)) / count(*)')} AS share FROM m"))
def _(s, d):
    return rnd(M.distinct_share(view(s, d, "part_meta"), PF[:1]))


@query("row_numbers", on("part_meta", "SELECT instances, row_number() OVER (ORDER BY instances) AS row_id FROM m"))
def _(s, d):
    return M.with_row_id(view(s, d, "part_meta")).select("instances", "row_id")


@query("recode_failures", on("part_meta", "SELECT instances, " + ", ".join(f"CASE WHEN {a} IS NULL THEN NULL WHEN {a} > 60000 THEN 0.0 ELSE 1.0 END AS {a}" for a in PA) + " FROM m"))
def _(s, d):
    df = view(s, d, "part_meta").withColumns({a: F.when(F.col(a) > 60000, F.lit(float("inf"))).otherwise(F.col(a)) for a in PA})
    return M.recode_failures(df, PA).select("instances", *PA)


@query("align_algorithms", on("supp_meta", "SELECT instances, source, " + ", ".join(SF) + ", algo_a, CAST(NULL AS DOUBLE) AS algo_x, algo_n, algo_r FROM m"))
def _(s, d):
    return M.align_algorithms(view(s, d, "supp_meta"), ["algo_a", "algo_x"])


# ---- labels
def _zero(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN {labels.MACHINE_EPSILON!r} ELSE {x} END"


def _best(algos: list[str], maximise: bool) -> str:
    return f"{'greatest' if maximise else 'least'}({', '.join(algos)})"


def _place(algos: list[str], maximise: bool) -> str:
    b = _best(algos, maximise)
    return "CASE " + " ".join(f"WHEN {a} = {b} THEN {i}" for i, a in enumerate(algos, 1)) + " END"


def _gap(a: str, algos: list[str], maximise: bool) -> str:
    y, b = _zero(a), _zero(_best(algos, maximise))
    return f"1 - ({y}) / ({b})" if maximise else f"({y}) / ({b}) - 1"


def _good(a: str, algos: list[str], maximise: bool, absolute: bool, eps: float) -> str:
    fits = f"{a} {'>=' if maximise else '<='} {eps}" if absolute else f"{_gap(a, algos, maximise)} <= {eps}"
    return f"coalesce({fits}, false)"


for _max in (False, True):
    _word = "max" if _max else "min"

    @query(f"best_perf_{_word}", on("part_meta", f"SELECT instances, {_best(PA, _max)} AS best_perf, {_place(PA, _max)} AS best_algo FROM m"))
    def _(s, d, _max=_max):
        return view(s, d, "part_meta").select("instances", labels.best_value(PA, _max).alias("best_perf"), labels.best_index(PA, _max).alias("best_algo"))

    @query(f"rel_gap_{_word}", on("part_meta", "SELECT instances, " + ", ".join(f"{r(_gap(a, PA, _max))} AS {a}" for a in PA) + " FROM m"))
    def _(s, d, _max=_max):
        df = view(s, d, "part_meta")
        return rnd(df.select("instances", *(labels.relative_gap(a, PA, _max).alias(a) for a in PA)))

    for _abs, _eps in ((True, 45000.0), (False, EPS)):

        @query(f"good_{'abs' if _abs else 'rel'}_{_word}", on("part_meta", "SELECT instances, " + ", ".join(f"CAST({_good(a, PA, _max, _abs, _eps)} AS INT) AS good_{a[5:]}" for a in PA) + " FROM m"))
        def _(s, d, _max=_max, _abs=_abs, _eps=_eps):
            df = view(s, d, "part_meta")
            return ints(df.select("instances", *(labels.good(a, PA, maximise=_max, absolute=_abs, epsilon=_eps).alias(f"good_{a[5:]}") for a in PA)))


_ROUNDED = ", ".join(f"round({a}, -4) AS {a}" for a in PA)


@query("ties", on("part_meta", f", t AS (SELECT instances, {_ROUNDED} FROM m) SELECT instances, {' + '.join(f'CASE WHEN {a} = {_best(PA, False)} THEN 1 ELSE 0 END' for a in PA)} AS n_best, {_place(PA, False)} AS best_algo FROM t"))
def _(s, d):
    df = view(s, d, "part_meta").withColumns({a: F.round(a, -4) for a in PA})
    return df.select("instances", F.greatest(labels.ties(PA, False), F.lit(0)).alias("n_best"), labels.best_index(PA, False).alias("best_algo"))


_TIED = f"list_filter(range(1, {len(PA) + 1}), lambda i: list_extract([{', '.join(PA)}], i) = {_best(PA, False)})"


@query("tie_break", on("part_meta", f", t AS (SELECT instances, {_ROUNDED} FROM m), p AS (SELECT instances, {_TIED} AS places, CAST('0x' || substr(md5('3:' || instances), 1, 8) AS BIGINT) AS draw FROM t) SELECT instances, CAST(CASE WHEN len(places) > 0 THEN places[1 + draw % len(places)] END AS INT) AS best_algo FROM p"))
def _(s, d):
    df = view(s, d, "part_meta").withColumns({a: F.round(a, -4) for a in PA})
    return df.select("instances", labels.tie_break(PA, False, seed=3).alias("best_algo"))


def _labelled(algos: list[str], eps: float = EPS) -> str:
    goods = [f"{_good(a, algos, False, False, eps)} AS good_{a[5:]}" for a in algos]
    return f"SELECT m.*, {_best(algos, False)} AS best_perf, {_place(algos, False)} AS best_algo, {', '.join(goods)} FROM m"


_NUM = " + ".join(f"CAST(good_{a} AS INT)" for a in M.PART_ALGOS)


def _part_labels(s, d):
    return labels.label(view(s, d, "part_meta"), PA, absolute=False, epsilon=EPS, beta_threshold=BETA)


@query("num_good", on("part_meta", f", l AS ({_labelled(PA)}) SELECT instances, {_NUM} AS num_good FROM l"))
def _(s, d):
    return _part_labels(s, d).select("instances", "num_good")


@query("beta_easy", on("part_meta", f", l AS ({_labelled(PA)}) SELECT instances, CAST({_NUM} > {BETA} * 6 AS INT) AS beta_easy FROM l"))
def _(s, d):
    return ints(_part_labels(s, d).select("instances", "beta_easy"))


@query("portfolio_counts", on("part_meta", f", l AS ({_labelled(PA)}) SELECT coalesce(best_algo, 0) AS best_algo, count(*) AS n FROM l GROUP BY 1"))
def _(s, d):
    return labels.portfolio(_part_labels(s, d))


@query("never_good", on("part_meta", both(" UNION ALL ", [f"SELECT '{a}' AS algo FROM m HAVING bool_or({_good(a, PA, False, True, 7000.0)})" for a in PA])))
def _(s, d):
    df = labels.label(view(s, d, "part_meta"), PA, absolute=True, epsilon=7000.0)
    return s.createDataFrame([(a,) for a in labels.drop_never_good(df, PA)], "algo string")


@query("unique_good", on("part_meta", f", l AS (SELECT *, {_NUM} AS k FROM ({_labelled(PA)})) " + both(" UNION ALL ", [f"SELECT '{a}' AS algo, {r(f'avg(CASE WHEN good_{a} AND k <= 1 THEN 1.0 ELSE 0.0 END)')} AS share FROM l" for a in M.PART_ALGOS])))
def _(s, d):
    return rnd(labels.unique_good(_part_labels(s, d), PA))


_FAR = [f"abs({a} - mu)" for a in UA]


@query("cost_weights", on("user_meta", f", l AS (SELECT avg(v) AS mu FROM ({both(' UNION ALL ', [f'SELECT {a} AS v FROM m' for a in UA])})), f AS (SELECT instances, {', '.join(f'{e} AS w_{a[5:]}' for a, e in zip(UA, _FAR, strict=True))} FROM m, l), x AS (SELECT min(CASE WHEN v > 0 THEN v END) AS lo, max(v) AS hi FROM ({both(' UNION ALL ', [f'SELECT w_{a} AS v FROM f' for a in M.USER_ALGOS])})) SELECT instances, {', '.join(r(f'CASE WHEN w_{a} IS NULL THEN hi WHEN w_{a} = 0 THEN lo ELSE w_{a} END') + f' AS w_{a}' for a in M.USER_ALGOS)} FROM f, x"))
def _(s, d):
    return rnd(labels.cost_weights(view(s, d, "user_meta"), UA).select("instances", *(f"w_{a}" for a in M.USER_ALGOS)))


# ---- preparation
def _hazen(c: str, p: float) -> str:
    """Quantile with sorted value i of n at (i - 0.5) / n."""
    at = f"least(greatest(n * {p} + 0.5, 1), n)"
    return f"(SELECT max(CASE WHEN i = floor({at}) THEN v END) * (1 - (max({at}) - floor(max({at})))) + coalesce(max(CASE WHEN i = floor({at}) + 1 THEN v END), 0) * (max({at}) - floor(max({at}))) FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n FROM m WHERE {c} IS NOT NULL))"


_BOUNDS = ", b AS (" + both(" UNION ALL ", [f"SELECT '{c}' AS name, {_hazen(c, 0.5)} AS med, {_hazen(c, 0.75)} - {_hazen(c, 0.25)} AS iqr" for c in PF]) + ")"


@query("median_iqr_bounds", on("part_meta", f"{_BOUNDS} SELECT name, {r('med')} AS med, {r('iqr')} AS iqr, {r('med - 5 * iqr')} AS lo, {r('med + 5 * iqr')} AS hi FROM b"))
def _(s, d):
    got = prep.bounds(view(s, d, "part_meta"), PF)
    return rnd(s.createDataFrame([(c, *map(float, v)) for c, v in got.items()], "name string, med double, iqr double, lo double, hi double"))


_REACH = 0.5


@query("clamp_outliers", on("part_meta", f"{_BOUNDS} SELECT instances, " + ", ".join(r(f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, (SELECT med - {_REACH} * iqr FROM b WHERE name = '{c}')), (SELECT med + {_REACH} * iqr FROM b WHERE name = '{c}')) END") + f" AS {c}" for c in PF) + " FROM m"))
def _(s, d):
    df = view(s, d, "part_meta")
    b = prep.bounds(df, PF, _REACH)
    return rnd(df.select("instances", *(prep.clamp(c, b[c][2], b[c][3]).alias(c) for c in PF)))


@query("min_shift", on("part_meta", "SELECT instances, " + ", ".join(f"{c} - min({c}) OVER () + 1 AS {c}" for c in PF) + ", " + ", ".join(f"{a} - least({', '.join(f'min({x}) OVER ()' for x in PA)}) AS {a}" for a in PA) + " FROM m"))
def _(s, d):
    df = view(s, d, "part_meta")
    low = df.agg(*(F.min(c).alias(c) for c in PF), prep.global_least(df, PA).alias("y")).first()
    return df.select("instances", *((F.col(c) - low[c] + 1).alias(c) for c in PF), *((F.col(a) - low["y"]).alias(a) for a in PA))


_SHIFTED = [f"{c} - min({c}) OVER () + 1" for c in PF]


@query("boxcox_fixed_lambda", on("part_meta", f", x AS (SELECT instances, {', '.join(f'{e} AS {c}' for c, e in zip(PF, _SHIFTED, strict=True))} FROM m) SELECT instances, {', '.join(f'{r(f"(pow({c}, 0.5) - 1) / 0.5")} AS half_{c[8:]}, {r(f"ln({c})")} AS log_{c[8:]}' for c in PF)} FROM x"))
def _(s, d):
    df = view(s, d, "part_meta")
    low = df.agg(*(F.min(c).alias(c) for c in PF)).first()
    moved = {c: F.col(c) - low[c] + 1 for c in PF}
    return rnd(df.select("instances", *(x for c in PF for x in (prep.box_cox(moved[c], 0.5).alias(f"half_{c[8:]}"), prep.box_cox(moved[c], 0).alias(f"log_{c[8:]}")))))


_GRID = [-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]


def _llf(c: str, lam: float) -> str:
    t = f"ln({c})" if lam == 0 else f"(pow({c}, {lam}) - 1) / {lam}"
    return f"-count({c}) / 2.0 * ln(var_pop({t})) + ({lam} - 1) * sum(ln({c}))"


@query("boxcox_llf_grid", on("part_meta", f", x AS (SELECT {', '.join(f'{e} AS {c}' for c, e in zip(PF, _SHIFTED, strict=True))} FROM m) " + both(" UNION ALL ", [f"SELECT '{c}' AS name, CAST({lam} AS DOUBLE) AS lambda, {r(_llf(c, lam), 3)} AS llf FROM x" for c in PF for lam in _GRID])))
def _(s, d):
    df = view(s, d, "part_meta")
    low = df.agg(*(F.min(c).alias(c) for c in PF)).first()
    got = prep.log_likelihoods(df, {c: F.col(c) - low[c] + 1 for c in PF}, dict.fromkeys(PF, _GRID))
    return rnd(s.createDataFrame([(c, lam, v) for c in PF for lam, v in zip(_GRID, got[c], strict=True)], "name string, lambda double, llf double"), "llf", places=3)


@query("boxcox_fit")
def _(s, d):
    df = view(s, d, "part_meta")
    low = df.agg(*(F.min(c).alias(c) for c in PF)).first()
    got = prep.fit_lambdas(df, {c: F.col(c) - low[c] + 1 for c in PF})
    return s.createDataFrame(list(got.items()), "name string, lambda double")


@query("zscore", on("part_meta", "SELECT instances, " + ", ".join(f"{r(f'({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()')} AS {c}" for c in [*PF, *PA]) + " FROM m"))
def _(s, d):
    df = view(s, d, "part_meta")
    mom = prep.moments(df, {c: F.col(c) for c in [*PF, *PA]})
    return rnd(df.select("instances", *(prep.standardise(F.col(c), *mom[c]).alias(c) for c in [*PF, *PA])))


@query("prepare_fit")
def _(s, d):
    return prep.as_table(s, prep.fit(view(s, d, "part_meta"), PF, PA))


@query("prepare_apply")
def _(s, d):
    df = view(s, d, "part_meta")
    return prep.apply(df, prep.fit(df, PF, PA))


#: Given parameters of preparation: bounds, shift, exponent, mean and deviation of each column, as a stored model holds them.
_GIVEN = {c: (0.5 * i + 0.1, 40.0 + 3 * i, 0.25 * i - 0.5, (0.5, 0.0, 1.5, -0.5)[i % 4], 0.1 * i - 1.0, 1.0 + 0.5 * i) for i, c in enumerate([*PF, *PA])}


def _given_sql(c: str) -> str:
    low, high, shift, lam, mu, sigma = _GIVEN[c]
    x = f"greatest({low!r}, least({high!r}, {c}))" if c in PF else c
    moved = f"greatest({x} + {shift!r}, {2.0**-52!r})"
    power = f"ln({moved})" if lam == 0 else f"(pow({moved}, {lam!r}) - 1) / {lam!r}"
    return f"CASE WHEN {c} IS NOT NULL THEN {r(f'(({power}) - ({mu!r})) / {sigma!r}', 2)} END AS {c}"


@query("prepare_given", on("part_meta", "SELECT instances, " + ", ".join(_given_sql(c) for c in [*PF, *PA]) + " FROM m"))
def _(s, d):
    names = ["lo", "hi", "shift", "lambda", "mu", "sigma"]
    rows = [{"name": c, "role": "feature" if c in PF else "algo"} | dict(zip(names, v, strict=True)) for c, v in _GIVEN.items()]
    return rnd(prep.apply(view(s, d, "part_meta"), rows).select("instances", *PF, *PA), places=2)


# ---- correlation and selection
def _corr(pairs: list[tuple[str, str]], name: str) -> str:
    return both(" UNION ALL ", [f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS rho FROM m" for a, b in pairs])


@query("corr_tstat", on("part_meta", f", c AS ({_corr([(a, b) for a in PF for b in PA], 'part')}) SELECT \"left\", \"right\", n, {r('rho')} AS rho, {r('rho * sqrt((n - 2) / (1 - rho * rho))', 4)} AS t FROM c"))
def _(s, d):
    out = rnd(selection.correlations(view(s, d, "part_meta"), PF, PA), "rho")
    return rnd(out, "t", places=4)


@query("corr_matrix", on("user_meta", f", c AS ({_corr([(a, b) for i, a in enumerate(UF) for b in UF[i + 1:]], 'user')}) SELECT \"left\", \"right\", {r('rho')} AS rho FROM c"))
def _(s, d):
    m = selection.correlation_matrix(view(s, d, "user_meta"), UF)
    return rnd(s.createDataFrame([(a, b, float(m[i, j])) for i, a in enumerate(UF) for j, b in enumerate(UF) if i < j], "left string, right string, rho double"))


@query("corr_p_values")
def _(s, d):
    return selection.with_p_values(s, selection.correlations(view(s, d, "part_meta"), PF, PA))


_PLACE = "row_number() OVER (PARTITION BY \"right\" ORDER BY abs(rho) DESC, list_position([" + ", ".join(f"'{c}'" for c in PF) + "], \"left\"))"


@query("corr_select_topk", on("part_meta", f", c AS ({_corr([(a, b) for a in PF for b in PA], 'part')}) SELECT \"left\", \"right\", {_PLACE} AS place FROM c"))
def _(s, d):
    return selection.ranked(selection.correlations(view(s, d, "part_meta"), PF, PA), PF).select("left", "right", "place")


@query("corr_select_rule")
def _(s, d):
    table = selection.with_p_values(s, selection.correlations(view(s, d, "part_meta"), PF, PA))
    return s.createDataFrame([(c,) for c in selection.correlation_rule(table, PF, 0.05)], "feature string")


@query("corr_select_growing", on("part_meta", f", c AS ({_corr([(a, b) for a in PF for b in PA], 'part')}), p AS (SELECT \"left\", min(place) AS place FROM (SELECT \"left\", {_PLACE} AS place FROM c) GROUP BY 1), depth AS (SELECT min(place) AS k FROM p x WHERE (SELECT count(*) FROM p y WHERE y.place <= x.place) >= 3) SELECT \"left\" AS feature FROM p, depth WHERE place <= k"))
def _(s, d):
    return s.createDataFrame([(c,) for c in selection.top_rule(selection.correlations(view(s, d, "part_meta"), PF, PA), PF)], "feature string")


@query("feature_clusters")
def _(s, d):
    own = selection.cluster_features(selection.correlation_matrix(view(s, d, "part_meta"), PF), 3)
    return s.createDataFrame([(c, int(k)) for c, k in zip(PF, own, strict=True)], "feature string, cluster int")


@query("silhouette_scan")
def _(s, d):
    scan = selection.silhouette_scan(selection.correlation_matrix(view(s, d, "part_meta"), PF))
    return s.createDataFrame([(k, float(v)) for k, v in scan], "k int, silhouette double")


#: A given clustering of the part features.
_OWN = [0, 0, 1, 1, 2, 2, 2]
_FAR = both(" UNION ALL ", [f"SELECT {i} AS i, {j} AS j, {_OWN[i]} AS a, {_OWN[j]} AS b, 1 - corr({PF[i]}, {PF[j]}) AS d FROM m" for i in range(len(PF)) for j in range(len(PF)) if i != j])
_WIDTHS = "SELECT i, min(CASE WHEN a = b THEN x END) AS p, min(CASE WHEN a <> b THEN x END) AS q FROM (SELECT i, a, b, avg(d) AS x FROM f GROUP BY 1, 2, 3) GROUP BY 1"


@query("silhouette_given", on("part_meta", f", f AS ({_FAR}) SELECT {r('avg((q - p) / greatest(p, q))')} AS silhouette FROM ({_WIDTHS})"))
def _(s, d):
    m = selection.correlation_matrix(view(s, d, "part_meta"), PF)
    return rnd(s.createDataFrame([(selection.silhouette(m, np.array(_OWN)),)], "silhouette double"))


def _user_labels(s, d):
    return labels.label(view(s, d, "user_meta"), UA, absolute=False, epsilon=EPS, beta_threshold=BETA)


def _prepared_users(s, d):
    df = _user_labels(s, d)
    return Tables(s, "users").save(prep.apply(df, prep.fit(df, UF, UA)), "prepared")


@query("feature_search")
def _(s, d):
    chosen = selection.select_features(_prepared_users(s, d), UF, UA, UG, rho=0.0, clusters=3, replicates=10)
    return s.createDataFrame([(c,) for c in chosen], "feature string")


@query("feature_search_genetic")
def _(s, d):
    search = selection.Search(_prepared_users(s, d), UF, UA, UG)
    chosen = search.genetic([[0, 1], [2, 3], [4, 5]])
    return s.createDataFrame([(UF[i], float(search.known[chosen])) for i in chosen], "feature string, cost double")


# ---- pairs
def _d2(a: str, b: str, cols: list[str]) -> str:
    return "sqrt(" + " + ".join(f"pow({a}.{c} - {b}.{c}, 2)" for c in cols) + ")"


@query("pair_distance_topk", on("vec_meta", f", p AS (SELECT a.instances, b.instances AS other, {_d2('a', 'b', VF)} AS distance FROM m a JOIN m b ON a.instances <> b.instances), k AS (SELECT *, row_number() OVER (PARTITION BY instances ORDER BY distance, other) AS rank FROM p) SELECT instances, other, {r('distance')} AS distance, rank FROM k WHERE rank <= 3"))
def _(s, d):
    return rnd(subset.top_neighbours(view(s, d, "vec_meta"), VF, 3))


_NN = f", nn AS (SELECT a.instances, min({_d2('a', 'b', VF)}) AS nearest FROM m a JOIN m b ON a.instances <> b.instances GROUP BY 1)"


@query("nn_distances", on("vec_meta", f"{_NN} SELECT instances, {r('nearest')} AS nearest FROM nn"))
def _(s, d):
    return rnd(subset.nearest_distances(view(s, d, "vec_meta"), VF))


@query("nn_uniformity", on("vec_meta", f"{_NN} SELECT count(nearest) AS n, {r('avg(nearest)')} AS mean_nn, {r('stddev_samp(nearest)')} AS std_nn, {r('stddev_samp(nearest) / avg(nearest)')} AS cv, {r('1 - stddev_samp(nearest) / avg(nearest)')} AS uniformity FROM nn"))
def _(s, d):
    return rnd(subset.uniformity(subset.nearest_distances(view(s, d, "vec_meta"), VF)))


#: Standard scores of user features and performances.
_UZ = "SELECT instances, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in [*UF, *UA]) + f", {', '.join(f'{_good(a, UA, False, False, EPS)} AS good_{a[5:]}' for a in UA)}, {_best(UA, False)} AS best_perf, {_place(UA, False)} AS best_algo, row_number() OVER (ORDER BY instances) AS row_id FROM m"


def _user_scores(s, d, *more: str):
    df = M.with_row_id(_user_labels(s, d))
    mom = prep.moments(df, {c: F.col(c) for c in [*UF, *UA]})
    return Tables(s, "scores").save(df.withColumns({c: prep.standardise(F.col(c), *mom[c]) for c in [*UF, *UA]}), "z")


_RADIUS = 1.2
_GAMMA = (len(UA) / len(UF)) ** 0.5 * _RADIUS
_ALL_GOOD = " AND ".join(f"a.{g} AND b.{g}" for g in UG)
_EDGES = f", z AS ({_UZ}), e AS (SELECT a.row_id AS i, b.row_id AS j, {_d2('a', 'b', UF)} AS dx, {_d2('a', 'b', UA)} AS dy, {_ALL_GOOD} AS agree FROM z a JOIN z b ON a.row_id < b.row_id)"


def _greedy(radius: float, cond: str) -> str:
    """Rows in order; each is kept unless a kept row before it removes it."""
    return f""", near AS (SELECT *, coalesce({cond}, false) AS rem FROM e WHERE dx <= {radius}),
rm AS (SELECT j, list(i) AS l FROM near WHERE rem GROUP BY j),
g AS (WITH RECURSIVE w(step, kept) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL SELECT w.step + 1, CASE WHEN rm.l IS NOT NULL AND list_has_any(w.kept, rm.l) THEN w.kept ELSE list_append(w.kept, w.step + 1) END
  FROM w LEFT JOIN rm ON rm.j = w.step + 1 WHERE w.step < (SELECT count(*) FROM z)) SELECT kept FROM w ORDER BY step DESC LIMIT 1),
k AS (SELECT unnest(kept) AS i FROM g),
ke AS (SELECT near.* FROM near JOIN k USING (i)),
bys AS (SELECT j, min(i) AS b FROM ke WHERE rem GROUP BY j),
met AS (SELECT ke.j, ke.i, ke.rem FROM ke LEFT JOIN bys USING (j) WHERE b IS NULL OR i <= b),
fin AS (SELECT j, arg_max(CASE WHEN rem THEN 0 ELSE 1 END, i) AS v FROM met GROUP BY j)
SELECT z.row_id, CAST(k.i IS NULL AS INT) AS removed, CAST(fin.j IS NULL AS INT) AS dissimilar, CAST(coalesce(fin.v, 0) AS INT) AS violates
FROM z LEFT JOIN k ON k.i = z.row_id LEFT JOIN fin ON fin.j = z.row_id"""


for _kind, _cond in (("Ftr", "true"), ("Ftr&AP", f"dy <= {_GAMMA!r}"), ("Ftr&Good", "agree"), ("Ftr&AP&Good", f"dy <= {_GAMMA!r} AND agree")):
    _key = _kind.lower().replace("&", "_")

    @query(f"filter_edges_{_key}", on("user_meta", f"{_EDGES} SELECT i, j, {r('dx')} AS dx, {r('dy')} AS dy, CAST(agree AS INT) AS agree, CASE WHEN {_cond} THEN 'remove' ELSE 'violation' END AS action FROM e WHERE dx <= {_RADIUS}"))
    def _(s, d, _kind=_kind):
        return rnd(ints(subset.filter_edges(_user_scores(s, d), UF, UA, UG, _RADIUS, _kind)))

    @query(f"filter_greedy_{_key}", on("user_meta", _EDGES + _greedy(_RADIUS, _cond)))
    def _(s, d, _kind=_kind):
        return ints(subset.greedy_filter(_user_scores(s, d), UF, UA, UG, _RADIUS, _kind))


def _purified(radius: float) -> str:
    return f"(SELECT *, CAST({radius} AS DOUBLE) AS radius FROM (" + on("user_meta", _EDGES + _greedy(radius, f"dy <= {(len(UA) / len(UF)) ** 0.5 * radius!r}")) + "))"


@query("purify", f"SELECT * FROM {_purified(0.8)} UNION ALL SELECT * FROM {_purified(1.2)}")
def _(s, d):
    return ints(subset.purify(_user_scores(s, d), UF, UA, UG, [0.8, 1.2], "Ftr&AP"))


@query("holdout", on("part_meta", "SELECT instances FROM (SELECT instances, row_number() OVER (ORDER BY md5('1:' || instances), instances) AS k, count(*) OVER () AS n FROM m) WHERE k <= round(n * 0.25)"))
def _(s, d):
    return subset.holdout(view(s, d, "part_meta"), 0.25).select("instances")


@query("index_subset", on("user_meta", ", n AS (SELECT *, row_number() OVER (ORDER BY instances) AS row_id FROM m) SELECT instances, row_id FROM n WHERE row_id % 3 = 1"))
def _(s, d):
    users = view(s, d, "user_meta")
    index = s.range(0, users.count(), 3).select((F.col("id") + 1).alias("idx"))
    return subset.by_index(M.with_row_id(users), index).select("instances", "row_id")


# ---- projection
_AT = [" + ".join(f"({w}) * {c}" for c, w in zip(UF, row, strict=True)) for row in FIXED_A]
_PLACED = f", z AS ({_UZ}), p AS (SELECT *, {_AT[0]} AS z_1, {_AT[1]} AS z_2 FROM z)"


def _placed(s, d):
    return project.project(_user_scores(s, d), UF, FIXED_A)


@query("gramian", on("user_meta", f", z AS ({_UZ}) " + both(" UNION ALL ", [f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {r(f'sum({a} * {b})', 4)} AS total FROM z" for a in UF for b in [*UF, *UA]])))
def _(s, d):
    g = project.Gramian.of(_user_scores(s, d), UF, UA)
    return rnd(s.createDataFrame([(a, b, float(g.xt[i, j])) for i, a in enumerate(UF) for j, b in enumerate(g.targets)], "left string, right string, total double"), places=4)


@query("project_fixed", on("user_meta", f"{_PLACED} SELECT instances, {r('z_1')} AS z_1, {r('z_2')} AS z_2 FROM p"))
def _(s, d):
    return rnd(_placed(s, d).select("instances", "z_1", "z_2"))


_HAT = [f"({b[0]}) * z_1 + ({b[1]}) * z_2" for b in FIXED_B]


@query("projection_quality", on("user_meta", f"{_PLACED} " + both(" UNION ALL ", [f"SELECT '{t}' AS target, count({t}) AS n, {r(f'sum(pow({t} - ({h}), 2))', 4)} AS error, {r(f'pow(corr({t}, {h}), 2)')} AS r2 FROM p" for t, h in zip([*UF, *UA], _HAT, strict=True)])))
def _(s, d):
    return rnd(rnd(project.fit_quality(_placed(s, d), UF, [*UF, *UA], FIXED_B), "r2"), "error", places=4)


@query("dist_corr", on("user_meta", f"{_PLACED}, q AS (SELECT {_d2('a', 'b', UF)} AS dx, {_d2('a', 'b', ['z_1', 'z_2'])} AS dz FROM p a JOIN p b ON a.instances < b.instances) SELECT count(*) AS n_pairs, {r('corr(dx, dz)')} AS corr FROM q"))
def _(s, d):
    return rnd(project.distance_correlation(_placed(s, d), UF))


@query("project_fit")
def _(s, d):
    _, placed = project.fit(_user_scores(s, d), UF, UA, tries=3)
    return placed.select("instances", "z_1", "z_2")


@query("project_analytic")
def _(s, d):
    _, placed = project.fit(_user_scores(s, d), UF, UA, analytic_solution=True)
    return placed.select("instances", "z_1", "z_2")


# ---- boundary
def _corner(i: int, c: str) -> str:
    return f"CASE WHEN (vertex >> {i}) & 1 = 1 THEN b{i} ELSE a{i} END"


_SPAN = f", z AS ({_UZ}), x AS (SELECT {', '.join(f'min({c}) AS a{i}, max({c}) AS b{i}' for i, c in enumerate(UF))} FROM z), v AS (SELECT vertex, {', '.join(f'{_corner(i, c)} AS {c}' for i, c in enumerate(UF))} FROM range({2 ** len(UF)}) t(vertex), x)"
_THRESHOLD = 0.3
_KEEP = " AND ".join(f"NOT coalesce((SELECT corr({a}, {b}) FROM z) > {_THRESHOLD} AND sign({a}) <> sign({b}), false) AND NOT coalesce((SELECT corr({a}, {b}) FROM z) < -{_THRESHOLD} AND sign({a}) = sign({b}), false)" for i, a in enumerate(UF) for b in UF[i + 1 :])


def _corners(s, d):
    df = _user_scores(s, d)
    return df, bounds.vertices(s, UF, bounds.extremes(df, UF))


@query("vertices", on("user_meta", f"{_SPAN} SELECT vertex, {', '.join(f'{r(c)} AS {c}' for c in UF)} FROM v"))
def _(s, d):
    return rnd(_corners(s, d)[1])


@query("vertices_pruned", on("user_meta", f"{_SPAN} SELECT vertex FROM v WHERE {_KEEP}"))
def _(s, d):
    df, corners = _corners(s, d)
    return bounds.prune(corners, UF, selection.correlation_matrix(df, UF), _THRESHOLD).select("vertex")


@query("hull", on("user_meta", f"{_PLACED}, q AS (SELECT DISTINCT z_1 AS x, z_2 AS y FROM p WHERE z_1 IS NOT NULL AND z_2 IS NOT NULL) SELECT {r('a.x')} AS z_1, {r('a.y')} AS z_2 FROM q a JOIN q b ON (a.x, a.y) <> (b.x, b.y) WHERE NOT EXISTS (SELECT 1 FROM q c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-12)"))
def _(s, d):
    h = bounds.hull(_placed(s, d))
    return rnd(h.where("seq > 1").select("z_1", "z_2"))


@query("boundary")
def _(s, d):
    edge, pruned = bounds.boundary(_user_scores(s, d), UF, FIXED_A)
    return edge.withColumn("kind", F.lit("edge")).unionByName(pruned.withColumn("kind", F.lit("pruned")))


# ---- prediction
_FOLDS = 5
_FOLDED = f"{_PLACED}, f AS (SELECT *, (row_number() OVER (PARTITION BY good_click ORDER BY instances) - 1) % {_FOLDS} AS fold FROM p)"


@query("stratified_folds", on("user_meta", f"{_FOLDED} SELECT instances, CAST(fold AS INT) AS fold FROM f"))
def _(s, d):
    return predict.stratified_folds(_placed(s, d), "good_click", _FOLDS).select("instances", "fold")


@query("knn3_predict", on("user_meta", f"{_FOLDED}, n AS (SELECT a.instances, {', '.join(f'b.{g}' for g in UG)}, row_number() OVER (PARTITION BY a.instances ORDER BY {_d2('a', 'b', ['z_1', 'z_2'])}, b.instances) AS k FROM f a JOIN f b ON a.fold <> b.fold) SELECT instances, {', '.join(f'{r(f"avg(CAST({g} AS DOUBLE))")} AS share_{g}, CAST(avg(CAST({g} AS DOUBLE)) > 0.5 AS INT) AS hat_{g}' for g in UG)} FROM n WHERE k <= 3 GROUP BY 1"))
def _(s, d):
    df = Tables(s, "knn").save(predict.stratified_folds(_placed(s, d), "good_click", _FOLDS), "folds")
    return rnd(ints(predict.knn_predict(df, df, ["z_1", "z_2"], UG, 3, other_fold="fold")))


#: Given predictions: an algorithm is expected to be good where it is under its own mean.
_HATTED = f", z AS ({_UZ}), h AS (SELECT z.*, {', '.join(f'coalesce(z.{a} < -0.3, false) AS hat_{a[5:]}, m.{a} AS raw_{a[5:]}' for a in UA)} FROM z JOIN m USING (instances))"


def _hatted(s, d):
    z = _user_scores(s, d)
    raw = _user_labels(s, d).select("instances", *(F.col(a).alias(f"raw_{a[5:]}") for a in UA))
    return z.withColumns({h: F.coalesce(F.col(a) < -0.3, F.lit(False)) for h, a in zip(UH, UA, strict=True)}).join(raw, "instances")


def _cells(g: str, h: str) -> str:
    return ", ".join(f"count(*) FILTER ({g} = {a} AND {h} = {b}) AS {c}" for c, a, b in (("tn", "false", "false"), ("fn", "true", "false"), ("fp", "false", "true"), ("tp", "true", "true")))


_CONFUSION = "(" + both(" UNION ALL ", [f"SELECT '{g}' AS name, {_cells(g, h)} FROM h" for g, h in zip(UG, UH, strict=True)]) + ")"


@query("confusion", on("user_meta", f"{_HATTED} SELECT * FROM {_CONFUSION}"))
def _(s, d):
    return predict.confusion(_hatted(s, d), list(zip(UG, UH, strict=True))).select("name", "tn", "fn", "fp", "tp")


@query("precision_recall", on("user_meta", f"{_HATTED} SELECT name, {r('tp / nullif(tp + fp, 0)')} AS precision, {r('tp / nullif(tp + fn, 0)')} AS recall, {r('(tp + tn) / nullif(tn + fn + fp + tp, 0)')} AS accuracy FROM {_CONFUSION}"))
def _(s, d):
    return rnd(predict.confusion(_hatted(s, d), list(zip(UG, UH, strict=True))).select("name", "precision", "recall", "accuracy"))


_PREC = ", pr AS (SELECT " + ", ".join(f"count(*) FILTER ({g} AND {h}) / nullif(count(*) FILTER ({h}), 0) AS p{i}, avg(CAST({g} AS DOUBLE)) AS s{i}" for i, (g, h) in enumerate(zip(UG, UH, strict=True))) + " FROM h)"
_W = "[" + ", ".join(f"CAST({h} AS INT) * coalesce(p{i}, 0)" for i, h in enumerate(UH)) + "]"
_SH = "[" + ", ".join(f"s{i}" for i in range(len(UH))) + "]"
_SELECTED = f"{_HATTED}{_PREC}, sel AS (SELECT *, CASE WHEN selection0 = 0 THEN list_position({_SH}, list_max({_SH})) ELSE selection0 END AS selection1 FROM (SELECT *, CASE WHEN list_max({_W}) > 0 THEN list_position({_W}, list_max({_W})) ELSE 0 END AS selection0 FROM h, pr))"


def _selected(s, d):
    h = Tables(s, "hats").save(_hatted(s, d), "h")
    prec = [x["precision"] for x in predict.confusion(h, list(zip(UG, UH, strict=True))).collect()]
    return predict.select(h, UH, prec, predict.default_algorithm(h, UG))


@query("selector", on("user_meta", f"{_SELECTED} SELECT instances, CAST(selection0 AS INT) AS selection0, CAST(selection1 AS INT) AS selection1 FROM sel"))
def _(s, d):
    return _selected(s, d).select("instances", "selection0", "selection1")


def _at(sel: str, cols: list[str]) -> str:
    return f"list_extract([{', '.join(cols)}], CAST(nullif({sel}, 0) AS BIGINT))"


_RAWS = [f"raw_{a}" for a in M.USER_ALGOS]
_ANY = " OR ".join(UG)


def _summary_sql() -> str:
    def pct(a: str, b: str) -> str:
        return f"round(100 * ({a}) / nullif({b}, 0), 1) + 0.0"

    rows = []
    for a, g, h in zip(M.USER_ALGOS, UG, UH, strict=True):
        n = f"count(*) FILTER ({g} AND {h})"
        rows.append(f"SELECT '{a}' AS algorithm, {r(f'avg(raw_{a})', 3)} AS avg_all, {r(f'stddev_samp(raw_{a})', 3)} AS std_all, {r(f'avg(CAST({g} AS DOUBLE))', 3)} AS probability_of_good, {r(f'avg(raw_{a}) FILTER ({h})', 3)} AS avg_selected, {r(f'stddev_samp(raw_{a}) FILTER ({h})', 3)} AS std_selected, {pct(f'count(*) FILTER ({g} = {h})', 'count(*)')} AS accuracy, {pct(n, f'count(*) FILTER ({h})')} AS precision, {pct(n, f'count(*) FILTER ({g})')} AS recall FROM sel")
    null = "CAST(NULL AS DOUBLE)"
    rows.append(f"SELECT 'Oracle', {r('avg(best_perf)', 3)}, {r('stddev_samp(best_perf)', 3)}, 1.0, {null}, {null}, {null}, {null}, {null} FROM sel")
    ok0, ok1 = f"coalesce({_at('selection0', UG)}, false)", f"coalesce({_at('selection1', UG)}, false)"
    tg, fg, fb = f"count(*) FILTER (selection0 > 0 AND {ok0})", f"count(*) FILTER (selection0 > 0 AND NOT {ok0})", f"count(*) FILTER (({_ANY}) AND NOT {ok0})"
    v0, v1 = _at("selection0", _RAWS), _at("selection1", _RAWS)
    rows.append(f"SELECT 'Selector', {r(f'avg({v1})', 3)}, {r(f'stddev_samp({v1})', 3)}, {r(f'avg(CAST({ok1} AS DOUBLE))', 3)}, {r(f'avg({v0})', 3)}, {r(f'stddev_samp({v0})', 3)}, {null}, {pct(tg, f'{tg} + {fg}')}, {pct(tg, f'{tg} + {fb}')} FROM sel")
    return both(" UNION ALL ", rows)


@query("selector_summary", on("user_meta", f"{_SELECTED} {_summary_sql()}"))
def _(s, d):
    sel = _selected(s, d)
    given = sel.drop(*UA).withColumnsRenamed(dict(zip(_RAWS, UA, strict=True)))
    return rnd(predict.summary(given, UA, UG, UH).drop("parameter_1", "parameter_2"), places=3)


@query("knn_train")
def _(s, d):
    return predict.train(_placed(s, d), UG, knn=True, folds=3)[1]


@query("svm_train")
def _(s, d):
    return predict.train(_placed(s, d), UG, knn=False)[1]


@query("svm_polynomial")
def _(s, d):
    return predict.train(_placed(s, d), UG, knn=False, folds=3, polynomial=True, parameters=[[1.0, 0.5]] * len(UG))[1]


# ---- footprints
_EPSILON_K = 4
_COMP = f"""{_PLACED}, n AS (SELECT count(*) AS n, max(z_1) - min(z_1) AS dx, max(z_2) - min(z_2) AS dy FROM p),
rad AS (SELECT sqrt(dx * dy * {_EPSILON_K} / (n * pi())) AS e FROM n),
e AS (SELECT a.instances AS u, b.instances AS v FROM p a JOIN p b ON {_d2('a', 'b', ['z_1', 'z_2'])} <= (SELECT e FROM rad)),
core AS (SELECT u FROM e GROUP BY u HAVING count(*) >= {_EPSILON_K + 1}),
reach AS (WITH RECURSIVE w(u, v) AS (SELECT u, v FROM e UNION SELECT w.u, e.v FROM w JOIN e ON w.v = e.u) SELECT u, v FROM w),
first AS (SELECT reach.u, min(core.u) AS f FROM reach JOIN core ON core.u = reach.v GROUP BY 1)
SELECT p.instances, coalesce(d.k, -1) AS class FROM p LEFT JOIN (SELECT u, CAST(dense_rank() OVER (ORDER BY f) AS INT) AS k FROM first) d ON d.u = p.instances"""


@query("eps_components", on("user_meta", _COMP))
def _(s, d):
    p = Tables(s, "placed").save(_placed(s, d).select("instances", "z_1", "z_2"), "p")
    x = p.agg(F.count("*").alias("n"), (F.max("z_1") - F.min("z_1")).alias("dx"), (F.max("z_2") - F.min("z_2")).alias("dy")).first()
    return footprint.components(p, footprint.neighbour_radius(x["n"], (x["dx"], x["dy"]), _EPSILON_K), _EPSILON_K)


_CORNERS = "(VALUES " + ", ".join(f"('{n}', {i}, {x}::DOUBLE, {y}::DOUBLE)" for n, c in POLYGONS.items() for i, (x, y) in enumerate(c)) + ") t(polygon, seq, x, y)"


@query("polygon_area", f"SELECT polygon, {r('sum(x * ny - nx * y) / 2')} AS area FROM (SELECT *, coalesce(lead(x) OVER w, first(x) OVER (PARTITION BY polygon ORDER BY seq)) AS nx, coalesce(lead(y) OVER w, first(y) OVER (PARTITION BY polygon ORDER BY seq)) AS ny FROM {_CORNERS} WINDOW w AS (PARTITION BY polygon ORDER BY seq)) GROUP BY 1")
def _(s, d):
    rows = [(n, i, x, y) for n, c in POLYGONS.items() for i, (x, y) in enumerate(c)]
    return rnd(footprint.polygon_areas(s.createDataFrame(rows, "polygon string, seq int, x double, y double")))


def _inside(corners) -> str:
    return " AND ".join(f"({bx} - ({ax})) * (z_2 - ({ay})) - ({by} - ({ay})) * (z_1 - ({ax})) >= 0" for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True))


_HITS = ", hit AS (" + both(" UNION ALL ", [f"SELECT instances, '{n}' AS polygon, good_click FROM p WHERE {_inside(c)}" for n, c in POLYGONS.items()]) + ")"


@query("points_in_polygon", on("user_meta", f"{_PLACED}{_HITS} SELECT instances, polygon FROM hit"))
def _(s, d):
    return footprint.points_in_polygons(_placed(s, d), POLYGONS)


_AREAS = {n: sum(c[i][0] * c[(i + 1) % len(c)][1] - c[(i + 1) % len(c)][0] * c[i][1] for i in range(len(c))) / 2 for n, c in POLYGONS.items()}


@query("footprint_metrics", on("user_meta", f"{_PLACED}{_HITS} " + both(" UNION ALL ", [f"SELECT '{n}' AS algo, {r(str(_AREAS[n]))} AS area, count(*) AS elements, count(*) FILTER (good_click) AS good_elements, {r(f'count(*) / {_AREAS[n]}')} AS density, {r('coalesce(count(*) FILTER (good_click) / nullif(count(*), 0), 0)')} AS purity FROM hit WHERE polygon = '{n}'" for n in POLYGONS])))
def _(s, d):
    from ..functions.geometry import Region

    regions = {("good", n): Region([np.array(c)]) for n, c in POLYGONS.items()}
    out = footprint.count_inside(_placed(s, d), regions, dict.fromkeys(regions, F.col("good_click")))
    return rnd(out.select("algo", "area", "elements", "good_elements", "density", "purity"))


def _footprints(s, d, level: float = 0.55):
    return footprint.footprints(_placed(s, d), UA, UG, "best_algo", "beta_easy", level)


@query("footprints")
def _(s, d):
    return _footprints(s, d).drop("pieces")


@query("footprint_summary")
def _(s, d):
    return footprint.summary(_footprints(s, d))


@query("footprint_vertices")
def _(s, d):
    return export.vertices(_footprints(s, d), "good", UA[0])


@query("footprint_assess")
def _(s, d):
    return footprint.assess(_placed(s, d), _footprints(s, d), UA, UG, "best_algo", "beta_easy").drop("pieces")


#: Given footprints of three algorithms; the far one holds no row and counts nothing.
_STORED = dict(zip(UA, POLYGONS, strict=False))


@query("footprint_assess_given", on("user_meta", f"{_PLACED} " + both(" UNION ALL ", [f"SELECT '{a}' AS algo, {r(str(_AREAS[n]))} AS area, CASE WHEN g > 0 THEN c ELSE 0 END AS elements, g AS good_elements, {r(f'CASE WHEN g > 0 THEN c / {_AREAS[n]} ELSE 0 END')} AS density, {r('CASE WHEN g > 0 THEN g / c ELSE 0 END')} AS purity FROM (SELECT count(*) AS c, count(*) FILTER (good_{a[5:]}) AS g FROM p WHERE {_inside(POLYGONS[n])})" for a, n in _STORED.items()])))
def _(s, d):
    rows = [("good", a, [[list(p) for p in POLYGONS[n]]], float(_AREAS[n]), 0, 0, 0.0, 0.0) for a, n in _STORED.items()]
    out = footprint.assess(_placed(s, d), s.createDataFrame(rows, footprint.SCHEMA), UA, UG, "best_algo", "beta_easy")
    return rnd(out.select("algo", "area", "elements", "good_elements", "density", "purity"))


@query("purity_sweep")
def _(s, d):
    return footprint.purity_sweep(_placed(s, d), UA, UG, "best_algo", "beta_easy")


# ---- exports and plot data
def _scale(c: str, low: str, high: str) -> str:
    return f"CAST(round(255 * ({c} - {low}) / ({high} - {low})) AS INT) AS {c}"


@query("color_scale_col", on("part_meta", "SELECT instances, " + ", ".join(_scale(c, f"min({c}) OVER ()", f"max({c}) OVER ()") for c in PF) + " FROM m"))
def _(s, d):
    return export.colour_scale(view(s, d, "part_meta"), PF).select("instances", *PF)


_LOW, _HIGH = f"least({', '.join(f'min({a}) OVER ()' for a in PA)})", f"greatest({', '.join(f'max({a}) OVER ()' for a in PA)})"


@query("color_scale_global", on("part_meta", "SELECT instances, " + ", ".join(_scale(a, _LOW, _HIGH) for a in PA) + " FROM m"))
def _(s, d):
    return export.colour_scale_global(view(s, d, "part_meta"), PA).select("instances", *PA)


@query(
    "color_table",
    "SELECT CAST(round(50 * d + 30 * g + 250 * u) AS INT) AS R, CAST(round(30 * d + 160 * g + 250 * u) AS INT) AS G, CAST(round(160 * d + 140 * g + 20 * u) AS INT) AS B "
    "FROM (SELECT d, u, 1 - d - u AS g FROM (SELECT greatest(0.0::DOUBLE, 1 - 2 * (i / 255::DOUBLE)) AS d, greatest(0.0::DOUBLE, 2 * (i / 255::DOUBLE) - 1) AS u FROM range(256) t(i)))",
)
def _(s, d):
    return export.colour_table(s)


@query("axis_extent", on("user_meta", f"{_PLACED} SELECT " + ", ".join(f"CAST(floor(min({z})) - 1 AS BIGINT) AS {z}_low, CAST(ceil(max({z})) + 1 AS BIGINT) AS {z}_high" for z in ("z_1", "z_2")) + " FROM p"))
def _(s, d):
    return export.axis_extent(_placed(s, d))


@query("plot_minmax", on("part_meta", "SELECT instances, " + ", ".join(f"{r(f'({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())')} AS {c}" for c in PF) + " FROM m"))
def _(s, d):
    return rnd(export.min_max(view(s, d, "part_meta"), PF).select("instances", *PF))


_LOGS = ", ".join(f"log10({a} + 1) AS {a}" for a in PA)


@query("plot_loglobal", on("part_meta", f", t AS (SELECT instances, {_LOGS} FROM m) SELECT instances, " + ", ".join(f"{r(f'({a} - {_LOW}) / ({_HIGH} - {_LOW})')} AS {a}" for a in PA) + " FROM t"))
def _(s, d):
    return rnd(export.log_global(view(s, d, "part_meta"), PA).select("instances", *PA))


@query("plot_log_columns", on("part_meta", f", t AS (SELECT instances, {_LOGS} FROM m) SELECT instances, " + ", ".join(f"{r(f'({a} - min({a}) OVER ()) / (max({a}) OVER () - min({a}) OVER ())')} AS {a}" for a in PA) + " FROM t"))
def _(s, d):
    return rnd(export.log_columns(view(s, d, "part_meta"), PA).select("instances", *PA))


@query("plot_good_share", on("user_meta", f"{_PLACED} SELECT instances, {r('z_1')} AS z_1, {r('z_2')} AS z_2, {r('(' + ' + '.join(f'CAST({g} AS INT)' for g in UG) + f') / {len(UG)}.0')} AS share FROM p"))
def _(s, d):
    return rnd(export.good_share(_placed(s, d), len(UG)))


@query("plot_points", on("user_meta", f"{_PLACED} " + both(" UNION ALL ", [f"SELECT instances, {r('z_1')} AS z_1, {r('z_2')} AS z_2, '{g}' AS name, CAST({g} AS DOUBLE) AS value FROM p" for g in UG])))
def _(s, d):
    return rnd(export.plot_points(_placed(s, d), UG))


@query("portfolio_legend", on("user_meta", f"{_PLACED} SELECT CAST(coalesce(best_algo, 0) AS INT) AS place, count(*) AS n, CASE coalesce(best_algo, 0) WHEN 0 THEN 'None' {' '.join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(M.USER_ALGOS, 1))} END AS name FROM p GROUP BY 1, 3"))
def _(s, d):
    return export.legend(_placed(s, d), "best_algo", M.USER_ALGOS)


# ---- whole runs
def _options() -> Options:
    return Options(performance=Performance(False, False, EPS, BETA), search=FeatureSearch(clusters=3, replicates=5), prediction=Prediction(folds=3))


@query("train_run")
def _(s, d):
    return build.train(view(s, d, "user_meta"), _options()).prediction


@query("explore_run")
def _(s, d):
    run = build.train(view(s, d, "user_meta"), _options())
    base = Tables(s, "model").base
    run.model.save(s, base)
    return build.explore(view(s, d, "user_meta"), Model.load(s, base)).rows.select("instances", "z_1", "z_2", "selection0", "selection1")


@query("stream_scores")
def _(s, d):
    t = Tables(s, "stream")
    # events are grouped once
    users = t.save(view(s, d, "user_meta"), "in")
    run = build.train(users, Options(performance=Performance(False, False, EPS, BETA), search=FeatureSearch(enabled=False), prediction=Prediction(folds=3)), with_footprints=False)
    scored = score_stream(s, f"{t.base}/in", users.schema, run.model)
    write_scores(scored.select("instances", "z_1", "z_2", "selection1"), f"{t.base}/out", f"{t.base}/checkpoint").awaitTermination()
    return s.read.parquet(f"{t.base}/out")
