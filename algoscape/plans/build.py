"""Training and scoring runs: labels, preparation, selection, projection, boundary, prediction, footprints."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import Tables
from ..operators import bounds, footprint, labels, predict, prep, project, selection, subset
from ..sources import metadata
from ..sources.export import export_run
from ..sources.model import Model
from ..spec import Options, Roles

log = logging.getLogger(__name__)


@dataclass
class Run:
    """Rows with all results, and the small tables of a run."""

    options: Options
    raw: DataFrame
    rows: DataFrame
    features: list[str]
    algos: list[str]
    projection: DataFrame
    edge: DataFrame | None = None
    pruned: DataFrame | None = None
    prediction: DataFrame | None = None
    footprints: DataFrame | None = None
    model: Model | None = None

    def export(self, path: str) -> list[str]:
        return export_run(self, path)


def _flags(algos: list[str]) -> list[str]:
    return [f"good_{a[5:]}" for a in algos]


def _subset(df: DataFrame, roles: Roles, options: Options, features: list[str]) -> DataFrame:
    s = options.selection
    if s.holdout is not None:
        return subset.holdout(df, s.holdout, options.seed)
    if s.index_file is not None:
        return subset.by_index(df, metadata.read_table(df.sparkSession, s.index_file))
    if s.min_distance is not None:
        verdict = subset.greedy_filter(df, features, roles.algos, _flags(roles.algos), s.min_distance, s.distance_type)
        return df.join(verdict.where("not removed").select("row_id"), "row_id", "left_semi")
    return df


def train(table: DataFrame, options: Options | None = None, *, with_footprints: bool = True, with_prediction: bool = True) -> Run:
    """A whole training run over a metadata table (see Roles for its columns)."""
    o = options or Options()
    spark = table.sparkSession
    tables = Tables(spark, "train")
    roles = Roles.of(table).pick(o.selection.features, o.selection.algos)
    df = metadata.typed(table, roles)
    roles = Roles("instances", "source" if roles.source else None, roles.features, roles.algos)
    df, roles = metadata.clean(df, roles)
    raw = tables.save(metadata.with_row_id(df), "raw")
    p = o.performance
    labelled = labels.label(raw, roles.algos, maximise=p.maximise, absolute=p.absolute, epsilon=p.epsilon, beta_threshold=p.beta_threshold)
    algos = labels.drop_never_good(labelled, roles.algos)
    if algos != roles.algos:
        log.warning("algorithms that are good nowhere were dropped: %s", sorted(set(roles.algos) - set(algos)))
        # places in the portfolio follow the algorithms that remain
        raw = raw.drop(*(a for a in roles.algos if a not in algos))
        labelled = labels.label(raw, algos, maximise=p.maximise, absolute=p.absolute, epsilon=p.epsilon, beta_threshold=p.beta_threshold)
    roles = Roles(roles.instance, roles.source, roles.features, algos)
    flags = _flags(algos)
    parameters: list[dict] = []
    prepared = labelled
    if o.preparation.enabled:
        parameters = prep.fit(raw, roles.features, algos, bound=o.preparation.bound, normalise=o.preparation.normalise)
        prepared = prep.apply(labelled, parameters)
    prepared = tables.save(prepared, "prepared")
    some = _subset(prepared, roles, o, roles.features)
    features = roles.features
    if o.search.enabled:
        s = o.search
        features = selection.select_features(some, features, algos, flags, rho=s.rho, clusters=s.clusters, replicates=s.replicates, iterations=s.max_iterations, seed=o.seed)
        if o.selection.min_distance is not None:
            some = _subset(prepared, roles, o, features)
    rows = tables.save(some, "subset") if some is not prepared else prepared
    q = o.projection
    solution, placed = project.fit(rows, features, algos, analytic_solution=q.analytic, tries=q.tries, seed=o.seed, start=q.start, solution=q.solution)
    placed = tables.save(placed, "placed")
    edge, pruned = bounds.boundary(rows, features, solution.a, p_value=o.boundary.p_value, threshold=o.boundary.correlation)
    model = Model(o, algos, roles.features, features, parameters, solution.a.tolist(), solution.b.tolist())
    run = Run(o, raw.join(placed.select("row_id"), "row_id", "left_semi"), placed, features, algos, project.summary(spark, features, solution.a), edge, pruned, model=model)
    if with_prediction:
        _predict(run, flags, tables)
    if with_footprints:
        usable = o.footprints.use_predictions and "selection0" in run.rows.columns
        good, best = ([f"hat_{f}" for f in flags], "selection0") if usable else (flags, "best_algo")
        run.footprints = footprint.footprints(run.rows, algos, good, best, "beta_easy", o.footprints.purity)
        model.footprints = run.footprints
    return run


def _predict(run: Run, flags: list[str], tables: Tables) -> None:
    o, rows, raw = run.options, run.rows, run.raw
    weights = None
    if o.prediction.weights:
        rows = labels.cost_weights(rows, run.algos)
        weights = [f"w_{a[5:]}" for a in run.algos]
    q = o.prediction
    fitted, oof = predict.train(rows, flags, knn=q.knn, folds=q.folds, polynomial=q.polynomial, weights=weights, parameters=q.parameters, seed=o.seed)
    hats = [f"hat_{f}" for f in flags]
    both = rows.join(oof, "instances")
    table = {r["name"]: r for r in predict.confusion(both, list(zip(flags, hats, strict=True))).collect()}
    precision = [table[f]["precision"] for f in flags]
    default = predict.default_algorithm(both, flags)
    chosen = tables.save(predict.select(both, hats, precision, default), "predicted")
    measured = chosen.drop(*run.algos).join(raw.select("row_id", *run.algos), "row_id")
    shown = [(float(m["k"]), None) if q.knn else (float(m["c"]), float(m["scale"])) for m in fitted["models"]]
    run.rows, run.prediction = chosen, predict.summary(measured, run.algos, flags, hats, shown)
    run.model.prediction, run.model.precision, run.model.default = fitted, precision, default


def place(table: DataFrame, model: Model) -> DataFrame:
    """New rows labelled, prepared, projected and predicted with a stored model: row-wise steps only, so the table may
    be a stream."""
    o, p = model.options, model.options.performance
    df = metadata.align_algorithms(metadata.typed(table), model.algos)
    algos = [c for c in df.columns if c.startswith("algo_")]
    out = labels.label(df, algos, maximise=p.maximise, absolute=p.absolute, epsilon=p.epsilon, beta_threshold=p.beta_threshold)
    if o.preparation.enabled:
        out = prep.apply(out, model.preparation)
    out = project.project(out, model.selected, model.projection)
    if model.prediction is not None:
        hats = [f"hat_{m['flag']}" for m in model.prediction["models"]]
        out = predict.select(predict.score(out, model.prediction), hats, model.precision, model.default)
    return out


def explore(table: DataFrame, model: Model) -> Run:
    """A scoring run: rows placed by a model, its predictors and footprints measured on them."""
    spark = table.sparkSession
    tables = Tables(spark, "explore")
    rows = tables.save(place(table, model), "rows")
    raw = metadata.align_algorithms(metadata.typed(table), model.algos)
    flags = _flags(model.algos)
    run = Run(model.options, raw, rows, model.selected, model.algos, project.summary(spark, model.selected, model.projection), model=model)
    if model.prediction is not None:
        measured = rows.drop(*model.algos).join(raw.select("instances", *model.algos), "instances")
        run.prediction = predict.summary(measured, model.algos, flags, [f"hat_{f}" for f in flags])
    if model.footprints is not None:
        usable = model.options.footprints.use_predictions and model.prediction is not None
        good, best = ([f"hat_{f}" for f in flags], "selection0") if usable else (flags, "best_algo")
        run.footprints = footprint.assess(rows, model.footprints, model.algos, good, best, "beta_easy")
    return run


def unique_good_share(rows: DataFrame, algos: list[str]) -> DataFrame:
    return labels.unique_good(rows, algos).orderBy(F.desc("share"))
