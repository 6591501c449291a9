"""Column roles, options and their validation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Roles:
    """Which columns of a metadata table hold the instance label, its source, features and algorithm performances."""

    instance: str
    source: str | None
    features: list[str]
    algos: list[str]

    @staticmethod
    def of(df: DataFrame) -> Roles:
        """By header, in any case: ``instances``, ``source``, prefixes ``feature_`` and ``algo_``; others are ignored."""
        low = {c: c.lower() for c in df.columns}
        instance = [c for c, x in low.items() if x == "instances"]
        source = [c for c, x in low.items() if x == "source"]
        if not instance:
            raise ValueError("the table has no column named instances")
        return Roles(instance[0], source[0] if source else None, [c for c, x in low.items() if x.startswith("feature_")], [c for c, x in low.items() if x.startswith("algo_")])

    def pick(self, features: list[str] | None = None, algos: list[str] | None = None) -> Roles:
        """Keep the named columns (exact, case-sensitive), in table order."""

        def some(have: list[str], names: list[str] | None, kind: str) -> list[str]:
            if names is None:
                return have
            kept = [c for c in have if c in set(names)]
            if not kept:
                raise ValueError(f"none of the named {kind} is in the table")
            return kept

        return replace(self, features=some(self.features, features, "features"), algos=some(self.algos, algos, "algorithms"))


@dataclass(frozen=True)
class Performance:
    maximise: bool = False
    absolute: bool = True
    epsilon: float = 0.20
    beta_threshold: float = 0.55


@dataclass(frozen=True)
class Preparation:
    enabled: bool = True
    bound: bool = True
    normalise: bool = True


@dataclass(frozen=True)
class Selection:
    features: list[str] | None = None
    algos: list[str] | None = None
    holdout: float | None = None
    index_file: str | None = None
    min_distance: float | None = None
    distance_type: str | None = None

    def __post_init__(self) -> None:
        if self.min_distance is not None and self.distance_type is None:
            raise ValueError("a density subset needs distance_type")
        if sum(x is not None for x in (self.holdout, self.index_file, self.min_distance)) > 1:
            raise ValueError("at most one way of taking a subset")


@dataclass(frozen=True)
class FeatureSearch:
    enabled: bool = True
    rho: float = 0.1
    clusters: int = 10
    max_iterations: int = 1000
    replicates: int = 100


@dataclass(frozen=True)
class Projection:
    analytic: bool = False
    tries: int = 5
    start: list[float] | None = None
    solution: list[float] | None = None


@dataclass(frozen=True)
class Boundary:
    p_value: float = 0.05
    correlation: float = 0.7


@dataclass(frozen=True)
class Prediction:
    knn: bool = True
    folds: int = 5
    polynomial: bool = False
    weights: bool = False
    tune: bool = True
    parameters: list[list[float]] | None = None


@dataclass(frozen=True)
class Footprints:
    use_predictions: bool = True
    purity: float = 0.55


@dataclass(frozen=True)
class Outputs:
    csv: bool = True
    web: bool = False
    plots: bool = True


@dataclass(frozen=True)
class Options:
    """All options of a run, written to and read from JSON."""

    performance: Performance = field(default_factory=Performance)
    preparation: Preparation = field(default_factory=Preparation)
    selection: Selection = field(default_factory=Selection)
    search: FeatureSearch = field(default_factory=FeatureSearch)
    projection: Projection = field(default_factory=Projection)
    boundary: Boundary = field(default_factory=Boundary)
    prediction: Prediction = field(default_factory=Prediction)
    footprints: Footprints = field(default_factory=Footprints)
    outputs: Outputs = field(default_factory=Outputs)
    seed: int = 1

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def from_json(text: str) -> Options:
        """Our own layout, or a foreign options object of either generation (see ``migrate``)."""
        raw = json.loads(text)
        if any(k in raw for k in ("perf", "general", "auto", "bound")):
            return Options.migrate(raw)
        kinds = {f.name: f.default_factory for f in fields(Options) if f.name != "seed"}
        unknown = set(raw) - set(kinds) - {"seed"}
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        return Options(**{k: kinds[k](**v) for k, v in raw.items() if k != "seed"}, seed=raw.get("seed", 1))

    @staticmethod
    def migrate(raw: dict[str, Any]) -> Options:
        """Options as older files name them: current keys, and the former names of their sections."""
        # Fixed names of the option format, former names first.
        former = {"pbldr": "pilot", "oracle": "pythia", "sbound": "cloister", "footprint": "trace", "clust": "sifted"}
        o = {former.get(k, k): v for k, v in raw.items()}
        perf, general = o.get("perf", {}), o.get("general", {})
        sel, sifted, pilot, cloister, pythia, trace, out = (o.get(k, {}) for k in ("selvars", "sifted", "pilot", "cloister", "pythia", "trace", "outputs"))
        density = bool(sel.get("densityflag"))
        d = Options()
        return Options(
            Performance(bool(perf.get("MaxPerf", perf.get("MaxMin", False))), bool(perf.get("AbsPerf", True)), float(perf.get("epsilon", 0.2)), float(perf.get("betaThreshold", general.get("betaThreshold", 0.55)))),
            Preparation(bool(o.get("auto", {}).get("preproc", True)), bool(o.get("bound", {}).get("flag", True)), bool(o.get("norm", {}).get("flag", True))),
            Selection(
                sel.get("feats"),
                sel.get("algos"),
                float(sel.get("smallscale", 0.5)) if sel.get("smallscaleflag") else None,
                sel.get("fileidx") if sel.get("fileidxflag") else None,
                float(sel.get("mindistance", 0.1)) if density else None,
                sel.get("type") if density else None,
            ),
            FeatureSearch(bool(sifted.get("flag", True)), float(sifted.get("rho", 0.1)), int(sifted.get("K", 10)), int(sifted.get("MaxIter", 1000)), int(sifted.get("Replicates", 100))),
            Projection(bool(pilot.get("analytic", False)), int(pilot.get("ntries", 5)), pilot.get("X0"), pilot.get("alpha")),
            Boundary(float(cloister.get("pval", 0.05)), float(cloister.get("cthres", 0.7))),
            Prediction(bool(pythia.get("useknn", True)), int(pythia.get("cvfolds", 5)), bool(pythia.get("ispolykrnl", False)), bool(pythia.get("useweights", False)), "params" not in pythia, pythia.get("params")),
            Footprints(bool(trace.get("usesim", True)), float(trace.get("PI", 0.55))),
            Outputs(bool(out.get("csv", True)), bool(out.get("web", False)), bool(out.get("png", True))),
            d.seed,
        )
