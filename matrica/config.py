"""Settings of an analysis: defaults, presets, and their file form (JSON)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class AnalysisConfig:
    """What both arms run and how.  An argument given to a call stands above these."""

    clustering_methods: tuple[str, ...] = ("kmeans", "hierarchical", "dbscan", "leiden", "louvain", "hdbscan")
    classifiers: tuple[str, ...] = ("LogisticRegression", "RandomForest", "KNN", "NaiveBayes", "LDA", "QDA", "SVM", "MLP", "GradientBoosting")
    resolutions: tuple[float, ...] = field(default=(0.25, 0.5, 1.0, 1.5, 2.0))
    n_neighbors: int = 15
    confusion_neighbors: int = 50
    n_pca_components: int = 50
    auto_components: str | None = None
    cv_folds: int = 5
    test_size: float = 0.2
    bootstrap_ci: bool = False
    n_bootstrap: int = 2000
    scoring: str = "weighted"
    adaptive_resolution: bool = False
    random_state: int = 42

    @classmethod
    def preset(cls, name: str = "default") -> AnalysisConfig:
        """``default``, ``fast`` (few methods, three folds) or ``robust`` (intervals, rank sums, chosen components)."""
        base = cls()
        if name == "default":
            return base
        if name == "fast":
            return replace(base, clustering_methods=("kmeans", "leiden"), classifiers=("LogisticRegression", "RandomForest", "KNN"), cv_folds=3)
        if name == "robust":
            return replace(base, bootstrap_ci=True, scoring="borda", auto_components="gavish_donoho", adaptive_resolution=True)
        raise ValueError(f"unknown preset: {name}; have default, fast, robust")

    def save(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str) -> AnalysisConfig:
        """Unknown keys are left out."""
        known = {f.name for f in fields(cls)}
        got = {k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(Path(path).read_text()).items() if k in known}
        return cls(**got)


#: What each setting means, as written into the template.
NOTES = {
    "clustering_methods": "tried by the unsupervised arm",
    "classifiers": "tried by the supervised arm",
    "resolutions": "of the community search",
    "n_neighbors": "in the neighbour graph",
    "confusion_neighbors": "a label is compared with",
    "n_pca_components": "unless auto_components chooses",
    "auto_components": "null, gavish_donoho or marchenko_pastur",
    "cv_folds": "of the cross-validation",
    "test_size": "share held out",
    "bootstrap_ci": "intervals for metrics",
    "n_bootstrap": "draws for an interval",
    "scoring": "weighted, borda or pareto",
    "adaptive_resolution": "refine the best resolution",
    "random_state": "seed of everything",
}


def write_template(path: str) -> None:
    """The defaults with a note for each; notes are unknown keys, which ``load`` leaves out."""
    body = {}
    for k, v in asdict(AnalysisConfig()).items():
        body[f"# {k}"] = NOTES[k]
        body[k] = v
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(body, indent=2))
