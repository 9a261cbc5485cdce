"""Model search over full grids, and experiment tables.

Settings are rows of a grid; a run is one fit and its scores. Runs go through a bounded pool of
threads that submit Spark jobs side by side over one stored vector table. Each finished run is
appended to a result store, and runs the store already holds are left out, so a search or an
experiment whose driver was lost goes on where it stopped. Nothing data-sized is on the driver:
lists of settings, and a row of scores a run.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from matchsmith.operators.metrics import per_class_metrics
from matchsmith.plans import sparse_trees as ST
from matchsmith.sources import io as IO

# The grids that the searches draw from. C is the inverse penalty of a row, so
# regParam is 1 / (C rows); class weights weigh both classes alike or not at all.
C_GRID = [1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0, 1000.0]
CLASS_WEIGHT = ["none", "balanced"]
GRIDS: dict[str, dict[str, list]] = {
    "naive_bayes": {},
    "logistic_regression": {"C": C_GRID, "class_weight": CLASS_WEIGHT},
    "linear_svm": {"C": C_GRID, "class_weight": CLASS_WEIGHT},
    "decision_tree": {"maxDepth": [2, 4, 7, 10], "minInstancesPerNode": [1, 2, 4, 8], "class_weight": CLASS_WEIGHT},
    "random_forest": {"featureSubsetStrategy": ["sqrt", "log2", "all"], "maxDepth": [2, 4, 7, 10], "minInstancesPerNode": [1, 2, 4, 8],
                      "class_weight": CLASS_WEIGHT},
    "gradient_boosting": {"stepSize": [0.1, 0.01, 0.001], "minInfoGain": [0.01, 0.1, 0.3, 0.5, 1.0, 1.5, 2.0], "maxDepth": [2, 4, 7, 10],
                          "featureSubsetStrategy": ["0.3", "0.6", "0.8", "1.0"], "subsamplingRate": [0.2, 0.4, 0.5, 0.6, 0.7],
                          "minInstancesPerNode": [1, 3, 5, 7]},
}
_MAKE: dict[str, Callable] = {
    "naive_bayes": lambda: NaiveBayes(modelType="bernoulli"),
    "logistic_regression": lambda: LogisticRegression(maxIter=100),
    "linear_svm": lambda: LinearSVC(maxIter=100),
    "decision_tree": lambda: DecisionTreeClassifier(seed=42),
    "random_forest": lambda: RandomForestClassifier(numTrees=100, seed=42),
    "gradient_boosting": lambda: GBTClassifier(maxIter=100, seed=42),
}
LEARNERS = tuple(GRIDS)
# Settings that a learner has where a run names none.
DEFAULTS = {"logistic_regression": {"C": 1.0}, "linear_svm": {"C": 1.0}}
# Rows that one partition of a stored vector table holds: a fit is many short jobs over them.
ROWS_OF_A_PARTITION = 100_000
# Cells (rows x features) of one: Spark ML's tree learners hold every row as a dense array. Beyond one such
# partition, trees on sparse 0/1 rows are grown from their nonzeros (``sparse_trees``).
CELLS_OF_A_PARTITION = 8_000_000
# Nonzeros of one, for sparse rows: the other learners read nothing else of them.
NONZEROS_OF_A_PARTITION = 2_000_000


def settings(learner: str, budget: int, seed: int = 42) -> list[dict]:
    """Up to ``budget`` different settings of the learner's grid, drawn with a seeded generator: the
    whole grid, in order, if it has no more."""
    grid, total = GRIDS[learner], 1
    for values in grid.values():
        total *= len(values)
    chosen = range(total) if total <= budget else sorted(random.Random(f"{seed}/{learner}").sample(range(total), budget))
    out = []
    for n in chosen:
        one = {}
        for name, values in grid.items():
            n, at = divmod(n, len(values))
            one[name] = values[at]
        out.append(one)
    return out


def estimator(learner: str, setting: dict, rows: int, balanced: str = "weight", **fixed):
    """The Spark ML estimator of a setting for ``rows`` training rows; ``fixed`` overrides."""
    est, params = _MAKE[learner](), {**DEFAULTS.get(learner, {}), **setting}
    if "C" in params:
        params["regParam"] = 1.0 / (params.pop("C") * max(rows, 1))
    if params.pop("class_weight", "none") == "balanced":
        est = est.setWeightCol(balanced)
    return est.copy({est.getParam(name): value for name, value in {**params, **fixed}.items()})


def fit(learner: str, setting: dict, train: DataFrame, rows: int, width: int = 0, **fixed):
    """The fitted model of a setting. ``width`` is the number of features of sparse 0/1 rows, which have their
    ones in ``places``; other rows leave it out."""
    est = estimator(learner, setting, rows, **fixed)
    if type(est).__name__ in ST.KINDS and rows * width > CELLS_OF_A_PARTITION:
        return ST.fit(est, train, width)
    return est.fit(train)


@dataclass
class ResultStore:
    """Finished runs as rows under a path, each added under its name (``io.append_run``)."""

    spark: SparkSession
    path: str

    def read(self) -> DataFrame:
        return IO.read_runs(self.spark, self.path, "result string")

    def append(self, run: str, result: dict) -> None:
        IO.append_run(self.spark.createDataFrame([(json.dumps(result, sort_keys=True),)], "result string").coalesce(1), self.path, run)

    def held(self, runs: list[str]) -> dict[str, dict]:
        """Results of the named runs that are stored (at most one row a name)."""
        asked = self.spark.createDataFrame([(r,) for r in runs], "run string")
        return {r["run"]: json.loads(r["result"]) for r in self.read().join(F.broadcast(asked), "run", "left_semi").collect()}


def run_name(**parts) -> str:
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def run_all(tasks: dict[str, Callable[[], dict]], store: ResultStore | None = None, workers: int = 4) -> dict[str, dict]:
    """Results of all named tasks: those in the store are not run again, the others run ``workers`` at
    a time and are stored as they finish."""
    done = store.held(list(tasks)) if store and tasks else {}
    left = [name for name in tasks if name not in done]

    def one(name):
        result = tasks[name]()
        if store:
            store.append(name, result)
        return name, result

    if left:
        pool = ThreadPool(min(workers, len(left)))
        try:
            done |= dict(pool.imap_unordered(inheritable_thread_target(one), left))
        finally:
            pool.close()
    return done


def f1_of(model, rows: DataFrame) -> dict:
    """Precision, recall and F1 of class 1."""
    m = per_class_metrics(model.transform(rows), "label", "prediction").where(F.col("class") == 1).first()
    return {k: float(m[k] or 0.0) if m else 0.0 for k in ("precision", "recall", "f1")}


def _share_of(df: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose hashed key falls under ``share``: nested for growing shares."""
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int(share * (1 << 20)))


def search(learner: str, train: DataFrame, valid: DataFrame, budget: int = 500, seed: int = 42, key: str = "pair_id",
           rungs: tuple[float, ...] = (1.0,), keep: float = 1 / 3, store: ResultStore | None = None, workers: int = 4,
           name: str = "search", **fixed) -> list[dict]:
    """Rows ``setting, rung, share, f1`` of a random search on a fixed validation fold.

    Every drawn setting is fitted on the first rung's share of the training rows; the best ``keep`` of
    them go on to the next share, and those left at the last, which is all rows, are fitted exactly. With the default single rung
    all settings are. ``fixed`` overrides parameters (such as ``maxIter``)."""
    if rungs[-1] != 1.0:
        raise ValueError("the last rung must be all training rows")
    drawn = list(enumerate(settings(learner, budget, seed)))
    rows: list[dict] = []
    for nth, share in enumerate(rungs):
        part = _share_of(train, key, share)
        n = part.count()

        def fit(setting, part=part, n=n):
            t0 = time.time()
            model = estimator(learner, setting, n, **fixed).fit(part)
            return {"f1": f1_of(model, valid)["f1"], "seconds": round(time.time() - t0, 3)}

        tasks = {run_name(name=name, learner=learner, setting=s, share=share, seed=seed, fixed=fixed): (i, s) for i, s in drawn}
        found = run_all({r: (lambda s=s, fit=fit: fit(s)) for r, (_, s) in tasks.items()}, store, workers)
        scored = [{"learner": learner, "setting": i, "params": s, "rung": nth, "share": share, **found[r]} for r, (i, s) in tasks.items()]
        rows += scored
        scored.sort(key=lambda r: (-r["f1"], r["setting"]))
        left = {r["setting"] for r in scored[:max(1, round(len(scored) * keep))]}
        drawn = [(i, s) for i, s in drawn if i in left]
    return rows


def best_of(rows: list[dict]) -> dict:
    """The best setting among the fits on all training rows (ties to the first drawn)."""
    return min((r for r in rows if r["share"] >= 1), key=lambda r: (-r["f1"], r["setting"]))


def experiment(cells: list[dict], fit: Callable[[dict], dict], store: ResultStore | None = None, workers: int = 4) -> list[dict]:
    """One result row a cell, such as ``{file, features, learner, noise}``: the cell's fields and what
    ``fit(cell)`` returns. Cells the store holds are not run again."""
    names = {run_name(**c): c for c in cells}
    found = run_all({n: (lambda c=c: fit(c)) for n, c in names.items()}, store, workers)
    return [{**c, **found[n]} for n, c in names.items()]


def text_of(setting: dict) -> str:
    return ";".join(f"{k}={v}" for k, v in sorted(setting.items()))


def packed(df: DataFrame, width: int = 1, key: str = "pair_id") -> DataFrame:
    """The rows in as few partitions as their number, and their ``width`` in features, ask for: a fit
    runs many jobs over them."""
    rows = df.count()
    by_rows, by_cells = -(-rows // ROWS_OF_A_PARTITION), -(-rows * width // CELLS_OF_A_PARTITION)
    return df.repartition(by_cells, key) if by_cells > max(1, by_rows) else df.coalesce(max(1, by_rows))


def packed_sparse(df: DataFrame, rows: int, nonzeros: int, key: str = "pair_id") -> DataFrame:
    """Sparse rows in as few partitions as their number and their ``nonzeros`` ask for, however wide they are."""
    parts = max(-(-rows // ROWS_OF_A_PARTITION), -(-nonzeros // NONZEROS_OF_A_PARTITION))
    return df.repartition(parts, key) if parts > 1 else df.coalesce(1)
