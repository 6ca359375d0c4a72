"""Classifiers on feature tables: preparation, training, scoring, scans."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.ordering import column_quantiles, take_first
from barloom.operators.metrics import classification_metrics, extended_metrics
from barloom.operators.predictions import ensemble, intersect_models, intersection_order, latest_candidates
from barloom.operators.review import NEW_HIGH_COLUMNS, NewHigh, with_new_high
from barloom.operators.schema import NON_FEATURES
from barloom.plans.datasets import scan_features
from barloom.session import ensure_checkpoint_dir
from barloom.sources.dated import path_exists

ALIASES = {
    "logistic_regression": "logistic_regression", "lr": "logistic_regression", "logistic": "logistic_regression",
    "lightgbm": "lightgbm", "lgbm": "lightgbm", "xgboost": "xgboost", "xgb": "xgboost",
}


def model_name(name: str) -> str:
    key = name.strip().lower()
    if key not in ALIASES:
        raise ValueError(f"unknown model: {name}; known: {sorted(set(ALIASES.values()))}")
    return ALIASES[key]


def model_names(names: list[str]) -> list[str]:
    out = [model_name(n) for n in names]
    if len(set(out)) != len(out):
        raise ValueError(f"duplicate models: {names}")
    return out


def estimator(name: str, seed: int = 42, **params):
    """MLlib estimator under the familiar model names; the two tree names map to boosted trees of different shape."""
    common = dict(featuresCol="__x", labelCol="label", weightCol="__w")
    name = model_name(name)
    if name == "logistic_regression":
        return LogisticRegression(**common, **{"maxIter": 100, "standardization": False, **params})
    shape = {"maxDepth": 5, "stepSize": 0.1} if name == "lightgbm" else {"maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.9}
    return GBTClassifier(**common, seed=seed, **{"maxIter": 50, **shape, **params})


class Scaler:
    """Mean and population deviation of the training rows, one aggregate for all columns; a zero deviation scales by 1."""

    def __init__(self, columns: list[str]) -> None:
        self.columns = columns
        self.stats: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame) -> "Scaler":
        row = df.agg(
            *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(self.columns)], *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(self.columns)]
        ).first()
        self.stats = {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(self.columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()})


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median per column, NaN as missing; a column without a value gets 0.  One ordering serves all columns."""
    found = {r["column"]: r["q0"] for r in column_quantiles(df, columns, [0.5]).collect()}  # one row per column
    return {c: found.get(c, 0.0) for c in columns}


class Scored:
    """A fitted model with its preparation; ``imputed`` has the value per column that replaces a missing one, else 0 does."""

    def __init__(self, columns: list[str], imputed: dict[str, float] | None, scaler: Scaler | None, model: PipelineModel) -> None:
        self.columns, self.imputed, self.scaler, self.model = columns, imputed, scaler, model

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Positive-class probability.  Key columns are not features."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"feature columns missing: {missing}")
        keep = df.columns
        temp = {c: f"__f_{i}" for i, c in enumerate(self.columns)}
        out = df.withColumns({t: F.col(c).cast("double") for c, t in temp.items()})
        out = out.na.fill({t: (self.imputed or {}).get(c, 0.0) for c, t in temp.items()})
        if self.scaler:
            out = out.withColumns({temp[c]: (F.col(temp[c]) - F.lit(m)) / F.lit(s) for c, (m, s) in self.scaler.stats.items()})
        out = self.model.transform(out)
        return out.select(*keep, vector_to_array("probability")[1].alias(name))

    def save(self, path: str, name: str = "", threshold: float = 0.5) -> None:
        """Model and preparation (columns in order, fill values, scaler) under ``path``; what was there is replaced."""
        kept = {
            "format": BUNDLE, "name": name, "threshold": threshold, "columns": self.columns, "imputed": self.imputed,
            "scaler": [[c, *self.scaler.stats[c]] for c in self.scaler.columns] if self.scaler else None,
        }
        self.model.write().overwrite().save(f"{path}/model")
        # numbers as text of their shortest exact form: a reloaded model scores alike to the last bit
        row = active_session().createDataFrame([(json.dumps(kept),)], "preparation string")
        row.coalesce(1).write.mode("overwrite").text(f"{path}/preparation")

    @classmethod
    def load(cls, path: str) -> "Scored":
        kept = read_preparation(path)
        scaler = None
        if kept["scaler"] is not None:
            scaler = Scaler([c for c, _, _ in kept["scaler"]])
            scaler.stats = {c: (m, d) for c, m, d in kept["scaler"]}
        return cls(kept["columns"], kept["imputed"], scaler, PipelineModel.load(f"{path}/model"))


#: Version of the stored preparation.
BUNDLE = 1


def active_session() -> SparkSession:
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active session")
    return spark


def read_preparation(path: str) -> dict:
    kept = json.loads("\n".join(r["value"] for r in active_session().read.text(f"{path}/preparation").collect()))
    if kept.get("format") != BUNDLE:
        raise ValueError(f"{path}: stored preparation has format {kept.get('format')}, not {BUNDLE}")
    return kept


class ModelStore:
    """Trained models by name under one folder; any familiar name of a model finds it."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{model_name(name)}"

    def save(self, name: str, model: Scored, threshold: float = 0.5) -> str:
        model.save(self.path(name), model_name(name), threshold)
        return self.path(name)

    def names(self) -> list[str]:
        spark = active_session()
        return [n for n in sorted(set(ALIASES.values())) if path_exists(spark, f"{self.path(n)}/preparation")]

    def load(self, name: str) -> Scored:
        if model_name(name) not in self.names():
            raise ValueError(f"no stored model {model_name(name)} under {self.root}; stored: {self.names()}")
        return Scored.load(self.path(name))

    def threshold(self, name: str) -> float:
        return read_preparation(self.path(name))["threshold"]

    def score(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """``df`` with ``score_<name>`` and ``pred_<name>`` of each stored model."""
        for n in model_names(names or self.names()):
            df = self.load(n).score(df, f"score_{n}").withColumn(f"pred_{n}", (F.col(f"score_{n}") >= self.threshold(n)).cast("int"))
        return df


def feature_list(df: DataFrame) -> list[str]:
    return [f for f, t in df.dtypes if f not in NON_FEATURES and t in ("double", "float", "int", "bigint", "boolean")]


def balanced_weights(df: DataFrame, balanced: bool) -> DataFrame:
    if not balanced:
        return df.withColumn("__w", F.lit(1.0))
    n = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}  # two rows
    total = sum(n.values())
    w = F.lit(1.0)
    for k, c in n.items():
        w = F.when(F.col("label") == k, F.lit(total / (len(n) * c))).otherwise(w)
    return df.withColumn("__w", w)


def split_frames(df: DataFrame, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows: valid, else test, else the last fifth of train in order."""
    n = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}  # three rows
    if not n.get("train"):
        raise ValueError("no training rows")
    train = df.where("split = 'train'")
    for name in ("valid", "test"):
        if n.get(name):
            return train, df.where(F.col("split") == name)
    if n["train"] < 2:
        raise ValueError("too few training rows")
    from barloom.functions.ordering import with_global_rank

    tail = max(1, round(n["train"] * 0.2))
    tail = 1 if tail >= n["train"] else tail
    ranked = with_global_rank(train, order or [F.asc("asof_date"), F.asc("sample_id")], "__k")
    cut = n["train"] - tail
    return ranked.where(F.col("__k") <= cut).drop("__k"), ranked.where(F.col("__k") > cut).drop("__k")


def fit(
    train: DataFrame, features: list[str], name: str, *, impute: bool = False, scale: bool = True, balanced: bool = False, seed: int = 42, **params
) -> Scored:
    temp = [f"__f_{i}" for i in range(len(features))]
    df = train.withColumns({t: F.col(c).cast("double") for c, t in zip(features, temp)})
    df = balanced_weights(df, balanced)
    scaler, filler = None, medians(train, features) if impute else None
    df = df.na.fill({t: (filler or {}).get(c, 0.0) for c, t in zip(features, temp)})
    if scale:
        scaler = Scaler(features).fit(df.select(*[F.col(t).alias(c) for c, t in zip(features, temp)]))
        df = df.withColumns({t: (F.col(t) - F.lit(scaler.stats[c][0])) / F.lit(scaler.stats[c][1]) for c, t in zip(features, temp)})
    stages = [VectorAssembler(inputCols=temp, outputCol="__x"), estimator(name, seed, **params)]
    return Scored(features, filler, scaler, Pipeline(stages=stages).fit(df))


def train(df: DataFrame, name: str = "logistic_regression", threshold: float = 0.5, evaluator: Callable | None = None, **params):
    """Fit on the training split; returns the model, validation predictions and their metrics.

    ``evaluator`` is any function (predictions, label column, score column, threshold) -> metrics DataFrame.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()  # read by the counts, the scaler, every iteration and the scoring
    tr, va = split_frames(df)
    model = fit(tr, feature_list(df), name, **params)
    pred = model.score(va).withColumnsRenamed({"label": "y_true"})
    return model, pred, (evaluator or classification_metrics)(pred, "y_true", "score", threshold)


def train_many(df: DataFrame, names: list[str], threshold: float = 0.5, seed: int = 42, **params) -> dict[str, dict]:
    """Median-imputed, balanced models; the linear one is scaled.  Predictions cover all splits, metrics come per split."""
    out = {}
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    features = feature_list(df)
    for name in model_names(names):
        linear = name == "logistic_regression"
        own = params.get(name, {})
        model = fit(df.where("split = 'train'"), features, name, impute=True, scale=linear, balanced=True, seed=seed, **own)
        pred = model.score(df).withColumn("pred_label", (F.col("score") >= threshold).cast("int"))
        metrics = {s: extended_metrics(pred.where(F.col("split") == s), "label", "score", threshold) for s in ("train", "valid", "test")}
        out[name] = {"model": model, "predictions": pred, "metrics": metrics}
    return out


def pair_scorer(a: Scored, b: Scored, prefix: str) -> Callable[[DataFrame], DataFrame]:
    """Scorer that adds both models' scores under a phase prefix."""
    return lambda df: b.score(a.score(df, f"{prefix}_score_lgbm"), f"{prefix}_score_xgb")


def scan(
    bars: DataFrame, model: Scored, asof_date: str, window: int = 120, min_history: int = 160, *, exact: bool = False, gate: NewHigh | None = None
) -> DataFrame:
    """Score every entity on a date, optionally only those near their high, whose factor multiplies the score."""
    f = scan_features(bars, asof_date, window, min_history, exact)
    if gate is not None:
        g = with_new_high(bars, gate).select("ts_code", "trade_date", *NEW_HIGH_COLUMNS).where("new_high_review_pass")
        f = f.join(g, ["ts_code", "trade_date"])
    out = model.score(f.drop("trade_date"), "model_score")
    factor = F.coalesce("new_high_score_factor", F.lit(1.0)) if gate is not None else F.lit(1.0)
    return out.withColumn("score", F.col("model_score") * factor).orderBy(F.desc("score"), "sample_id")


def scan_intersection(bars: DataFrame, a: Scored, b: Scored, asof_date: str, top_n: int, **args) -> DataFrame:
    left, right = scan(bars, a, asof_date, **args), scan(bars, b, asof_date, **args)
    order = [F.desc("score"), F.asc("sample_id")]
    return take_first(intersect_models(left, right, order, order), intersection_order(), top_n)


def latest_ensemble(features: DataFrame, a: Scored, b: Scored, threshold: float, top_n: int) -> DataFrame:
    """Both models on one feature table, combined, predicted positives of the latest date."""
    meta = ["sample_id", "ts_code", "asof_date"]
    sides = [m.score(features).withColumn("pred_label", (F.col("score") >= threshold).cast("int")) for m in (a, b)]
    return latest_candidates(ensemble(*sides, meta, threshold), top_n, by_gap=True)
