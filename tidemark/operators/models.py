"""Walk-forward models on pyspark.ml, refitted at cutoffs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import refits


def assemble(df: DataFrame, features: list[str], fill: float = -1.0) -> DataFrame:
    """Feature vector with NULL and NaN as ``fill``."""
    clean = df
    for f in features:
        c = F.col(f).cast("double")
        clean = clean.withColumn(f"__{f}", F.when(c.isNull() | F.isnan(c), F.lit(fill)).otherwise(c))
    names = [f"__{f}" for f in features]
    return VectorAssembler(inputCols=names, outputCol="features").transform(clean).drop(*names)


@dataclass
class Boosted:
    """Gradient-boosted trees with a fixed seed: 'binary' or 'regression'."""

    features: list[str]
    label: str
    kind: str = "binary"
    rounds: int = 20
    depth: int = 4
    seed: int = 7

    def fit(self, df: DataFrame) -> Any:
        maker = GBTClassifier if self.kind == "binary" else GBTRegressor
        est = maker(featuresCol="features", labelCol=self.label, maxIter=self.rounds, maxDepth=self.depth, seed=self.seed)
        return est.fit(assemble(df.filter(F.col(self.label).isNotNull()).withColumn(self.label, F.col(self.label).cast("double")), self.features))

    def predict(self, model: Any, df: DataFrame, out: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        p = model.transform(assemble(df, self.features))
        value = vector_to_array("probability")[1] if self.kind == "binary" else F.col("prediction")
        return p.withColumn(out, value).select(*df.columns, out)

    def fit_all(self, df: DataFrame, periods: list[int]) -> dict[int, Any] | None:
        return refits.fit_boosted(df, self.features, self.label, periods, self.rounds, self.depth) if self.kind == "binary" else None

    def predict_all(self, models: dict[int, Any], df: DataFrame, out: str) -> DataFrame:
        return refits.predict(df, self.features, models, refits.start_probability, out)


@dataclass
class Poisson:
    """Poisson regression on numeric features."""

    features: list[str]
    label: str

    def fit(self, df: DataFrame) -> Any:
        glm = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features", labelCol=self.label, regParam=1e-6)
        return glm.fit(assemble(df.filter(F.col(self.label).isNotNull()).withColumn(self.label, F.col(self.label).cast("double")), self.features))

    def predict(self, model: Any, df: DataFrame, out: str) -> DataFrame:
        return model.transform(assemble(df, self.features)).withColumn(out, F.col("prediction")).select(*df.columns, out)

    def fit_all(self, df: DataFrame, periods: list[int]) -> dict[int, Any]:
        return refits.fit_poisson(df, self.features, self.label, periods)

    def predict_all(self, models: dict[int, Any], df: DataFrame, out: str) -> DataFrame:
        return refits.predict(df, self.features, models, refits.rate, out)


@dataclass
class WalkForward:
    """Fit at every ``every``-th round and predict until the next fit; fits are kept by cutoff."""

    make: Callable[[], Any]
    every: int = 4
    fits: dict[int, Any] = field(default_factory=dict)

    def cutoff(self, index: int) -> int:
        return (index - 1) // self.every * self.every + 1

    def predict(self, history: DataFrame, order: str, rounds: list[int], out: str = "pred") -> DataFrame:
        """Predictions for the rows of each round from a model that saw only rounds before its cutoff.

        Rounds whose cutoff has no earlier row can't be predicted and are left out. A model with ``fit_all`` is fitted
        for all cutoffs side by side.
        """
        first = history.agg(F.min(order)).first()[0]
        cuts = sorted({c for i in rounds if first is not None and (c := self.cutoff(i)) > first})
        model = self.make()
        if hasattr(model, "fit_all"):
            to_period = lambda cut: (cut - 1) // self.every
            h = history.withColumn(refits.PERIOD, F.floor((F.col(order) - 1) / self.every).cast("int"))
            fits = model.fit_all(h, [to_period(c) for c in cuts if c not in self.fits])
            if fits is not None:
                self.fits |= {c: fits[to_period(c)] for c in cuts if to_period(c) in fits}
                fits = {to_period(c): self.fits[c] for c in cuts if c in self.fits}
                return model.predict_all(fits, h.filter(F.col(order).isin(rounds) & F.col(refits.PERIOD).isin(list(fits))), out)
        for cut in cuts:
            if cut not in self.fits:
                self.fits[cut] = self.make().fit(history.filter(F.col(order) < cut))
        parts = history.limit(0).withColumn(out, F.lit(None).cast("double"))
        for cut in cuts:
            group = [i for i in rounds if self.cutoff(i) == cut]
            parts = parts.unionByName(self.make().predict(self.fits[cut], history.filter(F.col(order).isin(group)), out))
        return parts


MOST_FOLDS = 100


def out_of_fold(df: DataFrame, make: Callable[[], Any], fold: str, out: str) -> DataFrame:
    """Each row predicted by a model fitted on the other folds (at most ``MOST_FOLDS``, none NULL); NULL where there is no other fold."""
    folds = [r[0] for r in df.select(fold).distinct().limit(MOST_FOLDS + 1).collect()]
    if len(folds) > MOST_FOLDS or None in folds:
        raise ValueError(f"{fold} has NULLs or more than {MOST_FOLDS} values")
    if len(folds) < 2:
        return df.withColumn(out, F.lit(None).cast("double"))
    parts = None
    for f in sorted(folds):
        m = make()
        p = m.predict(m.fit(df.filter(F.col(fold) != f)), df.filter(F.col(fold) == f), out)
        parts = p if parts is None else parts.unionByName(p)
    return parts
