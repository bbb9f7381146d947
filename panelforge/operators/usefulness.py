"""Does one feature help to predict the target beyond entity effects and time?

The ridge models have one 0/1 column per entity. Their normal equations are condensed to the few numeric
features by eliminating the entity effects entity by entity, which takes nothing but per-entity sums.
One aggregate over the rows therefore serves every penalty, fold and feature set, for any number of
entities; a second pass measures the absolute errors of all fold models.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators import tree_models, trees
from panelforge.operators.folds import group_folds
from panelforge.operators.profile import within_group_std
from panelforge.operators.regression import medians
from panelforge.session import staged

# Penalties tried by default.
ALPHAS = tuple(float(a) for a in np.logspace(-3, 3, 25))


@dataclass(frozen=True)
class RidgeFit:
    """Model on centered features; entity effects apply to known entities only."""

    features: tuple[str, ...]
    alpha: float
    intercept: float
    coefficients: Mapping[str, float]

    def unseen(self, center: Mapping[str, float]) -> Column:
        """Prediction for an entity without an effect."""
        total = F.lit(self.intercept)
        for c, b in self.coefficients.items():
            total = total + F.lit(b) * (F.col(c) - F.lit(center[c]))
        return total


def entity_moments(df: DataFrame, features: Sequence[str], target: str, center: Mapping[str, float], entity: str) -> DataFrame:
    """Sums of ``1, centered features, target`` and their products per fold and entity."""
    terms = [F.lit(1.0), *[F.col(c).cast("double") - F.lit(center[c]) for c in features], F.col(target).cast("double")]
    width = len(terms)
    return df.groupBy("fold", entity).agg(
        *[F.sum(terms[i] * terms[j]).alias(f"m{i}_{j}") for i in range(width) for j in range(i, width)]
    )


def _matrix(row, width: int) -> np.ndarray:
    out = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            out[i, j] = out[j, i] = row[f"m{i}_{j}"]
    return out


class FixedEffectRidge:
    """Ridge with entity effects, solved from per-entity sums for every penalty and set of folds.

    The effect of the alphabetically first training entity is left out, as with a dropped dummy.
    """

    def __init__(self, moments: DataFrame, features: Sequence[str], entity: str, alphas: Sequence[float]):
        self.features, self.entity, self.alphas = tuple(features), entity, tuple(alphas)
        self.moments, self.width = moments, len(features) + 2
        w = self.width
        pairs = [(i, j) for i in range(w) for j in range(i, w)]
        # Column i of an entity's row sums is m0_i: its rows, feature sums and target sum.
        row_sums = F.struct(*[F.col(f"m0_{i}") for i in range(w)])
        rows = moments.groupBy("fold").agg(
            *[F.sum(f"m{i}_{j}").alias(f"m{i}_{j}") for i, j in pairs],
            F.min(entity).alias("_first"), F.min_by(row_sums, F.col(entity)).alias("_first_sums"),
        ).collect()
        per_alpha = moments.select("fold", *[f"m0_{i}" for i in range(w)], F.posexplode(F.array(*[F.lit(a) for a in self.alphas])).alias("k", "a"))
        removed = per_alpha.groupBy("fold", "k").agg(
            *[F.sum(F.col(f"m0_{i}") * F.col(f"m0_{j}") / (F.col("m0_0") + F.col("a"))).alias(f"m{i}_{j}") for i, j in pairs]
        ).collect()
        self.effects: dict[int, dict[int, np.ndarray]] = {}
        for r in removed:
            self.effects.setdefault(r["fold"], {})[r["k"]] = _matrix(r, w)
        self.total = {r["fold"]: _matrix(r, w) for r in rows}
        self.first = {r["fold"]: (r["_first"], np.array([r["_first_sums"][f"m0_{i}"] for i in range(w)])) for r in rows}

    def fit(self, folds: Sequence[int], k: int, features: Sequence[str]) -> RidgeFit:
        """Model of penalty ``k`` on the given folds and features."""
        alpha = self.alphas[k]
        total = sum(self.total[f] for f in folds)
        _, sums = min((self.first[f] for f in folds), key=lambda x: x[0])
        effects = sum(self.effects[f][k] for f in folds) - np.outer(sums, sums) / (sums[0] + alpha)
        keep = [0, *[self.features.index(c) + 1 for c in features]]
        n = total[0, 0]
        variance = np.array([0.0, *[max(total[j, j] / n - (total[0, j] / n) ** 2, 0.0) for j in keep[1:]]])
        left = (total - effects)[np.ix_(keep, keep)] + np.diag(alpha * variance)
        theta = np.linalg.lstsq(left, (total - effects)[keep, -1], rcond=None)[0]
        return RidgeFit(tuple(features), alpha, float(theta[0]), {c: float(b) for c, b in zip(features, theta[1:])})

    def test_mse(self, fold: int, model: RidgeFit) -> float:
        w = np.zeros(self.width)
        w[0], w[-1] = -model.intercept, 1.0
        for c, b in model.coefficients.items():
            w[self.features.index(c) + 1] = -b
        return float(w @ self.total[fold] @ w / self.total[fold][0, 0])

    def best_penalty(self, features: Sequence[str]) -> int:
        """Penalty with the smallest mean squared error over held-out folds."""
        folds = sorted(self.total)
        errors = [
            np.mean([self.test_mse(f, self.fit([g for g in folds if g != f], k, features)) for f in folds])
            for k in range(len(self.alphas))
        ]
        return int(np.argmin(errors))

    def permutation_importance(self, model: RidgeFit, feature: str) -> float:
        """Expected drop of R2 when the feature's values are shuffled over all rows.

        With residual e and coefficient b the expected extra squared error per row is
        ``2 b cov(e, f) + 2 b^2 var(f)``, so no shuffled copy of the data is needed.
        """
        w, j = self.width, self.features.index(feature) + 1
        theta = [F.lit(model.intercept), *[F.lit(model.coefficients.get(c, 0.0)) for c in self.features]]
        first = min((self.first[f] for f in self.total), key=lambda x: x[0])[0]

        def m(a: int, b: int) -> Column:
            return F.col(f"m{min(a, b)}_{max(a, b)}")

        def rest(a: int) -> Column:
            """Sum over the entity's rows of column a times (target - numeric part)."""
            out = m(a, w - 1)
            for i in range(w - 1):
                out = out - theta[i] * m(i, a)
            return out

        effect = F.when(F.col(self.entity) == first, F.lit(0.0)).otherwise(rest(0) / (m(0, 0) + model.alpha))
        row = self.moments.agg(
            F.sum(rest(0) - effect * m(0, 0)).alias("e"), F.sum(rest(j) - effect * m(0, j)).alias("ef"),
        ).first()
        total = sum(self.total.values())
        n, b = total[0, 0], model.coefficients[feature]
        mean_f, mean_y = total[0, j] / n, total[0, -1] / n
        cov = row["ef"] / n - row["e"] / n * mean_f
        var_f, var_y = total[j, j] / n - mean_f**2, total[-1, -1] / n - mean_y**2
        return float((2 * b * cov + 2 * b * b * var_f) / var_y)


def feature_usefulness(
    df: DataFrame, feature: str, target: str, splits: int = 5, alphas: Sequence[float] = ALPHAS, boosting: trees.Boosting | None = None,
    entity: str = "entity", period: str = "period",
) -> DataFrame:
    """Grouped cross-validation errors with and without the feature, its permutation importance and its
    median within-entity std, as ``metric, value``. ``target`` is in logs; level errors use ``exp``.

    ``boosting`` (parameters of the boosted trees) adds the nonlinear comparison, without entity columns:
    every held-out entity is unseen and would have zeros there.
    """
    features = [period, feature]
    center = medians(df, features)
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(center[c])) for c in features})
    folded = staged(group_folds(filled.select(entity, period, feature, target), splits, entity))
    ridge = FixedEffectRidge(
        staged(entity_moments(folded, features, target, center, entity)), features, entity, alphas
    )
    folds = sorted(ridge.total)
    out = {"median_within_group_std": within_group_std(df, [feature], entity).first()["median_within_std"]}
    sets = {"base": [period], "with_feature": features}
    gap = {}
    for name, chosen in sets.items():
        k = ridge.best_penalty(chosen)
        out[f"alpha_{name}"] = ridge.alphas[k]
        predicted = F.lit(None).cast("double")
        for f in folds:
            model = ridge.fit([g for g in folds if g != f], k, chosen)
            predicted = F.when(F.col("fold") == f, model.unseen(center)).otherwise(predicted)
        gap[f"mae_{name}_ridge"] = F.abs(F.col(target) - predicted)
        gap[f"mae_{name}_ridge_level"] = F.abs(F.exp(target) - F.exp(predicted))
    per_fold = folded.groupBy("fold").agg(*[F.avg(g).alias(n) for n, g in gap.items()])
    out.update(per_fold.agg(*[F.avg(n).alias(n) for n in gap]).first().asDict())
    models = ["ridge"]
    if boosting is not None:
        models.append("trees")
        # Both feature sets and all folds are models of one fit.
        rows = trees.binned(folded.withColumn("_key", F.xxhash64(entity, period)), features, ["fold", target, "_key"])
        both = {f"{name}:{f}": (F.col("fold") != f, F.col("fold") == f, chosen) for name, chosen in sets.items() for f in folds}
        scored = tree_models.predictions(rows, target, "_key", both, boosting)
        gaps = scored.groupBy("model").agg(F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("log"), F.avg(F.abs(F.exp(target) - F.exp("prediction"))).alias("level"))
        for e in gaps.groupBy(F.split("model", ":")[0].alias("name")).agg(F.avg("log").alias("log"), F.avg("level").alias("level")).collect():
            out[f"mae_{e['name']}_trees"], out[f"mae_{e['name']}_trees_level"] = e["log"], e["level"]
    for m in models:
        for suffix in ("", "_level"):
            out[f"mae_delta_{m}{suffix}"] = out[f"mae_with_feature_{m}{suffix}"] - out[f"mae_base_{m}{suffix}"]
    final = ridge.fit(folds, ridge.best_penalty(features), features)
    out["permutation_importance"] = ridge.permutation_importance(final, feature)
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in out.items()], "metric string, value double")
