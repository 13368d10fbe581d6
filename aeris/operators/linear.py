"""Linear models from sufficient statistics (M1-M8).

One Spark aggregate yields n, sums, X'X and X'y of the distances from the column
means; only these p x p numbers reach the driver, where the (ridge) normal equations are solved. K-fold
cross-validation takes one grouped aggregate (statistics per fold); the
training statistics of fold f are total minus fold f, so all k fits come from
the same pass, and one more pass scores every fold. Ridge and lasso, all folds and
all strengths alike, are arithmetic on these numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeris.operators.clean import complete_cases


@dataclass
class LinearModel:
    features: list
    targets: list
    coef: np.ndarray       # p x t
    intercept: np.ndarray  # t
    alpha: float = 0.0

    def prediction(self, target: str) -> Column:
        k = self.targets.index(target)
        expr = F.lit(float(self.intercept[k]))
        for i, f in enumerate(self.features):
            expr = expr + F.lit(float(self.coef[i, k])) * F.col(f).cast("double")
        return expr

    def predict(self, df: DataFrame, prefix: str = "pred_") -> DataFrame:
        return df.select("*", *[self.prediction(t).alias(f"{prefix}{t}") for t in self.targets])

    def coefficients(self, spark) -> DataFrame:
        rows = [("intercept", t, float(self.intercept[k])) for k, t in enumerate(self.targets)]
        rows += [(f, t, float(self.coef[i, k])) for i, f in enumerate(self.features)
                 for k, t in enumerate(self.targets)]
        return spark.createDataFrame(rows, "term string, target string, coef double")


@dataclass
class Moments:
    """n, sums and cross-products of the distances from ``centre``."""

    n: float
    s: np.ndarray
    m: np.ndarray
    centre: np.ndarray

    def minus(self, other: "Moments") -> "Moments":
        return Moments(self.n - other.n, self.s - other.s, self.m - other.m, self.centre)


def _stat_aggs(cols, centre) -> list:
    far = [F.col(c).cast("double") - F.lit(float(x)) for c, x in zip(cols, centre)]
    p = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(x).alias(f"s_{i}") for i, x in enumerate(far)]
    aggs += [F.sum(far[i] * far[j]).alias(f"p_{i}_{j}") for i in range(p) for j in range(i, p)]
    return aggs


def _to_moments(row, centre: np.ndarray) -> Moments:
    p = len(centre)
    s = np.array([row[f"s_{i}"] or 0.0 for i in range(p)])
    m = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            m[i, j] = m[j, i] = row[f"p_{i}_{j}"] or 0.0
    return Moments(float(row["n"]), s, m, centre)


def sufficient_stats(df: DataFrame, features, targets, by: str | None = None):
    """Moments over complete cases; {group: Moments} with ``by``.

    A first small aggregate gives the means; products of distances from them keep
    their digits however far the columns lie from zero, and groups that share this
    centre can be added and subtracted."""
    cols = list(features) + list(targets)
    cc = complete_cases(df, cols)
    means = cc.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(cols)]).first()
    centre = np.array([means[f"m_{i}"] or 0.0 for i in range(len(cols))])
    if by is None:
        return _to_moments(cc.agg(*_stat_aggs(cols, centre)).first(), centre)
    rows = cc.groupBy(by).agg(*_stat_aggs(cols, centre)).collect()  # one row per group (k folds)
    return {r[by]: _to_moments(r, centre) for r in rows}


def total(per_group: dict) -> Moments:
    """Sum of the moments of groups with one centre."""
    parts = list(per_group.values())
    return Moments(sum(x.n for x in parts), sum(x.s for x in parts), sum(x.m for x in parts),
                   parts[0].centre)


def solve(x: Moments, n_features: int, alpha: float = 0.0, fit_intercept: bool = True):
    """Ridge (alpha > 0) or OLS normal equations; intercept not penalised."""
    p = n_features
    if fit_intercept:
        mean = x.s / x.n
        c = x.m - x.n * np.outer(mean, mean)
        mean = mean + x.centre
    else:
        mean = np.zeros_like(x.s)
        c = (x.m + np.outer(x.centre, x.s) + np.outer(x.s, x.centre)
             + x.n * np.outer(x.centre, x.centre))
    sxx, sxy = c[:p, :p], c[:p, p:]
    coef = np.linalg.lstsq(sxx + alpha * np.eye(p), sxy, rcond=None)[0]
    return coef, mean[p:] - mean[:p] @ coef


# Sweeps over all coefficients at most, and the change (in units of a column's spread
# of the target) below which a sweep has settled.
SWEEPS, STILL = 100_000, 1e-13


def solve_lasso(x: Moments, n_features: int, alpha: float):
    """Least 1/(2n) ||y - Xw||^2 + alpha ||w||_1 for each target by coordinate descent;
    intercept not penalised. A constant feature gets 0."""
    p = n_features
    mean = x.s / x.n
    c = x.m / x.n - np.outer(mean, mean)
    mean = mean + x.centre
    sxx, sxy, spread = c[:p, :p], c[:p, p:], np.diag(c)
    coef = np.zeros_like(sxy)
    steady = spread[:p] > 1e-12 * max(spread[:p].max(initial=0.0), 1e-300)
    for t in range(sxy.shape[1]):
        w, scale = coef[:, t], np.sqrt(max(spread[p + t], 1e-300))
        slope = sxy[:, t].copy()  # of the smooth part, negated: sxy - sxx w
        for _ in range(SWEEPS):
            moved = 0.0
            for j in np.flatnonzero(steady):
                aim = slope[j] + sxx[j, j] * w[j]
                new = np.sign(aim) * max(abs(aim) - alpha, 0.0) / sxx[j, j]
                if new != w[j]:
                    slope -= sxx[:, j] * (new - w[j])
                    moved = max(moved, abs(new - w[j]) * np.sqrt(sxx[j, j]) / scale)
                    w[j] = new
            if moved <= STILL:
                break
    return coef, mean[p:] - mean[:p] @ coef


def _model(x: Moments, features, targets, alpha: float, fit_intercept: bool = True,
           penalty: str = "ridge") -> LinearModel:
    if penalty == "lasso":
        coef, b = solve_lasso(x, len(features), alpha)
    else:
        coef, b = solve(x, len(features), alpha, fit_intercept)
    return LinearModel(list(features), list(targets), coef, b, alpha)


def fit_linear(df: DataFrame, features, targets, alpha: float = 0.0,
               fit_intercept: bool = True) -> LinearModel:
    return _model(sufficient_stats(df, features, targets), features, targets, alpha, fit_intercept)


def fit_lasso(df: DataFrame, features, targets, alpha: float) -> LinearModel:
    """Lasso of every target from one aggregate."""
    return _model(sufficient_stats(df, features, targets), features, targets, alpha, penalty="lasso")


def lasso_conditions(df: DataFrame, model: LinearModel) -> DataFrame:
    """(term, target, coef, slope): each feature's mean product with the residual, from
    the rows themselves. At the optimum it is alpha times the sign of a coefficient that
    is not 0, and at most alpha in size for one that is."""
    cc = complete_cases(df, model.features + model.targets)
    left = [(F.col(t).cast("double") - model.prediction(t)) for t in model.targets]
    sums = cc.agg(*[F.avg(F.col(f).cast("double") * r).alias(f"g_{i}_{k}") for i, f in enumerate(model.features)
                    for k, r in enumerate(left)])
    return sums.select(F.inline(F.array(*[F.struct(
        F.lit(f).alias("term"), F.lit(t).alias("target"), F.lit(float(model.coef[i, k])).alias("coef"),
        F.col(f"g_{i}_{k}").alias("slope")) for i, f in enumerate(model.features)
        for k, t in enumerate(model.targets)])))


def fold_models(per_fold: dict, features, targets, alpha: float, penalty: str = "ridge") -> dict:
    """Per fold the model of all other folds (total minus the fold)."""
    whole = total(per_fold)
    return {f: _model(whole.minus(x), features, targets, alpha, penalty=penalty) for f, x in per_fold.items()}


def fold_scores(df: DataFrame, models: dict, features, targets, fold_col: str) -> DataFrame:
    """Metrics per fold, each row predicted by the model that did not see it: one pass."""
    from aeris.operators.metrics import regression_metrics
    cc = complete_cases(df, list(features) + list(targets))
    preds = []
    for t in targets:
        expr = None
        for f, mdl in models.items():
            expr = F.when(F.col(fold_col) == f, mdl.prediction(t)) if expr is None \
                else expr.when(F.col(fold_col) == f, mdl.prediction(t))
        preds.append(expr.alias(f"pred_{t}"))
    scored = cc.select(fold_col, *targets, *preds)
    return regression_metrics(scored, targets, [f"pred_{t}" for t in targets], by=fold_col)


def fold_means(fold_metrics: DataFrame) -> DataFrame:
    """Mean mse, rmse and r2 over the folds, as one row."""
    return fold_metrics.agg(*[F.avg(c).alias(c) for c in ("mse", "rmse", "r2")])


def cross_validate(df: DataFrame, features, targets, fold_col: str = "fold", alpha: float = 0.0,
                   penalty: str = "ridge"):
    """k fits from one grouped aggregate; (per-fold metrics, still lazy, and models)."""
    models = fold_models(sufficient_stats(df, features, targets, by=fold_col), features, targets, alpha, penalty)
    return fold_scores(df, models, features, targets, fold_col), models


def fit_with_cv(df: DataFrame, features, targets, fold_col: str = "fold", alpha: float = 0.0,
                refit: str = "all", penalty: str = "ridge"):
    """Cross-validate, then return (model, fold metrics).

    ``refit='all'`` takes the model of every row, from the sum of the fold
    statistics; ``'last_fold'`` keeps the last fold's model, as the reference's
    linear script does."""
    per_fold = sufficient_stats(df, features, targets, by=fold_col)
    models = fold_models(per_fold, features, targets, alpha, penalty)
    chosen = models[max(models)] if refit == "last_fold" else _model(
        total(per_fold), features, targets, alpha, penalty=penalty)
    return chosen, fold_scores(df, models, features, targets, fold_col)


def _residual_r2(x: Moments, model: LinearModel) -> np.ndarray:
    """R2 of a model per target, from moments alone (1 or 0 for a constant target)."""
    p, out = len(model.features), []
    for k in range(len(model.targets)):
        w = np.concatenate([-model.coef[:, k], np.eye(len(model.targets))[k]])
        shift = w @ x.centre - model.intercept[k]  # residual at the centre
        rss = w @ x.m @ w + 2 * shift * (w @ x.s) + x.n * shift * shift
        tss = x.m[p + k, p + k] - x.s[p + k] ** 2 / x.n
        out.append(1 - rss / tss if tss > 0 else float(abs(rss) < 1e-12))
    return np.array(out)


# Ridge: beyond this many times the largest eigenvalue of X'X every coefficient is
# below its millionth part, and a larger alpha cannot move the scores any more.
SHRUNK = float(1 << 20)


def overfit_search(train: DataFrame, test: DataFrame, features, targets, fold_col: str = "fold",
                   alpha: float = 1.0, gap: float = 0.1, penalty: str = "ridge"):
    """While |R2_cv - R2_test| > gap, double alpha and refit.

    Only alpha changes, so the statistics are taken once and every round is
    arithmetic on them. Doubling ends when the gap is met, or when no alpha can meet
    it: for ridge once alpha exceeds ``SHRUNK`` times the largest eigenvalue of the
    training rows' X'X, for lasso once all coefficients are 0, without a penalty
    (alpha 0) at once. Returns a list of (round, alpha, cv_r2, test_r2, converged)."""
    per_fold = sufficient_stats(train, features, targets, by=fold_col)
    unseen = sufficient_stats(test, features, targets)
    whole, p = total(per_fold), len(features)
    centred = whole.m - np.outer(whole.s, whole.s) / whole.n
    largest = float(np.linalg.eigvalsh(centred[:p, :p])[-1])
    history = []
    while True:
        models = fold_models(per_fold, features, targets, alpha, penalty)
        cv = float(np.mean([_residual_r2(per_fold[f], m).mean() for f, m in models.items()]))
        held = float(_residual_r2(unseen, models[max(models)]).mean())
        met = abs(cv - held) <= gap
        history.append((len(history), float(alpha), cv, held, met))
        if penalty == "lasso":
            ended = not any(m.coef.any() for m in models.values())
        else:
            ended = alpha <= 0 or alpha > SHRUNK * largest
        if met or ended:
            return history
        alpha = alpha * 2
