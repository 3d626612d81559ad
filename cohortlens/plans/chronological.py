"""Chronological model building over successive time points (G10-G12, G19-G21,
A16-A21, G24-G26).

A *scenario* is a (training rows, test rows) pair, given as 0/1 flag columns
on one design table, so every scenario and every time point shares each
Spark pass:

* stepwise selection for all (scenario, time point) searches runs
  concurrently (``selection.stepwise_many``);
* all 10-fold CV refits are one batched fit over one cached input; the tasks
  score each row by the models that left its fold out, and the errors of every
  cell are one aggregate of those (model, y, score) rows;
* holdout confusion and AUC of every cell come from one count of unique
  (model, score).

Results are long tables keyed by (scenario, time_point); summaries (means
over time points, metric matrices) are projections/pivots of those.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.columns import order_key, safe_ratio, sigmoid
from cohortlens.operators import metrics as mt
from cohortlens.operators import svm as sv
from cohortlens.operators.features import Encoding, fit_encoding, one_hot
from cohortlens.operators.glm import Fit, Input, Judged, Spec, fit_many, model_sums, score_long
from cohortlens.operators.linear import gram_many, stepwise_gram
from cohortlens.operators.ranking import cumulative, hash_bucket
from cohortlens.operators.selection import Search, stepwise_many
from cohortlens.session import materialize

_BKT_COL = "_fold_bkt"


@dataclass
class Scenario:
    name: str
    train: str              # 0/1 column: training rows
    test: str               # 0/1 column: evaluation rows
    test2: str | None = None  # optional second evaluation set (G7)
    variant: str | None = None  # preparation variant (G24)


@dataclass
class Design:
    """Prepared rows + treatment dummies + scenario flags + per-scenario folds."""
    df: DataFrame
    encoding: Encoding
    terms: dict[str, list[str]]          # formula term -> design columns
    label: str
    scenarios: list[Scenario]

    def fold_col(self, s: Scenario) -> str:
        """The folds of the scenario's training rows; scenarios that share these name one column, so that their models are the same."""
        return f"fold_{next(x.name for x in [*self.scenarios, s] if x.train == s.train)}"


def build_design(df: DataFrame, factors: Sequence[str], numerics: Sequence[str], label: str,
                 scenarios: Sequence[Scenario], k: int = 10, id_col: str = "id", seed=1) -> Design:
    """Encode factors once on the full table (same columns for every
    scenario), and give each scenario's training rows balanced folds."""
    enc = fit_encoding(df, factors)
    out = one_hot(df, enc, keep_factors=True)
    # one two-level running count over a single md5 order, with every
    # scenario's training flag as a value column: each row's running count of
    # its own training set is its rank there, so one window assigns the
    # balanced folds of all scenarios
    flags = sorted({s.train for s in scenarios})
    keyed = out.withColumn("_key", order_key(id_col, seed)).withColumn(_BKT_COL, hash_bucket("_key"))
    ranked = cumulative(keyed, ["_key"], flags, bucket=_BKT_COL, with_total=False, suffix="_rk")
    out = ranked.withColumns({f"fold_{s.name}": F.when(F.col(s.train) == 1, F.pmod(F.col(f"{s.train}_rk") - 1,
                                                                                   F.lit(k))).cast("int")
                              for s in scenarios}).drop("_key", _BKT_COL, *[f"{f}_rk" for f in flags])
    terms = {f: enc.columns[f] for f in factors}
    terms.update({c: [c] for c in numerics})
    return Design(materialize(out), enc, terms, label, list(scenarios))


def _cells(design: Design, sets: Sequence[Sequence[str]]):
    for s in design.scenarios:
        for t, terms in enumerate(sets, start=1):
            yield s, t, list(terms)


def _cell(s: Scenario, t: int) -> str:
    return f"{s.name}#{t}"


def misclassification(y, p):
    """The reference's CV cost: ``mean(abs(y - p) > 0.5)`` (per-row part)."""
    return (F.abs(y - p) > F.lit(0.5)).cast("double")


def chronological_logistic(design: Design, sets: Sequence[Sequence[str]], pi: float = 0.5,
                           k: int = 10, prior_tau: float | None = None, cost=misclassification,
                           max_rounds: int = 100) -> tuple[DataFrame, DataFrame]:
    """Per (scenario, time point): stepAIC from the time point's
    full formula, then ``evaluate_logistic`` of the selected model.

    Returns (results, selected_terms) DataFrames.
    """
    searches = {_cell(s, t): Search(design.terms, terms, include=s.train) for s, t, terms in _cells(design, sets)}
    stepwise_many(design.df, searches, design.label, "binomial", max_rounds=max_rounds)
    models = [Evaluated(s, t, (found := searches[_cell(s, t)]).fit, len(found.path) - 1, found.done) for s, t, _ in _cells(design, sets)]
    return evaluate_logistic(design, models, pi, k, prior_tau, cost)


@dataclass
class Evaluated:
    """A fitted model of a scenario and time point; ``finished``: its search has ended by itself."""
    scenario: Scenario
    time_point: int
    fit: Fit
    steps: int = 0
    finished: bool = True


def evaluate_logistic(design: Design, models: Sequence[Evaluated], pi: float = 0.5, k: int = 10,
                      prior_tau: float | None = None, cost=misclassification) -> tuple[DataFrame, DataFrame]:
    """G3 + G4 for many fitted models at once.

    Computes the 10-fold CV error -- the mean over training rows of ``cost(y,
    p_out_of_fold)``, a user Column function (F1; default misclassification) --
    with all refits in one batch, holdout confusion at ``p > pi`` and exact
    holdout AUC.  Scores come from the tasks as (model, y, score) rows, those of
    the CV refits only for the fold that each left out; the costs are one
    grouped aggregate of them, confusion and AUC share the holdout's counts
    of unique scores.  ``prior_tau``: score prior-corrected probabilities (G16).
    ``converged`` is true if the fit and its k refits did, ``finished`` if the
    search did.
    """
    y, spark = design.label, design.df.sparkSession
    cv_specs = {f"{i}|{j}": Spec(tuple(m.fit.names[1:]), include=m.scenario.train, fold_col=design.fold_col(m.scenario), exclude_fold=j)
                for i, m in enumerate(models) for j in range(k)}
    shift = dict.fromkeys([m.scenario.name for m in models], 0.0)
    if prior_tau is not None:  # class-0 share of the scored (test) rows, as the reference does
        shares = design.df.agg(*[F.avg(F.when(F.col(s.test) == 1, (F.col(y) == 0).cast("double"))).alias(s.name) for s in design.scenarios]).first()
        shift = {s.name: prior_shift(prior_tau, shares[s.name]) for s in design.scenarios}
    with Input(design.df, cv_specs, y) as data:
        refits = fit_many(data, cv_specs, y, "binomial")
        folds = [{j: refits[f"{i}|{j}"] for j in range(k)} for i in range(len(models))]
        out_of_fold = [Judged(Spec(tuple(m.fit.names[1:])), rows=m.scenario.train, folds=folds[i], fold_col=design.fold_col(m.scenario), response=True)
                       for i, m in enumerate(models)]
        errors = {r["model"]: r["cv"] for r in score_long(data.df, out_of_fold, y).groupBy("model")
                  .agg(F.avg(cost(F.col("y"), F.col("score"))).alias("cv")).collect()}
    held_out = [Judged(Spec(tuple(m.fit.names[1:])), m.fit, m.scenario.test, shift=shift[m.scenario.name], response=True) for m in models]
    counts = materialize(mt.score_counts(score_long(design.df, held_out, y), "y", "score", ["model"]))
    confusion = {r["model"]: r for r in mt.confusion_of_counts(counts, ["model"], pi).collect()}
    aucs = {r["model"]: r["auc"] for r in mt.auc_of_counts(counts, ["model"]).collect()}
    rows, sel = [], []
    for i, m in enumerate(models):
        cells = confusion.get(i)
        rows.append((m.scenario.name, m.time_point, float(m.fit.aic()), errors.get(i), *[int(cells[c]) if cells else 0 for c in mt.CELLS],
                     aucs.get(i), int(m.steps), m.fit.converged and all(f.converged for f in folds[i].values()), m.finished))
        sel += [(m.scenario.name, m.time_point, col) for col in m.fit.names[1:]]
    res = spark.createDataFrame(rows, "scenario string, time_point int, aic double, cv_error double, tn long, fn long, fp long, tp long, "
                                      "auc double, steps int, converged boolean, finished boolean")
    return mt.with_metrics(res), spark.createDataFrame(sel, "scenario string, time_point int, term string")


def prior_shift(tau: float, ybar: float | None) -> float:
    """G16 on the link scale: ln(((1 - tau)/tau) * (ybar/(1 - ybar))), 0 where a class is absent."""
    return math.log((1.0 - tau) / tau * (ybar / (1.0 - ybar))) if ybar is not None and 0.0 < ybar < 1.0 else 0.0


def _prior_corrected(p, tau: float, ybar):
    """logit' = logit(p) - ln(((1 - tau)/tau) * (ybar/(1 - ybar)))."""
    c = F.ln(F.lit((1.0 - tau) / tau) * (ybar / (F.lit(1.0) - ybar)))
    # logit(0) = -Inf and logit(1) = +Inf keep the probability at 0 / 1
    return (F.when(p <= F.lit(0.0), F.lit(0.0)).when(p >= F.lit(1.0), F.lit(1.0))
            .otherwise(sigmoid(F.ln(p / (F.lit(1.0) - p)) - c)))


def chronological_linear(design: Design, sets: Sequence[Sequence[str]], response: str,
                         mark: float = 50.0, k: int = 10, last_time_point: int = 7) -> tuple[DataFrame, DataFrame]:
    """Per (scenario, time point): stepAIC on the factors, adjusted R^2,
    10-fold CV MSE, and the holdout regression-as-classifier counts (A10/A11).

    One factor pass for all scenarios and folds; all holdout counts and squared
    errors are summed in the tasks, each row by the models that test on it.
    ``last_time_point`` names the model the reference keeps; ``finished`` is
    true if the search ended by itself.
    """
    df = design.df
    spark = df.sparkSession
    cols_all = sorted({c for cs in design.terms.values() for c in cs})
    grams = gram_many(df, cols_all, response, {s.name: (s.train, design.fold_col(s)) for s in design.scenarios})
    found, sel = [], []
    for s in design.scenarios:
        g = grams[s.name]
        for t, terms in enumerate(sets, start=1):
            chosen, f, path = stepwise_gram(g, design.terms, list(terms))
            cols = [c for tm in chosen for c in design.terms[tm]]
            found.append((s, t, f, g.cv_mse(cols), len(path) - 1))
            sel += [(s.name, t, c) for c in cols]
    judged, place = [], {}
    for i, (s, t, f, _, _) in enumerate(found):
        for tag, flag in (("", s.test), ("t2_", s.test2)):
            if flag:
                place[i, tag] = len(judged)
                judged.append(Judged(Spec(tuple(f.names[1:])), f, flag))

    def counts(_, y, pred):
        low, miss = y < mark, pred < mark
        return [(low & miss).sum(), (low & ~miss).sum(), (~low & miss).sum(), (~low & ~miss).sum(), ((y - pred) ** 2).sum()]

    sums = model_sums(df, judged, response, 5, counts)

    def cells_of(i, tag):
        if (i, tag) not in place:
            return [None] * 5
        *cells, sse = sums[place[i, tag]]
        n = sum(cells)
        return [*map(int, cells), float(sse / n) if n else None]

    rows = [(s.name, t, float(f.extra["adj_r2"]), float(cv), *cells_of(i, ""), *cells_of(i, "t2_"), steps, t == last_time_point,
             bool(f.extra["finished"])) for i, (s, t, f, cv, steps) in enumerate(found)]
    res = spark.createDataFrame(rows, "scenario string, time_point int, adj_r2 double, cv_mse double, "
                                      "true_fail long, false_pass long, false_fail long, true_pass long, "
                                      "test_mse double, t2_true_fail long, t2_false_pass long, "
                                      "t2_false_fail long, t2_true_pass long, t2_test_mse double, "
                                      "steps int, last_model boolean, finished boolean")
    for tag in ("", "t2_"):
        tf, fp, ff, tp = (F.col(f"{tag}{c}") for c in ("true_fail", "false_pass", "false_fail", "true_pass"))
        res = res.withColumns({f"{tag}accuracy": safe_ratio(tf + tp, tf + tp + fp + ff),
                               f"{tag}specificity": safe_ratio(tf, tf + fp),
                               f"{tag}npv": safe_ratio(tf, tf + ff), f"{tag}sensitivity": safe_ratio(tp, tp + ff)})
    return res, spark.createDataFrame(sel, "scenario string, time_point int, term string")


def expanded(design: Design, terms: Sequence[str]) -> list[str]:
    return [c for t in terms for c in design.terms[t]]


def chronological_svm(design: Design, sets: Sequence[Sequence[str]], cells: Mapping[str, Mapping[str, tuple[float, float]]],
                      w_fail: float = 1.0, w_pass: float = 1.0, dim: int = 64, seed: int = 1) -> DataFrame:
    """Per (cell, scenario, time point) an RFF squared-hinge SVM with class
    weights; holdout confusion from the decision sign and AUC.  ``cells``: name
    -> {scenario: (gamma, cost)}, such as the tuned and the fixed setting.  All
    models are fitted in one batched run."""
    keys, specs = [], {}
    for name, settings in cells.items():
        for s, t, terms in _cells(design, sets):
            if s.name in settings:
                key = f"{name}|{_cell(s, t)}"
                specs[key] = sv.svm_spec(expanded(design, terms), *settings[s.name], dim, seed, include=s.train, class_weights=(w_fail, w_pass))
                keys.append((key, s, t, name))
    fits = sv.fit_svms(design.df, specs, design.label)
    res = _svm_eval(design, specs, fits, [(k, s, t) for k, s, t, _ in keys])
    names = design.df.sparkSession.createDataFrame([(i, name) for i, (*_, name) in enumerate(keys)], "model int, cell string")
    return res.join(F.broadcast(names), "model").drop("model")


def _svm_eval(design: Design, specs, fits, cells) -> DataFrame:
    """Holdout confusion (decision sign) and AUC per cell, from one count of
    unique decisions.  A logistic map keeps their order, so the AUC of Platt
    probabilities is that of the decisions."""
    judged = [Judged(specs[k], fits[k], s.test) for k, s, _ in cells]
    counts = materialize(mt.score_counts(score_long(design.df, judged, design.label), "y", "score", ["model"]))
    confusion = {r["model"]: r for r in mt.confusion_of_counts(counts, ["model"], 0.0).collect()}
    aucs = {r["model"]: r["auc"] for r in mt.auc_of_counts(counts, ["model"]).collect()}
    rows = [(i, s.name, t, *[int(confusion[i][c]) if i in confusion else 0 for c in mt.CELLS], aucs.get(i), fits[k].converged)
            for i, (k, s, t) in enumerate(cells)]
    return mt.with_metrics(design.df.sparkSession.createDataFrame(
        rows, "model int, scenario string, time_point int, tn long, fn long, fp long, tp long, auc double, converged boolean"))


def class_weight_sweep(design: Design, terms: Sequence[str], gamma: float, cost: float,
                       pass_weights: Sequence[float], fail_weights: Sequence[float], dim: int = 64,
                       seed: int = 1) -> DataFrame:
    """One SVM per (pass, fail) weight pair on a fixed feature set; the
    pairs are fitted together in one batched run."""
    cols = expanded(design, terms)
    cells, specs = [], {}
    for s in design.scenarios:
        for i, (wp, wf) in enumerate(zip(pass_weights, fail_weights), start=1):
            specs[_cell(s, i)] = sv.svm_spec(cols, gamma, cost, dim, seed, include=s.train, class_weights=(wf, wp))
            cells.append((_cell(s, i), s, i))
    fits = sv.fit_svms(design.df, specs, design.label)
    res = _svm_eval(design, specs, fits, cells).drop("model")
    wdf = spark_weights(design.df.sparkSession, pass_weights, fail_weights)
    return res.withColumnRenamed("time_point", "weighting").join(F.broadcast(wdf), "weighting")


def spark_weights(spark: SparkSession, pass_weights, fail_weights) -> DataFrame:
    return spark.createDataFrame([(i, float(p), float(f)) for i, (p, f) in
                                  enumerate(zip(pass_weights, fail_weights), start=1)],
                                 "weighting int, pass_weight double, fail_weight double")


def tune_grid(design: Design, terms: Sequence[str], costs: Sequence[float], gammas: Sequence[float],
              k: int = 10, dim: int = 64, seed: int = 1) -> DataFrame:
    """Cost x gamma grid, k-fold CV misclassification per cell.

    All (scenario, gamma, cost, fold) models are one batched Newton run over
    one cached input; the out-of-fold errors are counted in the tasks, each
    row by the models that left its fold out.  Output: one row per (scenario,
    gamma, cost); ``converged`` if all its k models did.
    """
    cols = expanded(design, terms)
    grid = [(s, gi, gamma, c) for s in design.scenarios for gi, gamma in enumerate(gammas) for c in costs]
    specs = {f"{i}|{j}": sv.svm_spec(cols, gamma, c, dim, seed, include=s.train, fold_col=design.fold_col(s), exclude_fold=j)
             for i, (s, _, gamma, c) in enumerate(grid) for j in range(k)}
    with Input(design.df, specs, design.label) as data:
        fits = sv.fit_svms(data, specs, design.label)
        judged = [Judged(specs[f"{i}|0"], rows=s.train, folds={j: fits[f"{i}|{j}"] for j in range(k)}, fold_col=design.fold_col(s))
                  for i, (s, *_) in enumerate(grid)]
        errors = sv.cv_errors(data.df, judged, design.label)
    return design.df.sparkSession.createDataFrame(
        [(s.name, gi + 1, float(gamma), float(c), errors[i], all(fits[f"{i}|{j}"].converged for j in range(k)))
         for i, (s, gi, gamma, c) in enumerate(grid)],
        "scenario string, gamma_index int, gamma double, cost double, error double, converged boolean")


def best_cells(grid: DataFrame) -> DataFrame:
    """Arg-best (lowest error; ties -> smaller cost, then smaller gamma)."""
    best = F.min(F.struct("error", "cost", "gamma")).alias("b")
    return grid.groupBy("scenario").agg(best).select("scenario", "b.gamma", "b.cost", "b.error")


def tuning_slices(grid: DataFrame) -> DataFrame:
    """Error by gamma for each cost (pivot of the grid)."""
    return grid.groupBy("scenario", "gamma").pivot("cost").agg(F.first("error"))


def appearance(selected: DataFrame, first_tp: DataFrame, n_time_points: int) -> DataFrame:
    """A20 + A21: in how many time points each term was selected, and that
    count over the number of time points it could appear in
    (``n_time_points + 1 - first time point``); zero-count terms dropped."""
    counts = selected.groupBy("scenario", "term").agg(F.countDistinct("time_point").alias("appearances"))
    out = counts.join(F.broadcast(first_tp), "term")
    return out.withColumn("proportion", F.col("appearances") / (F.lit(n_time_points + 1) - F.col("first_time_point")))


def first_time_points(spark: SparkSession, design: Design, sets: Sequence[Sequence[str]]) -> DataFrame:
    seen = {}
    for t, terms in enumerate(sets, start=1):
        for tm in terms:
            for c in design.terms[tm]:
                seen.setdefault(c, t)
    return spark.createDataFrame(sorted(seen.items()), "term string, first_time_point int")


def performance_summary(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("scenario",)) -> DataFrame:
    """Mean of each metric over the time points of each scenario
    (and preparation variant or model setting, named in ``by``)."""
    return results.groupBy(*by).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])


def metric_matrix(results: DataFrame, metric: str) -> DataFrame:
    """One metric as a scenario x time-point matrix."""
    return results.groupBy("scenario").pivot("time_point").agg(F.first(metric))


def per_time_point_rates(results: DataFrame) -> DataFrame:
    """A18 + A19: false fails/passes per time point and as a share of the
    actual test size (not a hard-coded 378)."""
    n = F.col("tn") + F.col("fn") + F.col("fp") + F.col("tp")
    return results.select("scenario", "time_point", F.col("fn").alias("false_fails"), F.col("fp").alias("false_passes"),
                          safe_ratio(F.col("fn"), n).alias("false_fail_rate"), safe_ratio(F.col("fp"), n).alias("false_pass_rate"))


def pair_means(perf: DataFrame, pairs: Mapping[str, Sequence[str]], metrics: Sequence[str]) -> DataFrame:
    """Mean of two (or more) runs' summaries, e.g. two test years."""
    spark = perf.sparkSession
    pdf = spark.createDataFrame([(p, s) for p, ss in pairs.items() for s in ss], "pair string, scenario string")
    return perf.join(F.broadcast(pdf), "scenario").groupBy("pair").agg(
        *[F.avg(m).alias(m) for m in metrics])
