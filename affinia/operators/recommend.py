"""Recommenders over ballot cells, hold-out splits and ranking metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinia.functions.hashing import key
from affinia.functions.numeric import clip
from affinia.sources.shared import free, mark, written

MAX_POINTS = 12.0
#: The published settings of each model, in the order of the comparison.
MODELS = {
    "baseline_global_mean": {},
    "baseline_voter_mean": {},
    "bias_only_entry_quality": {},
    "neighborhood_cf": {"n_neighbors": 10, "shrinkage": 25.0, "min_overlap": 30},
    "implicit_als_hkv": {"n_factors": 16, "reg": 20.0, "alpha": 1.0},
    "matrix_factorization_als": {"n_factors": 4, "reg": 20.0},
}
#: The pairs of model and reference that are tested over ballots, and the seeds of repeated splits.
COMPARISONS = [
    ("matrix_factorization_als", "baseline_voter_mean"),
    ("matrix_factorization_als", "bias_only_entry_quality"),
    ("neighborhood_cf", "bias_only_entry_quality"),
    ("implicit_als_hkv", "bias_only_entry_quality"),
]
SEEDS = (42, 7, 13, 2021, 99)


def _beside(df: DataFrame, one: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """df with the columns of ``one``, which has a row for each value of ``by``, a single one if that is empty."""
    return df.join(F.broadcast(one), list(by)) if by else df.crossJoin(F.broadcast(one))


def splits(cells: DataFrame, seeds: Sequence[int], share: float = 0.2) -> DataFrame:
    """cells with ``seed`` and ``is_test``, once for each seed: whole voter-years are held out, those first by md5 of
    seed and name."""
    draws = cells.sparkSession.createDataFrame([(x,) for x in seeds], "seed int")
    groups = cells.select("voter_year").distinct().crossJoin(F.broadcast(draws))
    own = Window.partitionBy("seed")
    n = F.count(F.lit(1)).over(own)
    rank = F.row_number().over(own.orderBy(key(F.col("seed"), F.col("voter_year")), "voter_year"))
    chosen = groups.select("voter_year", "seed", (rank <= F.greatest(F.lit(1), F.round(n * share))).alias("is_test"))
    return cells.join(chosen, "voter_year")


def split(cells: DataFrame, seed: int, share: float = 0.2) -> DataFrame:
    """cells with ``is_test``, for one seed."""
    return splits(cells, [seed], share).drop("seed")


def aggregated(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., voter, entry, points): the rounds of a voter-year as their mean."""
    return cells.groupBy(*by, "voter", "entry").agg(F.avg("points").alias("points"))


def encoder(values: DataFrame, column: str) -> DataFrame:
    """(column, idx): contiguous numbers from 0 in the order of the names, of a small dimension."""
    return values.select(column).distinct().select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias("idx"))


def mean_predictions(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Test cells with the global mean and the voter's mean (global for a new voter) of the train cells."""
    train = cells.filter(~F.col("is_test"))
    mu = train.groupBy(*by).agg(F.avg("points").alias("mu"))
    own = train.groupBy(*by, "voter").agg(F.avg("points").alias("vm"))
    out = _beside(cells.filter("is_test"), mu, by).join(own, [*by, "voter"], "left")
    return out.withColumns({"global_mean": F.col("mu"), "voter_mean": F.coalesce("vm", "mu")}).drop("mu", "vm")


def biases(train: DataFrame, reg_voter: float = 10.0, reg_entry: float = 5.0, rounds: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., kind, name, bias) with kinds mu, voter and entry: damped alternating means, entries first.

    The aggregated cells (voters x entries) and the result are written tables, so that rounds don't scan
    ballots anew and what builds on the biases has a short plan.
    """
    agg = written(aggregated(train, by), "cells")
    mu = agg.groupBy(*by).agg(F.avg("points").alias("mu"))
    centred = _beside(agg, mu, by).select(*by, "voter", "entry", (F.col("points") - F.col("mu")).alias("r"))
    voter = centred.select(*by, "voter").distinct().withColumn("bias", F.lit(0.0))
    entry = None
    for _ in range(rounds):
        entry = centred.join(voter, [*by, "voter"]).groupBy(*by, "entry").agg((F.sum(F.col("r") - F.col("bias")) / (F.count(F.lit(1)) + reg_entry)).alias("bias"))
        voter = centred.join(entry, [*by, "entry"]).groupBy(*by, "voter").agg((F.sum(F.col("r") - F.col("bias")) / (F.count(F.lit(1)) + reg_voter)).alias("bias"))
    out = mu.select(*by, F.lit("mu").alias("kind"), F.lit("").alias("name"), F.col("mu").alias("bias"))
    out = out.union(voter.select(*by, F.lit("voter"), "voter", "bias")).union(entry.select(*by, F.lit("entry"), "entry", "bias"))
    return written(out, "biases")


def bias_term(cells: DataFrame, fitted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """cells with ``base``: mu + voter bias + entry bias, an unknown name counting 0."""
    part = lambda kind, name: fitted.filter(F.col("kind") == kind).select(*by, F.col("name").alias(name), F.col("bias").alias(f"b_{name}"))
    out = _beside(cells, fitted.filter("kind = 'mu'").select(*by, F.col("bias").alias("mu")), by)
    out = out.join(part("voter", "voter"), [*by, "voter"], "left").join(part("entry", "entry"), [*by, "entry"], "left")
    base = F.col("mu") + F.coalesce("b_voter", F.lit(0.0)) + F.coalesce("b_entry", F.lit(0.0))
    return out.withColumn("base", base).drop("mu", "b_voter", "b_entry")


def bias_predictions(cells: DataFrame, fitted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return bias_term(cells, fitted, by).withColumn("prediction", clip(F.col("base"), 0.0, MAX_POINTS)).drop("base")


def residuals(train: DataFrame, fitted: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return bias_term(aggregated(train, by), fitted, by).select(*by, "voter", "entry", (F.col("points") - F.col("base")).alias("r"))


def voter_similarity(res: DataFrame, shrink: float = 25.0, least: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., voter, other, sim): cosine of residual rows, shrunk by overlap; 0 under the least overlap."""
    norm = res.groupBy(*by, "voter").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    right = res.withColumnsRenamed({"voter": "other", "r": "ro"})
    both = res.join(right, [*by, "entry"]).filter("voter <> other").groupBy(*by, "voter", "other").agg(F.sum(F.col("r") * F.col("ro")).alias("dot"), F.count(F.lit(1)).alias("n"))
    both = both.join(norm, [*by, "voter"]).join(norm.withColumnsRenamed({"voter": "other", "norm": "no"}), [*by, "other"])
    sim = F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("no")), F.lit(0.0)) * F.col("n") / (F.col("n") + shrink)
    return both.select(*by, "voter", "other", F.when(F.col("n") >= least, sim).otherwise(0.0).alias("sim"))


def knn_predictions(cells: DataFrame, train: DataFrame, fitted: DataFrame, k: int = 10, shrink: float = 25.0, least: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Bias prediction plus the weighted residuals of the k most similar voters who have the entry."""
    res = written(residuals(train, fitted, by), "residuals")
    sims = written(voter_similarity(res, shrink, least, by).filter("sim <> 0"), "voter-similarity")
    asked = cells.select(*by, "voter", "entry").distinct()
    near = asked.join(sims, [*by, "voter"]).join(res.withColumnsRenamed({"voter": "other", "r": "ro"}), [*by, "other", "entry"])
    w = Window.partitionBy(*by, "voter", "entry").orderBy(F.desc(F.round(F.abs("sim"), 12)), "other")
    near = near.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    term = near.groupBy(*by, "voter", "entry").agg((F.sum(F.col("sim") * F.col("ro")) / F.sum(F.abs("sim"))).alias("adjust"))
    out = bias_term(cells, fitted, by).join(term, [*by, "voter", "entry"], "left")
    return out.withColumn("prediction", clip(F.col("base") + F.coalesce("adjust", F.lit(0.0)), 0.0, MAX_POINTS)).drop("base", "adjust")


def ranks(scored: DataFrame, seed: int | Column, *keys: str, prediction: str = "prediction") -> DataFrame:
    """Places of a ballot's cells by prediction (rp) and by points (ra), within the keys. Ties of predictions go
    by md5, so that a constant one ranks at random; ties of points by name, whatever the predictions."""
    tie = key(seed, F.col("ballot"), F.col("recipient"))
    by = Window.partitionBy(*keys, "ballot")
    return scored.withColumns({
        "rp": F.row_number().over(by.orderBy(F.desc(F.round(prediction, 9)), tie)),
        "ra": F.row_number().over(by.orderBy(F.desc("points"), "recipient")),
    })


def ndcg(k: int) -> Column:
    """Aggregate: NDCG at k with linear gain; 0 without any gain."""
    dcg = F.sum(F.when(F.col("rp") <= k, F.col("points") / F.log2(F.col("rp") + 1)).otherwise(0.0))
    ideal = F.sum(F.when(F.col("ra") <= k, F.col("points") / F.log2(F.col("ra") + 1)).otherwise(0.0))
    return F.coalesce(F.try_divide(dcg, ideal), F.lit(0.0))


def per_ballot(scored: DataFrame, seed: int | Column, k: int = 5, *keys: str, prediction: str = "prediction") -> DataFrame:
    """(keys..., ballot, ndcg, ndcg2, precision, mse) of each ballot, at k and twice k."""
    hit = F.count_if((F.col("rp") <= k) & (F.col("ra") <= k)) / F.lit(float(k))
    return ranks(scored, seed, *keys, prediction=prediction).groupBy(*keys, "ballot").agg(
        ndcg(k).alias("ndcg"), ndcg(2 * k).alias("ndcg2"), hit.alias("precision"), F.avg(F.pow(F.col(prediction) - F.col("points"), 2)).alias("mse")
    )


def evaluation(scored: DataFrame, seed: int | Column, k: int = 5, *keys: str) -> DataFrame:
    """A row for the keys: n_cells, n_ballots, rmse, rmse_awarded, precision, ndcg, ndcg2."""
    e2 = F.pow(F.col("prediction") - F.col("points"), 2)
    errors = scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.sqrt(F.avg(e2)).alias("rmse"), F.sqrt(F.avg(F.when(F.col("points") > 0, e2))).alias("rmse_awarded"))
    own = per_ballot(scored, seed, k, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_ballots"), *(F.avg(c).alias(c) for c in ("precision", "ndcg", "ndcg2")))
    return _beside(errors, own, keys)


def format_params(params: dict[str, float]) -> str:
    """Settings as a table shows them."""
    return ", ".join(f"{k}={v:g}" for k, v in params.items())


def model_predictions(cells: DataFrame, models: Sequence[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., model, ballot, recipient, points, prediction) of the test cells by each of MODELS that is named, fitted on
    the train cells. cells: as ``split`` or, with by, ``splits`` gives them; a written table."""
    train, test = cells.filter("NOT is_test"), cells.filter("is_test")
    own: list[DataFrame] = []

    def add(name: str, df: DataFrame, prediction: str = "prediction") -> None:
        if name in models:
            own.append(df.select(*by, F.lit(name).alias("model"), "ballot", "recipient", "points", F.col(prediction).alias("prediction")))

    means = mean_predictions(cells, by)
    add("baseline_global_mean", means, "global_mean")
    add("baseline_voter_mean", means, "voter_mean")
    fitted = biases(train, by=by)
    add("bias_only_entry_quality", bias_predictions(test, fitted, by))
    if "neighborhood_cf" in models:
        own_params = MODELS["neighborhood_cf"]
        add("neighborhood_cf", knn_predictions(test, train, fitted, own_params["n_neighbors"], own_params["shrinkage"], own_params["min_overlap"], by))
    factor = [m for m in ("implicit_als_hkv", "matrix_factorization_als") if m in models]
    if factor:
        kinds = {"implicit_als_hkv": "implicit", "matrix_factorization_als": "mf"}
        runs = [(m, kinds[m], int(MODELS[m]["n_factors"]), MODELS[m]["reg"], MODELS[m].get("alpha", 0.0)) for m in factor]
        grid = cells.sparkSession.createDataFrame(runs, RUNS)
        found = factor_predictions(train, test, fitted, grid, ["ballot", "recipient"], by)
        own.append(found.select(*by, F.col("run").alias("model"), "ballot", "recipient", "points", "prediction"))
    return reduce(DataFrame.unionByName, own)


def comparison(scored: DataFrame, seed: int | Column, k: int = 5) -> DataFrame:
    """(model, params, metrics...) of each model of model_predictions."""
    own = evaluation(scored, seed, k, "model")
    params = scored.sparkSession.createDataFrame([(m, format_params(p)) for m, p in MODELS.items()], "model string, params string")
    return own.join(F.broadcast(params), "model")


def over_seeds(scored: DataFrame, k: int = 5) -> DataFrame:
    """(model, mean and standard deviation of each metric) over the seeds of model_predictions."""
    own = evaluation(scored, F.col("seed"), k, "seed", "model")
    return own.groupBy("model").agg(*(f(c).alias(f"{c}_{n}_over_seeds") for c in ("rmse", "precision", "ndcg") for n, f in (("mean", F.avg), ("std", F.stddev_samp))))


def significance(scored: DataFrame, seed: int | Column, k: int = 5, comparisons: Sequence[tuple[str, str]] = tuple(COMPARISONS)) -> DataFrame:
    """(model, reference, and the columns of paired_t): paired tests over held-out ballots, whose cells depend on each other."""
    ballots = per_ballot(scored, seed, k, "model")
    pairs = scored.sparkSession.createDataFrame(list(comparisons), "model string, reference string")
    left = ballots.join(F.broadcast(pairs), "model")
    right = ballots.withColumnRenamed("model", "reference")
    return paired_t(left, right, {"ndcg": True, "mse": False}, ("reference",), ("model",))


def paired_t(left: DataFrame, right: DataFrame, metrics: dict[str, bool], by: tuple[str, ...] = (), further: tuple[str, ...] = ()) -> DataFrame:
    """(by..., further..., metric, model_mean, reference_mean, mean_difference, model_better, t, n) over shared ballots; by is in
    both frames, further in the left one."""
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*by, "ballot")]
    both = left.alias("l").join(right.alias("r"), reduce(lambda a, b: a & b, on))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(up).alias("up"), F.col(f"l.{m}").alias("a"), F.col(f"r.{m}").alias("b")) for m, up in metrics.items()))).alias("x")
    groups = [*by, *further]
    rows = both.select(*(F.col(f"l.{c}").alias(c) for c in groups), pairs).select(*groups, "x.*")
    d = F.col("a") - F.col("b")
    out = rows.groupBy(*groups, "metric", "up").agg(F.avg("a").alias("model_mean"), F.avg("b").alias("reference_mean"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("sd"), F.count(F.lit(1)).alias("n"))
    better = F.when(F.col("up"), F.col("mean_difference") > 0).otherwise(F.col("mean_difference") < 0)
    return out.select(*groups, "metric", "model_mean", "reference_mean", "mean_difference", better.alias("model_better"), F.try_divide("mean_difference", F.col("sd") / F.sqrt("n")).alias("t"), "n")


def examples(scored: DataFrame, k: int = 5, least: int = 5) -> DataFrame:
    """Top-k recipients by prediction and by points for every voter, on mean points and on lift."""
    by_entry = Window.partitionBy("entry")
    lifted = scored.withColumns({"pl": F.col("prediction") - F.avg("prediction").over(by_entry), "al": F.col("points") - F.avg("points").over(by_entry)})
    pairs = lifted.groupBy("voter", "recipient").agg(F.avg("prediction").alias("pm"), F.avg("points").alias("am"), F.avg("pl").alias("pl"), F.avg("al").alias("al"), F.count(F.lit(1)).alias("n"))
    pairs = pairs.filter(F.col("n") >= least)
    two = F.array(F.struct(F.lit("mean_points").alias("basis"), F.col("pm").alias("p"), F.col("am").alias("a")), F.struct(F.lit("bloc_lift").alias("basis"), F.col("pl").alias("p"), F.col("al").alias("a")))
    long = pairs.select("voter", "recipient", "n", F.explode(two).alias("x")).select("voter", "recipient", "n", "x.*")
    w = Window.partitionBy("voter", "basis")
    long = long.withColumns({"rp": F.row_number().over(w.orderBy(F.desc(F.round("p", 9)), "recipient")), "ra": F.row_number().over(w.orderBy(F.desc(F.round("a", 9)), "recipient"))})
    p = long.filter(F.col("rp") <= k).select("voter", "basis", F.col("rp").alias("rank"), F.col("recipient").alias("predicted_country"), F.col("p").alias("predicted_value"), (F.col("ra") <= k).alias("predicted_in_actual_top"))
    a = long.filter(F.col("ra") <= k).select("voter", "basis", F.col("ra").alias("rank"), F.col("recipient").alias("actual_country"), F.col("a").alias("actual_value"), F.col("n").alias("actual_opportunities"))
    return p.join(a, ["voter", "basis", "rank"])


#: Rounds of a factorisation.
ROUNDS = 15
#: Columns of a grid of factor models.
RUNS = "run string, model string, factors int, reg double, alpha double"
#: Train and test cells that one task may hold; larger splits are factorised over the cluster.
TASK_CELLS = 2_000_000
#: Blocks of sums that a task keeps before it sends them on.
_BLOCKS = 4096


def first_factors(names: Sequence[str], factors: int, seed: int = 42) -> np.ndarray:
    """Small normal numbers by name, the same wherever they are drawn."""
    out = np.empty((len(names), factors))
    for row, name in zip(out, names, strict=True):
        word = int.from_bytes(hashlib.blake2b(f"{seed}:{name}".encode(), digest_size=8).digest(), "big")
        row[:] = np.random.default_rng(word).normal(0.0, 0.05, factors)
    return out


def _sums(own: np.ndarray, x: np.ndarray, weight: np.ndarray, target: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of weighted products of rows of x, and of weighted targets, by key; a bounded piece at a time."""
    f = x.shape[1]
    gram, rhs = np.zeros((n, f, f)), np.zeros((n, f))
    step = max(1, (1 << 22) // (f * f))
    for at in range(0, len(own), step):
        k, y = own[at : at + step], x[at : at + step] * weight[at : at + step, None]
        np.add.at(gram, k, y[:, :, None] * x[at : at + step, None, :])
        np.add.at(rhs, k, y * target[at : at + step, None])
    return gram, rhs


def als(rows: np.ndarray, cols: np.ndarray, target: np.ndarray, weight: np.ndarray, shape: tuple[int, int], factors: int, reg: float, rounds: int | None = None, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Alternating ridge regressions over observed cells only, rows first; the ridge isn't scaled by the counts,
    and a side without cells keeps zeros. first: the columns' factors to begin with."""
    v = first_factors([str(k) for k in range(shape[1])], factors) if first is None else first
    ridge = reg * np.eye(factors)
    for _ in range(rounds or ROUNDS):
        gram, rhs = _sums(rows, v[cols], weight, target, shape[0])
        u = np.linalg.solve(gram + ridge, rhs[:, :, None])[:, :, 0]
        gram, rhs = _sums(cols, u[rows], weight, target, shape[1])
        v = np.linalg.solve(gram + ridge, rhs[:, :, None])[:, :, 0]
    return u, v


def als_over_cluster(cells: DataFrame, factors: int, reg: float, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(name, f) of voters and of entries: the factors of ``als`` for cells (voter, entry, target, weight) of any number.

    A step joins the cells with the factors of the other side; each task adds up its blocks of products by key
    and sends on these, so that a name with many cells is added up where its cells are. Steps are written
    tables.
    """
    spark = cells.sparkSession
    cells = written(cells.select("voter", "entry", "target", "weight"), "cells")

    def blocks(it):
        names: dict[str, int] = {}
        gram, rhs = np.zeros((_BLOCKS, factors, factors)), np.zeros((_BLOCKS, factors))

        def sent() -> pd.DataFrame:
            n = len(names)
            out = pd.DataFrame({"name": list(names), "sums": [np.concatenate([g.ravel(), r]) for g, r in zip(gram[:n], rhs[:n], strict=True)]})
            names.clear()
            gram[:n], rhs[:n] = 0, 0
            return out

        for pdf in it:
            for at in range(0, len(pdf), _BLOCKS):
                part = pdf.iloc[at : at + _BLOCKS]
                if len(names) + part["own"].nunique() > _BLOCKS:
                    yield sent()
                own = np.array([names.setdefault(x, len(names)) for x in part["own"]], np.int64)
                g, r = _sums(own, np.stack(part["f"].to_numpy()), part["weight"].to_numpy(float), part["target"].to_numpy(float), len(names))
                gram[: len(names)] += g
                rhs[: len(names)] += r
        if names:
            yield sent()

    def solved(it):
        for pdf in it:
            sums = np.stack(pdf["sums"].to_numpy()) if len(pdf) else np.zeros((0, factors * factors + factors))
            gram = sums[:, : factors * factors].reshape(-1, factors, factors) + reg * np.eye(factors)
            found = np.linalg.solve(gram, sums[:, factors * factors :, None])[:, :, 0]
            yield pd.DataFrame({"name": pdf["name"], "f": list(found)})

    def first(it):
        for pdf in it:
            yield pd.DataFrame({"name": pdf["name"], "f": list(first_factors(list(pdf["name"]), factors))})

    def side(own: str, other: str, known: DataFrame) -> DataFrame:
        rows = cells.join(known.select(F.col("name").alias(other), "f"), other).select(F.col(own).alias("own"), "f", "weight", "target")
        parts = rows.mapInPandas(blocks, "name string, sums array<double>").select("name", F.posexplode("sums").alias("k", "x"))
        added = parts.groupBy("name", "k").agg(F.sum("x").alias("x")).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("s"))
        return written(added.select("name", F.transform("s", lambda y: y["x"]).alias("sums")).mapInPandas(solved, "name string, f array<double>"), "factors")

    begin = mark()
    entries = written(cells.select(F.col("entry").alias("name")).distinct().mapInPandas(first, "name string, f array<double>"), "factors")
    voters = entries
    for _ in range(rounds or ROUNDS):
        voters = side("voter", "entry", entries)
        entries = side("entry", "voter", voters)
        free(spark, begin, voters, entries)
    return voters, entries


def _model_cells(pdf, model: str, alpha: float):
    """(target, weight) of train cells: residuals, or awards weighted by their points. Arrays or columns."""
    if model == "mf":
        return pdf["points"] - pdf["base"], pdf["points"] * 0.0 + 1.0
    award = (pdf["points"] > 0).astype(float) if isinstance(pdf, pd.DataFrame) else (F.col("points") > 0).cast("double")
    return award, pdf["points"] * alpha + 1.0


def _fit_one(train: pd.DataFrame, test: pd.DataFrame, model: str, factors: int, reg: float, alpha: float) -> np.ndarray:
    """Predictions of test cells (voter, entry, base, points) from train cells of the same columns."""
    voters, entries = {x: k for k, x in enumerate(sorted(train["voter"].unique()))}, {x: k for k, x in enumerate(sorted(train["entry"].unique()))}
    rows, cols = train["voter"].map(voters).to_numpy(), train["entry"].map(entries).to_numpy()
    points = train["points"].to_numpy(float)
    target, weight = (x.to_numpy(float) for x in _model_cells(train, model, alpha))
    u, v = als(rows, cols, target, weight, (len(voters), len(entries)), factors, reg, first=first_factors(list(entries), factors))
    r, c = test["voter"].map(voters), test["entry"].map(entries)
    known = (r.notna() & c.notna()).to_numpy()
    raw = np.zeros(len(test))
    raw[known] = (u[r[known].astype(int)] * v[c[known].astype(int)]).sum(axis=1)
    if model == "mf":
        return np.clip(test["base"].to_numpy(float) + raw, 0.0, MAX_POINTS)
    x = (u[rows] * v[cols]).sum(axis=1)
    var = ((x - x.mean()) ** 2).sum()
    slope = float(((x - x.mean()) * (points - points.mean())).sum() / var) if var > 0 else 0.0
    return np.clip(points.mean() + slope * (raw - x.mean()), 0.0, MAX_POINTS)


def _fit_over_cluster(train: DataFrame, test: DataFrame, model: str, factors: int, reg: float, alpha: float) -> DataFrame:
    """test (voter, entry, base, points, ...) with ``prediction``, as by _fit_one."""
    target, weight = _model_cells(train, model, alpha)
    u, v = als_over_cluster(train.select("voter", "entry", target.alias("target"), weight.alias("weight")), factors, reg)
    dot = F.aggregate(F.zip_with("fu", "fv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    def scored(cells: DataFrame) -> DataFrame:
        own = cells.join(u.select(F.col("name").alias("voter"), F.col("f").alias("fu")), "voter", "left").join(v.select(F.col("name").alias("entry"), F.col("f").alias("fv")), "entry", "left")
        return own.withColumn("raw", F.coalesce(dot, F.lit(0.0))).drop("fu", "fv")

    if model == "mf":
        return scored(test).withColumn("prediction", clip(F.col("base") + F.col("raw"), 0.0, MAX_POINTS)).drop("raw")
    line = scored(train).agg(F.avg("points").alias("m"), F.avg("raw").alias("mx"), F.coalesce(F.try_divide(F.covar_pop("raw", "points"), F.var_pop("raw")), F.lit(0.0)).alias("slope"))
    return scored(test).crossJoin(F.broadcast(line)).withColumn("prediction", clip(F.col("m") + F.col("slope") * (F.col("raw") - F.col("mx")), 0.0, MAX_POINTS)).drop("raw", "m", "mx", "slope")


def factor_predictions(train: DataFrame, test: DataFrame, fitted: DataFrame, grid: DataFrame, carry: list[str], by: tuple[str, ...] = (), task_cells: int = TASK_CELLS) -> DataFrame:
    """(by..., run, voter, entry, points, carry..., prediction) of test cells for each row of grid (RUNS).

    With up to ``task_cells`` cells for a value of ``by``, a run is one task, which holds the aggregated cells (voters x entries)
    and the test cells; with more, its sums are made over the cluster. carry names test columns to return.
    """
    kept = ["voter", "entry", "points", *carry]
    train = written(bias_term(aggregated(train, by), fitted, by).select(*by, "voter", "entry", "points", "base"), "train")
    test = written(bias_term(test, fitted, by).select(*by, *kept, "base"), "test")
    if by:
        groups = train.select(*by).distinct().collect()  # as many as there are splits
        most = max((train.filter(_all_equal(g)).count() + test.filter(_all_equal(g)).count() for g in groups), default=0)
    else:
        groups, most = [None], train.count() + test.count()
    if most > task_cells:
        out = []
        for g in groups:
            own = [df if g is None else df.filter(_all_equal(g)) for df in (train, test)]
            for r in grid.collect():
                found = _fit_over_cluster(*own, r.model, r.factors, r.reg, r.alpha)
                out.append(found.select(*by, F.lit(r.run).alias("run"), *kept, "prediction"))
        return reduce(DataFrame.unionByName, out)
    zero = [F.lit(None).cast("string").alias(c) for c in carry]
    a = train.select(*by, F.lit(False).alias("is_test"), "voter", "entry", "points", "base", *zero)
    b = test.select(*by, F.lit(True), "voter", "entry", "points", "base", *carry)
    rows = a.union(b).crossJoin(F.broadcast(grid))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.iloc[0]
        train, test = pdf[~pdf["is_test"]], pdf[pdf["is_test"]]
        train = train.sort_values(["voter", "entry"])
        out = test[[*by, "run", *kept]].copy()
        out["prediction"] = _fit_one(train, test, g["model"], int(g["factors"]), float(g["reg"]), float(g["alpha"]))
        return out

    kinds = "".join(f"{c} {train.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"{kinds}run string, voter string, entry string, points double, " + "".join(f"{c} string, " for c in carry) + "prediction double"
    return rows.groupBy(*by, "run").applyInPandas(one, schema)


def _all_equal(row) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c) == F.lit(x) for c, x in row.asDict().items()))
