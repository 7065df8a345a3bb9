"""Random-forest and boosted-tree forecasters on the feature table.

``tree_fits`` and what reads its table tune one model per series, any number of series in one job:
pieces of work (series, fold, block of trees) are dealt to tasks, and Spark adds up their answers.
The other functions pool all rows they are given into one Spark ML model, for series too long for a
task. Folds are chronological within each series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from statistics import fmean

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidecast.functions import growing
from tidecast.operators.split import expanding_folds, test_rows, train_rows
from tidecast.schema import SEED, SERIES, TS, Y

# The two search grids.
FOREST_GRID = {
    "n_estimators": [200, 500],
    "max_depth": [None, 8, 16],
    "min_samples_leaf": [1, 3, 5],
    "max_features": ["sqrt", 0.7],
}
BOOST_GRID = {
    "n_estimators": [100, 300],
    "learning_rate": [0.03, 0.05, 0.1],
    "max_depth": [2, 3],
    "min_samples_leaf": [1, 4],
}
GRIDS = {"random_forest": FOREST_GRID, "gradient_boosting": BOOST_GRID}
# Deepest tree Spark ML grows; stands for "no limit" there.
DEEPEST = 30
DEEP = 1 << 30  # no limit
TREES_AT_ONCE = 300
TASKS_PER_PARTITION = 16
FITS = pa.schema(
    [(SERIES, pa.string()), ("fold", pa.int32()), ("model", pa.string()), ("point", pa.int32())]
    + [("pos", pa.list_(pa.int64())), ("actual", pa.list_(pa.float64()))]
    + [("said", pa.list_(pa.float64())), ("importance", pa.list_(pa.float64()))]
)
SEARCH_SCHEMA = (
    "model string, n_estimators int, max_depth string, min_samples_leaf int, "
    "max_features string, learning_rate double, validation_rmse double"
)


def grid_points(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def forest(params: dict, seed: int = SEED) -> RandomForestRegressor:
    depth = params.get("max_depth")
    return RandomForestRegressor(
        featuresCol="features",
        labelCol=Y,
        predictionCol="prediction",
        numTrees=int(params["n_estimators"]),
        maxDepth=DEEPEST if depth is None else int(depth),
        minInstancesPerNode=int(params["min_samples_leaf"]),
        featureSubsetStrategy=str(params["max_features"]),
        seed=seed,
    )


def boosted(params: dict, seed: int = SEED) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features",
        labelCol=Y,
        predictionCol="prediction",
        maxIter=int(params["n_estimators"]),
        stepSize=float(params["learning_rate"]),
        maxDepth=int(params["max_depth"]),
        minInstancesPerNode=int(params["min_samples_leaf"]),
        lossType="squared",
        seed=seed,
    )


ESTIMATORS = {"random_forest": forest, "gradient_boosting": boosted}


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def fold_rmse(estimator, folds: DataFrame, splits: int) -> float:
    """Mean validation RMSE over the folds of an assembled fold table."""
    scorer = RegressionEvaluator(labelCol=Y, predictionCol="prediction", metricName="rmse")
    scores = []
    for fold in range(1, splits + 1):
        part = folds.where(F.col("fold") == fold)
        model = estimator.fit(part.where("fold_role = 'train'"))
        scores.append(scorer.evaluate(model.transform(part.where("fold_role = 'validation'"))))
    return fmean(scores)


def search_trees(
    split: DataFrame,
    features: Sequence[str],
    kind: str,
    grid: dict[str, list] | None = None,
    splits: int = 4,
    seed: int = SEED,
    parallel: int = 4,
):
    """Score every grid point on chronological folds and refit the best on all training rows.

    Returns the fitted model and the table of scores, best first.
    """
    build = ESTIMATORS[kind]
    points = grid_points(grid or (FOREST_GRID if kind == "random_forest" else BOOST_GRID))
    train = assemble(train_rows(split).withColumn("n", F.col("n_train")), features)
    train = train.select(SERIES, "pos", "n", Y, "features").persist()
    folds = expanding_folds(train, splits)
    try:
        with ThreadPoolExecutor(parallel) as pool:
            scores = list(pool.map(lambda p: fold_rmse(build(p, seed), folds, splits), points))
        ranked = sorted(zip(scores, range(len(points))))
        model = build(points[ranked[0][1]], seed).fit(train)
    finally:
        train.unpersist()
    rows = [
        (
            kind,
            points[i]["n_estimators"],
            str(points[i]["max_depth"]),
            points[i]["min_samples_leaf"],
            None if "max_features" not in points[i] else str(points[i]["max_features"]),
            points[i].get("learning_rate"),
            float(score),
        )
        for score, i in ranked
    ]
    # A few dozen rows made on the driver from the grid itself.
    return model, split.sparkSession.createDataFrame(rows, SEARCH_SCHEMA)


def family(kind: str, point: dict) -> tuple:
    """What grid points must share to be read off the same trees."""
    if kind == "random_forest":
        return point["min_samples_leaf"], point["max_features"]
    return (kind,)


def looked_at(wanted: str | float, features: int) -> int:
    """How many features a node looks at."""
    if wanted == "sqrt":
        return max(1, int(features**0.5))
    return max(1, int(float(wanted) * features))


def tree_tasks(grids: dict[str, dict]) -> list[tuple[str, list[int], int, int]]:
    """(kind, grid points, first tree, past the last) of every piece of work on a series and fold.

    A forest of more trees or a lesser depth is read off the same trees, so points that share leaf
    size and features share their trees, cut into blocks; each block names the points it counts
    for. Boosted chains of all points of a fold are grown side by side.
    """
    out = []
    for kind, grid in grids.items():
        points = grid_points(grid)
        for shared in dict.fromkeys(family(kind, p) for p in points):
            own = [i for i, p in enumerate(points) if family(kind, p) == shared]
            sizes = {i: int(points[i]["n_estimators"]) for i in own}
            most = max(sizes.values())
            if kind == "gradient_boosting":
                out.append((kind, own, 0, most))
                continue
            cuts = sorted({0, *sizes.values(), *range(0, most, TREES_AT_ONCE)})
            for begin, end in zip(cuts, cuts[1:]):
                out.append((kind, [i for i in own if sizes[i] >= end], begin, end))
    return out


def fold_blocks(split: DataFrame, features: Sequence[str], splits: int) -> DataFrame:
    """The rows of every series and fold as arrays, by position; fold 0 asks the test rows.

    A table of weekly or daily features has at most a row per day and series, so a block is bounded
    by the timestamp type.
    """
    named = split.na.drop(subset=[Y, *features])
    train = train_rows(named)
    folds = expanding_folds(train.withColumn("n", F.col("n_train")), splits).select(
        SERIES, "fold", (F.col("fold_role") == "train").alias("learns"), "pos", Y, *features
    )
    marked = named.where("role IN ('train', 'test')")
    last = marked.select(
        SERIES, F.lit(0).alias("fold"), (F.col("role") == "train").alias("learns"), "pos", Y, *features
    )
    cells = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    rows = folds.unionByName(last).select(
        SERIES, "fold", F.struct("pos", "learns", F.col(Y).cast("double").alias("y"), cells).alias("cell")
    )
    grouped = rows.groupBy(SERIES, "fold").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return grouped.select(
        SERIES,
        "fold",
        *[F.col(f"cells.{c}").alias(c) for c in ("pos", "learns", "y")],
        F.flatten("cells.x").alias("x"),
    )


def tree_fits(
    split: DataFrame,
    features: Sequence[str],
    grids: dict[str, dict] | None = None,
    splits: int = 4,
    seed: int = SEED,
) -> DataFrame:
    """Grow the trees of every grid point on every fold and on all training rows of each series.

    A row per series, fold, grid point and piece of work: the summed answers for the rows that the
    fold asks, and the summed importances. One job for any number of series: the pieces of work are
    dealt to tasks with the series' rows. The same trees grow whatever else is in the table.
    """
    grids = GRIDS if grids is None else grids
    tasks, points = tree_tasks(grids), {k: grid_points(g) for k, g in grids.items()}
    pieces = F.explode(F.sequence(F.lit(0), F.lit(len(tasks) - 1))).alias("task")
    dealt = fold_blocks(split, features, splits).select("*", pieces)
    tasks_wanted = TASKS_PER_PARTITION * int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks_wanted, SERIES, "fold", "task")
    width = len(features)

    def work(task: int, x: np.ndarray, y: np.ndarray, query: np.ndarray):
        kind, own, begin, end = tasks[task]
        some = [points[kind][i] for i in own]
        if kind == "random_forest":
            depths = {i: DEEP if p["max_depth"] is None else int(p["max_depth"]) for i, p in zip(own, some)}
            count = looked_at(some[0]["max_features"], width)
            leaf = int(some[0]["min_samples_leaf"])
            got = growing.forest_block(
                x, y, query, np.arange(begin, end), leaf, count, set(depths.values()), seed
            )
            for i, d in depths.items():
                yield kind, i, *got[d]
            return
        chains = list(dict.fromkeys((p["learning_rate"], p["min_samples_leaf"], p["max_depth"]) for p in some))
        rates, leaf, depth = (np.array(c) for c in zip(*chains))
        sizes = {i: int(p["n_estimators"]) for i, p in zip(own, some)}
        got = growing.boosted_chains(x, y, query, rates, leaf, depth, end, set(sizes.values()))
        for i, p in zip(own, some):
            chain = chains.index((p["learning_rate"], p["min_samples_leaf"], p["max_depth"]))
            yield kind, i, *(part[chain] for part in got[sizes[i]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                x, y = np.array(r["x"], float).reshape(-1, width), np.array(r["y"], float)
                learns, pos = np.array(r["learns"], bool), np.array(r["pos"])
                if not learns.any() or learns.all():
                    continue
                for kind, point, said, importance in work(r["task"], x[learns], y[learns], x[~learns]):
                    rows.append((r[SERIES], r["fold"], kind, point, pos[~learns], y[~learns], said, importance))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(zip(*rows) if rows else [[]] * len(FITS), FITS)], schema=FITS
            )

    return dealt.mapInArrow(run, from_arrow_schema(FITS))


def tree_predictions(fits: DataFrame, grids: dict[str, dict] | None = None) -> DataFrame:
    """``(series_id, fold, model, point, pos, actual, prediction)``: the answers of whole ensembles."""
    grids = GRIDS if grids is None else grids
    zipped = F.inline(F.arrays_zip("pos", "actual", "said"))
    summed = (
        fits.select(SERIES, "fold", "model", "point", zipped)
        .groupBy(SERIES, "fold", "model", "point", "pos")
        .agg(F.first("actual").alias("actual"), F.sum("said").alias("said"))
    )
    trees = points_table(fits.sparkSession, grids).select(
        "model", "point", F.when(F.col("model") == "random_forest", F.col("n_estimators")).otherwise(1).alias("trees")
    )
    joined = summed.join(F.broadcast(trees), ["model", "point"])
    return joined.select(
        SERIES, "fold", "model", "point", "pos", "actual", (F.col("said") / F.col("trees")).alias("prediction")
    )


def points_table(spark: SparkSession, grids: dict[str, dict]) -> DataFrame:
    """The grid points themselves: a few dozen rows made on the driver from the grids."""
    rows = [
        (
            kind,
            i,
            int(p["n_estimators"]),
            str(p["max_depth"]),
            int(p["min_samples_leaf"]),
            None if "max_features" not in p else str(p["max_features"]),
            p.get("learning_rate"),
        )
        for kind, grid in grids.items()
        for i, p in enumerate(grid_points(grid))
    ]
    return spark.createDataFrame(rows, SEARCH_SCHEMA.replace("model string", "model string, point int").rsplit(",", 1)[0])


def tree_scores(fits: DataFrame, grids: dict[str, dict] | None = None, splits: int = 4) -> DataFrame:
    """``series_id, point`` and the columns of the search table, with every point's mean fold RMSE.

    A series whose folds are not all there, for want of rows, has no score.
    """
    grids = GRIDS if grids is None else grids
    folds = tree_predictions(fits, grids).where("fold > 0")
    error = F.col("actual") - F.col("prediction")
    by_fold = folds.groupBy(SERIES, "model", "point", "fold").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    mean = F.when(F.count("rmse") == splits, F.avg("rmse")).alias("validation_rmse")
    scored = by_fold.groupBy(SERIES, "model", "point").agg(mean)
    named = points_table(fits.sparkSession, grids)
    return scored.join(F.broadcast(named), ["model", "point"]).select(
        SERIES, "point", *[c.split()[0] for c in SEARCH_SCHEMA.split(", ")]
    )


def best_points(scores: DataFrame) -> DataFrame:
    """``(series_id, model, point)`` with the least score of each kind; ties to the first point."""
    first = F.min(F.struct("validation_rmse", "point"))
    known = scores.where("validation_rmse IS NOT NULL")
    return known.groupBy(SERIES, "model").agg(first["point"].alias("point"))


def searched_forecasts(
    split: DataFrame, fits: DataFrame, scores: DataFrame, grids: dict[str, dict] | None = None
) -> DataFrame:
    """``series_id, ts, step, actual`` and the answer of each kind's best point, NULL without one."""
    grids = GRIDS if grids is None else grids
    best = best_points(scores)
    told = tree_predictions(fits, grids).where("fold = 0").join(best, [SERIES, "model", "point"])
    columns = [F.max(F.when(F.col("model") == k, F.col("prediction"))).alias(k) for k in grids]
    wide = told.groupBy(SERIES, "pos").agg(*columns)
    rows = test_rows(split).select(SERIES, "pos", TS, "step", F.col(Y).alias("actual"))
    return rows.join(wide, [SERIES, "pos"], "left").select(SERIES, TS, "step", "actual", *grids)


def searched_importances(fits: DataFrame, scores: DataFrame, features: Sequence[str]) -> DataFrame:
    """``series_id, feature, importance, model`` of each best point; a model's sum to one."""
    best = best_points(scores)
    last = fits.where("fold = 0").join(best, [SERIES, "model", "point"])
    summed = (
        last.select(SERIES, "model", F.posexplode("importance").alias("nth", "part"))
        .groupBy(SERIES, "model", "nth")
        .agg(F.sum("part").alias("part"))
    )
    total = summed.groupBy(SERIES, "model").agg(F.sum("part").alias("total"))
    names = F.array(*[F.lit(f) for f in features])
    return summed.join(total, [SERIES, "model"]).select(
        SERIES,
        F.get(names, F.col("nth")).alias("feature"),
        F.coalesce(F.try_divide("part", "total"), F.lit(0.0)).alias("importance"),
        "model",
    )


def fit_trees(
    split: DataFrame, features: Sequence[str], points: dict[str, dict], seed: int = SEED
) -> dict:
    """Fit one model per kind with given parameters; the training vectors are built once."""
    train = assemble(train_rows(split), features).select(Y, "features").persist()
    try:
        return {kind: ESTIMATORS[kind](p, seed).fit(train) for kind, p in points.items()}
    finally:
        train.unpersist()


def tree_forecasts(split: DataFrame, features: Sequence[str], models: dict) -> DataFrame:
    """``series_id, ts, step, actual`` and one column per model, in one pass over the test rows."""
    rows = assemble(test_rows(split), features)
    for name, model in models.items():
        rows = model.copy({model.predictionCol: name}).transform(rows)
    return rows.select(SERIES, TS, "step", F.col(Y).alias("actual"), *models)


def importances(
    spark: SparkSession, model, features: Sequence[str], name: str
) -> DataFrame:
    """Impurity importances, largest first; they sum to one."""
    values = model.featureImportances.toArray()
    rows = sorted(((f, float(v), name) for f, v in zip(features, values)), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, importance double, model string")
