"""Clustering and classification on feature tables, with MLlib."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .features import FEATURES, Z_CLIP, Z_CUT
from .ordered import with_position
from .quantiles import exact_percentile

# ---- fixed values
K = 6
RESTARTS, SEED = 10, 42
DISTANCE_QUANTILE = 0.995
# ---- end of fixed values
BLOCK = 20000  # rows of either side that meet in one task
UNBOUNDED = 2 ** 31 - 1  # iterations of a search that ends by its tolerance, not by a count


def clipped(scores: DataFrame, features: list[str] = FEATURES, bound: float = Z_CLIP) -> DataFrame:
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(-bound)), F.lit(bound))
    return scores.withColumn("features", array_to_vector(F.array(*[clip(f) for f in features])))


def train_kmeans(rows: DataFrame, k: int = K, restarts: int = RESTARTS, seed: int = SEED, max_iter: int = 300):
    """M1: the restart with the lowest cost. ``rows`` has ``features``; a fixed number of fits over cached rows."""
    data = rows.select("features").persist()
    try:
        fits = [KMeans(k=k, seed=seed + i, maxIter=max_iter, initMode="k-means||").fit(data) for i in range(restarts)]
        return min(fits, key=lambda m: m.summary.trainingCost)
    finally:
        data.unpersist()


def centres(model, features: list[str] = FEATURES) -> list[dict]:
    """Centroids with ``normal``: every coordinate under the cut (k rows)."""
    return [{"cluster": i, "normal": all(abs(x) < Z_CUT for x in c), **dict(zip(features, map(float, c)))}
            for i, c in enumerate(model.clusterCenters())]


def assign(model, rows: DataFrame) -> DataFrame:
    """Nearest centroid and its distance. The k centroids travel as literals."""
    cs = [[float(x) for x in c] for c in model.clusterCenters()]
    x = vector_to_array("features")
    dist = lambda c: F.sqrt(F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    best = F.array_min(F.array(*[F.struct(dist(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(cs)]))
    return rows.withColumn("_b", best).withColumn("cluster", F.col("_b.cluster")).withColumn("distance", F.col("_b.distance")).drop("_b")


def anomalous(model, train: DataFrame, rows: DataFrame) -> DataFrame:
    """M2: outside the normal clusters, or farther than the p99.5 of the training distances inside them."""
    normal = [c["cluster"] for c in centres(model) if c["normal"]]
    is_normal = F.col("cluster").isin(*normal) if normal else F.lit(False)
    cut = exact_percentile(assign(model, train).where(is_normal).withColumn("_g", F.lit(0)), ["_g"], "distance", DISTANCE_QUANTILE, "_cut")
    out = assign(model, rows).join(F.broadcast(cut), F.lit(True), "left")
    return out.withColumn("anomalous", ~is_normal | (F.col("distance") > F.coalesce("_cut", F.lit(float("inf"))))).drop("_cut", "_g")


def between(rows: DataFrame, start: Column, end: Column, ts: str = "bucket") -> DataFrame:
    return rows.where((F.col(ts) >= start) & (F.col(ts) < end))


def model_version(k: int, start: str, end: str) -> str:
    return f"kmeans-v1 k={k} entrenado={start}/{end}"


def windows_overlap(train: tuple, detect: tuple) -> bool:
    """M3: a warning is due when the two windows share time."""
    return train[0] < detect[1] and detect[0] < train[1]


def overlap_warning(train_start: Column, train_end: Column, start: Column, end: Column) -> Column:
    """M3 over a table of runs; a window without an end reaches to infinity."""
    forever = F.to_timestamp(F.lit("9999-12-31"))
    return (train_start < F.coalesce(end, forever)) & (start < F.coalesce(train_end, forever))


def elbow(rows: DataFrame, ks=range(2, 20), seed: int = SEED) -> list[tuple[int, float, float]]:
    """M4: (k, inertia, silhouette) for a fixed list of k."""
    data = rows.select("features").persist()
    try:
        out = []
        for k in ks:
            m = KMeans(k=k, seed=seed).fit(data)
            out.append((k, float(m.summary.trainingCost), float(ClusteringEvaluator().evaluate(m.transform(data)))))
        return out
    finally:
        data.unpersist()


def profile(rows: DataFrame, scores: list[str], originals: list[str], by: str = "cluster") -> DataFrame:
    """A43."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in originals],
                                *[F.avg(c).alias(f"z_{c}") for c in scores])


def profile_names(model, features: list[str] = FEATURES) -> dict[int, str]:
    """Names by a rule on the centroid (its largest coordinate), as cluster numbers are not stable."""
    # fixed values: the five profile names
    by_feature = {"cpu_user": "Saturación de CPU", "cpu_system": "Saturación de CPU", "memoria_used": "Saturación de memoria",
                  "disco_used_frac": "Disco en llenado"}
    out = {}
    for c in centres(model, features):
        top = max(features, key=lambda f: abs(c[f]))
        out[c["cluster"]] = "Operación normal" if c["normal"] else by_feature.get(top, "Caída de servicio")
    return out


def labelled(rows: DataFrame, assigned: DataFrame, names: dict[int, str], on: list[str], features: list[str] = FEATURES) -> DataFrame:
    """Features with their profile, rows with nulls dropped."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.join(assigned.select(*on, F.try_element_at(m, F.col("cluster")).alias("profile")), on).na.drop(subset=[*features, "profile"])


# ---------------------------------------------------------------- classifiers
def time_split(rows: DataFrame, ts: str, share: float = 0.7, ties: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """M5: by row position in time. Positions come from counts per ten seconds, so no task orders more than that."""
    placed = with_position(rows.withColumn("_all", F.lit(1)), ["_all"], ts, 10, ties)
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    j = placed.join(F.broadcast(n), F.lit(True))
    cut = F.floor(F.col("_n") * F.lit(share))
    drop = ["_all", "_n", "pos"]
    return j.where(F.col("pos") <= cut).drop(*drop), j.where(F.col("pos") > cut).drop(*drop)


def time_folds(rows: DataFrame, ts: str, folds: int = 5, ties: list[str] | None = None) -> DataFrame:
    """M9: ``fold`` 0..folds-1, contiguous blocks in time of equal size (the first ones one longer)."""
    placed = with_position(rows.withColumn("_all", F.lit(1)), ["_all"], ts, 10, ties)
    j = placed.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_n"))), F.lit(True))
    q, r, i = F.floor(F.col("_n") / folds), F.col("_n") % folds, F.col("pos") - 1
    fold = F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / F.greatest(q, F.lit(1))))
    return j.withColumn("fold", fold.cast("int")).drop("_all", "_n", "pos")


def tree(features: list[str], label: str = "label", depth: int = 4, seed: int = SEED) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"),
                            DecisionTreeClassifier(labelCol=label, maxDepth=depth, seed=seed)])


def _scaled(features: list[str]) -> list:
    return [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]


class OftenRead(Pipeline):
    """A pipeline whose last stage passes over the rows in tens of jobs a class.

    Every task of such a job reports all metrics of the plan that it reads, so the training rows are written first, and as
    many tasks as the cluster has cores read them. A task streams its rows, so it holds no more of a larger table.
    """

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        *first, last = self.getStages()
        rows = written(dataset.select(*dict.fromkeys([*first[0].getInputCols(), last.getLabelCol()])))
        rows = rows.coalesce(dataset.sparkSession.sparkContext.defaultParallelism)
        ready = Pipeline(stages=first).fit(rows)
        return PipelineModel([*ready.stages, last.fit(ready.transform(rows))])


def linear_svm(features: list[str], label: str = "label", max_iter: int = UNBOUNDED) -> Pipeline:
    """M6: trained until the search of each class ends by itself, as in the original, which sets no number of iterations."""
    return OftenRead(stages=[*_scaled(features), OneVsRest(classifier=LinearSVC(maxIter=max_iter), labelCol=label, parallelism=4)])


def perceptron(features: list[str], classes: int, label: str = "label", seed: int = SEED, max_iter: int = 100) -> Pipeline:
    return Pipeline(stages=[*_scaled(features), MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), 32, 16, classes],
                                                                              seed=seed, maxIter=max_iter)])


def _nearest(k: int):
    """A function of a block of queries and one of training rows: the k nearest of each query, the lower label first on a tie.

    Products of the blocks choose the candidates, with room for their rounding; the distances are then summed dimension by dimension.
    """
    def cells_of(t: pa.Table, name: str) -> np.ndarray:
        return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)

    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(q) and len(t):
            x, y, n = cells_of(q, "_x"), cells_of(t, "_t"), min(k, len(t))
            label = np.nan_to_num(t["_y"].to_numpy(), nan=-np.inf)
            yy = (y * y).sum(1)
            for at in range(0, len(x), 256):
                a = x[at:at + 256]
                aa = (a * a).sum(1)
                g = aa[:, None] + yy - 2 * (a @ y.T)
                most = np.partition(g, n - 1, axis=1)[:, n - 1] + 1e-10 * (aa + yy.max() + 1)
                i, j = np.nonzero(~(g > most[:, None]))
                d = np.zeros(len(i))
                for c in range(x.shape[1]):
                    d += (a[i, c] - y[j, c]) ** 2
                d = np.sqrt(d)
                order = np.lexsort((label[j], d, i))
                i, j, d = i[order], j[order], d[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                found.append((i[first] + at, j[first], d[first]))
        i, j, d = (np.concatenate(c) for c in zip(*found))
        return pa.table([q["_id"].take(pa.array(i, pa.int64())), t["_y"].take(pa.array(j, pa.int64())), pa.array(d, pa.float64())], names=["_id", "_y", "_d"])
    return run


def knn(train: DataFrame, rows: DataFrame, train_id: str, row_id: str, features: list[str], label: str = "label", k: int = 5,
        cells: int = 32) -> DataFrame:
    """M6: exact majority of the k nearest, after standard scaling. Ties go to the lower label.

    Training rows are grouped around ``cells`` centres. A row's distance to a
    centre and the radius of its group bound all distances in the group, so the
    groups that surely hold k rows bound the k-th distance, and only groups that
    can come closer are met, in blocks of about ``BLOCK`` rows of either side. What is gathered is
    one centre, radius and count for each of the ``cells`` groups.
    """
    scaler = Pipeline(stages=_scaled(features)).fit(train)
    vec = lambda d, i, *more: scaler.transform(d).select(F.col(i).alias("_id"), "features", *more)
    t, q = vec(train, train_id, F.col(label).cast("double").alias("_y")), vec(rows, row_id)
    model = KMeans(k=cells, seed=SEED, maxIter=5).fit(t.select("features"))
    homes = assign(model, t).select("_id", "cluster", "_y", "distance", vector_to_array("features").alias("_t"))
    sizes = {r["cluster"]: (r["far"], r["n"]) for r in homes.groupBy("cluster").agg(F.max("distance").alias("far"), F.count("*").alias("n")).collect()}
    x = vector_to_array("features")
    root = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    near = []
    for i, c in enumerate(model.clusterCenters()):
        if i in sizes:
            far, n = sizes[i]
            d = root(x, F.array(*[F.lit(float(v)) for v in c]))
            near.append(F.struct((d + F.lit(far)).alias("most"), (d - F.lit(far)).alias("least"), F.lit(n).cast("bigint").alias("n"), F.lit(i).alias("cell")))
    state = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("most"))
    bound = F.aggregate("_c", state, lambda s, c: F.when(s["n"] >= k, s).otherwise(F.struct((s["n"] + c["n"]).alias("n"), c["most"].alias("most"))), lambda s: s["most"])
    q = q.select("_id", x.alias("_x"), F.array_sort(F.array(*near)).alias("_c")).withColumn("_most", bound * (1 + 1e-9))
    shares = -(-rows.count() // BLOCK) or 1
    parts = F.try_element_at(F.create_map(*[F.lit(v) for c, (_, n) in sizes.items() for v in (c, -(-n // BLOCK))]), F.col("cluster")) if sizes else F.lit(1)
    met = q.select("_id", "_x", F.pmod(F.xxhash64("_id", "_x"), F.lit(shares)).cast("int").alias("_q"), F.explode(F.filter("_c", lambda c: c["least"] <= F.col("_most"))["cell"]).alias("cluster"))
    met = met.withColumn("_p", F.explode(F.sequence(F.lit(0), parts - 1)))
    homes = homes.select("cluster", "_y", "_t", F.pmod(F.xxhash64("_id", "_t"), parts).cast("int").alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_q"))
    on = ["cluster", "_p", "_q"]
    pairs = met.groupBy(*on).cogroup(homes.groupBy(*on)).applyInArrow(_nearest(k), f"_id {q.schema['_id'].dataType.simpleString()}, _y double, _d double")
    top = pairs.withColumn("_r", F.row_number().over(W.partitionBy("_id").orderBy("_d", "_y"))).where(F.col("_r") <= k)
    votes = top.groupBy("_id", F.col("_y").alias("y")).agg(F.count(F.lit(1)).alias("_v"))
    return votes.groupBy("_id").agg(F.max_by("y", F.struct("_v", -F.col("y"))).alias("prediction")).withColumnRenamed("_id", row_id)


def grid_search(rows: DataFrame, features: list[str], label: str, fold: str, depths=(3, 4, 5, 6), leaves=(1, 20), impurities=("gini", "entropy"),
                slack: float = 0.001):
    """M9: macro-free weighted F1 over time folds; the simplest setting within ``slack`` of the best."""
    p = tree(features, label)
    dt = p.getStages()[1]
    grid = ParamGridBuilder().addGrid(dt.maxDepth, list(depths)).addGrid(dt.minInstancesPerNode, list(leaves)).addGrid(dt.impurity, list(impurities)).build()
    folds = rows.select(F.max(fold)).first()[0] + 1
    cv = CrossValidator(estimator=p, estimatorParamMaps=grid, foldCol=fold, numFolds=folds, parallelism=4,
                        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="f1")).fit(rows)
    best = max(cv.avgMetrics)
    ok = [(g, s) for g, s in zip(grid, cv.avgMetrics) if s >= best - slack]
    pick = min(ok, key=lambda gs: (gs[0][dt.maxDepth], -gs[0][dt.minInstancesPerNode], gs[0][dt.impurity]))
    return {"depth": pick[0][dt.maxDepth], "leaf": pick[0][dt.minInstancesPerNode], "impurity": pick[0][dt.impurity], "f1": pick[1]}


def class_scores(rows: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """M7: per class precision, recall, F1 and support, from the counts of the confusion matrix."""
    m = rows.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    a = m.groupBy(F.col(label).alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    b = m.groupBy(F.col(pred).alias("class")).agg(F.sum("n").alias("predicted"))
    j = a.join(b, "class", "full").na.fill(0, ["support", "tp", "predicted"])
    p = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return j.select("class", "support", "predicted", "tp", p.alias("precision"), r.alias("recall"),
                    F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def overall_scores(per_class: DataFrame) -> DataFrame:
    n = F.sum("support")
    return per_class.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
                         (F.sum("tp") / n).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def weakened_recall(model, rows: DataFrame, features: list[str], label: str, normal: float, factors=(1.0, 0.75, 0.5, 0.3)) -> DataFrame:
    """M8: recall per class with the fault rows scaled down; the factors are copies made by one explode."""
    f = rows.where(F.col(label) != normal).withColumn("factor", F.explode(F.array(*[F.lit(x) for x in factors])))
    for c in features:
        f = f.withColumn(c, F.col(c) * F.col("factor"))
    return model.transform(f).groupBy("factor", label).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("recall"))


def leave_one_out(rows: DataFrame, events: DataFrame, make, features: list[str], label: str, key: str, ts: str, minutes: int = 10) -> list[dict]:
    """M8: recall on each fault event when it was not seen. One fit per event of a bounded campaign (tens)."""
    out = []
    for e in events.orderBy("event_id").toLocalIterator():
        a, z = F.lit(e["start"]), F.lit(e["end"])
        m = F.expr(f"interval {minutes} minutes")
        near = F.col(ts).between(a - m, z + m)
        fit = make().fit(rows.where(~near))
        inside = fit.transform(rows.where((F.col(key) == e[key]) & F.col(ts).between(a, z) & (F.col(label) == e["label"])))
        r = inside.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
        out.append({"event_id": e["event_id"], "label": e["label"], "recall": r})
    return out


def save_baseline(base: DataFrame, path: str) -> None:
    """M10."""
    base.write.mode("overwrite").parquet(path)
