"""Feature heads over vectors, their metrics, calibration and consensus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import predict_contract, softmax
from ..sources.shared import written
from . import curate


def train_head(rows: DataFrame, vec: str, label: str, weight: str | None = None, layers: Sequence[int] | None = None) -> PipelineModel:
    """A probe on frozen vectors: a perceptron with the hidden layers given, or a weighted logistic regression."""
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(rows)
    if layers:
        width = len(rows.select(vec).first()[0])
        head = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_label", layers=[width, *layers, len(index.labels)], maxIter=100, seed=42)
    else:
        head = LogisticRegression(featuresCol="_x", labelCol="_label", maxIter=50, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[index, head]).fit(with_features(rows, vec))


def choose_head(rows: DataFrame, vec: str, label: str, group: str, layers: Sequence[int] = (256, 128), run: int = 10, runs: int = 10, patience: int = 3, least: int = 3, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """A perceptron trained in short runs, that of the best macro F1 on validation groups; and ``run, macro_f1, chosen``.

    Classes of fewer than ``least`` groups are dropped.  Whole groups go to training or validation (and test, which is
    left alone).  Each run of ``run`` iterations starts from the last one's weights, so a run costs no more than its
    iterations; after ``patience`` runs without a better macro F1, or ``runs`` in all, it ends.  The first of equal runs
    is chosen.  Null vectors and labels are skipped.
    """
    known = curate.drop_rare_classes(rows.filter(F.col(vec).isNotNull() & F.col(label).isNotNull()), label, group, least)
    split = written(curate.group_split(known, group, seed=seed).withColumnRenamed(group, "_group"), "split")
    data = written(with_features(known, vec).select("_x", label, F.col(group).alias("_group")).join(split, "_group"), "rows")
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(data)
    marked = index.transform(data)
    train, held = marked.filter("fold = 'train'"), marked.filter("fold = 'val'")
    width = data.select(F.size(vector_to_array("_x"))).first()[0]
    head = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_label", layers=[width, *layers, len(index.labels)], maxIter=run, seed=seed)
    best, scores, weights = None, [], None
    for _ in range(runs):
        model = (head.copy({head.initialWeights: weights}) if weights is not None else head).fit(train)
        weights = model.weights
        f1 = classification_metrics(model.transform(held), "_label", "prediction").first()["macro_f1"] or 0.0
        if best is None or f1 > max(scores):
            best = model
        scores.append(float(f1))
        if len(scores) - scores.index(max(scores)) > patience:
            break
    chosen = scores.index(max(scores))
    report = rows.sparkSession.createDataFrame([(k + 1, round(x, 6), k == chosen) for k, x in enumerate(scores)], "run int, macro_f1 double, chosen boolean")
    return PipelineModel(stages=[index, best]), report


def with_features(rows: DataFrame, vec: str) -> DataFrame:
    return rows.withColumn("_x", array_to_vector(F.col(vec).cast("array<double>")))


def head_probabilities(rows: DataFrame, vec: str, model: PipelineModel, id_col: str = "id") -> DataFrame:
    """``id, probabilities`` in the order of the head's classes."""
    scored = model.stages[-1].transform(with_features(rows, vec))
    return scored.select(id_col, vector_to_array("probability").alias("probabilities"))


def multi_head(rows: DataFrame, vec: str, heads: dict[str, PipelineModel], id_col: str = "id") -> DataFrame:
    """All heads over each vector: ``id, feature, value, confidence, second, second_confidence, status``."""
    out = None
    for feature, model in heads.items():
        named = head_probabilities(rows, vec, model, id_col).select(id_col, F.lit(feature).alias("feature"), predict_contract(F.col("probabilities"), model.stages[0].labels).alias("p")).select(id_col, "feature", "p.*")
        out = named if out is None else out.unionByName(named)
    return out


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of each true and predicted class, zeros included (classes are few: those that occur)."""
    classes = df.select(F.col(truth).alias("c")).union(df.select(predicted)).filter("c is not null").distinct()
    grid = classes.select(F.col("c").alias("truth")).join(F.broadcast(classes.select(F.col("c").alias("predicted"))))
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["truth", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and support of each class."""
    cells = confusion(df, truth, predicted)
    right = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    rows = cells.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), right.alias("right"))
    said = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = rows.join(said, "class").withColumns({"precision": ratio(F.col("right"), F.col("said")), "recall": ratio(F.col("right"), F.col("support"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "support", "precision", "recall", "f1")


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, macro F1 and F1 weighted by support."""
    known = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    report = class_report(known, truth, predicted)
    return report.agg(F.sum(F.col("recall") * F.col("support")).alias("_r"), F.sum("support").alias("_n"), F.avg("f1").alias("macro_f1"), F.sum(F.col("f1") * F.col("support")).alias("_w")).select((F.col("_r") / F.col("_n")).alias("accuracy"), "macro_f1", (F.col("_w") / F.col("_n")).alias("weighted_f1"))


def multi_view(df: DataFrame, specimen: str, probabilities: str, classes: Sequence[str]) -> DataFrame:
    """Mean class probabilities over a specimen's rows, judged as one: ``specimen, n, value, confidence, ...``."""
    each = df.select(specimen, F.posexplode(probabilities).alias("k", "p"))
    means = each.groupBy(specimen, "k").agg(F.avg("p").alias("p"), F.count("*").alias("n"))
    gathered = means.groupBy(specimen).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda s: s["p"]).alias("probabilities"))
    return gathered.select(specimen, "n", predict_contract(F.col("probabilities"), classes).alias("p")).select(specimen, "n", "p.*")


def calibrate_temperature(df: DataFrame, logits: str, label: str, grid: Sequence[float]) -> DataFrame:
    """``temperature, nll`` for each temperature of a grid (a list of settings); the least is the calibration."""
    tried = df.select(logits, label, F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("temperature"))
    p = F.element_at(softmax(F.col(logits), F.col("temperature")), (F.col(label) + 1).cast("int"))
    return tried.groupBy("temperature").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("nll"))


def best_temperature(df: DataFrame, logits: str, label: str, low: float = 0.25, high: float = 4.0, steps: int = 9, rounds: int = 3) -> float:
    """Grid search, refined around the best each round."""
    for _ in range(rounds):
        grid = [low + (high - low) * k / (steps - 1) for k in range(steps)]
        best = calibrate_temperature(df, logits, label, grid).orderBy("nll", "temperature").first()["temperature"]
        width = (high - low) / (steps - 1)
        low, high = max(best - width, 1e-3), best + width
    return best


def reliability(df: DataFrame, confidence: str, correct: Column, bins: int = 10) -> DataFrame:
    """Count, accuracy and mean confidence by bins (lo, hi], the first one closed; empty bins have null means."""
    k = F.greatest(F.lit(1), F.ceil(F.col(confidence) * bins)).cast("int")
    got = df.groupBy(k.alias("bin")).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"), F.avg(confidence).alias("confidence"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error of :func:`reliability`'s bins."""
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def confidence_thresholds(df: DataFrame, confidence: str, correct: Column, grid: Sequence[float]) -> DataFrame:
    """``threshold, n, accuracy`` of the rows at or above each threshold of a grid."""
    tried = df.select(F.col(confidence).alias("_c"), correct.cast("double").alias("_ok"), F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("threshold"))
    return tried.filter("_c >= threshold").groupBy("threshold").agg(F.count("*").alias("n"), F.avg("_ok").alias("accuracy"))


def confidence_threshold(df: DataFrame, confidence: str, correct: Column, target: float = 0.85, least: int = 10, lowest: bool = False) -> DataFrame:
    """One row: the highest threshold from 0.95 down to 0.10 that reaches the target on enough rows (or the lowest)."""
    grid = [round(0.95 - 0.05 * k, 2) for k in range(18)]
    good = confidence_thresholds(df, confidence, correct, grid).filter((F.col("n") >= least) & (F.col("accuracy") >= target))
    return good.agg((F.min if lowest else F.max)("threshold").alias("threshold"))


def per_item_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: rows with a truth, null predictions apart, and accuracy of the rest."""
    known = df.filter(F.col(truth).isNotNull())
    said = F.col(predicted).isNotNull()
    right = F.count_if(said & (F.col(predicted) == F.col(truth)))
    return known.agg(F.count("*").alias("total"), F.count_if(~said).alias("abstained"), right.alias("correct"), F.try_divide(right, F.count_if(said)).alias("accuracy"))


def consensus(df: DataFrame, entity: str, predicted: str) -> DataFrame:
    """``entity, value, votes, n``: the most frequent prediction of each entity, ties by value."""
    votes = df.filter(F.col(predicted).isNotNull()).groupBy(entity, F.col(predicted).alias("value")).agg(F.count("*").alias("votes"))
    by = Window.partitionBy(entity)
    return votes.withColumn("n", F.sum("votes").over(by)).withColumn("_k", F.row_number().over(by.orderBy(F.desc("votes"), "value"))).filter("_k = 1").drop("_k")


def consensus_against(df: DataFrame, entity: str, predicted: str, truths: DataFrame, truth: str) -> DataFrame:
    """:func:`consensus` of each entity whose truth is known, with ``truth`` and ``correct``; ``truths`` has a row per entity."""
    known = truths.filter(F.col(truth).isNotNull()).select(entity, F.col(truth).alias("truth"))
    return consensus(df, entity, predicted).join(known, entity).withColumn("correct", F.col("value") == F.col("truth"))


def consensus_accuracy(df: DataFrame, entity: str, predicted: str, truths: DataFrame, truth: str) -> DataFrame:
    """``total, correct, accuracy`` of consensuses against truth in one row; accuracy 0 without any."""
    right = F.count(F.when(F.col("correct"), 1))
    held = consensus_against(df, entity, predicted, truths, truth).agg(F.count("*").alias("total"), right.alias("correct"))
    return held.withColumn("accuracy", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0))


def level_counts(df: DataFrame, level: str, levels: Sequence[str]) -> DataFrame:
    """Rows of each level, zeros included."""
    every = df.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    return every.join(df.groupBy(F.col(level).alias("level")).agg(F.count("*").alias("n")), "level", "left").withColumn("n", F.coalesce("n", F.lit(0)))
