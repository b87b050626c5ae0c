"""Pixel classification with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour
from .ordered import with_index

C = F.col
CLASSES = ["ocean", "land", "rock", "wave"]
SEED = 42


def pixel_features(px: DataFrame) -> tuple[DataFrame, list[str]]:
    r, g, b = C("r"), C("g"), C("b")
    f = {"f_r": r / 255.0, "f_g": g / 255.0, "f_b": b / 255.0}
    f |= {f"f_{n}": c / 255.0 for n, c in colour.hsv(r, g, b).items()}
    f |= {f"f_{n}": c for n, c in colour.advanced(r, g, b).items()}
    return px.select("*", *[c.alias(n) for n, c in f.items()]), list(f)


def assemble(d: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(d)


def class_index(label: str = "label"):
    """Position in the fixed class list, so models and reports agree without a fitted indexer."""
    return (F.array_position(F.array(*[F.lit(c) for c in CLASSES]), C(label)) - 1).cast("double")


def balanced_weights(d: DataFrame, label: str = "target") -> DataFrame:
    """n / (classes * class count) per row; the class table has one row per class."""
    n = d.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    t = n.agg(F.struct(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    w = n.withColumn("_t", t).select(label, (C("_t.n") / (C("_t.k") * C("_n"))).alias("weight"))
    return d.join(w, label)


def sample_grid(px: DataFrame, step: int = 20, margin: int = 10, width: int = 640, height: int = 512) -> DataFrame:
    on = lambda c, size: (C(c) >= margin) & (C(c) < size - margin) & ((C(c) - margin) % step == 0)
    return px.filter(on("y", height) & on("x", width))


def dealt(d: DataFrame, key: str) -> DataFrame:
    """The rows in one partition a core: a fit passes over them hundreds of times, each time in one wave of tasks."""
    return d.repartition(d.sparkSession.sparkContext.defaultParallelism, key)


def guard_samples(d: DataFrame, least: int = 40) -> DataFrame:
    if d.limit(least).count() < least:
        raise ValueError(f"at least {least} labelled samples are needed")
    return d


def forest(trees: int = 100, depth: int = 10, balanced: bool = False) -> RandomForestClassifier:
    m = RandomForestClassifier(labelCol="target", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED)
    return m.setWeightCol("weight") if balanced else m


def boosted(rounds: int = 100, depth: int = 5, parallelism: int = 4) -> OneVsRest:
    one = GBTClassifier(labelCol="target", featuresCol="features", maxIter=rounds, maxDepth=depth, seed=SEED)
    return OneVsRest(classifier=one, labelCol="target", featuresCol="features", parallelism=parallelism)


def perceptron(inputs: int, hidden: tuple[int, ...] = (128, 64, 32), rounds: int = 500, classes: int = len(CLASSES)) -> Pipeline:
    scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    net = MultilayerPerceptronClassifier(
        labelCol="target", featuresCol="scaled", layers=[inputs, *hidden, classes], maxIter=rounds, seed=SEED
    )
    return Pipeline(stages=[scale, net])


def standardise(d: DataFrame, column: str = "features") -> DataFrame:
    """Zero mean and unit population variance per dimension."""
    model = StandardScaler(inputCol=column, outputCol="_s", withMean=True).fit(d)
    n = d.count()
    k = F.lit((n / (n - 1)) ** 0.5)
    return model.transform(d).withColumn(column, array_to_vector(F.transform(vector_to_array("_s"), lambda v: v * k))).drop("_s")


def split_stratified(d: DataFrame, key: str, label: str, share: float = 0.8, seed: int = SEED) -> DataFrame:
    """Adds ``train``: exactly floor(share * n) rows of each class, in hashed order.

    The hash is even, so its ranges cut a class of any size into equally small sorts.
    """
    h = d.withColumn("_h", (C(key) * 2654435761 + seed) % 2147483648)
    d = with_index(h, [label], "_h", ties=[key], out="_i", chunk=32768)
    n = d.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return d.join(n, label).withColumn("train", C("_i") < F.floor(C("_n") * share)).drop("_h", "_i", "_n")


def cross_validate(d: DataFrame, estimator, folds: int = 5, parallelism: int = 4) -> DataFrame:
    """(mean_accuracy, std_accuracy) of k folds."""
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=ParamGridBuilder().build(), numFolds=folds, seed=SEED, parallelism=parallelism,
        evaluator=MulticlassClassificationEvaluator(labelCol="target", metricName="accuracy"),
    )
    m = cv.fit(d)
    return d.sparkSession.createDataFrame([(float(m.avgMetrics[0]), float(m.stdMetrics[0]))], "mean_accuracy double, std_accuracy double")


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((C("target") == C("prediction")).cast("int")).alias("accuracy"))


def compare(train: DataFrame, test: DataFrame, estimators: dict) -> DataFrame:
    """(model, accuracy) of every estimator; the fits are separate jobs, the table has one row per model."""
    out = None
    for name, e in estimators.items():
        row = accuracy(e.fit(train).transform(test)).select(F.lit(name).alias("model"), "accuracy")
        out = row if out is None else out.union(row)
    return out


def best(models: DataFrame) -> DataFrame:
    return models.agg(F.max_by("model", F.struct("accuracy", "model")).alias("model"), F.max("accuracy").alias("accuracy"))


def soft_vote(members: list, d: DataFrame) -> DataFrame:
    """Mean class probability of the members, all evaluated on the same row."""
    for i, m in enumerate(members):
        d = m.transform(d).withColumn(f"_p{i}", vector_to_array("probability")).drop("prediction", "probability", "rawPrediction", "scaled")
    size = F.size("_p0")
    mean = F.transform(F.sequence(F.lit(0), size - 1), lambda k: sum((F.get(f"_p{i}", k) for i in range(len(members))), F.lit(0.0)) / len(members))
    d = d.withColumn("vote", mean)
    return d.withColumn("prediction", (F.array_position("vote", F.array_max("vote")) - 1).cast("double")).drop(*[f"_p{i}" for i in range(len(members))])


def report(d: DataFrame, truth: str, guess: str) -> DataFrame:
    """Precision, recall and support per class and overall accuracy, from the confusion counts."""
    c = d.groupBy(C(truth).alias("t"), C(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sides = c.select(F.inline(F.array(F.struct(C("t").alias("label"), C("n").alias("s"), F.lit(0).cast("bigint").alias("p"), F.when(C("t") == C("g"), C("n")).otherwise(0).alias("h")),
                                      F.struct(C("g").alias("label"), F.lit(0).cast("bigint").alias("s"), C("n").alias("p"), F.lit(0).cast("bigint").alias("h")))))
    r = sides.groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("_p"), F.sum("h").alias("_h"))
    total = c.agg(F.sum(F.when(C("t") == C("g"), C("n")).otherwise(0)) / F.sum("n")).scalar()
    return r.select(
        "label", "support", F.coalesce(C("_h") / F.nullif(C("_p"), F.lit(0)), F.lit(0.0)).alias("precision"),
        F.coalesce(C("_h") / F.nullif(C("support"), F.lit(0)), F.lit(0.0)).alias("recall"), total.alias("accuracy"),
    )


def importances(model, columns: list[str], spark) -> DataFrame:
    rows = [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


class Registry:
    """Versions of a model in a shared folder; the newest entry names the version in use."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def entries(self) -> DataFrame:
        """(version, model, rows, accuracy) of all promotions, oldest first."""
        return self.spark.read.schema("version int, model string, rows long, accuracy double").parquet(f"{self.folder}/entries").orderBy("version")

    def _current(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/entries")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.entries().orderBy(F.desc("version")).first()

    def load(self) -> PipelineModel | None:
        """The model in use."""
        now = self._current()
        return PipelineModel.load(f"{self.folder}/model-{now.version:06d}") if now else None

    def upgrade(self, name: str, model: PipelineModel, held_out: DataFrame) -> dict:
        """Promotes ``model`` if it beats the one in use on the same held-out rows, or if there is none.

        The model is saved before its entry is written, so readers never meet an entry without its model.
        """
        score = lambda m: accuracy(m.transform(held_out)).first()["accuracy"]
        now, present = self._current(), self.load()
        old = score(present) if present else None
        new = score(model)
        if new is None:
            raise ValueError("no held-out rows to compare models on")
        chosen = old is None or new > old
        version = (now.version if now else 0) + chosen
        if chosen:
            save_model(model, f"{self.folder}/model-{version:06d}")
            row = [(version, name, held_out.count(), float(new))]
            self.spark.createDataFrame(row, "version int, model string, rows long, accuracy double").coalesce(1).write.mode("append").parquet(f"{self.folder}/entries")
        return {"candidate": name, "old": old, "new": new, "promoted": bool(chosen), "version": version}
