"""Residual learners: cell medians (default) and boosted trees.

The cell-median learner predicts the median residual of an entity at one weekday and slot, the constant
that minimises absolute error there.  It trains every entity and every fold in one grouped
aggregation.  Boosted trees come from Spark ML with absolute-error loss.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattshare.functions.rowwise import flag
from wattshare.session import staged

# The shares of the first model tried when two are mixed.
BLEND_WEIGHTS = (0.0, 0.25, 0.4, 0.5, 0.6, 0.75, 1.0)


@dataclass
class CellMedianModel:
    """One row per (scope, slot): ``coarse`` median, ``cells`` medians by weekday, rows ``seen`` in the scope."""

    table: DataFrame
    scope: list[str]
    slot: str
    weekday: str
    min_rows: int

    def predict(self, df: DataFrame, name: str = "correction") -> DataFrame:
        """Add the correction: weekday cell, else slot, else 0; 0 where the scope had too few rows."""
        scored = df.join(self.table, [*self.scope, self.slot], "left")
        learned = F.coalesce(F.try_element_at("cells", F.col(self.weekday)), "coarse", F.lit(0.0))
        value = F.when(F.col("seen") >= self.min_rows, learned).otherwise(0.0)
        return scored.select(*df.columns, value.alias(name))


def fit_cell_median(
    train: DataFrame, target: str = "residual", scope: Sequence[str] = ("community_code",),
    slot: str = "mod", weekday: str = "dow", min_rows: int = 500, exact: bool = True,
) -> CellMedianModel:
    """Fit on rows with a known target.

    Add ``fold`` to ``scope`` to fit every fold in the same pass.  With the entity in ``scope`` a cell
    gathers one value per week (per day at the slot level), so the exact median holds little.  A
    model pooled over entities has no such bound: ``exact=False`` uses the mergeable sketch.
    Both levels come from one grouping-sets pass, and a prediction needs one join.
    """
    scope = list(scope)
    keys = [*scope, slot, weekday]
    median = F.median(target) if exact else F.percentile_approx(target, 0.5, 10_000)
    levels = (
        train.filter(F.col(target).isNotNull())
        .groupingSets([keys, [*scope, slot]], *keys)
        .agg(F.grouping(weekday).alias("_whole"), median.alias("_med"), F.count(F.lit(1)).alias("_n"))
    )
    by_slot = F.col("_whole") == 1
    table = levels.groupBy(*scope, slot).agg(
        F.max(F.when(by_slot, F.col("_med"))).alias("coarse"),
        F.sum(F.when(by_slot, F.col("_n"))).alias("n"),
        # Seven weekdays at most.
        F.map_from_entries(F.collect_list(F.when(~by_slot, F.struct(weekday, "_med")))).alias("cells"),
    ).withColumn("seen", F.sum("n").over(Window.partitionBy(*scope)))
    return CellMedianModel(table.drop("n"), scope, slot, weekday, min_rows)


@dataclass(frozen=True)
class CellMedian:
    """Learner: the median residual per (scope, slot, weekday), fitted for all scopes in one aggregation."""

    slot: str = "mod"
    weekday: str = "dow"
    min_rows: int = 500
    exact: bool = True

    def fit(self, train: DataFrame, target: str, scope: Sequence[str]) -> CellMedianModel:
        return fit_cell_median(train, target, scope, self.slot, self.weekday, self.min_rows, self.exact)


@dataclass(frozen=True)
class Boosted:
    """Learner: one pooled tree ensemble per fold over the named features, the entity among the categories.

    ``numeric`` features that the rows lack are left out, so that one list serves with and without weather.  Folds are
    few by their nature and are fitted side by side, each from the same stored rows.  With ``stop_days`` the last days of
    each fold's own train rows, which end before its purge, decide when its trees stop; they are not learned from.
    """

    numeric: Sequence[str]
    categorical: Sequence[str] = ("community_code",)
    options: Mapping[str, object] = field(default_factory=dict)
    stop_days: int | None = None
    side_by_side: int = 3

    def fit(self, train: DataFrame, target: str, scope: Sequence[str]) -> FoldModels:
        numeric = [c for c in self.numeric if c in train.columns]
        categorical = [c for c in self.categorical if c in train.columns]
        dated = self.stop_days or self.options.get("stop_date")
        extra = [c for c in (self.options.get("weight"), "target_date" if dated else None) if c]
        rows = staged(train.select(*dict.fromkeys([*(c for c in scope if c == "fold"), *numeric, *categorical, target, *extra])), "learner")
        ends = {}
        if "fold" in scope:
            # A row per fold, which are few.
            last = F.max("target_date") if self.stop_days else F.lit(None)
            ends = {r["fold"]: r["d"] for r in rows.groupBy("fold").agg(last.alias("d")).orderBy("fold").collect()}
        elif self.stop_days:
            ends = {None: rows.agg(F.max("target_date")).first()[0]}

        def one(fold) -> BoostedModel:
            options = dict(self.options)
            if self.stop_days:
                options["stop_date"] = str(ends[fold] - timedelta(days=self.stop_days - 1))
            own = rows if fold is None else rows.filter(F.col("fold") == fold)
            return fit_gbt(own, target, numeric, categorical, stage=False, **options)

        if "fold" not in scope:
            return FoldModels({None: one(None)})
        with ThreadPoolExecutor(self.side_by_side) as pool:
            return FoldModels(dict(zip(ends, pool.map(one, ends))))


@dataclass
class FoldModels:
    """An ensemble for each fold; None stands for all rows."""

    models: dict

    def predict(self, df: DataFrame, name: str = "correction") -> DataFrame:
        if None in self.models:
            return self.models[None].predict(df, name)
        parts = [model.predict(df.filter(F.col("fold") == fold), name) for fold, model in self.models.items()]
        return reduce(DataFrame.unionByName, parts)


@dataclass
class FeatureMatrix:
    """Ordered feature list and the fitted transformation that yields the ``features`` vector."""

    names: list[str]
    transformer: object
    medians: Mapping[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.transformer.transform(_imputed(df, self.medians))


def _imputed(df: DataFrame, medians: Mapping[str, float]) -> DataFrame:
    return df.withColumns({
        **{f"{c}_imp": F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in medians.items()},
        **{f"{c}_missing": flag(F.col(c).isNull()) for c in medians},
    })


def fit_feature_matrix(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = ()) -> FeatureMatrix:
    """Impute numbers by their median with a flag beside each, index categories, assemble in order.

    Trees in Spark ML reject missing values, hence the flags.  A column without any value in training
    has no median and becomes constant.  Categories unseen in training get a bucket of their own.
    """
    middle = [F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(c) for c in numeric]
    found = train.agg(*middle).first() if numeric else {}
    medians = {c: 0.0 if found[c] is None else float(found[c]) for c in numeric}
    prepared = _imputed(train, medians)
    stages = []
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_idx" for c in categorical],
                                    handleInvalid="keep"))
    inputs = [f"{c}_imp" for c in numeric] + [f"{c}_missing" for c in numeric] + [f"{c}_idx" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    names = list(numeric) + [f"{c}_missing" for c in numeric] + list(categorical)
    return FeatureMatrix(names, Pipeline(stages=stages).fit(prepared), medians)


def feature_rows(matrix: FeatureMatrix, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return matrix.transform(df).select(*keys, vector_to_array("features").alias("features"))


@dataclass
class BoostedModel:
    matrix: FeatureMatrix
    regressor: object

    def predict(self, df: DataFrame, name: str = "correction") -> DataFrame:
        scored = self.regressor.transform(self.matrix.transform(df))
        return scored.select(*df.columns, F.col("prediction").alias(name))

    def importance(self, spark) -> DataFrame:
        """Relative importance of every feature, largest first."""
        weights = self.regressor.featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(self.matrix.names, weights)), "feature string, weight double").orderBy(
            F.desc("weight"), "feature")


def fit_gbt(
    train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
    weight: str | None = None, trees: int = 20, depth: int = 5, step: float = 0.1,
    min_instances: int = 200, subsample: float = 0.85, features: str = "0.85", stop_date: str | None = None,
    seed: int = 42, stage: bool = True,
) -> BoostedModel:
    """One pooled absolute-error tree ensemble; pass the entity among ``categorical``.

    Every category is a bin of its column, which suits a portfolio's communities and promoted clients.

    ``weight`` (the baseline in kW) makes a log-ratio loss behave like error in kW.  ``stop_date``
    holds back the latest train days for early stopping, never the fold being reported.
    """
    used = dict.fromkeys([*numeric, *categorical, target, *([weight] if weight else []), *(["target_date"] if stop_date else [])])
    rows = train.filter(F.col(target).isNotNull()).select(*used)
    if stage:
        # Indexing, imputing and boosting each pass over the rows.
        rows = staged(rows, "boosting")
    matrix = fit_feature_matrix(rows, numeric, categorical)
    vectors = matrix.transform(rows)
    # Bins must cover the widest category, plus the bucket for unseen values.
    widest = max([2] + _category_sizes(vectors))
    booster = GBTRegressor(
        featuresCol="features", labelCol=target, predictionCol="prediction", lossType="absolute", maxIter=trees,
        maxDepth=depth, stepSize=step, minInstancesPerNode=min_instances, subsamplingRate=subsample,
        featureSubsetStrategy=features, maxBins=max(32, widest), seed=seed)
    if weight is not None:
        booster = booster.setWeightCol(weight)
    if stop_date is not None:
        vectors = vectors.withColumn("_stop", F.col("target_date") >= F.lit(stop_date).cast("date"))
        booster = booster.setValidationIndicatorCol("_stop")
    keep = ["features", target] + ([weight] if weight else []) + (["_stop"] if stop_date else [])
    return BoostedModel(matrix, booster.fit(vectors.select(*keep)))


def _category_sizes(vectors: DataFrame) -> list[int]:
    attrs = vectors.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    return [len(a.get("vals", [])) for a in attrs.get("nominal", [])]


def fit_gbt_per_entity(
    train: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str] = (),
    entity: str = "community_code", min_rows: int = 500, most_entities: int = 100, **options,
) -> dict[str, BoostedModel]:
    """One ensemble per entity with at least ``min_rows`` rows.

    Meant for the few dozen communities and promoted clients of a portfolio: each fit is a
    distributed job of its own, a few run side by side.  More than ``most_entities`` are refused: a model per entity
    is held on the driver; for many entities use ``fit_cell_median`` or ``fit_gbt``.  The rows are written once by
    entity, so that each fit reads its own files.
    """
    known = train.filter(F.col(target).isNotNull())
    enough = known.groupBy(entity).count().filter(F.col("count") >= min_rows).select(entity).orderBy(entity)
    names = [r[0] for r in enough.limit(most_entities + 1).collect()]
    if len(names) > most_entities:
        raise ValueError(f"more than {most_entities} entities: fit a pooled learner")
    rows = staged(known, "by-entity", partition_by=entity)

    def one(name: str) -> BoostedModel:
        return fit_gbt(rows.filter(F.col(entity) == name), target, numeric, categorical, stage=False, **options)

    with ThreadPoolExecutor(4) as pool:
        return dict(zip(names, pool.map(one, names)))


def predict_per_entity(
    models: dict[str, BoostedModel], df: DataFrame, entity: str = "community_code", name: str = "correction",
) -> DataFrame:
    """Score each entity with its own model; entities without one get 0."""
    parts = [df.filter(~F.coalesce(F.col(entity).isin(list(models)), F.lit(False))).withColumn(name, F.lit(0.0))]
    parts += [model.predict(df.filter(F.col(entity) == code), name) for code, model in models.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def blend_sweep(
    first: DataFrame, second: DataFrame, weights: Sequence[float] = BLEND_WEIGHTS,
) -> DataFrame:
    """Portfolio error of ``w·first + (1 − w)·second`` for every weight, in one job.

    The weights become one summed column each, so the joined rows are read once and not repeated.
    """
    keys = ["fold", "community_code", "datetime_utc"]
    both = first.join(second.select(*keys, F.col("pred_kw").alias("_second")), keys)
    mixed = [F.sum(F.lit(w) * F.col("pred_kw") + F.lit(1 - w) * F.col("_second")).alias(f"_w{i}")
             for i, w in enumerate(weights)]
    slots = both.groupBy("fold", "datetime_utc").agg(F.sum("total_kw").alias("_actual"), *mixed)
    errors = slots.agg(*[F.avg(F.abs(F.col("_actual") - F.col(f"_w{i}"))).alias(f"_e{i}") for i in range(len(weights))])
    pairs = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.col(f"_e{i}").alias("mae_kw"))
                      for i, w in enumerate(weights)])
    return errors.select(F.inline(pairs))


def top_features(importance: DataFrame, k: int = 5, by: str = "community_code") -> DataFrame:
    """The k heaviest features of every group, weights scaled to sum to 1 within it."""
    whole = Window.partitionBy(by)
    ranked = Window.partitionBy(by).orderBy(F.desc("weight"), "feature")
    total = F.sum("weight").over(whole)
    return (
        importance.withColumn("share", F.when(total > 0, F.col("weight") / total))
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    )


def importance_table(spark, models: dict[str, BoostedModel]) -> DataFrame:
    rows = [(code, f, w) for code, m in models.items()
            for f, w in zip(m.matrix.names, m.regressor.featureImportances.toArray().tolist())]
    return spark.createDataFrame(rows, "community_code string, feature string, weight double")
