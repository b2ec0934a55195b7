"""Joining process parameters to products and relating them to defects.

All statistics start from one table of distinct (scope, parameter, value) counts.
Ranks, quantiles, correlation and AUC are arithmetic on its running totals, so no
task ever holds all values of one parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewise.fixed_values import EXACT_KEYS, NON_PARAMETERS, TIME_KEYS
from linewise.functions import blank_to_null, is_analyzable, is_blank, is_defect_status
from linewise.operators.joining import match_join
from linewise.operators.ordering import nearest_non_null, number_rows, totals_before
from linewise.operators.quality import numeric_columns
from linewise.session import cut_lineage, stored_model

SCOPE = "analysis_scope"


# --------------------------------------------------------------------------- joins

def exact_process_join(products: DataFrame, parameters: DataFrame, order: str | None = None) -> tuple[DataFrame, str]:
    """Left join on the first shared key; repeated keys are averaged, text keeps the first.

    ``order`` names the column that says which text came first; without it the
    smallest text is kept, which is at least repeatable.
    """
    key = next((name for name in EXACT_KEYS if name in products.columns and name in parameters.columns), None)
    if key is None:
        raise ValueError("products and parameters share no product key")
    numeric = numeric_columns(parameters, exclude=(key,))
    other = [name for name in parameters.columns if name != key and name not in numeric]

    def first(name: str) -> Column:
        if order is None or order == name:
            return F.min(name)
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col(order)))

    grouped = parameters.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("_matched"), *[F.avg(name).alias(name) for name in numeric], *[first(name).alias(name) for name in other]
    )
    return _attach(products, grouped, key, parameters.columns), key


def _attach(products: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    renamed = right.select(*[
        F.col(name).alias(f"{name}_process" if name != key and name in products.columns else name) for name in right.columns
    ])
    joined = products.join(renamed, key, "left")
    return joined.withColumn(
        "match_quality", F.when(F.col("_matched").isNotNull(), "exact").otherwise("unmatched")
    ).drop("_matched")


def nearest_time_join(
    left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance_seconds: float,
    right_order: Sequence[str], quality: str = "time_nearest",
) -> DataFrame:
    """Left rows with the right row closest in time, both directions, tolerance inclusive.

    On equal distance the earlier row wins; among rows of one time the last (by
    ``right_order``) serves the earlier side and the first the later side. Both
    sides are reduced to distinct times and merged into one sorted sequence; the
    neighbours come from running windows per range partition, so neither a busy
    second nor a wide tolerance multiplies rows.
    """
    columns = [name for name in right.columns if name != right_time]
    micros = F.unix_micros(F.col(right_time).cast("timestamp"))
    row = F.struct(F.col(right_time).alias("_t_right"), *columns)
    position = F.struct(*right_order)
    moments = (
        right.where(F.col(right_time).isNotNull()).groupBy(micros.alias("_t"))
        .agg(F.max_by(row, position).alias("_last"), F.min_by(row, position).alias("_first"))
        .select("_t", F.struct("_t", "_last", "_first").alias("_row"))
    )
    left_micros = F.unix_micros(F.col(left_time).cast("timestamp"))
    asked = left.where(F.col(left_time).isNotNull()).select(left_micros.alias("_t")).distinct()
    axis = asked.withColumn("_asked", F.lit(True)).join(moments, "_t", "full_outer")
    near = nearest_non_null(axis, [], ["_t"], "_row", "_prev", "_next").where("_asked")
    back, ahead = F.col("_t") - F.col("_prev._t"), F.col("_next._t") - F.col("_t")
    limit = int(tolerance_seconds * 1_000_000)
    use_back = F.col("_prev").isNotNull() & (F.col("_next").isNull() | (back <= ahead)) & (back <= limit)
    use_ahead = F.col("_next").isNotNull() & (F.col("_prev").isNull() | (ahead < back)) & (ahead <= limit)
    chosen = near.select(
        "_t", F.when(use_back, F.col("_prev._last")).when(use_ahead, F.col("_next._first")).alias("_hit")
    )
    joined = left.withColumn("_t", left_micros).join(chosen, "_t", "left")
    values = [
        F.col(f"_hit.`{name}`").alias(f"{name}_process" if name in left.columns else name) for name in columns
    ]
    time_name = f"{right_time}_process" if right_time in left.columns else right_time
    matched = F.coalesce(*[F.col(f"_hit.`{name}`").isNotNull() for name in columns]) if not columns else None
    any_value = F.col("_hit").isNotNull() if matched is None and not columns else F.array_contains(
        F.array(*[F.col(f"_hit.`{name}`").isNotNull() for name in columns]), True
    )
    return joined.select(
        *[F.col(f"`{name}`") for name in left.columns], F.col("_hit._t_right").alias(time_name), *values,
        F.when(F.coalesce(any_value, F.lit(False)), quality).otherwise("unmatched").alias("match_quality"),
    )


def join_process(
    products: DataFrame, parameters: DataFrame, tolerance_seconds: float = 60, right_order: Sequence[str] = ()
) -> tuple[DataFrame, str]:
    """Exact join when a product key is shared, else nearest time."""
    if any(key in products.columns and key in parameters.columns for key in EXACT_KEYS):
        return exact_process_join(products, parameters)
    left_time = next((name for name in TIME_KEYS if name in products.columns), None)
    right_time = next((name for name in TIME_KEYS if name in parameters.columns), None)
    if not left_time or not right_time:
        raise ValueError("no shared product key and no time column on both sides")
    order = list(right_order) or [name for name in parameters.columns if name != right_time]
    return nearest_time_join(products, parameters, left_time, right_time, tolerance_seconds, order), f"{left_time}~{right_time}"


def defect_counts(products: DataFrame, detections: DataFrame) -> DataFrame:
    """Detected-defect count and flag per product; region anomalies do not count."""
    rows = detections.where(is_analyzable(F.col("detection_type"))) if "detection_type" in detections.columns else detections
    counts = rows.groupBy("global_order").agg(F.count("*").alias("detected_defect_count"))
    return products.join(counts, "global_order", "left").fillna(0, ["detected_defect_count"]).withColumn(
        "has_detected_defect", (F.col("detected_defect_count") > 0).cast("int")
    )


# -------------------------------------------------------------------------- targets

def build_targets(
    products: DataFrame, detections: DataFrame, codes: DataFrame | None = None,
    minimum_products: int = 4, minimum_vi_products: int = 5,
) -> DataFrame:
    """(analysis_scope, target, global_order): every product that is positive for a target."""
    rows = detections.where(is_analyzable(F.col("detection_type"))) if "detection_type" in detections.columns else detections
    parts = [rows.select(SCOPE, F.lit("DETECTED").alias("target"), "global_order").distinct()]
    if codes is not None:
        coded = codes.where(is_defect_status(F.col("code_status"))).select(
            SCOPE, "dmc_raw", F.concat_ws("_", "source_type", "canonical_code").alias("target")
        ).distinct()
        hits = products.select(SCOPE, "dmc_raw", "global_order").join(coded, [SCOPE, "dmc_raw"]).select(SCOPE, "target", "global_order")
        parts.append(_frequent(hits, minimum_products))
    if "trajectory_id" in detections.columns:
        tracks = rows.where(~is_blank(F.col("trajectory_id"))).select(
            SCOPE, F.concat(F.lit("TRAJECTORY_"), F.col("trajectory_id")).alias("target"), "global_order"
        ).distinct()
        parts.append(_frequent(tracks, minimum_products))
    for target, column in (("AOI_NOK", "aoi_state"), ("VI_NOK", "vi_state")):
        if column in products.columns:
            parts.append(products.where(F.col(column) == "NOK").select(SCOPE, F.lit(target).alias("target"), "global_order"))
    if "vi_defect_code" in products.columns:
        exploded = products.select(SCOPE, "global_order", F.explode(F.split(F.coalesce("vi_defect_code", F.lit("")), ";")).alias("_c"))
        vi = exploded.where(~is_blank(F.col("_c"))).select(
            SCOPE, F.concat(F.lit("VI_CODE_"), F.trim("_c")).alias("target"), "global_order"
        )
        counted = vi.groupBy(SCOPE, "target").agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum_vi_products)
        parts.append(vi.join(counted.drop("_n"), [SCOPE, "target"]).distinct())
    result = parts[0]
    for more in parts[1:]:
        result = result.unionByName(more)
    return result


def _frequent(hits: DataFrame, minimum: int) -> DataFrame:
    counted = hits.groupBy(SCOPE, "target").agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum)
    return hits.join(counted.drop("_n"), [SCOPE, "target"])


def parameter_names(parameters: DataFrame) -> list[str]:
    return numeric_columns(parameters, exclude=NON_PARAMETERS)


def tall_parameters(joined: DataFrame, names: Sequence[str]) -> DataFrame:
    """(analysis_scope, global_order, parameter, value) of a joined wide table, nulls kept."""
    scope = F.col(SCOPE) if SCOPE in joined.columns else F.lit("")
    pairs = F.array(*[
        F.struct(F.lit(name).alias("parameter"), F.col(f"`{name}`").cast("double").alias("value")) for name in names
    ])
    return joined.select(scope.alias(SCOPE), "global_order", F.explode(pairs).alias("_p")).select(
        SCOPE, "global_order", "_p.parameter", "_p.value"
    )


# ------------------------------------------------------------------------ statistics

VALUE_KEY = [SCOPE, "parameter"]


def ranked_values(tall: DataFrame) -> DataFrame:
    """Distinct values with count, rows below, and the average rank of the value."""
    counts = tall.where("value is not null").groupBy(*VALUE_KEY, "value").agg(F.count("*").alias("n"))
    below = totals_before(counts, VALUE_KEY, ["value"], {"below": "n"})
    return below.withColumn("average_rank", F.col("below") + (F.col("n") + 1) / 2)


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "average_rank") -> DataFrame:
    """Rows with the mean rank of their value in the group; ties share it."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    below = totals_before(counts, keys, [value], {"_below": "_n"})
    ranks = below.withColumn(name, F.col("_below") + (F.col("_n") + 1) / 2).drop("_n", "_below")
    return match_join(df, ranks, [*keys, value], "left")


def _positives(tall: DataFrame, targets: DataFrame) -> DataFrame:
    """Positive counts per (scope, target, parameter, value)."""
    rows = tall.where("value is not null").join(targets.distinct(), [SCOPE, "global_order"])
    return rows.groupBy(SCOPE, "target", "parameter", "value").agg(F.count("*").alias("positives"))


def parameter_metrics(tall: DataFrame, targets: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Class means, Spearman and standardised effect per (scope, target, parameter).

    A 0/1 target makes Spearman a function of the rank sum of the positives, so
    three sums over distinct values replace a sort of the rows.
    """
    values = ranked_values(tall) if values is None else values
    general = tall.groupBy(*VALUE_KEY).agg(
        F.count("value").alias("n"), F.count("*").alias("rows"), F.sum("value").alias("sum_x"),
        F.stddev_samp("value").alias("sd"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
    )
    ranks = values.groupBy(*VALUE_KEY).agg(
        F.sum(F.col("n") * F.col("average_rank") * F.col("average_rank")).alias("sum_rr"),
        F.count("*").alias("distinct_values"),
    )
    hits = _positives(tall, targets).join(values.drop("n", "below"), [*VALUE_KEY, "value"]).groupBy(
        SCOPE, "target", "parameter"
    ).agg(
        F.sum("positives").alias("np"), F.sum(F.col("positives") * F.col("value")).alias("sum_px"),
        F.sum(F.col("positives") * F.col("average_rank")).alias("sum_pr"),
    )
    names = targets.select(SCOPE, "target").distinct()
    rows = (
        general.join(ranks, VALUE_KEY, "left").join(names, SCOPE)
        .join(hits, [SCOPE, "target", "parameter"], "left").fillna(0, ["np", "sum_px", "sum_pr"])
    )
    n, np_, share = F.col("n"), F.col("np"), F.col("np") / F.nullif(F.col("n"), F.lit(0))
    mean_rank = (n + 1) / 2
    cov = F.col("sum_pr") / F.nullif(n, F.lit(0)) - mean_rank * share
    var_rank = F.col("sum_rr") / F.nullif(n, F.lit(0)) - mean_rank * mean_rank
    varied = (n > 1) & (F.col("distinct_values") > 1) & (np_ > 0) & (np_ < n)
    mean_defect = F.when(np_ > 0, F.col("sum_px") / np_)
    mean_normal = F.when(n > np_, (F.col("sum_x") - F.col("sum_px")) / (n - np_))
    return rows.select(
        SCOPE, "target", "parameter", n.alias("sample_count"), (1 - n / F.col("rows")).alias("missing_rate"),
        mean_defect.alias("defect_mean"), mean_normal.alias("normal_mean"),
        F.when(varied, cov / F.sqrt(var_rank * share * (1 - share))).alias("spearman"),
        F.when((F.col("sd") > 0), (mean_defect - mean_normal) / F.col("sd")).alias("effect_size"),
        "minimum", "maximum",
    )


def rank_parameters(metrics: DataFrame) -> DataFrame:
    """Metrics ordered by absolute Spearman, strongest first."""
    return metrics.orderBy(F.abs(F.coalesce("spearman", F.lit(0.0))).desc(), SCOPE, "target", "parameter")


def quantile_edges(values: DataFrame, bins: int = 5) -> DataFrame:
    """Distinct linear-interpolation quantile edges per (scope, parameter), exact.

    Only groups with at least five values and two distinct ones. The edges are read
    off the running totals: a rank falls into exactly one value's interval.
    """
    sizes = values.groupBy(*VALUE_KEY).agg(F.sum("n").alias("total"), F.count("*").alias("distinct_values"))
    sizes = sizes.where("total >= 5 and distinct_values > 1").withColumn(
        "q", F.least(F.lit(bins), F.col("distinct_values")).cast("int")
    )
    wanted = sizes.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("q")))).withColumn(
        "_h", (F.col("total") - 1) * F.col("k") / F.col("q")
    ).withColumn("_low", F.floor("_h")).withColumn("_part", F.col("_h") - F.floor("_h"))
    ranks = wanted.groupBy(*VALUE_KEY).agg(
        F.array_distinct(F.flatten(F.collect_list(F.array(F.col("_low"), F.least(F.col("_low") + 1, F.col("total") - 1))))).alias("_ranks")
    )
    picked = (
        values.join(ranks, VALUE_KEY)
        .select(
            *VALUE_KEY, "value",
            F.explode(F.filter("_ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n")))).alias("_rank"),
        )
    )
    low = picked.select(*VALUE_KEY, F.col("_rank").alias("_low"), F.col("value").alias("_a"))
    high = picked.select(*VALUE_KEY, F.col("_rank").alias("_high"), F.col("value").alias("_b"))
    edges = (
        wanted.withColumn("_high", F.least(F.col("_low") + 1, F.col("total") - 1))
        .join(low, [*VALUE_KEY, "_low"]).join(high, [*VALUE_KEY, "_high"])
        .withColumn("_edge", F.when(F.col("_part") == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")))
    )
    return edges.groupBy(*VALUE_KEY).agg(F.sort_array(F.collect_set("_edge")).alias("edges"))


def binned_rates(tall: DataFrame, targets: DataFrame, values: DataFrame | None = None, bins: int = 5) -> DataFrame:
    """Defect rate per quantile bin (lower, upper], the first bin includes its lower edge."""
    values = ranked_values(tall) if values is None else values
    edges = quantile_edges(values, bins)
    binned = (
        values.join(edges, VALUE_KEY)
        .withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda edge: edge < F.col("value")))))
    )
    sizes = binned.groupBy(*VALUE_KEY, "bin", "edges").agg(F.sum("n").alias("sample_count"))
    hits = _positives(tall, targets).join(binned.select(*VALUE_KEY, "value", "bin"), [*VALUE_KEY, "value"]).groupBy(
        SCOPE, "target", "parameter", "bin"
    ).agg(F.sum("positives").alias("defect_count"))
    names = targets.select(SCOPE, "target").distinct()
    rows = sizes.join(names, SCOPE).join(hits, [SCOPE, "target", "parameter", "bin"], "left").fillna(0, ["defect_count"])
    return rows.select(
        SCOPE, "target", "parameter", F.col("bin").cast("bigint").alias("bin"),
        F.element_at("edges", F.col("bin")).alias("lower"), F.element_at("edges", F.col("bin") + 1).alias("upper"),
        "sample_count", "defect_count", (F.col("defect_count") / F.col("sample_count")).alias("defect_rate"),
    )


def auc(scores: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by rank sums with average ranks; null with one class."""
    counts = scores.groupBy(*keys, score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("bigint")).alias("_p"))
    below = totals_before(counts, keys, [score], {"_below": "_n"})
    rank = F.col("_below") + (F.col("_n") + 1) / 2
    sums = below.groupBy(*keys).agg(
        F.sum("_n").alias("_all"), F.sum("_p").alias("_pos"), F.sum(F.col("_p") * rank).alias("_ranks")
    )
    pos, neg = F.col("_pos"), F.col("_all") - F.col("_pos")
    return sums.select(
        *keys, F.when((pos > 0) & (neg > 0), (F.col("_ranks") - pos * (pos + 1) / 2) / (pos * neg)).alias("auc")
    )


def relationship_summary(joined: DataFrame, join_key: str, parameters: Sequence[str]) -> DataFrame:
    """Match rate and counts of a joined product-parameter table."""
    return joined.agg(
        F.lit(join_key).alias("join_key"), F.count("*").alias("product_count"),
        F.count_if(F.col("match_quality") != "unmatched").alias("matched_count"),
        F.coalesce(F.try_divide(F.count_if(F.col("match_quality") != "unmatched"), F.count("*")), F.lit(0.0)).alias("match_rate"),
        F.lit(len(parameters)).cast("bigint").alias("parameter_count"),
        F.coalesce(F.sum("has_detected_defect"), F.lit(0)).alias("defective_product_count"),
    )


# ----------------------------------------------------------------------------- model

def split_holdout(joined: DataFrame, target: str, batch: str | None, order: str = "global_order") -> tuple[DataFrame, str]:
    """Flag the last fifth of batches (by first appearance) or of rows as hold-out."""
    usable = joined.where(F.col(target).isNotNull())
    if batch and usable.select(batch).distinct().limit(2).count() == 2:
        batches = number_rows(usable.groupBy(batch).agg(F.min(order).alias("_first")), ["_first", batch], "_at")
        total = batches.agg(F.count("*").alias("_total"))
        cut = F.greatest(F.lit(1), F.floor(F.col("_total") * 0.8))
        flags = batches.crossJoin(total).select(batch, (F.col("_at") > cut).alias("holdout"))
        return match_join(usable, flags, [batch]), "last fifth of batches"
    ranked = number_rows(usable, [order], "_at")
    total = usable.agg(F.count("*").alias("_total"))
    cut = F.greatest(F.lit(1), F.least(F.col("_total") - 1, F.floor(F.col("_total") * 0.8)))
    return ranked.crossJoin(total).withColumn("holdout", F.col("_at") > cut).drop("_at", "_total"), "last fifth by order"


def logistic_importance(
    joined: DataFrame, features: Sequence[str], target: str = "has_detected_defect", batch: str | None = None,
) -> tuple[DataFrame, dict[str, object]]:
    """Standardised L2-logistic coefficients with relative importance and hold-out AUC."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = joined.sparkSession
    names = [name for name in features]
    empty = spark.createDataFrame([], "parameter string, coefficient double, relative_importance double")
    typed = joined.select("*", *[]).withColumns({name: F.col(f"`{name}`").cast("double") for name in names}).withColumn(
        target, F.col(target).cast("double")
    )
    classes = typed.where(F.col(target).isNotNull()).agg(
        F.count("*").alias("n"), F.min(target).alias("low"), F.max(target).alias("high")
    ).first()
    if classes["n"] < 20 or classes["low"] == classes["high"]:
        return empty, {"validation_method": "too few samples", "validation_auc": None}
    flagged, method = split_holdout(typed, target, batch)
    flagged = cut_lineage(flagged)
    by_part = {row["holdout"]: row for row in flagged.groupBy("holdout").agg(
        F.min(target).alias("low"), F.max(target).alias("high")).collect()}  # at most two rows
    one_class = len(by_part) < 2 or any(row["low"] == row["high"] for row in by_part.values())
    if one_class:
        method = "fitted on all rows (hold-out lacks a class)"
    train = flagged if one_class else flagged.where(~F.col("holdout"))
    filled = [f"_f{i}" for i in range(len(names))]
    middle = train.agg(*[F.median(name).alias(f) for name, f in zip(names, filled)]).first()  # exact; one row

    def imputed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({f: F.coalesce(F.nanvl(F.col(name), F.lit(None)), F.lit(middle[f]), F.lit(0.0)) for name, f in zip(names, filled)})

    model = Pipeline(stages=[
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        LogisticRegression(
            featuresCol="_x", labelCol=target, regParam=0.01, elasticNetParam=0.0, standardization=False,
            probabilityCol="_p", maxIter=200, tol=1e-9,
        ),
    ]).fit(imputed(train))
    model = stored_model(spark, model)
    weights = [float(value) for value in model.stages[-1].coefficients]
    total = sum(map(abs, weights)) or 1.0
    importance = spark.createDataFrame(
        [(name, weight, abs(weight) / total) for name, weight in zip(names, weights)], empty.schema
    )
    score = None
    if not one_class:
        scored = model.transform(imputed(flagged.where("holdout"))).select(
            vector_to_array("_p")[1].alias("_score"), F.col(target).alias("_y")
        )
        score = auc(scored, [], "_score", "_y").first()["auc"]
    return importance, {"validation_method": method, "validation_auc": score}
