"""End-to-end jobs: label capture files (K1), build the two datasets (K2,
K3), compare classifiers (K4).

Each is one lazy plan per output; the only driver round trips are small
aggregates (per-class counts for the split cut, fitted statistics).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowforge.operators import classifiers as C
from flowforge.operators.capture_rules import CAPTURE_DAYS
from pyspark.sql import types as T

from flowforge.functions.exprs import hash_key
from flowforge.operators.cleaning import CleanReport, validate_labels
from flowforge.session import ensure_checkpoint_dir, remove_folder, shuffles_released, wide_table_settings
from flowforge.operators.labelling import label_by_day
from flowforge.operators.metrics import binary_metrics, metric_rows, metric_table
from flowforge.operators.profile import class_counts, constant_features
from flowforge.operators.projection import canonical_labels, select_features, select_label
from flowforge.operators.scaling import apply_label_index, fit_label_index, normalize_splits
from flowforge.operators.split import hash_rank, row_order, shuffle_sets, sort_flows, split_sizes, stratified_split
from flowforge.schema import (CANONICAL_CLASSES, INFINITY_TOKENS, ORIGINAL_CLASSES,
                              TRAIN_PERCENTAGES, feature_columns, original_to_canonical)
from flowforge.sources.flows import (day_from_file, load_splits, read_flows, write_labelled,
                                     write_metric_table, write_splits)


def label_capture_files(spark: SparkSession, paths: Sequence[str], output: str | None = None):
    """K1: scan all day files once, label by day, drop, write one folder per day.

    Every day is written in flow order (F1), as one range-partitioned sort.
    Returns the per-(day, label) counts.  No shuffle in the labelling plan; the
    counts are one small aggregation.
    """
    wide_table_settings(spark)
    flows = day_from_file(read_flows(spark, paths, "generated", check_header=True))
    labelled = label_by_day(flows, "day", CAPTURE_DAYS).drop("source_file")
    if output is not None:
        write_labelled(sort_flows(labelled, ["day", *FLOW_ORDER]), output)
        labelled = (spark.read.option("header", True)
                    .schema(labelled.drop("day").schema).csv(output))
    return (labelled.filter(F.col("label").isNotNull())
            .groupBy("day", "label").agg(F.count(F.lit(1)).alias("count")))


#: The order of the flows of a day.
FLOW_ORDER = ("timestamp", "src_port", "dst_port", "src_addr", "dst_addr")


def _percentages(dataset: str, names: Sequence[str]) -> dict:
    return dict(zip(names, TRAIN_PERCENTAGES[dataset]))


def clean_flows(df: DataFrame, classes: Sequence[str], report: CleanReport | None = None) -> DataFrame:
    """C1 + C4 + C3 + B6 as one projection and one filter (row-local; the
    per-file repetition of the outlier pass is unnecessary).

    Every column gets its final cleaning expression in a single ``select`` so
    the plan stays flat: blank strings and infinity tokens -> NULL, NaN ->
    NULL, rate columns -> double.  Then rows with a missing key are removed
    (C1), labels are checked (C4) and rows with any missing cell dropped (C3).
    """
    tokens = list(INFINITY_TOKENS)
    rates = {"flow_byte_per_s", "flow_pkt_per_s"}
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            e = F.when((c == "") | c.isin(*tokens), F.lit(None)).otherwise(c)
            if f.name in rates:
                e = e.try_cast("double")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            e = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        else:
            e = c
        cols.append(e.alias(f.name))
    flat = (df if report is None else report.observe(df, "read")).select(*cols).filter(F.col("flow_id").isNotNull())
    if report is None:
        return validate_labels(flat, classes).na.drop(how="any")
    return report.observe(validate_labels(report.observe_missing(flat), classes).na.drop(how="any"), "kept")


#: Columns of the stored flows: their order in the split and in the written sets.
SPLIT_ORDER, SHUFFLE_ORDER = "_split_order", "_shuffle_order"


def build_dataset(spark: SparkSession, paths: Sequence[str], dataset: str,
                  output: str | None = None, seed: int = 0, report: CleanReport | None = None):
    """K2 (``original``: original layout, renamed by position, labels mapped
    to canonical names) or K3 (``generated``: generated layout).

    Returns ``(split frame, split sizes, constant features)``; writes the sets
    partitioned by ``split`` when ``output`` is given; ``report`` gets the counts of the
    cleaning steps, observed on the way.
    """
    wide_table_settings(spark)
    if dataset == "original":
        flows = read_flows(spark, paths, "original", with_file=False)
        flows = clean_flows(flows, ORIGINAL_CLASSES, report)
        flows = canonical_labels(flows, original_to_canonical())
        names = CANONICAL_CLASSES + ["Infiltration"]
    elif dataset == "generated":
        flows = read_flows(spark, paths, "generated", with_file=False, check_header=True)
        flows = clean_flows(flows, CANONICAL_CLASSES, report)
        names = CANONICAL_CLASSES
    else:
        raise ValueError(f"unknown dataset {dataset!r}")
    # flows have no unique key: order by a hash of the whole row, so identical
    # rows are interchangeable and the split is deterministic as a multiset
    key_cols = [c for c in flows.columns]
    # the split reads the cleaned flows several times (class sizes, cuts, sets): they are
    # written once in the shared checkpoint folder with both order keys, in columns, so that
    # counting reads slim columns and no wide row is hashed twice; this also cuts the lineage
    stored = f"{ensure_checkpoint_dir(spark).rstrip('/')}/flows-{uuid.uuid4().hex}"
    # every cell is turned to text once, for both keys (no cell is missing here)
    text = flows.withColumn("_text", F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols]))
    text.withColumns({SPLIT_ORDER: row_order(flows, [F.col("_text")], seed),
                      SHUFFLE_ORDER: hash_key([F.col("_text")], "shuffle")}).drop("_text").write.parquet(stored)
    flows = spark.read.parquet(stored)
    split = stratified_split(flows, "label", key_cols, _percentages(dataset, names), seed=seed, order=SPLIT_ORDER)
    if output is not None:
        # each finished set is written in shuffled order
        with shuffles_released(spark):
            write_splits(shuffle_sets(split, ["split"], key_cols, order=SHUFFLE_ORDER), output)
        split = spark.read.parquet(output)
        remove_folder(spark, stored)  # all that follows reads the written sets
    else:
        split = split.drop(SHUFFLE_ORDER)
    sizes = split_sizes(split, "label")
    const = constant_features(split, "split")
    return split, sizes, const


def compare_classifiers(spark: SparkSession, root: str, dataset: str,
                        output: str | None = None, models: Sequence[str] = tuple(C.MODELS),
                        knn_block_rows: int = 4096, label_col: str = "label") -> DataFrame:
    """K4: load the sets, pick the label column, select features, index labels on train, z-score with
    training statistics (no clip, float64), fit each model on train, score on
    test, and return the 13 x models metric table."""
    wide_table_settings(spark)
    sets = {name: select_label(df, label_col) for name, df in load_splits(spark, root, dataset).items()}
    feats = feature_columns(dataset)
    idx = fit_label_index(sets["train"])
    tagged = None
    for name, df in sets.items():
        part = df.withColumn("split", F.lit(name))
        tagged = part if tagged is None else tagged.unionByName(part)
    tagged = apply_label_index(idx, tagged)
    tagged = normalize_splits(tagged, feats, "split", "train", "z_score_std", 0, "float64")
    tagged = tagged.select("split", "label_idx",
                           C.features_array(feats, fill_null=0.0).alias("features"))
    # ids follow the content, not the files, so ties are decided alike on any layout
    tagged = hash_rank(tagged, ["split"], ["label_idx", "features"], 0) \
        .select(F.col("_rank").cast("long").alias("id"), "split", "label_idx",
                *[F.get("features", F.lit(i)).alias(c) for i, c in enumerate(feats)])
    # cut lineage once; every model reads it.  As columns it takes a fraction of the disk that rows do
    stored = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-input-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        tagged.write.parquet(stored)
    tagged = spark.read.parquet(stored).select(
        "id", "split", "label_idx", C.features_array(feats).alias("features"))
    train = tagged.filter(F.col("split") == "train")
    test = tagged.filter(F.col("split") == "test")
    runs = C.model_runs(train, test, knn_block_rows)
    long = None
    chosen = [m for m in models if m in runs]
    for name in chosen:
        fit, predict = runs[name]
        with shuffles_released(spark):
            pred, train_sec, pred_sec = C.timed_fit_predict(fit, predict)
        rows = metric_rows(name, binary_metrics(pred), train_sec, pred_sec)
        long = rows if long is None else long.unionByName(rows)
    remove_folder(spark, stored)  # the predictions are checkpointed
    table = metric_table(long, chosen)
    if output is not None:
        write_metric_table(table, output)
    return table


def label_counts(df: DataFrame) -> DataFrame:
    """E1 over a labelled frame."""
    return class_counts(df, "label")
