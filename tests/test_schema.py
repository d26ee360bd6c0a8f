"""Declared layouts and feature selections."""

import pytest

from flowforge.operators.projection import drop_columns, rename_by_position, select_features
from flowforge.schema import (CANONICAL_CLASSES, FLOW_SCHEMA, GENERATED_COLUMNS, ORIGINAL_CLASSES,
                              ORIGINAL_COLUMNS, ORIGINAL_FLOW_SCHEMA, feature_columns,
                              original_to_canonical)


def test_layout_widths_and_features():
    assert len(GENERATED_COLUMNS) == 83 and len(ORIGINAL_COLUMNS) == 85
    assert len(feature_columns("original")) == 69
    assert len(feature_columns("generated")) == 74
    assert "fwd_head_len_bis" in feature_columns("original")
    assert dict((f.name, f.dataType.simpleString()) for f in FLOW_SCHEMA)["timestamp"] == "bigint"
    assert dict((f.name, f.dataType.simpleString()) for f in ORIGINAL_FLOW_SCHEMA)["timestamp"] == "string"


def test_label_alignment():
    m = original_to_canonical()
    assert m["Web Attack \x96 XSS"] == "webattack_xss"
    assert m["Web Attack \x96 Sql Injection"] == "webattack_sql_injection"
    assert "Infiltration" not in m and len(CANONICAL_CLASSES) == 14 and len(ORIGINAL_CLASSES) == 15


def test_projection_errors(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        rename_by_position(df, ["x"])
    with pytest.raises(KeyError):
        drop_columns(df, ["nope"])
    with pytest.raises(ValueError):
        select_features(df, "unknown")
