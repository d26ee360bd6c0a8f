"""Scans, sinks and the end-to-end jobs on small hand-made capture files."""

import os
import random

import pytest
from pyspark.sql import functions as F

from flowforge.plans.workflows import build_dataset, compare_classifiers, label_capture_files
from flowforge.schema import (CANONICAL_CLASSES, GENERATED_COLUMNS, ORIGINAL_CLASSES,
                              ORIGINAL_COLUMNS)
from flowforge.sources.flows import day_from_file, load, load_splits, read_flows

A, V = "172.16.0.1", "192.168.10.50"


def _gen_row(rnd, flow_id, src, dst, dport, prot, ts, label, n_feat=75):
    feats = [f"{rnd.uniform(0, 100):.4f}" for _ in range(n_feat)]
    return [flow_id, src, str(rnd.randint(1024, 65000)), dst, str(dport), str(prot), ts] + feats + [label]


def _write_csv(path, header, rows, encoding="ISO-8859-1"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


@pytest.fixture(scope="module")
def capture_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("captures")
    rnd = random.Random(0)
    days = {
        "Monday": [("m1", A, V, 80, 6, "1499100000000000")],
        "Tuesday": [("t1", A, V, 21, 6, "1499170620000000"), ("t2", A, V, 22, 6, "1499188140000000"),
                    ("t3", V, A, 21, 6, "1499170620000000")],
        "Wednesday": [("w1", A, "192.168.10.51", 444, 6, "1499250000000000")],
        "Thursday": [("h1", A, V, 80, 6, "1499353200000000"), ("h2", A, V, 80, 6, "1499343300000000")],
        "Friday": [("f1", "1.2.3.4", "52.6.13.28", 80, 6, "1499430000000000"),
                   ("f2", A, V, 80, 6, "1499451842000000")],
    }
    for day, flows in days.items():
        rows = [_gen_row(rnd, fid, s, t, p, pr, ts, "NeedLabel") for fid, s, t, p, pr, ts in flows]
        rows.append([""] * len(GENERATED_COLUMNS))  # blank line of separators
        _write_csv(os.path.join(d, f"{day}-WorkingHours.csv"), GENERATED_COLUMNS, rows)
    return str(d)


def test_read_flows_and_day(spark, capture_dir):
    df = day_from_file(read_flows(spark, f"{capture_dir}/*.csv"))
    assert df.count() == 14
    days = {r["day"] for r in df.select("day").distinct().collect()}
    assert days == {"monday", "tuesday", "wednesday", "thursday", "friday"}
    assert dict(df.dtypes)["timestamp"] == "bigint"


def test_label_capture_files(spark, capture_dir, tmp_path):
    paths = [os.path.join(capture_dir, f) for f in sorted(os.listdir(capture_dir))]
    counts = {(r["day"], r["label"]): r["count"]
              for r in label_capture_files(spark, paths, str(tmp_path / "out")).collect()}
    assert counts[("tuesday", "ftp_patator")] == 1
    assert counts[("tuesday", "ssh_patator")] == 1
    # heartbleed needs source port 45022; the fixture row has another port
    assert ("wednesday", "heartbleed") not in counts
    assert counts[("thursday", "webattack_bruteforce")] == 1
    assert ("friday", "portscan") in counts
    # one CSV folder per capture day (A5), with a header line
    out = tmp_path / "out"
    assert sorted(p.name for p in out.iterdir() if p.name.startswith("day=")) == [
        "day=friday", "day=monday", "day=thursday", "day=tuesday", "day=wednesday"]
    # every day in flow order (F1), missing times last
    for day in out.glob("day=*"):
        times = [r["timestamp"] for r in spark.read.schema("flow_id string, src_addr string, src_port long, "
                 "dst_addr string, dst_port long, ip_prot long, timestamp long").option("header", True)
                 .csv([str(f) for f in sorted(day.glob("*.csv"))]).coalesce(1).collect()]
        assert times == sorted(times, key=lambda t: (t is None, t or 0)), day
    first_csv = next((out / "day=tuesday").glob("*.csv"))
    assert first_csv.read_text(encoding="ISO-8859-1").startswith("flow_id,")
    # a blank line keeps a missing label (left out of the counts) except on
    # Monday, where every row is set to benign
    assert counts[("tuesday", "benign")] == 1
    assert counts[("monday", "benign")] == 2


def test_load_dispatch(spark, tmp_path):
    with pytest.raises(ValueError):
        load(spark, str(tmp_path), "xlsx")


def _orig_rows(rnd, n, label):
    rows = []
    for i in range(n):
        vals = [f"id{label[:3]}{i}", "10.0.0.1", "1000", "10.0.0.2", "80", "6", "7/7/2017 9:00"]
        vals += [f"{rnd.uniform(0, 10) + ORIGINAL_CLASSES.index(label) * 5:.4f}" for _ in range(77)]
        vals.append(label)
        rows.append(vals)
    return rows


def test_build_original_dataset(spark, tmp_path):
    rnd = random.Random(1)
    rows = _orig_rows(rnd, 60, "BENIGN") + _orig_rows(rnd, 30, "Web Attack \x96 XSS") \
        + _orig_rows(rnd, 20, "DDoS") + _orig_rows(rnd, 4, "Infiltration")
    rows[3][20] = "Infinity"  # flow_byte_per_s read as a float: +inf, kept
    rows[5][30] = ""          # a missing feature: row dropped
    rows.append([""] * 85)    # blank line: removed
    header = [f"Col {i}" for i in range(85)]
    src = tmp_path / "orig"
    src.mkdir()
    _write_csv(src / "Wednesday-original.csv", header, rows)
    split, sizes, const = build_dataset(spark, [str(src / "Wednesday-original.csv")],
                                        "original", str(tmp_path / "sets" / "original"))
    got = {(r["label"], r["split"]): r["count"] for r in sizes.collect()}
    # benign: 58 clean rows, 9.6941 % -> 5 train, 4.84705 % -> 2 cv / 2 test
    assert got[("benign", "train")] == int(58 * 9.6941 / 100)
    assert got[("webattack_xss", "train")] == 15
    assert not any(k[0] == "Infiltration" for k in got)
    assert split.columns[:3] == ORIGINAL_COLUMNS[:3]
    assert "prot" in {r["column"] for r in const.collect()}
    sets = load_splits(spark, str(tmp_path / "sets"), "original")
    assert sets["train"].count() == sum(v for (l, s), v in got.items() if s == "train")


def test_build_generated_and_compare(spark, tmp_path):
    rnd = random.Random(2)
    rows = []
    for c, lab in enumerate(["benign", "ddos", "portscan"]):
        for i in range(200):  # more train rows than features, so that covariances have full rank
            r = _gen_row(rnd, f"{lab}{i}", A, V, 80, 6, str(1499000000000000 + i), lab)
            for j in range(7, 82):
                r[j] = f"{float(r[j]) / 10 + 10 * c:.4f}"
            rows.append(r)
    src = tmp_path / "gen"
    src.mkdir()
    _write_csv(src / "Friday-WorkingHours.csv", GENERATED_COLUMNS, rows)
    build_dataset(spark, [str(src / "Friday-WorkingHours.csv")], "generated",
                  str(tmp_path / "sets" / "generated"))
    table = compare_classifiers(spark, str(tmp_path / "sets"), "generated",
                                str(tmp_path / "metrics"))
    vals = {r["metric"]: r for r in table.collect()}
    assert set(vals) >= {"TP", "FP", "FN", "TN", "MCC", "Training time", "Prediction time"}
    assert vals["Prediction time"]["k-NN"] > 0 and vals["Training time"]["k-NN"] >= 0
    for model in ("MLP", "LDA", "QDA", "k-NN", "DT", "RF"):
        assert vals["Accuracy"][model] >= 0.9, model
    # three classes in a line: no line parts the middle one, yet benign rows are kept
    assert vals["TN"]["SVM"] >= 8
    assert sum(vals[m]["SVM"] for m in ("TP", "FP", "FN", "TN")) == 15 + 50 + 49
    assert os.path.isdir(tmp_path / "metrics")


def test_read_parquet_drops_pandas_index(spark, tmp_path):
    import pandas as pd
    pdf = pd.DataFrame({"a": [1, 2, 3], "label": ["x", "y", "z"]}).sample(frac=1, random_state=0)
    p = str(tmp_path / "set.parquet")
    pdf.to_parquet(p)
    from flowforge.sources.flows import read_parquet
    df = read_parquet(spark, p)
    assert df.columns == ["a", "label"] and df.count() == 3


def test_iso_8859_1_labels(spark, tmp_path):
    header = [f"c{i}" for i in range(85)]
    rnd = random.Random(3)
    rows = _orig_rows(rnd, 2, "Web Attack \x96 Brute Force")
    _write_csv(tmp_path / "x.csv", header, rows)
    labels = {r["label"] for r in read_flows(spark, str(tmp_path / "x.csv"), "original").collect()}
    assert labels == {"Web Attack \x96 Brute Force"}


def test_jobs_remove_what_only_they_read(spark, scratch, monkeypatch):
    """The cleaned flows of a build, the lines of a comparison and its model input are gone at the end."""
    import os

    from flowforge.plans import q_files
    from flowforge.session import ensure_checkpoint_dir
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    spark.range(1500).withColumnRenamed("id", "event_id").write.parquet(f"{scratch}/events.parquet")
    rows = q_files.compare_files(spark, scratch).collect()
    assert {r["LDA"] for r in rows if r["metric"] == "Accuracy"} == {1.0}
    left = {f.split("-")[0] for f in set(os.listdir(folder)) - before}
    assert "sets" in left and "metrics" in left
    assert not left & {"flows", "lines", "model"}
