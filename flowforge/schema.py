"""Declared schemas and class dimensions of the flow tables.

Schemas are declared, never inferred: inference costs a pass over the data and
can differ between files of the same day.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names of the two flow layouts and the class names.
# They must equal the published files' layouts, so they are stated as text,
# in file order.
# ---------------------------------------------------------------------------

#: Generated (rule-labelled) flows, 83 columns in file order.
GENERATED_COLUMNS = [
    "flow_id", "src_addr", "src_port", "dst_addr", "dst_port", "ip_prot",
    "timestamp", "flow_duration", "down_up_ratio", "pkt_len_max",
    "pkt_len_min", "pkt_len_mean", "pkt_len_var", "pkt_len_std",
    "bytes_per_s", "pkt_per_s", "fwd_pkt_per_s", "bwd_pkt_per_s",
    "fwd_pkt_cnt", "fwd_pkt_len_tot", "fwd_pkt_len_max", "fwd_pkt_len_min",
    "fwd_pkt_len_mean", "fwd_pkt_len_std", "fwd_pkt_hdr_len_tot",
    "fwd_pkt_hdr_len_min", "fwd_non_empty_pkt_cnt", "bwd_pkt_cnt",
    "bwd_pkt_len_tot", "bwd_pkt_len_max", "bwd_pkt_len_min",
    "bwd_pkt_len_mean", "bwd_pkt_len_std", "bwd_pkt_hdr_len_tot",
    "bwd_pkt_hdr_len_min", "bwd_non_empty_pkt_cnt", "iat_max", "iat_min",
    "iat_mean", "iat_std", "fwd_iat_tot", "fwd_iat_max", "fwd_iat_min",
    "fwd_iat_mean", "fwd_iat_std", "bwd_iat_tot", "bwd_iat_max",
    "bwd_iat_min", "bwd_iat_mean", "bwd_iat_std", "active_max", "active_min",
    "active_mean", "active_std", "idle_max", "idle_min", "idle_mean",
    "idle_std", "flag_syn", "flag_fin", "flag_rst", "flag_ack", "flag_psh",
    "fwd_flag_psh", "bwd_flag_psh", "flag_urg", "fwd_flag_urg",
    "bwd_flag_urg", "flag_cwr", "flag_ece", "fwd_bulk_bytes_mean",
    "fwd_bulk_pkt_mean", "fwd_bulk_rate_mean", "bwd_bulk_bytes_mean",
    "bwd_bulk_pkt_mean", "bwd_bulk_rate_mean", "fwd_subflow_bytes_mean",
    "fwd_subflow_pkt_mean", "bwd_subflow_bytes_mean", "bwd_subflow_pkt_mean",
    "fwd_TCP_init_win_bytes", "bwd_TCP_init_win_bytes", "label",
]

#: Original (published) flows, 85 columns, assigned by position.
ORIGINAL_COLUMNS = [
    "flow_id", "src_addr", "src_port", "dst_addr", "dst_port", "prot",
    "timestamp", "flow_duration", "tot_fwd_pkt", "tot_bwd_pkt",
    "fwd_pkt_len_tot", "bwd_pkt_len_tot", "fwd_pkt_len_max",
    "fwd_pkt_len_min", "fwd_pkt_len_mean", "fwd_pkt_len_std",
    "bwd_pkt_len_max", "bwd_pkt_len_min", "bwd_pkt_len_mean",
    "bwd_pkt_len_std", "flow_byte_per_s", "flow_pkt_per_s", "flow_iat_mean",
    "flow_iat_std", "flow_iat_max", "flow_iat_min", "fwd_iat_tot",
    "fwd_iat_mean", "fwd_iat_std", "fwd_iat_max", "fwd_iat_min",
    "bwd_iat_tot", "bwd_iat_mean", "bwd_iat_std", "bwd_iat_max",
    "bwd_iat_min", "fwd_psh_flag", "bwd_psh_flag", "fwd_urg_flag",
    "bwd_urg_flag", "fwd_head_len", "bwd_head_len", "fwd_pkt_per_s",
    "bwd_pkt_per_s", "pkt_len_min", "pkt_len_mean", "pkt_len_std",
    "pkt_len_max", "pkt_len_var", "fin_flag_cnt", "syn_flag_cnt",
    "rst_flag_cnt", "psh_flag_cnt", "ack_flag_cnt", "urg_flag_cnt",
    "cwe_flag_cnt", "ece_flag_cnt", "down_up_ratio", "avg_pkt_size",
    "avg_fwd_segm_size", "avg_bwd_segm_size", "fwd_head_len_bis",
    "avg_fwd_byte_per_bulk", "avg_fwd_pkt_per_bulk", "avg_fwd_bulk_rate",
    "avg_bwd_byte_per_bulk", "avg_bwd_pkt_per_bulk", "avg_bwd_bulk_rate",
    "subflow_fwd_pkt", "subflow_fwd_byte", "subflow_bwd_pkt",
    "subflow_bwd_byte", "init_win_bytes_fwd", "init_win_bytes_bwd",
    "act_data_pkt_fwd", "min_seg_size_forward", "active_mean", "active_std",
    "active_max", "active_min", "idle_mean", "idle_std", "idle_max",
    "idle_min", "label",
]

#: Canonical class names, in class-id order (id = list position).
CANONICAL_CLASSES = [
    "benign", "bot", "ddos", "dos_goldeneye", "dos_hulk", "dos_slowhttptest",
    "dos_slowloris", "ftp_patator", "heartbleed", "portscan", "ssh_patator",
    "webattack_bruteforce", "webattack_sql_injection", "webattack_xss",
]

#: Class names of the original files, in the same id order.  The three web
#: attack names carry the ISO-8859-1 byte 0x96.  ``Infiltration`` (id 14)
#: has no canonical name and keeps its own.
ORIGINAL_CLASSES = [
    "BENIGN", "Bot", "DDoS", "DoS GoldenEye", "DoS Hulk", "DoS Slowhttptest",
    "DoS slowloris", "FTP-Patator", "Heartbleed", "PortScan", "SSH-Patator",
    "Web Attack \x96 Brute Force", "Web Attack \x96 Sql Injection",
    "Web Attack \x96 XSS", "Infiltration",
]

#: Columns removed before modelling, per dataset.
MODEL_DROP_COLUMNS = {
    "original": [
        "flow_byte_per_s", "flow_pkt_per_s", "bwd_psh_flag", "bwd_urg_flag",
        "avg_fwd_byte_per_bulk", "avg_fwd_pkt_per_bulk", "avg_fwd_bulk_rate",
        "avg_bwd_byte_per_bulk", "avg_bwd_pkt_per_bulk", "avg_bwd_bulk_rate",
        "flow_id", "timestamp", "src_addr", "src_port", "dst_addr", "label",
    ],
    "generated": [
        "flag_urg", "fwd_flag_urg", "bwd_flag_urg", "flow_id", "timestamp",
        "src_addr", "src_port", "dst_addr", "label",
    ],
}

#: Per-class training percentages of the two dataset builds, class-id order.
#: Cross-validation and test percentages are half of these.
TRAIN_PERCENTAGES = {
    "original": [9.6941, 18.6674, 37.3679, 32.8573, 34.544, 44.2445,
                    48.9476, 25.2079, 45.4546, 50.00, 25.0806, 45.1228,
                    28.5715, 50.0000, 0],
    "generated": [15.78565, 50.00000, 50.00000, 50.00000, 50.00000,
                      50.00000, 50.00000, 50.00000, 50.00000, 49.63280,
                      50.00000, 50.00000, 50.00000, 49.31930],
}

#: Tokens the outlier pass turns into missing values (string columns only).
INFINITY_TOKENS = ["+Infinity", "-Infinity", "Infinity"]

#: Label sentinel of flows that still need a label, and the default class.
NEED_LABEL = "NeedLabel"
DEFAULT_LABEL = "benign"

# ---------------------------------------------------------------------------
# Types (our decision: see README "Types").
# ---------------------------------------------------------------------------

_LONG_GENERATED = {"src_port", "dst_port", "ip_prot", "timestamp"}
_STRING_GENERATED = {"flow_id", "src_addr", "dst_addr", "label"}
_LONG_ORIGINAL = {"src_port", "dst_port", "prot"}
_STRING_ORIGINAL = {"flow_id", "src_addr", "dst_addr", "timestamp", "label"}


def _struct(names, longs, strings) -> T.StructType:
    fields = []
    for n in names:
        if n in strings:
            t = T.StringType()
        elif n in longs:
            t = T.LongType()
        else:
            t = T.DoubleType()
        fields.append(T.StructField(n, t, True))
    return T.StructType(fields)


FLOW_SCHEMA = _struct(GENERATED_COLUMNS, _LONG_GENERATED, _STRING_GENERATED)
ORIGINAL_FLOW_SCHEMA = _struct(ORIGINAL_COLUMNS, _LONG_ORIGINAL, _STRING_ORIGINAL)


def original_to_canonical() -> dict[str, str]:
    """Original class name -> canonical name, by class id."""
    return dict(zip(ORIGINAL_CLASSES, CANONICAL_CLASSES))


def feature_columns(dataset: str) -> list[str]:
    """Model features of a dataset: every column minus its drop list."""
    names = ORIGINAL_COLUMNS if dataset == "original" else GENERATED_COLUMNS
    if dataset not in MODEL_DROP_COLUMNS:
        raise ValueError(f"unknown dataset {dataset!r}")
    drop = set(MODEL_DROP_COLUMNS[dataset])
    return [c for c in names if c not in drop]
