"""Labelling rules and drops of the five capture days (Monday to Friday).

Fixed values: endpoints, ports, protocol and inclusive time windows in epoch
microseconds, in the order the rules are applied (last match wins).
"""

from __future__ import annotations

from flowforge.operators.labelling import DayRules, Drop, Rule

# ---------------------------------------------------------------------------
# Fixed values.
# ---------------------------------------------------------------------------
ATTACKER = "172.16.0.1"
VICTIM = "192.168.10.50"
HEARTBLEED_VICTIM = "192.168.10.51"
BOT_CONTROLLER = "205.174.165.73"
FRIDAY_DROPPED_ENDPOINTS = ("52.6.13.28", "52.7.235.158")

MONDAY = DayRules(rules=(Rule("benign"),))

TUESDAY = DayRules(rules=(
    Rule("ftp_patator", src_addr=ATTACKER, dst_addr=VICTIM,
         ts_lo=1499170620000000, ts_hi=1499175000000000),
    Rule("ssh_patator", src_addr=ATTACKER, dst_addr=VICTIM,
         ts_lo=1499188140000000, ts_hi=1499191860000000),
))

WEDNESDAY = DayRules(rules=(
    Rule("heartbleed", src_addr=ATTACKER, src_port=45022,
         dst_addr=HEARTBLEED_VICTIM, dst_port=444),
    Rule("dos_slowloris", src_addr=ATTACKER, dst_addr=VICTIM, dst_port=80,
         ts_lo=1499256060000000, ts_hi=1499260260000000),
    Rule("dos_slowloris", src_addr=ATTACKER, dst_addr=VICTIM, dst_port=80,
         ts_lo=1499275440000000, ts_hi=1499275500000000),
    Rule("dos_slowhttptest", src_addr=ATTACKER, dst_addr=VICTIM, dst_port=80,
         ts_lo=1499260500000000, ts_hi=1499261820000000),
    Rule("dos_hulk", src_addr=ATTACKER, dst_addr=VICTIM, dst_port=80,
         ts_lo=1499262180000000, ts_hi=1499263620000000),
    Rule("dos_goldeneye", src_addr=ATTACKER, dst_addr=VICTIM, dst_port=80,
         ts_lo=1499263800000000, ts_hi=1499264340000000),
))

THURSDAY = DayRules(
    rules=(
        Rule("webattack_bruteforce", src_addr=ATTACKER, dst_addr=VICTIM, ip_prot=6,
             ts_lo=1499343300000000, ts_hi=1499346000000000),
        Rule("webattack_xss", src_addr=ATTACKER, dst_addr=VICTIM, ip_prot=6,
             ts_lo=1499346935000000, ts_hi=1499348100000000),
        Rule("webattack_sql_injection", src_addr=ATTACKER, dst_addr=VICTIM, ip_prot=6,
             ts_lo=1499348400000000, ts_hi=1499348576000000),
    ),
    drops=(Drop(ts_op=">=", ts=1499353200000000),),
)

FRIDAY = DayRules(
    rules=(
        Rule("bot", dst_addr=BOT_CONTROLLER,
             ts_lo=1499430840000000, ts_hi=1499436122000000),
        Rule("ddos", src_addr=ATTACKER, dst_addr=VICTIM, ip_prot=6,
             ts_lo=1499453791000000, ts_hi=1499454973000000),
        Rule("portscan", src_addr=ATTACKER, dst_addr=VICTIM, ip_prot=6,
             ts_lo=1499443530000000, ts_hi=1499451842000000),
    ),
    drops=(
        Drop(dst_addrs=(BOT_CONTROLLER,), ts_op=">", ts=1499436193000000),
        Drop(dst_addrs=FRIDAY_DROPPED_ENDPOINTS),
    ),
)

#: Day name (lower case, as derived from the capture file name) -> rules.
CAPTURE_DAYS = {
    "monday": MONDAY,
    "tuesday": TUESDAY,
    "wednesday": WEDNESDAY,
    "thursday": THURSDAY,
    "friday": FRIDAY,
}
