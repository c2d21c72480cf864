"""Row functions: clocks, sort keys, routing, formatting, decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LOGICAL = (1 << 20) - 1
GOLDEN = 0x9E3779B97F4A7C15
# Command codes of the wire protocol.
COMMANDS = {
    0x01: "CreateTopic", 0x02: "DeleteTopic", 0x03: "ListTopics", 0x04: "GetTopic", 0x05: "SetRetention", 0x06: "CreateTopicWithRetention", 0x07: "GetClusterStatus",
    0x08: "Authenticate", 0x09: "AuthenticateResponse", 0x10: "Fetch", 0x11: "FetchResponse", 0x12: "CatchingUp", 0x20: "Subscribe", 0x21: "Unsubscribe",
    0x22: "CommitOffset", 0x23: "SubscribeAck", 0x24: "CommitAck", 0x80: "TopicResponse", 0x81: "ClusterStatusResponse", 0xFF: "ErrorResponse",
}


def hlc(ms: Column, logical: Column) -> Column:
    return F.shiftleft(ms, 20).bitwiseOR(logical)


def hlc_ms(stamp: Column) -> Column:
    return F.shiftrightunsigned(stamp, 20)


def hlc_logical(stamp: Column) -> Column:
    return stamp.bitwiseAND(F.lit(MAX_LOGICAL))


def hlc_receive(wall_ms: Column, last: Column, remote: Column) -> Column:
    """The merge of a local clock with a remote stamp; the logical part stops at its maximum."""
    lm, rm, ll, rl = hlc_ms(last), hlc_ms(remote), hlc_logical(last), hlc_logical(remote)
    wall = (wall_ms > lm) & (wall_ms > rm)
    logical = F.when(wall, F.lit(0).cast("long")).when(lm > rm, ll + 1).when(rm > lm, rl + 1).otherwise(F.greatest(ll, rl) + 1)
    return hlc(F.when(wall, wall_ms).otherwise(F.greatest(lm, rm)), F.least(logical, F.lit(MAX_LOGICAL)))


def sort_key_hex(stamp: Column, node: Column, sequence: Column) -> Column:
    """The 128-bit key as 32 hex digits, which sort as the key does: the stamp, then 16 bits of node and 48 of sequence."""
    return F.lower(F.concat(F.lpad(F.hex(stamp), 16, "0"), F.lpad(F.hex(F.shiftleft(node, 48).bitwiseOR(sequence)), 16, "0")))


def clock_health(drift_ms: Column) -> Column:
    return F.when(F.abs(drift_ms) > 1000, "critical").when(F.abs(drift_ms) > 100, "degraded").otherwise("healthy")


def actor(topic_id: Column, actors: int) -> Column:
    """Multiplicative hashing modulo 2^64; decimals, as the product does not fit a long."""
    product = topic_id.cast("decimal(10,0)") * F.lit(str(GOLDEN)).cast("decimal(20,0)")
    return F.pmod(F.pmod(product, F.lit(str(1 << 64)).cast("decimal(20,0)")), F.lit(actors).cast("decimal(20,0)")).cast("long")


def backpressure(queue: Column, pending: Column, mem_pct: Column) -> Column:
    critical = (queue >= 5000) | (pending >= 500) | (mem_pct >= 90)
    part = lambda v, warn, half: F.when(v >= half, 3).when(v >= warn, 2).otherwise(0)
    score = part(queue, 1000, 2500) + part(pending, 100, 250) + part(mem_pct, 70, 80)
    return F.when(critical, "Critical").when(score == 0, "None").when(score <= 2, "Light").when(score <= 4, "Moderate").when(score <= 6, "Heavy").otherwise("Critical")


def delay_multiplier(level: Column) -> Column:
    return F.when(level == "Light", 1.5).when(level == "Moderate", 2.0).when(level == "Heavy", 4.0).when(level == "Critical", 10.0).otherwise(1.0)


def throughput_band(rate: Column) -> Column:
    return F.when(rate < 1e3, "CRITICAL").when(rate < 1e4, "LOW").when(rate < 5e4, "MODERATE").when(rate < 1e5, "GOOD").when(rate < 5e5, "EXCELLENT").when(rate < 1e6, "OUTSTANDING").otherwise("WORLD-CLASS")


def next_tier(tier: Column, warm: bool = True, cold: bool = True, archive: bool = True) -> Column:
    pick = lambda *steps: next((F.lit(name) for name, on in steps if on), F.lit(None).cast("string"))
    return F.when(tier == "hot", pick(("warm", warm), ("cold", cold))).when(tier == "warm", pick(("cold", cold), ("archive", archive))).when(tier == "cold", pick(("archive", archive)))


def human_bytes(n: Column) -> Column:
    unit = lambda size, name: F.format_string(f"%.2f {name}", n / size)
    return F.when(n >= 1 << 40, unit(1 << 40, "TB")).when(n >= 1 << 30, unit(1 << 30, "GB")).when(n >= 1 << 20, unit(1 << 20, "MB")).when(n >= 1 << 10, unit(1 << 10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def command_name(code: Column) -> Column:
    found = F.lit(None).cast("string")
    for k, v in COMMANDS.items():
        found = F.coalesce(found, F.when(code == k, v))
    return F.coalesce(found, F.lit("ErrorResponse"))


def human_ns(ns: Column) -> Column:
    unit = lambda size, name: F.format_string(f"%.2f {name}", ns / size)
    return F.when(ns >= 1_000_000_000, unit(1_000_000_000, "s")).when(ns >= 1_000_000, unit(1_000_000, "ms")).when(ns >= 1_000, unit(1_000, "us")).otherwise(F.concat(ns.cast("string"), F.lit(" ns")))


def json_field(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")
