"""Dimension tables and the joins that attach them.

No join here forces a broadcast: Spark compares the measured size of a dimension
with its own threshold and sorts or splits larger ones. What is joined is reduced
first, so an owner lookup moves one row per (hub, slot, source), not arrivals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firstpast.functions.numeric import exact_sum
from firstpast.functions.text import host_of, ip_in_name, is_identity_key, location_of

# Fixed values.
SLOTS_PER_EPOCH = 432_000
WINDOW_BACK_SECS = 120
WINDOW_FORWARD_SECS = 600
SLOT_MS = 400


def explode_schedule(responses: DataFrame) -> DataFrame:
    """One row per scheduled slot from responses of (first_slot, leader -> offsets)."""
    return (responses.select("first_slot", F.explode("leaders").alias("leader", "offsets"))
            .select("first_slot", "leader", F.explode("offsets").alias("offset"))
            .select((F.col("first_slot") + F.col("offset")).alias("slot"), "leader"))


def union_epochs(*schedules: DataFrame) -> DataFrame:
    """Schedules of several epochs as one table; the epochs do not overlap."""
    first, *rest = schedules
    for schedule in rest:
        first = first.unionByName(schedule)
    return first


def check_schedule(responses: DataFrame) -> DataFrame:
    """Per response: slots placed inside the epoch against the epoch's length."""
    offsets = F.flatten(F.map_values("leaders"))
    placed = F.size(F.filter(offsets, lambda o: (o >= 0) & (o < F.col("slots_in_epoch"))))
    return (responses.select("first_slot", "slots_in_epoch", placed.cast("bigint").alias("placed"))
            .withColumn("complete", F.col("placed") == F.col("slots_in_epoch")))


def check_schedule_rows(schedule: DataFrame, epoch_slots: int) -> DataFrame:
    """Per epoch of a flat schedule: distinct slots placed against the epoch's length."""
    return (schedule.select(F.floor(F.col("slot") / F.lit(float(epoch_slots))).cast("bigint").alias("epoch"),
                            "slot").distinct()
            .groupBy("epoch").agg(F.count("*").alias("placed"))
            .withColumn("complete", F.col("placed") == F.lit(epoch_slots)))


def with_leader(df: DataFrame, schedule: DataFrame, brands: DataFrame) -> DataFrame:
    """Attach the slot's leader and the leader's brand, both optional."""
    known = brands.select("leader", F.col("brand").alias("leader_provider"))
    return df.join(schedule.select("slot", "leader"), "slot", "left").join(known, "leader", "left")


def slot_totals(ranked: DataFrame, schedule: DataFrame, brands: DataFrame,
                time: str = "delta_ns") -> DataFrame:
    """(hub, slot, source) totals of a ranked table, with the slot's leader and brand.

    The leader is joined to one row per (hub, slot); its few source totals travel
    along as an array. ``lead`` marks one row per (hub, slot).
    """
    totals = (ranked.groupBy("hub", "slot", "source")
              .agg(F.count("*").alias("samples"),
                   F.count_if(F.col("rank") == 0).alias("wins"),
                   exact_sum(time).alias("sum_d")))
    slots = (totals.groupBy("hub", "slot")
             .agg(F.collect_list(F.struct("source", "samples", "wins", "sum_d")).alias("sources")))
    return (with_leader(slots, schedule, brands)
            .select("hub", "slot", "leader", "leader_provider", F.posexplode("sources").alias("nth", "s"))
            .select("hub", "slot", "leader", "leader_provider", "s.*", (F.col("nth") == 0).alias("lead")))


def unknown_leader_slots(totals: DataFrame) -> DataFrame:
    """How many distinct slots have no known leader."""
    return (totals.filter(F.col("leader").isNull()).select("slot").distinct()
            .agg(F.count("*").alias("unknown_leader_slots")))


def plausible_range(first_slot: int, epoch_slots: int) -> tuple[int, int]:
    """Slots within an epoch below and two above the start of the schedule held."""
    span = max(epoch_slots, SLOTS_PER_EPOCH)
    return max(0, first_slot - span), first_slot + 2 * span


def classify_slot(df: DataFrame, schedule: DataFrame, first_slot: int, epoch_slots: int) -> DataFrame:
    """Attach ``slot_verdict`` (implausible / leader / unknown) and the leader."""
    low, high = plausible_range(first_slot, epoch_slots)
    held = schedule.filter(F.col("slot").between(first_slot, first_slot + epoch_slots - 1))
    implausible = (F.col("slot") < low) | (F.col("slot") >= high)
    return (df.join(held.select("slot", "leader"), "slot", "left")
            .withColumn("leader", F.when(~implausible, F.col("leader")))
            .withColumn("slot_verdict",
                        F.when(implausible, "implausible")
                        .when(F.col("leader").isNotNull(), "leader").otherwise("unknown")))


def leader_window(schedule: DataFrame, anchor: int, back_secs: int = WINDOW_BACK_SECS,
                  forward_secs: int = WINDOW_FORWARD_SECS, slot_ms: int = SLOT_MS) -> DataFrame:
    """The schedule around an anchor slot; the range reaches the Parquet scan."""
    back = back_secs * 1000 // max(slot_ms, 1)
    forward = forward_secs * 1000 // max(slot_ms, 1)
    return schedule.filter(F.col("slot").between(max(0, anchor - back), anchor + forward))


def leader_names(schedule: DataFrame, names: DataFrame) -> DataFrame:
    """Display names of the schedule's distinct leaders that have one."""
    return schedule.select("leader").distinct().join(names.select("leader", "name"), "leader")


def resolve_provider(df: DataFrame, rules: DataFrame, ip: str = "src_ip", port: str = "dst_port") -> DataFrame:
    """Most specific rule first: (ip, port), then port only, then ip only, else NULL.

    ``rules`` has (name, ip, port) with NULL for the part a rule does not fix. Of
    several rules with the same key the last configured (``rule_order``) wins.
    """
    def by(keys: list[str], where: Column, alias: str) -> DataFrame:
        return rules.filter(where).groupBy(*keys).agg(F.max_by("name", "rule_order").alias(alias))

    has_ip, has_port = F.col("ip").isNotNull(), F.col("port").isNotNull()
    both = by(["ip", "port"], has_ip & has_port, "by_both")
    ports = by(["port"], ~has_ip & has_port, "by_port")
    ips = by(["ip"], has_ip & ~has_port, "by_ip")
    keyed = df.withColumn("ip", F.col(ip)).withColumn("port", F.col(port))
    return (keyed.join(both, ["ip", "port"], "left").join(ports, "port", "left").join(ips, "ip", "left")
            .withColumn("provider", F.coalesce("by_both", "by_port", "by_ip"))
            .drop("by_both", "by_port", "by_ip", "ip", "port"))


def sorted_names(col: str | Column) -> Column:
    """Distinct non-null values, sorted and joined with ``;``."""
    return F.array_join(F.array_sort(F.collect_set(col)), ";")


def name_ips(df: DataFrame, providers: DataFrame, ip: str = "src_ip") -> DataFrame:
    """Attach the registered names of an address, or UNREGISTERED."""
    names = (providers.select("src_ip", "name").distinct()
             .groupBy("src_ip").agg(sorted_names("name").alias("provider_names")))
    return (df.join(names.withColumnRenamed("src_ip", ip), ip, "left")
            .withColumn("provider_names",
                        F.when(F.coalesce("provider_names", F.lit("")) == "", "UNREGISTERED")
                        .otherwise(F.col("provider_names"))))


def coverage(interest: DataFrame, providers: DataFrame, sources: DataFrame,
             firsts: DataFrame) -> DataFrame:
    """Per watched (group, ip): registration, whether its sources arrived, whether it was first.

    ``sources`` holds the distinct arriving source names, ``firsts`` rows with the
    addresses that were first.
    """
    seen = sources.select(F.col("source").alias("name")).distinct().withColumn("arrived", F.lit(1))
    registered = (providers.select("src_ip", "name", "tier").distinct()
                  .join(seen, "name", "left")
                  .groupBy("src_ip")
                  .agg(sorted_names("name").alias("names"), sorted_names("tier").alias("tiers"),
                       F.max("arrived").alias("arrived"))
                  .withColumnRenamed("src_ip", "ip").withColumn("registered", F.lit(True)))
    first_ips = (firsts.select(F.col("src_ip").alias("ip")).distinct().withColumn("was_first", F.lit(True)))
    has_arrivals = F.col("arrived").isNotNull()
    was_first = F.col("was_first").isNotNull()
    note = (F.when(F.col("registered").isNull(),
                   "not registered, its packets are dropped: no data")
            .when(~has_arrivals & ~was_first, "registered but no samples in window").otherwise(""))

    def or_dash(col: str) -> Column:
        return F.when(F.coalesce(col, F.lit("")) == "", "-").otherwise(F.col(col))

    return (interest.join(registered, "ip", "left").join(first_ips, "ip", "left")
            .select("group", "ip", or_dash("names").alias("registered_as"),
                    or_dash("tiers").alias("tier"),
                    F.when(has_arrivals, "yes").otherwise("no").alias("arrivals_data"),
                    F.when(was_first, "yes").otherwise("no").alias("first_provider_data"),
                    note.alias("note")))


def source_ips(sources: DataFrame, name_ip: DataFrame) -> DataFrame:
    """Attach ``src_ip``: the mapped address, else one inside the name, else ''."""
    return (sources.join(name_ip.select(F.col("name").alias("source"), "ip"), "source", "left")
            .withColumn("src_ip", F.coalesce(F.when(F.col("ip") != "", F.col("ip")),
                                             ip_in_name("source"), F.lit("")))
            .drop("ip"))


def enrich_sources(df: DataFrame, name_ip: DataFrame, asn: DataFrame) -> DataFrame:
    """Attach address, network and location of each source."""
    networks = asn.select(F.col("ip").alias("src_ip"), F.col("org").alias("asn_dc"),
                          location_of("city", "country").alias("dc_location"))
    blank = F.lit("")
    return (source_ips(df, name_ip).join(networks, "src_ip", "left")
            .withColumn("asn_dc", F.coalesce("asn_dc", blank))
            .withColumn("dc_location", F.coalesce("dc_location", blank)))


def upsert_latest(df: DataFrame, key: list[str], version: str) -> DataFrame:
    """Newest row per key (last write wins), combined map-side.

    Rows with the same version are told apart by their whole content, so the
    result does not depend on the order of the input.
    """
    rest = [c for c in df.columns if c not in key and c != version]
    newest = df.groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("row"))
    return newest.select(*key, *[F.col(f"row.{c}").alias(c) for c in df.columns if c not in key])


def validator_dim(leaders: DataFrame, report: DataFrame, gossip: DataFrame, pings: DataFrame,
                  updated_at: Column) -> DataFrame:
    """One row per scheduled leader with report attributes, address and round trip."""
    return (leaders.select(F.col("leader").alias("pubkey")).distinct()
            .join(report.select("pubkey", "name", "client_type", "version", "location", "stake"),
                  "pubkey", "left")
            .join(gossip.select("pubkey", "gossip_ip"), "pubkey", "left")
            .join(pings.select("pubkey", "ping_ms"), "pubkey", "left")
            .withColumn("updated_at", updated_at))


def provider_ips(configured: DataFrame, observed: DataFrame) -> DataFrame:
    """Distinct (provider, ip) with its origin; configured beats observed."""
    marked = (configured.select("provider", "ip", F.lit("configured").alias("origin"))
              .unionByName(observed.select("provider", "ip", F.lit("observed").alias("origin"))))
    # 'configured' sorts before 'observed'.
    return marked.groupBy("provider", "ip").agg(F.min("origin").alias("origin"))


def ip_order(ip: str = "ip") -> Column:
    """Numeric order of a dotted address."""
    parts = F.split(F.col(ip), r"\.")
    return sum((parts[i].try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(1, 4)),
               parts[0].try_cast("bigint") * F.lit(256 ** 3))


def provider_pings(ips: DataFrame, samples: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """Latest round trip per provider address, plus one row per endpoint host."""
    rows = ips
    if endpoints is not None:
        rows = rows.unionByName(
            endpoints.select(F.col("name").alias("provider"), host_of("url").alias("ip"),
                             F.lit("grpc").alias("origin")).filter(F.col("ip").isNotNull()))
    latest = samples.groupBy("ip").agg(F.max(F.struct("checked_at_ns", "rtt_ms")).alias("s"))
    return (rows.join(latest, "ip", "left")
            .select("provider", "ip", "origin", F.col("s.rtt_ms").alias("rtt_ms"),
                    F.col("s.checked_at_ns").alias("checked_at_ns")))


def validator_report(raw: DataFrame) -> DataFrame:
    """Leader and name of a validator report; blank names and malformed keys dropped."""
    return (raw.select("leader", F.trim("name").alias("name"))
            .filter((F.col("name") != "") & is_identity_key("leader")))


def duplicates(df: DataFrame, by: list[str], value: Column, rule: str) -> DataFrame:
    return (df.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
            .select(F.lit(rule).alias("rule"), value.cast("string").alias("subject")))


# Commitment levels a feed may ask for.
COMMITMENTS = ("processed", "confirmed", "finalized")


def rule_violations(providers: DataFrame, ports: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Every broken configuration rule as a row; no row means the configuration is sound.

    ``providers`` has (name, port, ips), ``ports`` the listened ports, ``feeds``
    (name, url, commitment).
    """
    nowhere = (F.col("port").isNull() & (F.coalesce(F.size("ips"), F.lit(0)) <= 0))
    found = (duplicates(providers, ["name"], F.col("name"), "duplicate name")
             .unionByName(providers.filter(nowhere)
                          .select(F.lit("neither port nor ips").alias("rule"), F.col("name").alias("subject")))
             .unionByName(providers.filter(F.col("port").isNotNull())
                          .join(ports.select("port").distinct(), "port", "left_anti")
                          .select(F.lit("port not listened on").alias("rule"), F.col("name").alias("subject"))))
    if feeds is not None:
        found = (found
                 .unionByName(feeds.filter(F.trim("url") == "")
                              .select(F.lit("empty url").alias("rule"), F.col("name").alias("subject")))
                 .unionByName(duplicates(feeds, ["name"], F.col("name"), "duplicate feed name"))
                 .unionByName(feeds.filter(~F.lower("commitment").isin(*COMMITMENTS))
                              .select(F.lit("invalid commitment").alias("rule"), F.col("name").alias("subject"))))
    return found


def source_violations(sources: DataFrame) -> DataFrame:
    """Checks of live sources (name, udp_port, provider_id): duplicates and a zero id."""
    return (duplicates(sources, ["name"], F.col("name"), "duplicate name")
            .unionByName(duplicates(sources, ["udp_port"], F.col("udp_port"), "duplicate port"))
            .unionByName(duplicates(sources.filter(F.col("provider_id") != 0), ["provider_id"],
                                    F.col("provider_id"), "duplicate provider id"))
            .unionByName(sources.filter(F.col("provider_id") == 0)
                         .select(F.lit("zero provider id").alias("rule"), F.col("name").alias("subject"))))
