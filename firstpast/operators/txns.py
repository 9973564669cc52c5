"""Transaction races, filters and triggers."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firstpast.functions.numeric import micros
from firstpast.operators.percentiles import nearest_rank
from firstpast.operators.race import race_min
from firstpast.session import materialize

BEHIND_QUANTILES = {"behind_p50": 0.5, "behind_p90": 0.9, "behind_p99": 0.99}
# Fixed values.
TRIGGER_GAP_MS = 1000
LANDING_TIMEOUT_SECS = 60


def first_seen(events: DataFrame) -> DataFrame:
    """First sighting per (signature, source); a re-delivery never moves it."""
    return events.groupBy("signature", "source").agg(F.min("ns").alias("ns"))


def raced_signatures(events: DataFrame) -> DataFrame:
    """First sightings with the earliest time, the number of sources and ``behind`` ns.

    ``behind`` is set only for contested signatures (two or more sources). ``lead``
    marks one row per signature.
    """
    raced = race_min(first_seen(events), "ns", ["signature"])
    lead = F.row_number().over(Window.partitionBy("signature").orderBy("source")) == 1
    return (raced.withColumn("behind", F.when(F.col("contestants") >= 2, F.col("ns") - F.col("win_ns")))
            .withColumn("lead", lead))


def txn_race(events: DataFrame) -> DataFrame:
    """Per source: seen, contested, wins and mean time behind; plus the run's totals."""
    return totals_of(raced_signatures(events))


def totals_of(raced: DataFrame) -> DataFrame:
    """Race totals per source from scored sightings."""
    per_source = raced.groupBy("source").agg(
        F.count("*").alias("seen"), F.count("behind").alias("contested"),
        F.count_if(F.col("behind") == 0).alias("wins"),
        F.sum(F.col("behind").cast("decimal(20,0)")).alias("behind"),
        F.count_if("lead").alias("led"),
        F.count_if(F.col("lead") & F.col("behind").isNotNull()).alias("contested_led"))
    # One row per source is left, so the totals are summed over a handful of rows.
    everyone = Window.partitionBy(F.lit(0))
    contested = F.col("contested") > 0
    return (per_source
            .withColumn("distinct_signatures", F.sum("led").over(everyone))
            .withColumn("contested_signatures", F.sum("contested_led").over(everyone))
            .select("source", "seen", "contested", "wins",
                    F.when(contested, F.col("wins").cast("double") / F.col("contested")).alias("winrate"),
                    F.when(contested, F.col("behind").cast("double") / F.col("contested") / F.lit(1e3))
                    .alias("behind_mean_us"),
                    "distinct_signatures", "contested_signatures"))


def txn_percentiles(events: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of time behind, over every contested sighting."""
    return percentiles_of(raced_signatures(events))


def percentiles_of(raced: DataFrame) -> DataFrame:
    ranks = nearest_rank(raced, ["source"], "behind", BEHIND_QUANTILES)
    return ranks.select("source", *[micros(name).alias(f"{name}_us") for name in BEHIND_QUANTILES])


def filter_txns(txns: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (),
                required: Sequence[str] = (), vote: bool | None = None, failed: bool | None = None,
                signature: str | None = None) -> DataFrame:
    """Any of ``include``, none of ``exclude``, all of ``required``; empty means no limit."""
    keys = F.col("account_keys")

    def accounts(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    if include:
        txns = txns.filter(F.arrays_overlap(keys, accounts(include)))
    if exclude:
        txns = txns.filter(~F.arrays_overlap(keys, accounts(exclude)))
    if required:
        txns = txns.filter(F.size(F.array_except(accounts(required), keys)) == 0)
    if vote is not None:
        txns = txns.filter(F.col("is_vote") == vote)
    if failed is not None:
        txns = txns.filter(F.col("failed") == failed)
    if signature is not None:
        txns = txns.filter(F.col("signature") == signature)
    return txns


def watch(txns: DataFrame, wallet: str, at: str) -> DataFrame:
    """First sighting of each transaction that touches ``wallet``; unsigned ones skipped."""
    return (txns.filter(F.array_contains("account_keys", wallet)
                        & (F.coalesce("signature", F.lit("")) != ""))
            .groupBy("signature")
            .agg(F.min(F.struct(at, "slot")).alias("first"))
            .select("signature", F.col("first.slot").alias("trigger_slot"),
                    F.col(f"first.{at}").alias(at)))


def landing_distance(triggers: DataFrame, landed: DataFrame,
                     timeout_secs: int = LANDING_TIMEOUT_SECS) -> DataFrame:
    """Slots between trigger and landing; NULL if it failed or landed after the timeout.

    ``landed`` has (signature, landed_slot, landed_ns, failed), one row per signature.
    """
    in_time = ((~F.col("failed"))
               & (F.col("landed_ns") - F.col("sent_ns") <= F.lit(timeout_secs * 1_000_000_000)))
    return (triggers.join(landed, "signature", "left")
            .withColumn("landed_slot", F.when(in_time, F.col("landed_slot")))
            .select("signature", "trigger_slot", "landed_slot",
                    (F.col("landed_slot") - F.col("trigger_slot")).alias("distance")))


# Spans that are composed, or entered, in one place.
FAN = 32


def throttle(df: DataFrame, key: str, time: str, gap: int, start: int = 0,
             last: DataFrame | None = None, block: int | None = None, fan: int = FAN, scratch: str | None = None) -> DataFrame:
    """Keep a row only if at least ``gap`` passed since the last kept row of its key.

    The clock of a key starts at its time in ``last`` (key, last_at), else at
    ``start``; a dropped row is lost, not postponed. Returns the kept (key, time).

    What a span of time does is a step function: from the moment when the next action is allowed to the last
    action. A span can only be entered with a moment up to ``gap`` into it, and choices that reach the same row
    agree from there on, so the function has few steps. Functions of neighbouring spans compose, and composing is
    associative: time is cut into blocks, ``fan`` neighbours become one span, and so on up to the whole of a key.
    Down again, each span tells its parts when they are entered, until every block replays its rows by itself. No
    step takes more than ``fan`` spans of a key, however many rows the key has. Levels are written below ``scratch``, else
    to the shared folder.
    """
    block = block or gap * 64
    names = count()

    def written(level: DataFrame) -> DataFrame:
        return materialize(level, "throttle", scratch and f"{scratch}/{next(names)}")

    times = df.filter(F.col(time).isNotNull()).select(key, F.col(time).cast("bigint").alias("at")).distinct()
    clock = F.lit(start).cast("bigint")
    if last is not None:
        times = times.join(last.select(key, "last_at"), key, "left")
        clock = F.coalesce("last_at", clock)
    number = F.floor((F.col("at") - F.lit(start)) / F.lit(float(block))).cast("bigint")
    # Written, as every level below is read on the way up and on the way down.
    times = written(times.filter(F.col("at") >= clock + gap).select(key, "at", number.alias("span")))
    low, high = times.agg(F.min("span"), F.max("span")).first()
    name_type = f"`{key}` {df.schema[key].dataType.simpleString()}"
    if low is None:
        return times.select(key, F.col("at").alias(time))
    times = times.withColumn("span", F.col("span") - low)

    def opens(span: int, width: int) -> int:
        return start + (int(span) * width + low) * block

    def steps_of(pdf: pd.DataFrame) -> pd.DataFrame:
        at = sorted(pdf["at"].tolist())
        return _steps_frame(key, pdf[key].iloc[0], pdf["span"].iloc[0], _steps(at, gap, opens(pdf["span"].iloc[0], 1)))

    schema = f"{name_type}, span bigint, upto bigint, last_at bigint"
    levels = [written(times.groupBy(key, "span").applyInPandas(steps_of, schema))]
    while (high - low) // fan ** (len(levels) - 1) > 0:
        levels.append(written(_composed(levels[-1], key, gap, fan, fan ** len(levels), opens, schema)))

    entered = f"{name_type}, span bigint, allowed bigint"
    entries = levels[-1].select(key, "span").distinct().withColumn("allowed", F.lit(start).cast("bigint"))
    for level in levels[-2::-1]:
        entries = written(_entered(level, entries, key, gap, fan, entered))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        allowed, kept = int(pdf["allowed"].iloc[0]), []
        for t in pdf["at"].tolist():
            kept.append(t >= allowed)
            if kept[-1]:
                allowed = t + gap
        return pdf.loc[kept, [key, "at"]].rename(columns={"at": time})

    return (times.join(entries, [key, "span"]).groupBy(key, "span")
            .applyInPandas(replay, f"{name_type}, `{time}` bigint"))


# (a moment, the last action of the span if the next one is allowed from then on and not yet before), in order.
Steps = list[tuple[int, int]]


def _steps(at: list[int], gap: int, opens: int) -> Steps:
    """What a block does; of neighbouring moments that end alike the latest is named."""
    ends = _chain_ends(at, gap)
    firsts = [i for i in range(len(at)) if i == 0 or at[i - 1] < opens + gap]
    return [(at[i], ends[i]) for i in firsts if i == firsts[-1] or ends[i + 1] != ends[i]]


def _last_action(steps: Steps, allowed: int) -> int | None:
    """The last action of a span entered with that moment; None if it does not act."""
    at = bisect_left(steps, (allowed,))
    return steps[at][1] if at < len(steps) else None


def _then(left: Steps, right: Steps, gap: int, opens: int) -> Steps:
    """The steps of two neighbouring spans as one that begins at ``opens``."""
    both = []
    for upto, last in left:
        later = _last_action(right, last + gap)
        both.append((upto, last if later is None else later))
    # Where the left span does not act, the right one is entered as it is.
    both += [step for step in right if not left or step[0] > left[-1][0]]
    needed = next((i for i, (upto, _) in enumerate(both) if upto >= opens + gap), len(both) - 1)
    both = both[:needed + 1]
    return [step for i, step in enumerate(both) if i == needed or both[i + 1][1] != step[1]]


def _steps_frame(key: str, name, span: int, steps: Steps) -> pd.DataFrame:
    return pd.DataFrame({key: name, "span": span, "upto": [u for u, _ in steps], "last_at": [t for _, t in steps]})


def _spans(pdf: pd.DataFrame) -> list[tuple[int, Steps]]:
    """The spans of a group of step rows, in order."""
    rows = pdf.sort_values(["span", "upto"])
    return [(span, list(zip(some["upto"].tolist(), some["last_at"].tolist()))) for span, some in rows.groupby("span", sort=True)]


def _composed(level: DataFrame, key: str, gap: int, fan: int, width: int, opens: Callable[[int, int], int], schema: str) -> DataFrame:
    """``fan`` neighbours of a level as one span; ``width``: blocks in such a span."""
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        span = int(pdf["above"].iloc[0])
        whole: Steps = []
        for _, steps in _spans(pdf):
            whole = _then(whole, steps, gap, opens(span, width))
        return _steps_frame(key, pdf[key].iloc[0], span, whole)

    above = level.withColumn("above", F.floor(F.col("span") / fan).cast("bigint"))
    return above.groupBy(key, "above").applyInPandas(compose, schema)


def _entered(level: DataFrame, entries: DataFrame, key: str, gap: int, fan: int, schema: str) -> DataFrame:
    """When each span of a level is entered, from the moments of the spans above."""
    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        allowed, out = int(pdf["allowed"].iloc[0]), []
        for span, steps in _spans(pdf):
            out.append((pdf[key].iloc[0], span, allowed))
            acted = _last_action(steps, allowed)
            allowed = allowed if acted is None else acted + gap
        return pd.DataFrame(out, columns=[key, "span", "allowed"])

    above = level.withColumn("above", F.floor(F.col("span") / fan).cast("bigint"))
    return (above.join(entries.withColumnRenamed("span", "above"), [key, "above"]).groupBy(key, "above")
            .applyInPandas(enter, schema))


def _chain_ends(at: list[int], gap: int) -> list[int]:
    """For each sorted time, the last time reached by always acting again after ``gap``."""
    last = list(at)
    following = len(at)
    for i in range(len(at) - 1, -1, -1):
        while following > 0 and at[following - 1] >= at[i] + gap:
            following -= 1
        if following < len(at):
            last[i] = last[following]
    return last
