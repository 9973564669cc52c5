"""Completeness, timing and validity per (provider, slot, set).

Input rows are judged packets (``schema.of("shreds")``): ``merkle_ok`` and the
three-valued ``sig_ok`` (NULL = cannot be judged) are given.

Every step reduces by algebraic aggregates that combine map-side, and arrivals are only
ordered over distinct positions (at most 2 x 128 per provider and set), so
neither a flooded set nor one provider with a large share of all packets ends up
in a single task.

"The first of several, and what it said" is the least of numbers that hold the time in front and what was
said behind it (``numeric.packed``), so the aggregates keep fixed-width values and work by hashing. Texts are
either grouping columns or stand-in numbers (``numeric.code_of``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from firstpast.functions.numeric import code_of, leading_bytes, packed, parts_of, rest_of, saturating_sub, time_of, unpacked
from firstpast.operators.race import SET_RACE, race_anchor, race_min

# Fixed values.
MAX_POSITION = 128
MAX_PLAUSIBLE_SLOT = 1 << 40
KEEP_SLOTS = 5000
DELAY_EDGES_NS = (
    -100_000_000, -50_000_000, -20_000_000, -10_000_000, -5_000_000, -2_000_000, -1_000_000,
    -500_000, -200_000, 0, 200_000, 500_000, 1_000_000, 2_000_000, 5_000_000, 10_000_000,
    20_000_000, 50_000_000, 100_000_000,
)

# Counts in packet headers are 16 bits wide.
_COUNT = 1 << 16
# A stand-in number of a text, NULL included; the bytes of a payload hash that settle ties.
_CODE_BITS = 59
_CODE = (1 << _CODE_BITS) + 1
_TIE, _SHORT_TIE = 1 << 56, 1 << 24

PROVIDER_SET = ("provider", *SET_RACE)
# What stands for a payload hash: a hash of all of it, and its leading bytes, which settle ties.
PAYLOAD = ("payload_code", "payload_tie")
# What the bytes of a payload fix.
_FIXED = ("is_code", "position", "shred_index", "num_data", "num_coding", "data_complete", "last_in_slot")


def acceptance(merkle_ok: str = "merkle_ok", sig_ok: str = "sig_ok") -> Column:
    """bad: a check failed; unverifiable: the signature cannot be judged; ok: both hold."""
    failed = F.coalesce(~F.col(merkle_ok), F.lit(True)) | F.coalesce(~F.col(sig_ok), F.lit(False))
    return F.when(failed, "bad").when(F.col(sig_ok).isNull(), "unverifiable").otherwise("ok")


def _three_valued(flag: str) -> Column:
    """NULL, false, true as 0, 1, 2."""
    return F.when(F.col(flag), 2).when(~F.col(flag), 1).otherwise(0)


def _flag_of(code: Column) -> Column:
    return F.when(code == 2, True).when(code == 1, False)


def _code(text: str) -> Column:
    return code_of(text, _CODE_BITS)


def with_payload(packets: DataFrame) -> DataFrame:
    """``PAYLOAD`` in place of the payload hash: two numbers, where every group and row would carry the text.

    Both together tell the payloads of a provider's set apart: 64 bits of a hash, and seven bytes of the text.
    """
    stand_in = {"payload_code": F.xxhash64("payload_hash"), "payload_tie": leading_bytes("payload_hash", 7)}
    return packets.filter(F.col("payload_hash").isNotNull()).withColumns(stand_in).drop("payload_hash")


def _short_tie() -> Column:
    """The first three of the seven bytes."""
    return F.shiftright("payload_tie", 32)


def dedup_payload(shreds: DataFrame, *also: Column) -> DataFrame:
    """One row per distinct payload of a (provider, set): its first arrival and copies.

    A byte-identical copy is a duplicate before any validity check and never moves
    a timestamp. Arrival ties are settled by the verdict on the signature and the content, so reruns agree. ``also``
    adds grouping columns (a stream's event-time window). Of the payload hash the numbers of ``PAYLOAD`` are returned, of the
    content hash a stand-in ``data_code`` (0: none), of a leader ``leader_code``; ``name_data`` and ``set_rows`` give the texts back.
    """
    # The hash leads the key: where rows are compared, it tells them apart at once.
    place = ["slot", "fec_set_index", "provider"]
    keys = [*PAYLOAD, *place]
    # Verdicts are no grouping columns either: a filter on them would reach one reader's scan and undo the sharing.
    first = F.min(packed("rx_ns", (_three_valued("merkle_ok"), 3), (_three_valued("sig_ok"), 3), (_code("data_hash"), _CODE))).alias("first")
    name = F.when(F.col("leader").isNotNull(), F.xxhash64("leader")) if "leader" in shreds.columns else None
    leader = [] if name is None else [F.max(name).alias("leader_code")]
    merkle, sig, data = parts_of("said", 3, 3, _CODE)
    # The numbers of a payload are known with its hash; a filter would work the tie out twice.
    return (with_payload(shreds).filter(all_known(*place)).groupBy(*also, *keys, *_FIXED)
            .agg(F.min("rx_ns").alias("rx_ns"), first, F.count("*").alias("copies"), *leader)
            .filter(_all_in_use("copies", "rx_ns", "first"))
            .withColumn("said", rest_of("first", "rx_ns"))
            .withColumns({"merkle_ok": _flag_of(merkle), "sig_ok": _flag_of(sig)})
            .withColumn("data_code", data).drop("first", "said"))


def _all_in_use(count: str, *others: str) -> Column:
    """Always true. It keeps a whole aggregate in use by every reader, so that
    branches over it share one scan and one exchange."""
    always = F.col(count) > 0
    for col in others:
        always = always | F.col(col).isNull()
    return always


def all_known(*cols: str) -> Column:
    """Every column is set. Stated before a shared aggregate, it spares the joins above
    from pushing different null filters into each branch, which would undo the sharing."""
    known = F.col(cols[0]).isNotNull()
    for col in cols[1:]:
        known = known & F.col(col).isNotNull()
    return known


def judged(shreds: DataFrame) -> DataFrame:
    """Distinct payloads with their verdict."""
    return dedup_payload(shreds).withColumn("verdict", acceptance())


def match_truth(distinct: DataFrame) -> DataFrame:
    """Classify every failing payload against the authenticated copy of the same packet.

    ``failure`` is invalid_sig (same content), invalid_data (different content) or
    invalid_unknown (no authenticated copy, or no content hash). Data and code
    packets overlap in index, so ``is_code`` is part of the key. The truth, the last authenticated copy, has one
    row per packet, so many failing copies of one packet are split by the skew join.
    """
    # Keys that are never NULL, so that the join asks for no filter in one branch only; packets without a place match nothing.
    packet = [*SET_RACE, "kind", "index"]
    distinct = distinct.withColumns({"kind": _three_valued("is_code"), "index": F.coalesce("shred_index", F.lit(-1).cast("bigint"))})
    # The latest, of equal times the higher payload, then the higher content: the tie and what fits behind it of the content's number.
    half = 1 << 39
    latest = packed("rx_ns", (_short_tie(), _SHORT_TIE), (F.shiftright("data_code", _CODE_BITS + 1 - 39), half))
    truth = (distinct.filter((F.col("verdict") == "ok") & (F.col("data_code") > 0))
             .groupBy(*packet).agg(F.max_by("data_code", latest).alias("true_code")))
    failing = distinct.filter(F.col("verdict") == "bad").select("provider", *packet, "is_code", "shred_index", "data_code", "rx_ns")
    known = F.col("true_code").isNotNull() & (F.col("data_code") > 0) & all_known("is_code", "shred_index")
    same = F.col("data_code") == F.col("true_code")
    return (failing.join(truth, packet, "left").drop("kind", "index")
            .withColumn("failure", F.when(known & same, "invalid_sig").when(known, "invalid_data")
                        .otherwise("invalid_unknown")))


def name_data(matched: DataFrame, shreds: DataFrame) -> DataFrame:
    """Content hashes, ``data_hash`` and ``true_hash``, in place of their stand-in numbers."""
    names = shreds.select(_code("data_hash").alias("code"), F.col("data_hash").alias("said")).distinct()
    for code, name in (("data_code", "data_hash"), ("true_code", "true_hash")):
        matched = matched.join(names.toDF(code, name), code, "left").drop(code)
    return matched


def invalid_split(distinct: DataFrame) -> DataFrame:
    """Failures per (provider, set) by kind; the three always sum to ``invalid``."""
    kinds = ("invalid_sig", "invalid_data", "invalid_unknown")
    return (match_truth(distinct).groupBy(*PROVIDER_SET)
            .agg(F.count("*").alias("invalid"),
                 *[F.count_if(F.col("failure") == kind).alias(kind) for kind in kinds]))


def kth_arrival(arrivals: str, k: str) -> Column:
    """k-th smallest of an array of arrival times; NULL if k is 0 or too few arrived."""
    return F.when(F.col(k) > 0, F.try_element_at(F.sort_array(F.col(arrivals)), F.col(k).cast("int")))


def _count_or_none(count: str | Column) -> tuple[Column, int]:
    """A 16-bit count that may be missing, as a part of a packed number."""
    return F.coalesce((F.col(count) if isinstance(count, str) else count) + 1, F.lit(0).cast("bigint")), _COUNT + 1


def _count_of(part: Column) -> Column:
    return F.when(part > 0, part - 1)


def _sized(when: Column, num_data: Column, num_coding: Column) -> Column:
    """The first packet that tells the set's size, with what it tells."""
    return F.min(F.when(when, packed("rx_ns", (_short_tie(), _SHORT_TIE), _count_or_none(num_data), _count_or_none(num_coding))))


def _size_code(sized: str) -> Column:
    """Both counts of a size as one number, NULL where none was told."""
    data, coding = unpacked(sized, _SHORT_TIE, _COUNT + 1, _COUNT + 1)[1:]
    return data * (_COUNT + 1) + coding


def _learned_counts() -> Column:
    """Where the set's size was learned from: the first accepted code packet, or the
    accepted data packet flagged as the set's last (coding count then unknown)."""
    known = (F.col("verdict") == "ok") & (F.col("is_code") | F.coalesce("data_complete", F.lit(False)))
    from_data = F.pmod(F.col("position") + 1, F.lit(65536).cast("bigint"))
    return _sized(known, F.when(F.col("is_code"), F.col("num_data")).otherwise(from_data),
                  F.when(F.col("is_code"), F.col("num_coding")))


def _per_position(distinct: DataFrame) -> DataFrame:
    """(provider, set, kind, position) partial totals of distinct payloads."""
    ok = F.col("verdict") == "ok"
    counted = ok & (F.col("position") < MAX_POSITION)
    leader = [F.max("leader_code").alias("leader_code")] if "leader_code" in distinct.columns else []
    return (distinct
            .groupBy(*SET_RACE, "provider",
                     F.when(counted, F.col("is_code")).alias("kind"),
                     F.when(counted, F.col("position")).alias("slot_position"))
            .agg(F.min("rx_ns").alias("created_ns"),
                 F.min(F.when(ok, F.col("rx_ns"))).alias("first_ok"),
                 F.max(F.when(ok, F.col("rx_ns"))).alias("last_ok"),
                 F.sum(F.col("copies") - 1).alias("duplicated"),
                 F.count_if(F.col("verdict") == "unverifiable").alias("sig_unverifiable"),
                 F.count_if(F.col("verdict") == "bad").alias("invalid"),
                 F.max(ok & ~F.col("is_code") & F.coalesce("last_in_slot", F.lit(False))).alias("last_in_slot"),
                 _learned_counts().alias("learned"), *leader))


def _one_row(ranked: DataFrame, own: WindowSpec, totals: dict[str, Column]) -> DataFrame:
    """The first of the rows of every ``own`` window, with totals over all of them.

    The rows are sorted for ``nth`` already, so the totals of a few positions at a time need no table of all groups in memory.
    """
    return (ranked.select(*SET_RACE, "provider", "nth", *[c for c in ranked.columns if c == "size"],
                          *[total.over(own).alias(name) for name, total in totals.items()])
            .filter(F.col("nth") == 1))


def fold_positions(per_position: DataFrame) -> DataFrame:
    """Fold per-position totals into one row per (provider, set), failures unsplit.

    A provider's set has no more than ``MAX_POSITION`` positions of each kind, so they are ordered in a window, which costs one
    shuffle and one sort; lists of arrivals would be sorted for in every task before the shuffle and again after it.
    """
    leader = ["leader_code"] if "leader_code" in per_position.columns else []
    counted = F.col("kind").isNotNull()
    own = Window.partitionBy(*SET_RACE, "provider")
    arrival = F.when(counted, F.col("created_ns"))
    num_data, num_coding = (_count_of(part) for part in parts_of("size", _COUNT + 1, _COUNT + 1))
    ranked = (per_position.withColumns({"arrival": arrival, "size": _size_code("learned")})
              .withColumn("nth", F.row_number().over(own.orderBy(F.asc_nulls_last("arrival"))))
              .withColumn("size", F.min_by("size", "learned").over(own)))
    folded = (_one_row(ranked, own, {
        "decode_ns": F.min(F.when(F.col("nth") == num_data, F.col("arrival"))),
        "n_data": F.count_if(counted & ~F.col("kind")), "n_code": F.count_if(F.coalesce("kind", F.lit(False))),
        "created_ns": F.min("created_ns"), "first_ok": F.min("first_ok"), "last_ok": F.max("last_ok"),
        "duplicated": F.sum("duplicated"), "sig_unverifiable": F.sum("sig_unverifiable"), "invalid": F.sum("invalid"),
        "last_in_slot": F.max("last_in_slot"), **{c: F.max(c) for c in leader}})
              .withColumn("expected_total", num_data + num_coding)
              .withColumn("delivered", F.col("n_data") + F.col("n_code")))
    valid = ((F.col("invalid") == 0) & (F.col("sig_unverifiable") == 0)
             & F.col("decode_ns").isNotNull())
    return folded.select(
        *PROVIDER_SET, *leader,
        F.coalesce("first_ok", "created_ns").alias("first_ns"), "decode_ns",
        F.coalesce("last_ok", "created_ns").alias("last_ns"),
        "n_data", "n_code", "expected_total",
        saturating_sub(F.coalesce("expected_total", "delivered"), F.col("delivered")).alias("missed"),
        "invalid", "duplicated", "sig_unverifiable", valid.alias("is_valid"), "last_in_slot")


def set_rows(shreds: DataFrame) -> DataFrame:
    """The 19-column result row per (provider, slot, set)."""
    rows = rows_of_distinct(judged(shreds))
    if "leader" not in shreds.columns:
        return rows
    # Leaders are few; one row each gives the name back.
    names = (shreds.filter(F.col("leader").isNotNull()).select(F.xxhash64("leader").alias("leader_code"), F.col("leader").alias("named"))
             .distinct())
    named = rows.join(names, "leader_code", "left").withColumn("leader", F.col("named"))
    return named.select(*[c for c in rows.columns if c != "leader_code"])


def rows_of_distinct(distinct: DataFrame) -> DataFrame:
    """Result rows from distinct payloads with their verdict."""
    split = invalid_split(distinct).drop("invalid")
    rows = fold_positions(_per_position(distinct)).join(split, [*SET_RACE, "provider"], "left")

    def count(col: str) -> Column:
        return F.coalesce(col, F.lit(0).cast("bigint")).alias(col)

    return rows.select(
        *PROVIDER_SET, *[c for c in rows.columns if c == "leader_code"], F.lit(None).cast("string").alias("leader"), "first_ns", "decode_ns", "last_ns", "n_data", "n_code",
        "expected_total", "missed", "invalid", count("invalid_sig"), count("invalid_data"),
        count("invalid_unknown"), "duplicated", "sig_unverifiable", "is_valid", "last_in_slot")


def contested_scoreboard(rows: DataFrame) -> DataFrame:
    """Per provider over set rows: presence, wins and mean time behind.

    Only sets with two or more valid deliverers are races; every provider tied at
    the earliest decode wins. Also the totals the rates are taken from.
    """
    raced = race_min(rows.withColumn("finish", F.when(F.col("is_valid"), F.col("decode_ns")))
                     .select("provider", *SET_RACE, "finish"), "finish", SET_RACE)
    lead = F.row_number().over(Window.partitionBy(*SET_RACE).orderBy("provider")) == 1
    finished = F.col("finish").isNotNull()
    race = finished & (F.col("contestants") >= 2)
    per_provider = (raced.withColumn("lead", lead).groupBy("provider").agg(
        F.count("*").alias("present"), F.count("finish").alias("valid"),
        F.count_if(race).alias("races"),
        F.count_if(race & (F.col("finish") == F.col("win_ns"))).alias("wins"),
        F.sum(F.when(race, F.col("finish") - F.col("win_ns")).cast("decimal(20,0)")).alias("behind"),
        F.count_if("lead").alias("sets_led"),
        F.count_if(F.col("lead") & (F.col("contestants") >= 2)).alias("contested_led")))
    # One row per provider is left, so the totals are summed over a handful of rows.
    everyone = Window.partitionBy(F.lit(0))
    return (per_provider
            .withColumn("total_sets", F.sum("sets_led").over(everyone))
            .withColumn("contested_sets", F.sum("contested_led").over(everyone))
            .select("provider", "present", "valid", "races", "wins",
                    F.when(F.col("races") > 0, F.col("wins").cast("double") / F.col("races")).alias("winrate"),
                    F.when(F.col("races") > 0,
                           F.col("behind").cast("double") / F.col("races") / F.lit(1e3)).alias("mean_behind_us"),
                    (F.col("present").cast("double") / F.col("total_sets")).alias("coverage"),
                    "total_sets", "contested_sets"))


def order_scoreboard(scoreboard: DataFrame) -> DataFrame:
    return scoreboard.orderBy(F.desc_nulls_last("winrate"), F.desc("coverage"), "provider")


def _eligible(version: int | None) -> Column:
    matches = F.lit(True) if version is None else F.coalesce(F.col("version") == version, F.lit(False))
    return matches & F.col("root").isNotNull()


def _shown(version: int | None) -> Column:
    """The stand-in of the root that an eligible packet shows, else 0."""
    return F.when(_eligible(version), _code("root")).otherwise(F.lit(0).cast("bigint"))


def payload_variants(packets: DataFrame, version: int | None = None) -> DataFrame:
    """Packets of one provider and set that are alike in payload, shown root and verdict, as one row.

    Facts of sets and distinct payloads are both taken from these rows, so that they share one scan and one exchange.
    """
    keys = [*PAYLOAD, *PROVIDER_SET]
    return (with_payload(packets).filter(all_known(*PROVIDER_SET))
            .groupBy(*keys, "is_code", "position", "num_data", "num_coding", "sig_ok", _shown(version).alias("shown"))
            .agg(F.min("rx_ns").alias("rx_ns"), F.count("*").alias("copies")).filter(_all_in_use("copies", "rx_ns")))


def _facts(variants: DataFrame) -> DataFrame:
    """Per set, over the packets of all providers in arrival order: the first root shown
    (by a packet of the right version), the first signature verdict reached under that
    root, and the size with the moment it became known (the first code packet, sound
    or not).

    Packets are reduced per (set, root) first; a sound set shows one root. ``root_code`` stands for the root (0: none),
    ``told`` holds size and verdict, see ``_told``.
    """
    tie = (F.col("payload_tie"), _TIE)
    judged_ = F.col("sig_ok").isNotNull()
    roots = (variants.groupBy(*SET_RACE, "shown")
             .agg(F.min(F.when(F.col("shown") > 0, packed("rx_ns", tie))).alias("shown_at"),
                  F.min(F.when(judged_, packed("rx_ns", tie, (_three_valued("sig_ok"), 3)))).alias("sig"),
                  F.min(F.when(F.col("is_code"), packed("rx_ns", tie))).alias("known_at"),
                  _sized(F.col("is_code"), F.col("num_data"), F.col("num_coding")).alias("size"))
             .filter(all_known(*SET_RACE))
             .withColumn("verdict", unpacked("sig", _TIE, 3)[1]))
    none = F.lit(0).cast("bigint")
    sets_ = roots.groupBy(*SET_RACE).agg(
        F.min("known_at").alias("known_at"), F.min("size").alias("size"),
        F.min_by("shown", "shown_at").alias("root_code"), F.min_by("verdict", "shown_at").alias("verdict"))
    # What a set says of itself as one number that its rows carry along.
    told = F.coalesce(_size_code("size"), none) * 3 + F.coalesce("verdict", none)
    return sets_.select(*SET_RACE, F.coalesce("root_code", none).alias("root_code"), told.alias("told"),
                        time_of("known_at").alias("known_ns"), unpacked("known_at", _TIE)[0].alias("known_tie"))


def _told(told: str) -> tuple[Column, Column, Column]:
    """The size of a set, data and coding, and its signature verdict."""
    data, coding, verdict = parts_of(told, _COUNT + 1, _COUNT + 1, 3)
    return _count_of(data), _count_of(coding), _flag_of(verdict)


def set_facts(packets: DataFrame, version: int | None = None) -> DataFrame:
    """The first root, signature verdict and size of every set."""
    return _facts(payload_variants(packets, version))


def structural_valid(packets: DataFrame, version: int | None = None) -> DataFrame:
    """Attach ``structural`` and the set's signature verdict ``set_sig_ok``.

    A packet is structurally sound if its version matches and its root equals the
    root the set showed first, from whichever provider. The leader's signature is
    judged once per set. ``packets`` needs ``root`` and, with ``version``, a
    ``version`` column.
    """
    facts = set_facts(packets, version).select(*SET_RACE, "root_code", _told("told")[2].alias("set_sig_ok"))
    return (packets.join(facts, list(SET_RACE), "left")
            .withColumn("structural", F.coalesce((_shown(version) > 0) & (_shown(version) == F.col("root_code")), F.lit(False)))
            .drop("root_code"))


def _payloads_with_facts(packets: DataFrame, version: int | None) -> DataFrame:
    """Distinct payloads with the facts of their set, and whether they are sound."""
    variants = payload_variants(packets, version)
    # The first arrival of a payload, and the root it showed.
    said = F.min(packed("rx_ns", (F.col("shown"), _CODE))).alias("said")
    payloads = (variants.groupBy(*PAYLOAD, *PROVIDER_SET, "is_code", "position")
                .agg(F.min("rx_ns").alias("rx_ns"), F.sum("copies").alias("copies"), said)
                .withColumn("shown", rest_of("said", "rx_ns")).drop("said"))
    return (payloads.join(_facts(variants), list(SET_RACE))
            .withColumn("structural", (F.col("shown") > 0) & (F.col("shown") == F.col("root_code"))))


def live_set_stats(packets: DataFrame, version: int | None = None) -> DataFrame:
    """Per (provider, set): first, decode and last times and counts, live semantics.

    The set's size is known from the first code packet of any provider, sound or
    not. A provider can decode at its first sound packet at or after both that
    moment and its own ``num_data``-th distinct position.
    """
    # At or after the packet that told the size, payloads settling equal times.
    known = (F.col("rx_ns") > F.col("known_ns")) | (
        (F.col("rx_ns") == F.col("known_ns")) & (F.col("payload_tie") >= F.col("known_tie")))
    sound = F.col("structural")
    counted = sound & (F.col("position") < MAX_POSITION)
    per_position = (
        _payloads_with_facts(packets, version)
        .groupBy(*SET_RACE, "provider",
                 F.when(counted, F.col("is_code")).alias("kind"),
                 F.when(counted, F.col("position")).alias("slot_position"))
        .agg(F.min(F.when(sound, F.col("rx_ns"))).alias("first_ok"),
             F.max(F.when(sound, F.col("rx_ns"))).alias("last_ok"),
             F.min(F.when(sound & known, F.col("rx_ns"))).alias("first_known"),
             F.sum("copies").alias("received"),
             F.sum(F.col("copies") - 1).alias("duplicated"),
             F.count_if(~sound).alias("invalid"),
             # The same on all rows of a set; max only carries it along.
             F.max("told").alias("told")))
    arrival = F.when(F.col("slot_position").isNotNull(), F.col("first_ok"))
    own = Window.partitionBy(*SET_RACE, "provider")
    set_data, set_coding, set_sig_ok = _told("told")
    ranked = (per_position.withColumn("arrival", arrival)
              .withColumn("nth", F.row_number().over(own.orderBy(F.asc_nulls_last("arrival")))))
    folded = _one_row(ranked, own, {
        "kth": F.min(F.when(F.col("nth") == set_data, F.col("arrival"))), "delivered": F.count("kind"),
        "first_ok": F.min("first_ok"), "last_ok": F.max("last_ok"), "first_known": F.min("first_known"),
        "received": F.sum("received"), "duplicated": F.sum("duplicated"), "invalid": F.sum("invalid"), "told": F.max("told")})
    # Enough positions, and the first sound packet from when the size was known on: the later of both.
    decode = (F.when(set_data == 0, F.col("first_known"))
              .when(F.col("kth").isNotNull() & F.col("first_known").isNotNull(), F.greatest("kth", "first_known")))
    expected = set_data + set_coding
    return folded.select(
        *PROVIDER_SET, "first_ok", decode.alias("decode"),
        "last_ok", set_sig_ok.alias("set_sig_ok"), "received", "invalid", "duplicated", "delivered",
        saturating_sub(F.coalesce(expected, F.col("delivered")), F.col("delivered")).alias("missed"))


def anchored_set_stats(packets: DataFrame, baseline: str | None, version: int | None = None) -> DataFrame:
    """Signed delays of each provider to the set's anchor (negative = earlier).

    The anchor of each of the three times is the baseline provider's, else the
    earliest. Sets without one sound packet from anyone give no rows.
    """
    anchored = (live_set_stats(packets, version)
                .withColumn("anchor_first", race_anchor("first_ok", "provider", baseline))
                .withColumn("anchor_decode", race_anchor("decode", "provider", baseline))
                .withColumn("anchor_last", race_anchor("last_ok", "provider", baseline))
                .filter(F.col("anchor_first").isNotNull()))
    valid = ((F.col("invalid") == 0) & F.coalesce("set_sig_ok", F.lit(False))
             & F.col("decode").isNotNull())
    return anchored.select(
        *PROVIDER_SET,
        (F.col("first_ok") - F.col("anchor_first")).alias("fec_first_shred_delay_ns"),
        (F.col("decode") - F.col("anchor_decode")).alias("fec_decode_delay_ns"),
        (F.col("last_ok") - F.col("anchor_last")).alias("fec_last_shred_delay_ns"),
        F.col("invalid").alias("invalid_shreds"), F.col("missed").alias("missed_shreds"),
        F.col("duplicated").alias("duplicated_shreds"), valid.alias("is_valid"))


def provider_counters(packets: DataFrame, version: int | None = None) -> DataFrame:
    """Per provider: packets received, invalid and duplicate, and sets it delivered first.

    A tie for first goes to the lowest provider.
    """
    sound = F.col("structural")
    # No size or decode time is asked for, so payloads are folded per set at once, without their positions.
    stats = (_payloads_with_facts(packets, version).groupBy(*SET_RACE, "provider")
             .agg(F.min(F.when(sound, F.col("rx_ns"))).alias("first_ok"), F.sum("copies").alias("received"),
                  F.sum(F.col("copies") - 1).alias("duplicated"), F.count_if(~sound).alias("invalid")))
    order = Window.partitionBy(*SET_RACE).orderBy(F.asc_nulls_last("first_ok"), "provider")
    won = (F.row_number().over(order) == 1) & F.col("first_ok").isNotNull()
    return (stats.withColumn("won", won).groupBy("provider")
            .agg(F.sum("received").alias("received"), F.sum("invalid").alias("invalid"),
                 F.sum("duplicated").alias("duplicate"), F.count_if("won").alias("sets_won")))


def delay_histogram(delays: DataFrame, by: str = "provider", delay: str = "fec_first_shred_delay_ns",
                    edges: tuple[int, ...] = DELAY_EDGES_NS) -> DataFrame:
    """Cumulative counts per upper edge, the last edge open ("+Inf")."""
    seen = F.col(delay).isNotNull()
    counts = [F.count_if(F.col(delay) <= e).alias(f"le_{i}") for i, e in enumerate(edges)]
    wide = delays.groupBy(by).agg(*counts, F.count_if(seen).alias("le_inf"))
    cells = [F.struct(F.lit(str(e)).alias("le"), F.col(f"le_{i}").alias("n")) for i, e in enumerate(edges)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n")))
    return wide.select(by, F.explode(F.array(*cells)).alias("cell")).select(by, "cell.le", "cell.n")


def slot_first_seen(packets: DataFrame, keep: int = KEEP_SLOTS) -> DataFrame:
    """First arrival per slot over sound packets, newest ``keep`` slots only."""
    seen = (packets.filter(F.col("structural") & (F.col("slot") < MAX_PLAUSIBLE_SLOT))
            .groupBy("slot").agg(F.min("rx_ns").alias("seen_ns")))
    return keep_newest_slots(seen, keep)


def keep_newest_slots(slots: DataFrame, keep: int = KEEP_SLOTS) -> DataFrame:
    # The maximum is taken over whole rows, so that it reads the same aggregate as the
    # rows it limits instead of a second, narrower one.
    rest = [c for c in slots.columns if c != "slot"]
    newest = slots.agg(F.max(F.struct("slot", *rest)).alias("last")).select("last.slot").scalar()
    return slots.filter(F.col("slot") >= newest - keep)


