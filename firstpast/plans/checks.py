"""The registered queries restated as plain SQL for an independent engine.

Each statement is written from the meaning of the query -- row numbers, plain
joins, whole-table windows -- and not from the plan the Spark side uses.
"""

from __future__ import annotations

from firstpast.plans.views import check_ctes, check_view

_ARR = check_ctes("arrivals_delta") + """,
arr AS (SELECT * FROM arrivals_delta WHERE delta_ns IS NOT NULL),
firsts AS (SELECT hub, slot, fec_set_index, source, min(delta_ns) AS delta_ns FROM arr GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY hub, slot, fec_set_index
                                        ORDER BY delta_ns, source) - 1 AS rank FROM firsts),
races AS (SELECT hub, count(*) AS races FROM (SELECT DISTINCT hub, slot, fec_set_index FROM arr) GROUP BY hub)"""

_LEADERS = _ARR + f""",
schedule AS ({check_view('schedule')}),
leader_brands AS ({check_view('leader_brands')}),
led AS (SELECT r.*, s.leader, b.brand AS leader_provider FROM ranked r
        LEFT JOIN schedule s ON s.slot = r.slot LEFT JOIN leader_brands b ON b.leader = s.leader)"""


def _percentiles(table: str, by: str, value: str) -> str:
    """(by, p50_ms, p90_ms, p99_ms) at bin resolution."""
    picks = ", ".join(
        f"(-100000000.0 + (min(CASE WHEN cum >= {q} * total THEN bin END) + 0.5) * 20000.0) / 1e6 AS {name}"
        for name, q in (("p50_ms", "CAST(0.5 AS DOUBLE)"), ("p90_ms", "CAST(0.9 AS DOUBLE)"),
                        ("p99_ms", "CAST(0.99 AS DOUBLE)")))
    picks = picks.replace("-100000000.0", "CAST(-100000000 AS DOUBLE)").replace(
        "+ 0.5)", "+ CAST(0.5 AS DOUBLE))").replace("20000.0", "CAST(20000 AS DOUBLE)")
    return f"""SELECT {by}, {picks} FROM (
  SELECT {by}, bin, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS cum,
         sum(n) OVER (PARTITION BY {by}) AS total
  FROM (SELECT {by}, CAST(floor((least(greatest({value}, -100000000), 99999999) + 100000000)
                                / CAST(20000 AS DOUBLE)) AS BIGINT) AS bin, count(*) AS n
        FROM {table} GROUP BY ALL)) GROUP BY {by}"""


_PCT = "CAST(100 AS DOUBLE) * {} / {}"

CHECKS: dict[str, str] = {}

CHECKS["ranked_races"] = _ARR + """
SELECT hub, slot, fec_set_index, source, delta_ns, rank FROM ranked"""

CHECKS["per_source_stats"] = _ARR + f""",
pct AS ({_percentiles('ranked', 'hub, source', 'delta_ns')})
SELECT r.hub, r.source, count(*) AS samples,
       count(*) FILTER (WHERE rank = 0) AS win_count,
       CAST(100 AS DOUBLE) * count(*) FILTER (WHERE rank = 0) / any_value(races) AS win_rate_pct,
       CAST(sum(rank) AS DOUBLE) / count(*) AS avg_rank,
       CAST(sum(delta_ns) AS DOUBLE) / count(*) / 1e6 AS avg_delta_ms,
       any_value(p50_ms) AS p50_ms, any_value(p90_ms) AS p90_ms, any_value(p99_ms) AS p99_ms,
       min(delta_ns) / 1e6 AS min_ms, max(delta_ns) / 1e6 AS max_ms,
       CAST(100 AS DOUBLE) * count(*) FILTER (WHERE delta_ns < 0) / count(*) AS beats_baseline_pct,
       CAST(100 AS DOUBLE) * count(*) / any_value(races) AS coverage_pct
FROM ranked r JOIN races USING (hub) JOIN pct USING (hub, source) GROUP BY r.hub, r.source"""

CHECKS["races_per_hub"] = _ARR + " SELECT hub, races FROM races"

CHECKS["source_percentiles"] = _ARR + " " + _percentiles("ranked", "hub, source", "delta_ns")

_H2H = _ARR + """,
led AS (SELECT a.hub, a.source AS source_a, b.source AS source_b,
               count(*) FILTER (WHERE a.rank < b.rank) AS a_first_count, count(*) AS both_present
        FROM ranked a JOIN ranked b
          ON a.hub = b.hub AND a.slot = b.slot AND a.fec_set_index = b.fec_set_index AND a.source <> b.source
        GROUP BY ALL)"""

CHECKS["head_to_head"] = _H2H + """
SELECT hub, source_a, source_b, both_present, a_first_count,
       CAST(100 AS DOUBLE) * a_first_count / both_present AS a_first_pct
FROM led WHERE a_first_count > 0"""

CHECKS["h2h_matrix_long"] = _H2H + """,
cells AS (SELECT hub, source_a AS row_source, source_b AS col_source,
                 CAST(100 AS DOUBLE) * a_first_count / both_present AS beats_pct FROM led)
SELECT *, CASE WHEN beats_pct >= 60 THEN 'good' WHEN beats_pct <= 40 THEN 'bad' ELSE 'even' END AS band
FROM cells"""

CHECKS["h2h_matrix"] = _H2H + " SELECT hub, source_a AS row_source, " + ", ".join(
    f"max(CASE WHEN source_b = 'src-{i}' THEN round(CAST(100 AS DOUBLE) * a_first_count / both_present, 1) END) AS \"src-{i}\""
    for i in range(8)) + " FROM led GROUP BY hub, source_a"

CHECKS["leader_split"] = _LEADERS + """,
per AS (SELECT hub, leader_provider, count(DISTINCT slot) AS slots_seen,
               count(DISTINCT (slot, fec_set_index)) AS fec_sets
        FROM led WHERE leader_provider IS NOT NULL GROUP BY ALL)
SELECT l.hub, l.leader_provider, any_value(slots_seen) AS slots_seen, any_value(fec_sets) AS fec_sets,
       l.source, count(*) AS samples, count(*) FILTER (WHERE rank = 0) AS wins,
       CAST(100 AS DOUBLE) * count(*) FILTER (WHERE rank = 0) / any_value(fec_sets) AS win_rate_pct,
       CAST(sum(delta_ns) AS DOUBLE) / count(*) / 1e6 AS avg_delta_ms
FROM led l JOIN per p ON p.hub = l.hub AND p.leader_provider = l.leader_provider
GROUP BY l.hub, l.leader_provider, l.source"""

CHECKS["own_vs_other"] = _LEADERS + """
SELECT hub, source, CASE WHEN leader_provider = source THEN 'own' ELSE 'other' END AS slots_kind,
       count(*) AS samples, count(*) FILTER (WHERE rank = 0) AS wins,
       CAST(100 AS DOUBLE) * count(*) FILTER (WHERE rank = 0) / count(*) AS win_rate_of_samples_pct,
       CAST(sum(delta_ns) AS DOUBLE) / count(*) / 1e6 AS avg_delta_ms
FROM led WHERE source IN (SELECT brand FROM leader_brands) GROUP BY ALL"""

CHECKS["unknown_leader_slots"] = _LEADERS + """
SELECT count(DISTINCT slot) AS unknown_leader_slots FROM led WHERE leader IS NULL"""

_TREND = _ARR + """,
trend AS (SELECT strftime(t, '%Y-%m-%d') AS day, hub, source, count(*) AS samples,
       CAST(sum(delta_ns) AS DOUBLE) / count(*) / 1e6 AS avg_delta_ms,
       CAST(100 AS DOUBLE) * count(*) FILTER (WHERE delta_ns < 0) / count(*) AS beats_baseline_pct
FROM arr GROUP BY ALL)"""

CHECKS["daily_trend"] = _TREND + " SELECT * FROM trend"

CHECKS["trend_pivot"] = _TREND + " SELECT hub, day, " + ", ".join(
    f"max(CASE WHEN source = 'src-{i}' THEN avg_delta_ms END) AS \"src-{i}\"" for i in range(8)
) + " FROM trend GROUP BY hub, day"

CHECKS["first_provider_share"] = check_ctes("first_provider", "providers") + """,
names AS (SELECT src_ip, string_agg(name, ';' ORDER BY name) AS names
          FROM (SELECT DISTINCT src_ip, name FROM providers) GROUP BY src_ip),
counts AS (SELECT hub, src_ip, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM first_provider GROUP BY ALL)
SELECT hub, src_ip, coalesce(names, 'UNREGISTERED') AS provider_names, n AS first_count,
       CAST(100 AS DOUBLE) * n / CAST(sum(n) OVER (PARTITION BY hub) AS BIGINT) AS first_share_pct,
       strftime(t0, '%Y-%m-%d') AS window_start, strftime(t1, '%Y-%m-%d') AS window_end
FROM counts LEFT JOIN names USING (src_ip)"""

CHECKS["ip_coverage"] = check_ctes("first_provider", "providers", "arrivals") + """,
interest AS (SELECT concat('group-', s_nationkey % 4) AS grp, concat('10.0.', s_nationkey, '.', s_suppkey) AS ip
             FROM supplier UNION ALL SELECT concat('group-', n_regionkey), concat('10.1.0.', n_nationkey) FROM nation),
registry AS (SELECT name, src_ip, tier FROM providers
             UNION ALL SELECT n_name, concat('10.1.0.', n_nationkey), 'free' FROM nation),
reg AS (SELECT src_ip AS ip, string_agg(DISTINCT name, ';' ORDER BY name) AS names,
               string_agg(DISTINCT tier, ';' ORDER BY tier) AS tiers,
               bool_or(name IN (SELECT source FROM arrivals)) AS arrived
        FROM registry GROUP BY src_ip),
was AS (SELECT DISTINCT src_ip AS ip FROM first_provider)
SELECT grp AS "group", i.ip, coalesce(names, '-') AS registered_as, coalesce(tiers, '-') AS tier,
       CASE WHEN arrived THEN 'yes' ELSE 'no' END AS arrivals_data,
       CASE WHEN w.ip IS NOT NULL THEN 'yes' ELSE 'no' END AS first_provider_data,
       CASE WHEN names IS NULL THEN 'not registered, its packets are dropped: no data'
            WHEN NOT arrived AND w.ip IS NULL THEN 'registered but no samples in window' ELSE '' END AS note
FROM interest i LEFT JOIN reg ON reg.ip = i.ip LEFT JOIN was w ON w.ip = i.ip"""

_PANEL = _ARR + f""",
truth AS (SELECT hub, slot, fec_set_index, max(signature) AS tsig FROM arr
          WHERE delta_ns = 0 AND source = 'src-0' AND signature IS NOT NULL GROUP BY ALL),
sets AS (SELECT hub, count(*) AS sets FROM truth GROUP BY hub),
j AS (SELECT a.*, CASE WHEN coalesce(signature, '') = tsig THEN 'valid'
                       WHEN coalesce(signature, '') = '' THEN 'none' ELSE 'bad' END AS verdict
      FROM arr a JOIN truth t ON t.hub = a.hub AND t.slot = a.slot AND t.fec_set_index = a.fec_set_index),
v AS (SELECT *, row_number() OVER (PARTITION BY hub, slot, fec_set_index ORDER BY delta_ns, source) - 1 AS rank
      FROM j WHERE verdict = 'valid'),
pct AS ({_percentiles('v', 'hub, source', 'delta_ns')}),
good AS (SELECT hub, source, count(*) AS n, count(*) FILTER (WHERE rank = 0) AS wins, sum(rank) AS sr,
                sum(delta_ns) AS sd, count(*) FILTER (WHERE delta_ns < 0) AS neg FROM v GROUP BY ALL),
alls AS (SELECT hub, source, count(*) AS n_all, count(*) FILTER (WHERE verdict = 'bad') AS bad,
                count(*) FILTER (WHERE verdict = 'none') AS nosig FROM j GROUP BY ALL),
panel AS (SELECT a.hub, a.source, coalesce(n, 0) AS valid_samples, coalesce(wins, 0) AS win_count,
       CAST(100 AS DOUBLE) * coalesce(wins, 0) / sets AS win_rate_pct,
       CAST(sr AS DOUBLE) / n AS avg_rank, CAST(sd AS DOUBLE) / n / 1e6 AS avg_delta_ms,
       p50_ms, p90_ms, p99_ms, CAST(100 AS DOUBLE) * neg / n AS beats_baseline_pct,
       CAST(100 AS DOUBLE) * coalesce(n, 0) / sets AS valid_coverage_pct,
       bad AS bad_sig_count, nosig AS no_sig_count, CAST(100 AS DOUBLE) * bad / n_all AS bad_sig_pct_of_arrivals
FROM alls a JOIN sets USING (hub) LEFT JOIN good g ON g.hub = a.hub AND g.source = a.source
LEFT JOIN pct p ON p.hub = a.hub AND p.source = a.source)"""

CHECKS["signature_panel"] = _PANEL + " SELECT * FROM panel"
CHECKS["signature_mismatches"] = _PANEL + """
SELECT hub, source, valid_samples AS valid, bad_sig_count AS bad_signature, no_sig_count AS no_signature
FROM panel WHERE bad_sig_count > 0 OR no_sig_count > 0"""

_BUCKETS = _ARR + """,
b AS (SELECT *, time_bucket(INTERVAL 30 DAY, t, TIMESTAMP '1970-01-01') AS bucket FROM arr),
fb AS (SELECT *, min(bucket) OVER (PARTITION BY hub, slot, fec_set_index) AS first_bucket FROM b)"""

CHECKS["first_bucket_races"] = _BUCKETS + """
SELECT hub, slot, fec_set_index, source, min(delta_ns) AS delta_ns FROM fb WHERE bucket = first_bucket GROUP BY ALL"""
CHECKS["first_bucket_rows"] = _BUCKETS + """
SELECT hub, source, count(*) AS arrivals, CAST(sum(rx_ns) AS BIGINT) AS rx_sum
FROM fb WHERE bucket = first_bucket GROUP BY ALL"""

CHECKS["recent_arrivals"] = check_ctes("arrivals_delta") + """
SELECT hub, source, count(*) AS arrivals, CAST(sum(delta_ns) AS BIGINT) AS delta_sum FROM arrivals_delta
WHERE t > TIMESTAMP '2000-06-01' - INTERVAL 17520 HOUR AND delta_ns IS NOT NULL GROUP BY ALL"""

# -- sets ------------------------------------------------------------------

_SETS = check_ctes("shreds") + """,
numbered AS (SELECT *, row_number() OVER w AS copy_no, count(*) OVER (
                 PARTITION BY provider, slot, fec_set_index, payload_hash) AS copies
             FROM shreds WINDOW w AS (PARTITION BY provider, slot, fec_set_index, payload_hash
                 ORDER BY rx_ns, is_code, position, shred_index, num_data NULLS FIRST, num_coding NULLS FIRST,
                          data_complete, last_in_slot, merkle_ok, sig_ok NULLS FIRST, data_hash)),
d AS (SELECT *, CASE WHEN NOT merkle_ok OR sig_ok IS FALSE THEN 'bad' WHEN sig_ok IS NULL THEN 'unverifiable'
                     ELSE 'ok' END AS verdict FROM numbered WHERE copy_no = 1),
truth AS (SELECT slot, fec_set_index, is_code, shred_index, data_hash AS true_hash FROM (
            SELECT *, row_number() OVER (PARTITION BY slot, fec_set_index, is_code, shred_index
                                         ORDER BY rx_ns DESC, payload_hash DESC, data_hash DESC) AS rn
            FROM d WHERE verdict = 'ok' AND data_hash IS NOT NULL) WHERE rn = 1),
matched AS (SELECT d.*, true_hash, CASE WHEN data_hash = true_hash THEN 'invalid_sig'
                   WHEN data_hash <> true_hash THEN 'invalid_data' ELSE 'invalid_unknown' END AS failure
            FROM d LEFT JOIN truth USING (slot, fec_set_index, is_code, shred_index) WHERE verdict = 'bad'),
pos AS (SELECT provider, slot, fec_set_index, is_code, position, min(rx_ns) AS arrival FROM d
        WHERE verdict = 'ok' AND position < 128 GROUP BY ALL),
kth AS (SELECT *, row_number() OVER (PARTITION BY provider, slot, fec_set_index ORDER BY arrival) AS k FROM pos),
learned AS (SELECT provider, slot, fec_set_index,
                   CASE WHEN is_code THEN num_data ELSE (position + 1) % 65536 END AS nd,
                   CASE WHEN is_code THEN num_coding END AS nc FROM (
              SELECT *, row_number() OVER (PARTITION BY provider, slot, fec_set_index
                                           ORDER BY rx_ns, payload_hash) AS rn
              FROM d WHERE verdict = 'ok' AND (is_code OR data_complete)) WHERE rn = 1),
base AS (SELECT provider, slot, fec_set_index,
                coalesce(min(rx_ns) FILTER (WHERE verdict = 'ok'), min(rx_ns)) AS first_ns,
                coalesce(max(rx_ns) FILTER (WHERE verdict = 'ok'), min(rx_ns)) AS last_ns,
                count(DISTINCT position) FILTER (WHERE verdict = 'ok' AND position < 128 AND NOT is_code) AS n_data,
                count(DISTINCT position) FILTER (WHERE verdict = 'ok' AND position < 128 AND is_code) AS n_code,
                count(*) FILTER (WHERE verdict = 'bad') AS invalid,
                CAST(sum(copies - 1) AS BIGINT) AS duplicated,
                count(*) FILTER (WHERE verdict = 'unverifiable') AS sig_unverifiable,
                bool_or(verdict = 'ok' AND NOT is_code AND last_in_slot) AS last_in_slot
         FROM d GROUP BY ALL),
split AS (SELECT provider, slot, fec_set_index,
                 count(*) FILTER (WHERE failure = 'invalid_sig') AS invalid_sig,
                 count(*) FILTER (WHERE failure = 'invalid_data') AS invalid_data,
                 count(*) FILTER (WHERE failure = 'invalid_unknown') AS invalid_unknown
          FROM matched GROUP BY ALL),
rows_ AS (SELECT b.provider, b.slot, b.fec_set_index, s.leader, first_ns, kth.arrival AS decode_ns, last_ns,
                 n_data, n_code, nd + nc AS expected_total,
                 greatest(0, coalesce(nd + nc, n_data + n_code) - (n_data + n_code)) AS missed, invalid,
                 coalesce(invalid_sig, 0) AS invalid_sig, coalesce(invalid_data, 0) AS invalid_data,
                 coalesce(invalid_unknown, 0) AS invalid_unknown, duplicated, sig_unverifiable,
                 invalid = 0 AND sig_unverifiable = 0 AND kth.arrival IS NOT NULL AS is_valid, last_in_slot
          FROM base b LEFT JOIN learned l USING (provider, slot, fec_set_index)
          LEFT JOIN split USING (provider, slot, fec_set_index)
          LEFT JOIN kth ON kth.provider = b.provider AND kth.slot = b.slot
                       AND kth.fec_set_index = b.fec_set_index AND kth.k = l.nd
          LEFT JOIN (""" + check_view("schedule") + """) s ON s.slot = b.slot)"""

CHECKS["set_rows"] = _SETS + " SELECT * FROM rows_"
CHECKS["invalid_split"] = _SETS + """
SELECT provider, slot, fec_set_index, invalid_sig + invalid_data + invalid_unknown AS invalid,
       invalid_sig, invalid_data, invalid_unknown FROM split"""
CHECKS["truth_match"] = _SETS + """
SELECT provider, slot, fec_set_index, is_code, shred_index, data_hash, true_hash, failure, count(*) AS packets
FROM matched GROUP BY ALL"""
CHECKS["retransmits"] = _SETS + """
SELECT provider, count(*) AS payloads, CAST(sum(copies) AS BIGINT) AS packets,
       CAST(sum(copies - 1) AS BIGINT) AS retransmits, min(rx_ns) AS first_ns FROM d GROUP BY provider"""
CHECKS["sets_archive"] = _SETS + """
SELECT CAST(floor(first_ns * 10000 / CAST(600000000000 AS DOUBLE)) AS BIGINT) * 600 AS window_start,
       count(*) AS rows_fec_sets, min(slot) AS min_slot, max(slot) AS max_slot FROM rows_ GROUP BY ALL"""

CHECKS["archive_extent"] = _SETS + """
SELECT count(*) AS rows_fec_sets, min(slot) AS min_slot, max(slot) AS max_slot FROM rows_"""

CHECKS["contested_scoreboard"] = _SETS + """,
f AS (SELECT provider, slot, fec_set_index, CASE WHEN is_valid THEN decode_ns END AS fin FROM rows_),
r AS (SELECT slot, fec_set_index, min(fin) AS win, count(fin) AS n FROM f GROUP BY ALL),
t AS (SELECT count(*) AS total_sets, count(*) FILTER (WHERE n >= 2) AS contested_sets FROM r)
SELECT provider, count(*) AS present, count(fin) AS valid,
       count(*) FILTER (WHERE fin IS NOT NULL AND n >= 2) AS races,
       count(*) FILTER (WHERE fin = win AND n >= 2) AS wins,
       CAST(count(*) FILTER (WHERE fin = win AND n >= 2) AS DOUBLE)
         / count(*) FILTER (WHERE fin IS NOT NULL AND n >= 2) AS winrate,
       CAST(sum(fin - win) FILTER (WHERE n >= 2) AS DOUBLE)
         / count(*) FILTER (WHERE fin IS NOT NULL AND n >= 2) / 1e3 AS mean_behind_us,
       CAST(count(*) AS DOUBLE) / any_value(total_sets) AS coverage,
       any_value(total_sets) AS total_sets, any_value(contested_sets) AS contested_sets
FROM f JOIN r USING (slot, fec_set_index) CROSS JOIN t GROUP BY provider"""

_LIVE = check_ctes("shreds") + """,
eligible AS (SELECT *, version = 1 AND root IS NOT NULL AS eligible FROM shreds),
roots AS (SELECT slot, fec_set_index, root AS set_root FROM (
            SELECT *, row_number() OVER (PARTITION BY slot, fec_set_index ORDER BY rx_ns, payload_hash, root) AS rn
            FROM eligible WHERE eligible) WHERE rn = 1),
sound AS (SELECT e.*, coalesce(eligible AND root = set_root, false) AS structural
          FROM eligible e LEFT JOIN roots USING (slot, fec_set_index)),
setsig AS (SELECT slot, fec_set_index, sig_ok AS set_sig_ok FROM (
             SELECT *, row_number() OVER (PARTITION BY slot, fec_set_index ORDER BY rx_ns, payload_hash, sig_ok) AS rn
             FROM sound WHERE structural AND sig_ok IS NOT NULL) WHERE rn = 1),
size AS (SELECT slot, fec_set_index, num_data AS nd, num_coding AS nc, rx_ns AS krx, payload_hash AS kh FROM (
           SELECT *, row_number() OVER (PARTITION BY slot, fec_set_index
                                        ORDER BY rx_ns, payload_hash, num_data, num_coding) AS rn
           FROM sound WHERE is_code) WHERE rn = 1),
nb AS (SELECT *, row_number() OVER (PARTITION BY provider, slot, fec_set_index, payload_hash
                 ORDER BY rx_ns, is_code, position, shred_index, num_data NULLS FIRST, num_coding NULLS FIRST,
                          data_complete, last_in_slot, merkle_ok, sig_ok NULLS FIRST, data_hash, structural) AS copy_no
       FROM sound),
acc AS (SELECT *, row_number() OVER (PARTITION BY provider, slot, fec_set_index, is_code, position
                                     ORDER BY rx_ns, payload_hash) = 1 AND position < 128 AS fresh
        FROM nb WHERE copy_no = 1 AND structural),
run AS (SELECT a.*, nd, nc, krx IS NOT NULL AND (rx_ns > krx OR (rx_ns = krx AND payload_hash >= kh)) AS known,
               count(*) FILTER (WHERE fresh) OVER (PARTITION BY provider, slot, fec_set_index
                   ORDER BY rx_ns, payload_hash ROWS UNBOUNDED PRECEDING) AS cum
        FROM acc a LEFT JOIN size USING (slot, fec_set_index)),
good AS (SELECT provider, slot, fec_set_index, min(rx_ns) AS first_ok, max(rx_ns) AS last_ok,
                min(rx_ns) FILTER (WHERE known AND cum >= nd) AS decode,
                count(*) FILTER (WHERE fresh) AS delivered FROM run GROUP BY ALL),
cnt AS (SELECT provider, slot, fec_set_index, count(*) AS received, count(*) FILTER (WHERE copy_no > 1) AS duplicated,
               count(*) FILTER (WHERE copy_no = 1 AND NOT structural) AS invalid FROM nb GROUP BY ALL),
st AS (SELECT c.*, first_ok, last_ok, decode, coalesce(delivered, 0) AS delivered,
              greatest(0, coalesce(nd + nc, coalesce(delivered, 0)) - coalesce(delivered, 0)) AS missed, set_sig_ok
       FROM cnt c LEFT JOIN good USING (provider, slot, fec_set_index)
       LEFT JOIN size USING (slot, fec_set_index) LEFT JOIN setsig USING (slot, fec_set_index)),
anch AS (SELECT *, coalesce(min(CASE WHEN provider = 'p0' THEN first_ok END) OVER w, min(first_ok) OVER w) AS af,
                coalesce(min(CASE WHEN provider = 'p0' THEN decode END) OVER w, min(decode) OVER w) AS ad,
                coalesce(min(CASE WHEN provider = 'p0' THEN last_ok END) OVER w, min(last_ok) OVER w) AS al
         FROM st WINDOW w AS (PARTITION BY slot, fec_set_index)),
stats AS (SELECT provider, slot, fec_set_index, first_ok - af AS fec_first_shred_delay_ns,
       decode - ad AS fec_decode_delay_ns, last_ok - al AS fec_last_shred_delay_ns,
       invalid AS invalid_shreds, missed AS missed_shreds, duplicated AS duplicated_shreds,
       invalid = 0 AND coalesce(set_sig_ok, false) AND decode IS NOT NULL AS is_valid
FROM anch WHERE af IS NOT NULL)"""

CHECKS["structural_validity"] = _LIVE + """
SELECT provider, structural, set_sig_ok, count(*) AS packets FROM sound LEFT JOIN setsig USING (slot, fec_set_index)
GROUP BY ALL"""
CHECKS["anchored_set_stats"] = _LIVE + " SELECT * FROM stats"
CHECKS["delay_histogram"] = _LIVE + """
SELECT provider, CAST(le AS VARCHAR) AS le, count(*) FILTER (WHERE fec_first_shred_delay_ns <= le) AS n
FROM stats CROSS JOIN (SELECT unnest([-100000000, -50000000, -20000000, -10000000, -5000000, -2000000, -1000000,
  -500000, -200000, 0, 200000, 500000, 1000000, 2000000, 5000000, 10000000, 20000000, 50000000, 100000000]) AS le)
GROUP BY provider, le
UNION ALL SELECT provider, '+Inf', count(fec_first_shred_delay_ns) FROM stats GROUP BY provider"""
CHECKS["provider_counters"] = _LIVE + """,
won AS (SELECT provider, count(*) AS sets_won FROM (
          SELECT *, row_number() OVER (PARTITION BY slot, fec_set_index ORDER BY first_ok, provider) AS rn
          FROM st WHERE first_ok IS NOT NULL) WHERE rn = 1 GROUP BY provider)
SELECT provider, CAST(sum(received) AS BIGINT) AS received, CAST(sum(invalid) AS BIGINT) AS invalid,
       CAST(sum(duplicated) AS BIGINT) AS duplicate, any_value(coalesce(sets_won, 0)) AS sets_won
FROM st LEFT JOIN won USING (provider) GROUP BY provider"""
CHECKS["slot_first_seen"] = _LIVE + """,
seen AS (SELECT slot, min(rx_ns) AS seen_ns FROM sound WHERE structural AND slot < 1099511627776 GROUP BY slot)
SELECT * FROM seen WHERE slot >= (SELECT max(slot) FROM seen) - 5000"""
CHECKS["kth_arrival"] = _SETS + """
SELECT provider, slot, fec_set_index, arrival AS third_ns FROM kth WHERE k = 3"""

# -- transactions ------------------------------------------------------------

_TX = check_ctes("txn_events") + """,
fs AS (SELECT signature, source, min(ns) AS ns FROM txn_events GROUP BY ALL),
raced AS (SELECT *, CASE WHEN count(*) OVER w >= 2 THEN ns - min(ns) OVER w END AS behind
          FROM fs WINDOW w AS (PARTITION BY signature))"""

CHECKS["txn_first_seen"] = _TX + " SELECT * FROM raced"
CHECKS["txn_race"] = _TX + """
SELECT source, count(*) AS seen, count(behind) AS contested, count(*) FILTER (WHERE behind = 0) AS wins,
       CAST(count(*) FILTER (WHERE behind = 0) AS DOUBLE) / count(behind) AS winrate,
       CAST(sum(behind) AS DOUBLE) / count(behind) / 1e3 AS behind_mean_us,
       (SELECT count(DISTINCT signature) FROM fs) AS distinct_signatures,
       (SELECT count(DISTINCT signature) FROM raced WHERE behind IS NOT NULL) AS contested_signatures
FROM raced GROUP BY source"""
CHECKS["txn_percentiles"] = _TX + """,
o AS (SELECT source, behind, row_number() OVER (PARTITION BY source ORDER BY behind) - 1 AS i,
             count(*) OVER (PARTITION BY source) AS n FROM raced WHERE behind IS NOT NULL)
SELECT source,
       max(behind) FILTER (WHERE i = CAST(floor(CAST(n - 1 AS DOUBLE) * CAST(0.5 AS DOUBLE)) AS BIGINT)) / 1e3 AS behind_p50_us,
       max(behind) FILTER (WHERE i = CAST(floor(CAST(n - 1 AS DOUBLE) * CAST(0.9 AS DOUBLE)) AS BIGINT)) / 1e3 AS behind_p90_us,
       max(behind) FILTER (WHERE i = CAST(floor(CAST(n - 1 AS DOUBLE) * CAST(0.99 AS DOUBLE)) AS BIGINT)) / 1e3 AS behind_p99_us
FROM o GROUP BY source"""

_RANGES = check_ctes("range_shreds", "transactions") + """,
idx AS (SELECT provider, slot, shred_index, min(rx_ns) AS rx_ns, bool_or(data_complete) AS fin
        FROM range_shreds GROUP BY ALL),
ends AS (SELECT provider, slot, shred_index AS range_end,
                coalesce(lag(shred_index) OVER (PARTITION BY provider, slot ORDER BY shred_index), -1) AS prev
         FROM idx WHERE fin),
done AS (SELECT e.provider, e.slot, prev + 1 AS range_start, range_end, count(*) AS packets, max(rx_ns) AS ready_ns
         FROM ends e JOIN idx i ON i.provider = e.provider AND i.slot = e.slot
                               AND i.shred_index > prev AND i.shred_index <= range_end
         GROUP BY ALL HAVING count(*) = range_end - prev)"""

CHECKS["completed_ranges"] = _RANGES + " SELECT * FROM done"
CHECKS["txn_readable_at"] = _RANGES + """
SELECT t.signature, t.slot, t.range_end_exclusive, d.provider, d.ready_ns
FROM transactions t JOIN done d ON d.slot = t.slot AND d.range_end = t.range_end_exclusive - 1"""

CHECKS["filtered_txns"] = check_ctes("transactions") + """
SELECT signature, slot FROM transactions
WHERE (list_contains(account_keys, 'acct-1') OR list_contains(account_keys, 'acct-2') OR list_contains(account_keys, 'acct-3'))
  AND NOT list_contains(account_keys, 'acct-7') AND NOT is_vote AND NOT failed"""
CHECKS["required_txns"] = check_ctes("transactions") + """
SELECT signature, slot FROM transactions
WHERE list_contains(account_keys, 'acct-5') AND list_contains(account_keys, 'acct-11')"""
CHECKS["watched_triggers"] = _RANGES + """
SELECT signature, slot AS trigger_slot, min(ready_ns) AS ready_ns
FROM transactions t JOIN done d USING (slot) WHERE range_end = range_end_exclusive - 1
  AND list_contains(account_keys, 'acct-4') GROUP BY ALL"""
CHECKS["throttled_triggers"] = check_ctes("txn_events").replace("WITH ", "WITH RECURSIVE ") + """,
start AS (SELECT source, min(ns) AS ns FROM txn_events WHERE ns >= 1704067200000000000 + 600000000000 GROUP BY source),
chain AS (SELECT source, ns FROM start
          UNION ALL
          SELECT e.source, min(e.ns) FROM chain c JOIN txn_events e
            ON e.source = c.source AND e.ns >= c.ns + 600000000000 GROUP BY e.source)
SELECT source, ns FROM chain"""
CHECKS["trigger_landing"] = """
WITH triggers AS (SELECT concat('tx-', o_orderkey) AS signature, o_orderkey AS trigger_slot, 0 AS sent_ns FROM orders),
landed AS (SELECT concat('tx-', l_orderkey) AS signature, max(l_orderkey + l_linenumber) AS landed_slot,
                  max(l_linenumber) * 10000000000 AS landed_ns, max(l_tax) = 0.08 AS failed
           FROM lineitem GROUP BY l_orderkey)
SELECT signature, trigger_slot, CASE WHEN NOT failed AND landed_ns <= 60000000000 THEN landed_slot END AS landed_slot,
       CASE WHEN NOT failed AND landed_ns <= 60000000000 THEN landed_slot - trigger_slot END AS distance
FROM triggers LEFT JOIN landed USING (signature)"""

# -- dimensions ----------------------------------------------------------------

CHECKS["schedule_explode"] = "SELECT o_orderkey AS slot, concat('val-', o_custkey % 60) AS leader FROM orders"

CHECKS["schedule_check"] = """
SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) * 1000 AS first_slot, 1000 AS slots_in_epoch, count(*) AS placed,
       count(*) = 1000 AS complete
FROM orders GROUP BY ALL"""

CHECKS["epoch_completeness"] = check_ctes("schedule") + """
SELECT CAST(floor(slot / 100) AS BIGINT) AS epoch, count(DISTINCT slot) AS placed, count(DISTINCT slot) = 100 AS complete
FROM schedule GROUP BY 1"""
CHECKS["leader_classify"] = check_ctes("arrivals", "schedule") + """
SELECT CASE WHEN slot * 400 < 68000 OR slot * 400 >= 1364000 THEN 'implausible'
            WHEN leader IS NOT NULL AND slot * 400 BETWEEN 500000 AND 931999 THEN 'leader'
            ELSE 'unknown' END AS slot_verdict, count(*) AS arrivals
FROM arrivals LEFT JOIN schedule USING (slot) GROUP BY 1"""

CHECKS["leader_window"] = check_ctes("schedule") + """
SELECT slot, leader FROM schedule WHERE slot BETWEEN 1700 AND 3500"""
CHECKS["leader_names"] = check_ctes("schedule") + """
SELECT DISTINCT leader, CASE WHEN c_acctbal > 0 THEN c_name END AS name
FROM schedule JOIN customer ON leader = concat('val-', c_custkey)"""

_RULES = check_ctes("providers") + """,
rules AS (SELECT CASE WHEN updated_at % 4 = 0 THEN concat('port-', updated_at) ELSE name END AS name,
                 CASE WHEN updated_at % 4 <> 0 THEN src_ip END AS ip,
                 CASE WHEN updated_at % 4 = 0 THEN 100 + updated_at % 10 WHEN updated_at % 3 = 0 THEN updated_at % 10 END AS port,
                 updated_at AS rule_order FROM providers),
traffic AS (SELECT concat('10.0.', s_nationkey, '.', s_suppkey) AS src_ip,
                   CASE WHEN l_linenumber < 4 THEN s_suppkey % 10 ELSE 100 + l_linenumber END AS dst_port
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
r1 AS (SELECT ip, port, arg_max(name, rule_order) AS n1 FROM rules WHERE ip IS NOT NULL AND port IS NOT NULL GROUP BY ALL),
r2 AS (SELECT port, arg_max(name, rule_order) AS n2 FROM rules WHERE ip IS NULL AND port IS NOT NULL GROUP BY ALL),
r3 AS (SELECT ip, arg_max(name, rule_order) AS n3 FROM rules WHERE ip IS NOT NULL AND port IS NULL GROUP BY ALL)"""
CHECKS["rule_match"] = _RULES + """
SELECT src_ip, dst_port, coalesce(n1, n2, n3) AS provider, count(*) AS datagrams FROM traffic
LEFT JOIN r1 ON r1.ip = src_ip AND r1.port = dst_port LEFT JOIN r2 ON r2.port = dst_port LEFT JOIN r3 ON r3.ip = src_ip
GROUP BY ALL"""
CHECKS["rule_violations"] = """
WITH p AS (SELECT concat('src-', s_suppkey % 90) AS name,
                  CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 20 END AS port, s_suppkey % 5 = 0 AS has_ips FROM supplier),
f AS (SELECT concat('feed-', c_custkey % 1400) AS name, CASE WHEN c_custkey % 100 = 0 THEN ' ' ELSE 'http://x' END AS url,
             CASE WHEN c_custkey % 50 = 1 THEN 'eventual' ELSE 'Processed' END AS commitment FROM customer)
SELECT 'duplicate name' AS rule, name AS subject FROM p GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'neither port nor ips', name FROM p WHERE port IS NULL AND NOT has_ips
UNION ALL SELECT 'port not listened on', name FROM p WHERE port IS NOT NULL AND port >= 15
UNION ALL SELECT 'empty url', name FROM f WHERE trim(url) = ''
UNION ALL SELECT 'duplicate feed name', name FROM f GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'invalid commitment', name FROM f WHERE lower(commitment) NOT IN ('processed', 'confirmed', 'finalized')"""
CHECKS["source_violations"] = """
WITH s AS (SELECT concat('src-', s_suppkey % 95) AS name, 9000 + s_suppkey % 80 AS udp_port, s_suppkey % 60 AS provider_id FROM supplier)
SELECT 'duplicate name' AS rule, name AS subject FROM s GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'duplicate port', CAST(udp_port AS VARCHAR) FROM s GROUP BY udp_port HAVING count(*) > 1
UNION ALL SELECT 'duplicate provider id', CAST(provider_id AS VARCHAR) FROM s WHERE provider_id <> 0 GROUP BY provider_id HAVING count(*) > 1
UNION ALL SELECT 'zero provider id', name FROM s WHERE provider_id = 0"""
CHECKS["latest_dimension"] = """
SELECT id, name, updated_at FROM (
  SELECT o_custkey AS id, o_orderpriority AS name, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS updated_at,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority DESC) AS rn FROM orders) WHERE rn = 1"""
CHECKS["latest_snapshot"] = """
WITH w AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders
           WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-08' AND DATE '1997-03-15')
SELECT o_orderkey, o_custkey FROM w WHERE day = (SELECT max(day) FROM w)"""
CHECKS["validator_dim"] = check_ctes("schedule") + """,
report AS (SELECT concat('val-', c_custkey) AS pubkey, CASE WHEN c_acctbal > 0 THEN c_name END AS name, c_mktsegment AS client_type, CAST(c_nationkey AS VARCHAR) AS version,
                  concat('dc-', c_nationkey) AS location, CAST(floor(abs(c_acctbal)) AS BIGINT) AS stake FROM customer),
gossip AS (SELECT concat('val-', s_suppkey) AS pubkey, CASE WHEN s_acctbal > 2000 THEN concat('10.0.', s_nationkey, '.', s_suppkey) END AS gossip_ip FROM supplier),
pings AS (SELECT concat('val-', s_suppkey) AS pubkey, CASE WHEN s_acctbal > 5000 THEN s_acctbal / 100 END AS ping_ms FROM supplier)
SELECT l.pubkey, name, client_type, version, location, stake, gossip_ip, ping_ms
FROM (SELECT DISTINCT leader AS pubkey FROM schedule) l LEFT JOIN report USING (pubkey) LEFT JOIN gossip USING (pubkey) LEFT JOIN pings USING (pubkey)"""
CHECKS["provider_pings"] = check_ctes("providers", "first_provider") + """,
obs AS (SELECT DISTINCT concat('src-', l_suppkey % 8) AS provider, concat('10.0.', s_nationkey, '.', s_suppkey) AS ip
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
ips AS (SELECT name AS provider, src_ip AS ip, 'configured' AS origin FROM providers GROUP BY ALL
        UNION ALL SELECT provider, ip, 'observed' FROM obs WHERE (provider, ip) NOT IN (SELECT (name, src_ip) FROM providers)),
samples AS (SELECT concat('10.0.', s_nationkey, '.', s_suppkey) AS ip, event_id AS checked_at_ns, value AS rtt_ms
            FROM events JOIN supplier ON s_suppkey = user_id),
latest AS (SELECT ip, arg_max(rtt_ms, checked_at_ns) AS rtt_ms, max(checked_at_ns) AS checked_at_ns FROM samples GROUP BY ip)
SELECT provider, ip, origin, rtt_ms, checked_at_ns FROM ips LEFT JOIN latest USING (ip)
UNION ALL SELECT concat('feed-', s_suppkey), concat('10.0.', s_nationkey, '.', s_suppkey), 'grpc', rtt_ms, checked_at_ns
FROM supplier LEFT JOIN latest ON ip = concat('10.0.', s_nationkey, '.', s_suppkey)"""
CHECKS["enriched_sources"] = """
WITH src AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN concat('fra-10.0.', s_nationkey, '.', s_suppkey)
                         WHEN s_suppkey % 3 = 1 THEN concat('src-', s_suppkey) ELSE concat('ny-', s_suppkey) END AS source, s_nationkey, s_acctbal FROM supplier),
ipd AS (SELECT source, CASE WHEN s_suppkey % 3 = 1 AND s_acctbal > 0 THEN concat('10.0.', s_nationkey, '.', s_suppkey)
                            WHEN s_suppkey % 3 = 0 THEN concat('10.0.', s_nationkey, '.', s_suppkey) ELSE '' END AS src_ip FROM src),
asn AS (SELECT concat('10.0.', s_nationkey, '.', s_suppkey) AS ip, n_name AS org,
               CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE concat('city', s_suppkey) END AS city, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE r_name END AS country
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal < 8000)
SELECT source, src_ip, coalesce(org, '') AS asn_dc,
       coalesce(trim(concat(city, ', ', country), ', '), '') AS dc_location FROM ipd LEFT JOIN asn ON ip = src_ip"""

# -- files -----------------------------------------------------------------------

CHECKS["validator_report"] = """
SELECT concat(repeat('1', 32), c_custkey % 10) AS leader, concat('Acme, "Inc" ', c_custkey) AS name
FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 10 <> 0"""
CHECKS["name_ip_map"] = """
SELECT concat('src-', s_suppkey) AS name, concat('10.0.', s_nationkey, '.', s_suppkey) AS ip FROM supplier"""
CHECKS["replaced_epochs"] = check_ctes("schedule") + """
SELECT slot, CASE WHEN slot >= 1000 THEN concat('new-', leader) ELSE leader END AS leader
FROM schedule"""
CHECKS["set_stats_table"] = _LIVE + """
SELECT provider, count(*) AS sets, CAST(sum(missed_shreds) AS BIGINT) AS missed, count(*) FILTER (WHERE is_valid) AS valid
FROM stats GROUP BY provider"""
CHECKS["trend_report"] = _TREND + " SELECT day, hub, source, samples FROM trend"

# -- text and numbers ------------------------------------------------------------

_BRANDS = """CASE WHEN lower(source) LIKE 'everstake%' THEN 'everstake' WHEN lower(source) LIKE 'lucky%' THEN 'lucky-stake'
  WHEN lower(source) LIKE 'twinstake%' THEN 'twinstake' WHEN lower(source) LIKE 'jupiter%' THEN 'jupiter'
  WHEN lower(source) LIKE 'thor%' THEN 'thor' WHEN lower(source) LIKE 'dawn%' THEN 'dawn-labs'
  WHEN lower(source) LIKE 'assymetric%' OR lower(source) LIKE 'asymmetric%' THEN 'asymmetric'
  WHEN lower(source) LIKE 'staking-fac%' THEN 'staking-facilities' WHEN lower(source) LIKE 'p2p%' THEN 'p2p.org'
  WHEN lower(source) LIKE 'jito%' THEN 'jito' WHEN lower(source) LIKE 'soyas%' THEN 'soyas'
  WHEN lower(source) LIKE 'soldiver%' THEN 'soldiver' ELSE 'other' END"""
NAMED_SOURCE = """CASE l_suppkey % 10 WHEN 0 THEN 'Jito-fra' WHEN 1 THEN 'everstake-1' WHEN 2 THEN 'Assymetric-ny'
  WHEN 3 THEN 'asymmetric-2' WHEN 4 THEN 'dawn' WHEN 5 THEN 'P2P-7' WHEN 6 THEN 'staking-fac-fra' WHEN 7 THEN 'thor'
  WHEN 8 THEN 'my-lucky' ELSE concat('src-', l_suppkey) END"""
CHECKS["brand_arrivals"] = f"""
WITH s AS (SELECT {NAMED_SOURCE} AS source, l_linestatus AS hub FROM lineitem)
SELECT CASE hub WHEN 'F' THEN 'fra (F)' ELSE hub END AS hub, {_BRANDS} AS brand, count(*) AS arrivals FROM s GROUP BY ALL"""
CHECKS["report_brands"] = f"""
WITH s AS (SELECT DISTINCT {NAMED_SOURCE} AS source FROM lineitem)
SELECT DISTINCT {_BRANDS} AS brand FROM s WHERE {_BRANDS} NOT IN ('other', 'jito')"""
CHECKS["per_brand_panel"] = f"""
WITH s AS (SELECT {NAMED_SOURCE} AS source, l_linestatus AS hub, l_quantity FROM lineitem),
p AS (SELECT hub, source, count(*) AS samples FROM s GROUP BY ALL)
SELECT {_BRANDS} AS brand, hub, source, samples FROM p WHERE {_BRANDS} NOT IN ('other', 'jito')"""
CHECKS["page_hosts"] = r"""
SELECT page_id, nullif(trim(regexp_replace(regexp_extract(regexp_replace(url, '^.*://', ''), '^[^/?]*'), '^(.+):[0-9]*$', '\1')), '') AS host
FROM pages"""
CHECKS["gossip_addresses"] = """
SELECT s_suppkey, concat('10.0.', s_nationkey, '.', s_suppkey) AS ip FROM supplier"""
CHECKS["ping_times"] = """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS avg_ms,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS probe_ms FROM events"""
CHECKS["lenient_numbers"] = """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(trunc(value) AS BIGINT) END AS n FROM events"""

# -- packets, quality ------------------------------------------------------------

CHECKS["packet_parse"] = check_ctes("shreds") + """
SELECT provider, rx_ns, slot, fec_set_index, shred_index, is_code, position, num_data, num_coding,
       NOT is_code AND last_in_slot AS last_in_slot,
       NOT is_code AND (data_complete OR last_in_slot) AS data_complete, version
FROM shreds"""

CHECKS["packet_verdicts"] = check_ctes("shreds", "schedule") + """
SELECT CASE WHEN position = 6 AND is_code THEN 'malformed' WHEN position = 6 AND data_hash LIKE 'a%' THEN 'ping'
            WHEN position = 6 THEN 'malformed' WHEN version <> 1 THEN 'wrong_version'
            WHEN data_hash LIKE '0%' THEN 'unsupported' WHEN data_hash LIKE '1%' THEN 'malformed'
            WHEN leader IS NULL THEN 'no_leader' ELSE 'parsed' END AS verdict, count(*) AS packets
FROM shreds LEFT JOIN schedule USING (slot) GROUP BY 1"""

CHECKS["verified_signatures"] = check_ctes("shreds", "schedule") + """
SELECT sig_ok, count(*) AS packets FROM (
  SELECT CASE WHEN root IS NULL OR leader IS NULL THEN NULL
              ELSE substr(md5(concat(sh.slot, '|', fec_set_index)), 1, 1) <> '0' END AS sig_ok
  FROM shreds sh LEFT JOIN schedule s ON s.slot = sh.slot) GROUP BY ALL"""
CHECKS["quality_notes"] = _SETS + """,
c AS (SELECT CAST(sum(invalid_sig) AS BIGINT) AS invalid_sig, CAST(sum(invalid_data) AS BIGINT) AS invalid_data,
             CAST(sum(invalid_unknown) AS BIGINT) AS invalid_unknown FROM rows_)
SELECT 'invalid_data' AS counter, invalid_data AS value FROM c WHERE invalid_data > 0
UNION ALL SELECT 'invalid_sig', invalid_sig FROM c WHERE invalid_sig > 0
UNION ALL SELECT 'invalid_unknown', invalid_unknown FROM c WHERE invalid_unknown > 0
UNION ALL SELECT 'shreds_no_leader', n FROM (SELECT count(*) AS n FROM shreds sh
  LEFT JOIN (""" + check_view("schedule") + """) s ON s.slot = sh.slot WHERE s.leader IS NULL) WHERE n > 0"""
CHECKS["socket_losses"] = """
WITH r AS (SELECT event_type AS socket, epoch_us(ts) AS at_us, (event_id * 1000003) % 4294967296 AS reading FROM events),
d AS (SELECT *, coalesce(lag(reading) OVER (PARTITION BY socket ORDER BY at_us, reading), 0) AS prev FROM r)
SELECT socket, count(*) AS readings, CAST(sum(((reading - prev) % 4294967296 + 4294967296) % 4294967296) AS BIGINT) AS dropped
FROM d GROUP BY socket"""
CHECKS["manifest"] = _SETS + """
SELECT count(*) AS rows_fec_sets, min(slot) AS min_slot, max(slot) AS max_slot,
       CAST(sum(invalid_sig) AS BIGINT) AS invalid_sig, CAST(sum(invalid_data) AS BIGINT) AS invalid_data,
       CAST(sum(invalid_unknown) AS BIGINT) AS invalid_unknown, 3 AS notes FROM rows_"""

# -- streams, after they have drained ---------------------------------------------

CHECKS["stream_set_rows"] = CHECKS["set_rows"]
_SHREDS = check_view("shreds")
# Every failing packet once more, a million slots ahead.
CHECKS["stream_forged_slots"] = _SETS.replace(_SHREDS, f"""
  SELECT * FROM ({_SHREDS}) UNION ALL
  SELECT * REPLACE (slot + 1000000 AS slot) FROM ({_SHREDS}) WHERE NOT merkle_ok OR sig_ok IS FALSE""") + """
SELECT * EXCLUDE (leader) FROM rows_"""
CHECKS["stream_late_packets"] = check_ctes("shreds") + """,
ends AS (SELECT min(slot) AS low, max(slot) AS high FROM shreds),
dealt AS (SELECT shreds.*, CASE WHEN rx_ns % 50 = 0 THEN 2 ELSE floor((slot - low) * 3 / (high - low + 1)) END AS part
          FROM shreds, ends)
SELECT count(*) AS late FROM dealt
WHERE part = 2 AND slot <= (SELECT max(slot) FROM dealt WHERE part < 2 AND merkle_ok AND sig_ok) - 10"""
CHECKS["stream_txn_race"] = CHECKS["txn_race"]
CHECKS["stream_eager_ranges"] = CHECKS["completed_ranges"]
CHECKS["stream_scoreboard"] = CHECKS["contested_scoreboard"]
CHECKS["stream_throttle"] = CHECKS["throttled_triggers"]
CHECKS["stream_leaders"] = check_ctes("shreds", "schedule") + """
SELECT provider, leader, count(*) AS packets FROM shreds LEFT JOIN schedule USING (slot) GROUP BY ALL"""
