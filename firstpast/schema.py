"""Fixed schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    # One row per arrival of a source at a hub; delta_ns is relative to the
    # hub's baseline source and NULL where the expected source never arrived.
    "arrivals": """t TIMESTAMP, hub STRING, slot BIGINT, fec_set_index BIGINT,
        source STRING, delta_ns BIGINT, signature STRING""",
    "first_provider": "hub STRING, src_ip STRING, t TIMESTAMP",
    "providers": "src_ip STRING, name STRING, tier STRING",
    "datagrams": "provider STRING, rx_ns BIGINT, payload BINARY",
    "shreds": """provider STRING, rx_ns BIGINT, slot BIGINT, fec_set_index BIGINT,
        shred_index BIGINT, is_code BOOLEAN, position BIGINT, last_in_slot BOOLEAN,
        data_complete BOOLEAN, num_data BIGINT, num_coding BIGINT, leader STRING,
        sig_ok BOOLEAN, merkle_ok BOOLEAN, payload_hash STRING, data_hash STRING""",
    "shred_dump": """provider STRING, slot BIGINT, fec_set_index BIGINT,
        shred_index BIGINT, is_code BOOLEAN, rx_unix_ns BIGINT, sig_ok BOOLEAN,
        merkle_ok BOOLEAN, leader STRING, data_hash STRING""",
    "fec_sets": """provider STRING, slot BIGINT, fec_set_index BIGINT, leader STRING,
        first_ns BIGINT, decode_ns BIGINT, last_ns BIGINT, n_data BIGINT,
        n_code BIGINT, expected_total BIGINT, missed BIGINT, invalid BIGINT,
        invalid_sig BIGINT, invalid_data BIGINT, invalid_unknown BIGINT,
        duplicated BIGINT, sig_unverifiable BIGINT, is_valid BOOLEAN,
        last_in_slot BOOLEAN""",
    "fec_stats": """provider STRING, slot BIGINT, fec_set_index BIGINT,
        fec_first_shred_delay_ns BIGINT, fec_decode_delay_ns BIGINT,
        fec_last_shred_delay_ns BIGINT, invalid_shreds BIGINT, missed_shreds BIGINT,
        duplicated_shreds BIGINT, is_valid BOOLEAN""",
    "leader_schedule": "slot BIGINT, leader STRING",
    "slot_timings": "slot BIGINT, seen_at TIMESTAMP",
    "validators": """pubkey STRING, name STRING, client_type STRING, version STRING,
        location STRING, stake DECIMAL(20,0), gossip_ip STRING, ping_ms DOUBLE,
        updated_at TIMESTAMP""",
    "provider_names": "id BIGINT, name STRING, updated_at TIMESTAMP",
    "txn_events": "source STRING, signature STRING, ns BIGINT, slot BIGINT",
    "transactions": """signature STRING, is_vote BOOLEAN, failed BOOLEAN,
        account_keys ARRAY<STRING>, slot BIGINT, txn_index BIGINT,
        range_start BIGINT, range_end_exclusive BIGINT""",
    "schedule_response": "first_slot BIGINT, slots_in_epoch BIGINT, leaders MAP<STRING, ARRAY<BIGINT>>",
}


def of(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])


def columns(table: str) -> list[str]:
    return of(table).names
