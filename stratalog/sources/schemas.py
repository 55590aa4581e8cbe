"""Explicit schemas of all inputs. Nothing is inferred."""

from __future__ import annotations

COMMAND = "idx long, term long, type string, client_id long, seq long, op string, key binary, value binary"
VERSION = "key binary, seq long, value binary, tombstone boolean"
RUN_ROW = VERSION + ", file string, tier int"
MANIFEST_EDIT = (
    "ord long, added array<struct<tier:int,file:string,min_key:binary,max_key:binary,count:long>>, "
    "removed array<string>, flushed_index long"
)
WAL_RECORD = (
    "segment int, ord long, kind string, term long, voted_for long, from_index long, "
    "entries array<struct<index:long,term:long,type:string,data:binary>>, terminated boolean"
)
OPERATION = (
    "id long, client_id long, seq long, invoke_time long, return_time long, op string, key string, "
    "in_value string, ok boolean, unknown boolean, out_value string, found boolean"
)
FAULT_SCHEDULE = (
    "Version int, "
    "Crashes array<struct<Node:long,Save:long,Point:int,RetainUnsynced:int,RestartAfterCrash:boolean>>, "
    "Events array<struct<Time:long,Kind:int,Node:long,From:long,To:long,Groups:array<array<long>>,"
    "Rate:double,Multiplier:double>>, "
    "LSMCrashes array<struct<Node:long,Op:string,Occurrence:long,Point:int,RetainUnsynced:int,"
    "RestartAfterCrash:boolean>>"
)
CORPUS_MANIFEST = (
    "artifact_version int, generator_version int, "
    "scripted array<struct<name:string,seed:long,schedule:string>>, "
    "pinned struct<name:string,seed:long,schedule:string>"
)
WRITE_ROW = "trial int, seed int, flush_threshold_bytes int, operations int, elapsed_ns long"
POINT_READ_ROW = (
    "trial int, seed int, sstable_count int, bloom_enabled boolean, lookup_kind string, operations int, "
    "elapsed_ns long, p50_ns long, p95_ns long, p99_ns long, max_ns long, found long, not_found long, "
    "sstable_read_calls long, sstable_read_bytes long"
)
BLOOM_ROW = (
    "trial int, seed int, inserted_keys int, probe_keys int, m_bits long, k long, false_positives long, "
    "false_negatives long"
)
AMPLIFICATION_ROW = (
    "trial int, seed int, operations int, puts int, deletes int, logical_user_write_bytes long, "
    "sstable_write_bytes long, manifest_write_bytes long, read_operations int, sstable_read_calls long, "
    "sstable_read_bytes long, logical_live_bytes long, referenced_sstable_bytes long, compactions int"
)
PAUSE_ROW = (
    "trial int, seed int, operations int, compaction_operations int, ordinary_operations int, "
    "compaction_p50_ns long, compaction_p95_ns long, compaction_p99_ns long, compaction_max_ns long, "
    "ordinary_p50_ns long, ordinary_p95_ns long, ordinary_p99_ns long, ordinary_max_ns long"
)
SKIPLIST_ROW = "trial int, seed int, samples int, height_counts array<long>"
