"""The 21 tables of the data model as DDL strings (SCOPED adds the columns that scoped tables share)."""

from __future__ import annotations

from pyspark.sql import types as T

SCOPED = "dataset_group_id string, reset_epoch string, id string, created_at timestamp_ntz"
SNAPSHOT = "struct<size_bytes:bigint,modified_ns:bigint,file_identity:struct<device:bigint,inode:bigint>>"
MODALITIES = ("dino", "videomae", "beats", "egemaps")

_scoped = {
    "asset": "label int, label_revision int, label_event_id string, label_updated_at timestamp_ntz",
    "config_revision": "signature string, active_slot string, status string, snapshot string",
    "observation": f"config_revision_id string, path_key string, path string, role string, snapshot {SNAPSHOT}, stable_since timestamp_ntz",
    "variant": "asset_id string, sha256 string, size_bytes bigint, source_variant_id string",
    "scan_run": "config_revision_id string, complete boolean, role_results map<string,boolean>, lineage_watermark bigint",
    "location": "variant_id string, role string, path string, current_path_key string, status string, size_bytes bigint, modified_ns bigint, missing_since timestamp_ntz",
    "feature_bundle": "variant_id string, feature_signature string, status string, duration_seconds double, modality_validity map<string,double>, audio_status string",
    "feedback_event": "event_key string, asset_id string, label int, expected_revision int, resulting_revision int, evidence string",
    "task": "dedup_key string, kind string, status string, asset_id string, variant_id string, config_revision_id string, input_snapshot string, attempts int, error_code string, claim_token string, claimed_at timestamp_ntz, finished_at timestamp_ntz",
    "model_run": "active_slot string, status string, model_type string, threshold double, dataset_snapshot array<struct<asset_id:string,label:int,revision:int>>, validation string",
    "prediction": "batch_id string, model_run_id string, variant_id string, asset_id string, score double, predicted int, threshold double",
    "prediction_outcome": "prediction_id string, feedback_event_id string, actual int, correct boolean",
    "transfer_operation": "task_id string, status string, source_path string, destination_path string, source_sha256 string, destination_sha256 string",
}
_plain = {
    "dataset_group": "id string, name string, reset_epoch string, enabled boolean, lineage_floor bigint",
    "runtime_state": "id int, state string, updated_at timestamp_ntz",
    "workflow_binding": "id string, workflow string, source_dir string, destination_dir string, signature string",
    "resource_lease": "id string, owner string, device string, mode string, status string, memory_budget_mib bigint, memory_observation string, created_at timestamp_ntz",
    "lineage_event": "id bigint, operation_id string, sequence int, phase string, producer string, generation string, source_sha256 string, destination_sha256 string, source_path string, destination_path string, evidence string",
    "video_compression_mission": "id bigint, source_path string, status string, attempts int, error_message string, size_bytes bigint, modified_ns bigint",
    "image_compression_mission": "id bigint, source_path string, source_kind string, status string, output_name string, attempts int, error_code string, size_bytes bigint",
    "download_mission": "id bigint, page_url string, file_url string, file_name string, user_name string, title string, status int",
}
#: Window fact: one row per (bundle, window, modality).
WINDOWS = "bundle_id string, window int, start_s double, end_s double, modality string, vector array<float>, valid array<boolean>"
TABLES: dict[str, str] = {n: f"{SCOPED}, {d}" for n, d in _scoped.items()} | _plain


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(TABLES[table])
