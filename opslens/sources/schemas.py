"""Declared columns and types of every landed view (DDL; fleet key first).

Readers pass these instead of letting types come from the files.
"""

SCHEMAS = {
    "instances": (
        "server_name string, snapshot_id int, machine_name string, instance_name string, edition string, "
        "product_version string, product_level string, collation string, is_clustered boolean, is_hadr_enabled boolean, "
        "virtual_machine_type string, cpu_count bigint, hyperthread_ratio bigint, visible_cpus bigint, "
        "physical_memory_kb bigint, max_server_memory_mb bigint, memory_model bigint, sqlserver_start_time "
        "timestamp_ntz, is_fulltext_installed boolean, time_zone string, default_data_path string, default_log_path "
        "string, is_resource_governor_enabled boolean, engine_edition int, is_rds boolean"
    ),
    "packages": (
        "server_name string, snapshot_id int, name string, owner_name string"
    ),
    "schedulers": (
        "server_name string, snapshot_id int, cpu_id bigint, status string"
    ),
    "config": (
        "server_name string, snapshot_id int, name string, value bigint, value_in_use bigint"
    ),
    "databases": (
        "server_name string, snapshot_id int, database_id bigint, name string, recovery_model int, recovery_model_desc "
        "string, state int, state_desc string, compatibility_level int, is_encrypted boolean, is_auto_close_on boolean, "
        "is_auto_shrink_on boolean, is_auto_update_stats_on boolean, is_auto_create_stats_on boolean, "
        "is_auto_update_stats_async_on boolean, is_parameterization_forced boolean, snapshot_isolation_state_desc "
        "string, is_read_committed_snapshot_on boolean, is_read_only boolean, user_access int, is_cdc_enabled boolean, "
        "is_broker_enabled boolean, is_published boolean, is_merge_published boolean, is_subscribed boolean, "
        "is_distributor boolean, has_replication_objects boolean, log_reuse_wait_desc string, page_verify_option_desc string, "
        "source_database_id int, owner_name string, collation_name string"
    ),
    "master_files": (
        "server_name string, snapshot_id int, database_id bigint, database_name string, file_id bigint, name string, "
        "type int, size bigint, space_used bigint, growth int, is_percent_growth boolean, max_size int, physical_name "
        "string, volume_mount_point string, state_desc string"
    ),
    "volumes": (
        "server_name string, snapshot_id int, database_id bigint, file_id bigint, volume_mount_point string"
    ),
    "trace_events": (
        "server_name string, snapshot_id int, trace_event_id int, event_name string"
    ),
    "io_file_stats": (
        "server_name string, snapshot_id int, database_id bigint, file_id bigint, num_of_reads bigint, num_of_writes "
        "bigint, num_of_bytes_read bigint, num_of_bytes_written bigint, io_stall_read_ms bigint, io_stall_write_ms "
        "bigint, io_stall bigint"
    ),
    "backupset": (
        "server_name string, snapshot_id int, database_name string, media_set_id bigint, name string, type string, "
        "recovery_model string, backup_start_date timestamp_ntz, backup_finish_date timestamp_ntz"
    ),
    "backupmediafamily": (
        "server_name string, snapshot_id int, media_set_id bigint, family_sequence_number int, logical_device_name "
        "string, physical_device_name string"
    ),
    "processes": (
        "server_name string, snapshot_id int, spid bigint, kpid bigint, blocked bigint, dbid bigint, status string, "
        "command string, loginame string, hostname string, open_tran bigint, waittype string, waittime bigint, "
        "last_batch timestamp_ntz, login_time timestamp_ntz, cpu bigint, physical_io bigint, wait_type string, "
        "percent_complete bigint, start_time timestamp_ntz, estimated_completion_time bigint, sql_handle bigint, "
        "statement_start_offset bigint, statement_end_offset int, isolation_level bigint, wait_resource string, "
        "nt_username string, hostprocess string, memusage bigint, program_name string"
    ),
    "sql_text": (
        "server_name string, snapshot_id int, sql_handle bigint, object_id bigint, text string"
    ),
    "trace_log": (
        "server_name string, snapshot_id int, event_class bigint, database_name string, file_name string, "
        "application_name string, host_name string, login_name string, start_time timestamp_ntz, end_time "
        "timestamp_ntz, duration_us bigint, integer_data bigint"
    ),
    "xe_events": (
        "server_name string, snapshot_id int, object_name string, event_data string"
    ),
    "wait_stats": (
        "server_name string, snapshot_id int, wait_idx bigint, wait_type string, waiting_tasks_count bigint, "
        "wait_time_ms bigint, signal_wait_time_ms bigint"
    ),
    "log_info": (
        "server_name string, snapshot_id int, database_name string, start_offset bigint"
    ),
    "dbinfo": (
        "server_name string, snapshot_id int, database_name string, field string, value timestamp_ntz"
    ),
    "indexes": (
        "server_name string, snapshot_id int, database_name string, object_id bigint, index_id int, name string, "
        "is_unique boolean, is_primary_key boolean, is_unique_constraint boolean, is_hypothetical boolean, fill_factor "
        "int, type_desc string"
    ),
    "index_keys": (
        "server_name string, snapshot_id int, database_name string, object_id bigint, index_id int, colid bigint, keyno "
        "bigint, column_name string"
    ),
    "index_usage": (
        "server_name string, snapshot_id int, database_name string, object_id bigint, index_id int, user_seeks bigint, "
        "user_scans bigint, user_lookups bigint, user_updates bigint"
    ),
    "index_physical": (
        "server_name string, snapshot_id int, database_name string, object_id bigint, index_id int, index_type_desc "
        "string, page_count bigint, alloc_unit_type_desc string, index_depth int, fragmentation_pct double, "
        "fragment_count bigint, avg_fragment_size_in_pages double, avg_page_space_used_pct double, record_count bigint, "
        "compressed_page_count bigint"
    ),
    "statistics": (
        "server_name string, snapshot_id int, database_name string, object_id bigint, name string, updated "
        "timestamp_ntz"
    ),
    "missing_index_groups": (
        "server_name string, snapshot_id int, index_group_handle bigint, index_handle bigint"
    ),
    "missing_index_group_stats": (
        "server_name string, snapshot_id int, group_handle bigint, avg_total_user_cost double, avg_user_impact double, "
        "user_seeks bigint, user_scans bigint, last_user_seek timestamp_ntz"
    ),
    "missing_index_details": (
        "server_name string, snapshot_id int, index_handle bigint, database_id bigint, object_id bigint, object_name "
        "string, statement string, equality_columns string, inequality_columns string, included_columns string"
    ),
    "cached_plans": (
        "server_name string, snapshot_id int, plan_handle bigint, usecounts bigint, objtype string, db_name string, "
        "schema_name string, proc_name string, query_plan string"
    ),
    "query_stats": (
        "server_name string, snapshot_id int, plan_handle bigint, total_worker_time bigint, total_physical_reads "
        "bigint, total_logical_reads bigint, total_logical_writes bigint, total_elapsed_time bigint"
    ),
    "principals": (
        "server_name string, snapshot_id int, database_name string, principal_id bigint, name string, type string, sid "
        "bigint, is_fixed_role boolean, owning_principal_id bigint, default_schema_name string"
    ),
    "logins": (
        "server_name string, snapshot_id int, sid bigint, name string"
    ),
    "server_principals": (
        "server_name string, snapshot_id int, name string, sid bigint, type string, principal_id bigint"
    ),
    "role_members": (
        "server_name string, snapshot_id int, database_name string, role_principal_id bigint, member_principal_id "
        "bigint"
    ),
    "permissions": (
        "server_name string, snapshot_id int, database_name string, grantee_principal_id bigint, grantor_principal_id "
        "bigint, class int, major_id bigint, type string, state string, permission_name string"
    ),
    "objects": (
        "server_name string, snapshot_id int, database_name string, object_id bigint, schema_id int, name string, type "
        "string, is_ms_shipped boolean, parent_object_id bigint"
    ),
    "schemas": (
        "server_name string, snapshot_id int, database_name string, schema_id bigint, name string, principal_id bigint"
    ),
    "protects": (
        "server_name string, snapshot_id int, database_name string, id bigint, uid bigint, action int, protecttype int"
    ),
    "jobs": (
        "server_name string, snapshot_id int, job_id bigint, job_hex string, name string, enabled int, owner_name "
        "string"
    ),
    "job_steps": (
        "server_name string, snapshot_id int, job_id bigint, step_id int, step_name string, retry_attempts bigint, "
        "retry_interval int"
    ),
    "modules": (
        "server_name string, snapshot_id int, name string"
    ),
    "replica_states": (
        "server_name string, snapshot_id int, group_id int, replica_id bigint, database_id bigint, "
        "synchronization_state_desc string, synchronization_health_desc string, is_primary_replica boolean, is_local "
        "boolean, is_commit_participant boolean, database_state_desc string, is_suspended boolean, suspend_reason_desc "
        "string"
    ),
    "availability_groups": (
        "server_name string, snapshot_id int, group_id int, group_name string, synchronization_health_desc string, "
        "primary_replica string"
    ),
    "replicas": (
        "server_name string, snapshot_id int, replica_id bigint, replica_server_name string, availability_mode_desc "
        "string"
    ),
    "trace_flags": (
        "server_name string, snapshot_id int, trace_flag string, is_global boolean"
    ),
    "sku_features": (
        "server_name string, snapshot_id int, database_name string, feature_name string"
    ),
    "services": (
        "server_name string, snapshot_id int, servicename string, service_account string, "
        "instant_file_initialization_enabled string"
    ),
    "certificates": (
        "server_name string, snapshot_id int, database_name string, certificate_id bigint, name string, issuer_name "
        "string, expiry_date timestamp_ntz, sid bigint, thumbprint bigint"
    ),
    "requests": (
        "server_name string, snapshot_id int, spid bigint, kpid bigint, blocked bigint, dbid bigint, status string, "
        "command string, loginame string, hostname string, open_tran bigint, waittype string, waittime bigint, "
        "last_batch timestamp_ntz, login_time timestamp_ntz, cpu bigint, physical_io bigint, wait_type string, "
        "percent_complete bigint, start_time timestamp_ntz, estimated_completion_time bigint, sql_handle bigint, "
        "statement_start_offset bigint, statement_end_offset int, isolation_level bigint, wait_resource string, "
        "nt_username string, hostprocess string, memusage bigint, program_name string"
    ),
    "sessions": (
        "server_name string, snapshot_id int, session_id bigint, status string, loginame string, "
        "last_request_start_time timestamp_ntz, last_request_end_time timestamp_ntz, reads bigint, writes bigint, "
        "logical_reads bigint, lock_timeout int, row_count bigint, login_time timestamp_ntz, host_name string, "
        "program_name string"
    ),
    "server_objects": (
        "server_name string, snapshot_id int, object_class string, object_id bigint, name string, value string, "
        "is_remote boolean, is_auto_executed boolean, is_system boolean, mirroring_guid string"
    ),
    "encryption_keys": (
        "server_name string, snapshot_id int, database_id bigint, encryptor_thumbprint bigint, encryption_state bigint"
    ),
}
