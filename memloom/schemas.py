"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

TABLES = {
    "drawers": "id string, wing string, room string, content string, fts_text string, content_hash string, source string, source_mtime bigint, "
    "importance double, drawer_type string, mined_at timestamp, valid_from timestamp, valid_to timestamp, embedding array<float>, "
    "is_representative boolean, last_accessed_at timestamp, access_count int, cluster_id int, cluster_d_bar double, cluster_d_eff double",
    "entities": "id string, name string, canonical_name string, type string, properties string",
    "triples": "id string, subject string, predicate string, object string, valid_from date, valid_to date, confidence double, source_room string, "
    "source_file string, drawer_id string, source_ref string",
    "tunnels": "id string, topic string, wing_a string, room_a string, wing_b string, room_b string, created_at timestamp",
    "closets": "id string, drawer_id string, wing string, room string, aaak_text string, created_at timestamp",
    "task_memories": "id string, wing string, when_to_use string, content string, score double, author string, keywords array<string>, "
    "tools_used array<string>, source string, retrieval_count int, utility_count int, embedding array<float>, time_created timestamp, "
    "time_modified timestamp, last_used_at timestamp",
    "tool_memories": "wing string, tool_name string, guidelines string, updated_at timestamp",
    "tool_call_history": "id string, wing string, tool_name string, input_json string, output_json string, success boolean, score double, "
    "summary string, token_cost int, time_seconds double, is_summarized boolean, called_at timestamp",
    "drawer_tokens": "drawer_id string, token_type string, token_value string",
    "wiki_pages": "path string, wing string, title string, content string, citations array<string>, backlinks array<string>, updated_at timestamp, "
    "updated_by string, embedding array<float>, quality_score double",
    "wiki_log": "id string, ts timestamp, path string, action string, agent string, note string",
    "wiki_backlinks": "source string, target string",
    "wiki_pending_updates": "id string, wing string, page_path string, drawer_id string, similarity double, queued_at timestamp, resolved_at timestamp, resolution string",
    "activity_log": "id string, ts timestamp, wing string, action string, target string, agent string, summary string",
    "room_classification_log": "id string, path string, room string, classified_at timestamp",
    "episodes": "id string, wing string, goal string, outcome string, next_time string, drawer_refs string, skill_refs string, embedding array<float>, created_at timestamp",
    "skills": "id string, wing string, name string, description string, folder_path string, skill_md_mtime bigint, embedding array<float>, success_count int, fail_count int",
    "reflection_drafts": "id string, wing string, question string, answer string, citations string, status string, created_at timestamp",
}
