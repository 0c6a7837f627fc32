"""Explicit schemas of the tables that sources read and sinks write; nothing is inferred."""

from __future__ import annotations

CHUNKS = "chunk_id string, doc_id string, text string, source_path string, token_count int, section string, page_number int, chunk_index int, embedding array<float>"
DOCUMENTS = "doc_id string, source_path string, doc_type string, title string, page_count int, chunk_count int"
SNAPSHOT = "snapshot_id string, timestamp string, model string, doc_count bigint, chunk_count bigint, doc_hashes map<string,string>"
MESSAGES = "messages array<struct<role:string,content:string>>, metadata map<string,string>"
CACHE = "hash string, v array<float>"
DRAFTS = "id bigint, project_id string, section string, version int, content string, citations string, parent_id bigint, created_at timestamp"
JOBS = "job_id string, project_id string, job_type string, status string, progress int, created_at timestamp"
SYMBOLS = "path string, language string, name string, type string, start_line int, end_line int, complexity double, score double"
