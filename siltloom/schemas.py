"""Schemas of the engine's tables."""

from __future__ import annotations

ATTACHMENT = "struct<url: string, filename: string, file_type: string, local_path: string, content_text: string, size_bytes: bigint>"
RAW_NEWS = f"source_id string, type_id string, url string, title string, category string, content_html string, content_text string, attachments array<{ATTACHMENT}>, published_at string, crawled_at string, metadata map<string, string>"
INDEX_RECORD = "struct<checksum: string, local_path: string, size_bytes: bigint, file_type: string, urls: array<string>, referenced_by: array<string>, first_source_id: string, downloaded_at: string>"
LOG_RECORD = "struct<status: string, file: string, reason: string, size: bigint, source_id: string, category: string, title: string>"
DOWNLOAD_LOG = f"sharepoint map<string, {LOG_RECORD}>, google_drive map<string, {LOG_RECORD}>"
LINK = "struct<source_id: string, category: string, title: string>"
LINKS_MANIFEST = f"sharepoint map<string, {LINK}>, google_drive map<string, {LINK}>"
DOCUMENT = "doc_id string, kind string, title string, content string, source_url string, category string, source_id string, referenced_by array<string>, metadata map<string, string>, cleaned_at string"
QUEUE = "id bigint, url string, depth int, type_id string, payload string"
VISITED = "url_hash string, url string"
NEWS_TYPES = "type_id string, name string, url string"
