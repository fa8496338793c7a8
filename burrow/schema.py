"""Schemas of the index tables."""

from __future__ import annotations

PARAMETERS = "array<struct<name:string,type:string>>"
TABLES = {
    "packages": "name string, path string, kind string, version string, description string, metadata string",
    "dependencies": "package string, dependency string, dep_kind string, version_req string, is_internal boolean",
    "symbols": f"package string, name string, kind string, signature string, file_path string, line bigint, visibility string, parent_symbol string, return_type string, parameters {PARAMETERS}",
    "symbol_postings": "token string, file_path string, line bigint, name string",
    "files": "path string, package string, extension string, size_bytes bigint",
    "manifest_hashes": "path string, content_hash string",
    "source_hashes": "package string, content_hash string, hashed_at timestamp",
    "failures": "path string, error string",
    "meta": "key string, value string",
}
TREE = "path string, dir string, filename string, extension string, size_bytes bigint, mtime timestamp, content binary"
CHANGE = "files array<string>"
