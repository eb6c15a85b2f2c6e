"""Schemas of the symbol tables."""

from __future__ import annotations

VERSIONS = "version_id string, release_type string, release_time string, protocol_version int, indexed_at string, has_yarn boolean, has_mojmap boolean, has_intermediary boolean, sort_index int, variant_of string, class_count bigint, method_count bigint, field_count bigint"
CLASSES = "version_id string, class_id bigint, obf_name string, intermediary_name string, yarn_name string, mojmap_name string, package_path string, simple_name string, presence string"
MEMBERS = "version_id string, kind string, member_id bigint, class_id bigint, obf_name string, obf_desc string, intermediary_name string, intermediary_desc string, stable_desc string, yarn_name string, mojmap_name string, simple_name string"
SOURCE_FILES = "version_id string, mapping_type string, class_id bigint, relative_path string, content_hash string"
DECLS = "version_id string, ns string, owner string, access int, supertypes array<string>, subtypes array<string>, members array<struct<name: string, descriptor: string>>"
REFS = "version_id string, ns string, owner string, member string, ref_owner string, ref_member string, ref_descriptor string, ref_kind string, ref_synthetic string, cnt int"
RUNS = "path string, blob string, kind string, size bigint, from_ord int, to_ord int"
SOURCE_TEXT = "version_id string, mapping_type string, relative_path string, text string"
BODIES = "version_id string, ns string, owner string, member string, descriptor string, body string"
INSTRUCTIONS = "version_id string, ns string, owner string, method string, descriptor string, target string"
CONTENTS = "blob string, text string"
TRANSLATIONS = "path string, key string, value string, from_ord int, to_ord int"
RESOURCE_VERSIONS = "ord int, source_id string, name string, version_id string, release_type string, release_time string"
