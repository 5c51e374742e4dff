"""Errors of archive operations and their numbers."""

from __future__ import annotations

#: Fixed numbers of the error conditions that operations here can report.
CODES = {
    "glob_had_no_matches": 8,
    "image_name_collision": 11,
    "integrity": 13,
    "invalid_capture_config": 14,
    "invalid_chunk_size": 15,
    "invalid_compression_type": 16,
    "invalid_header": 17,
    "invalid_image": 18,
    "invalid_lookup_table_entry": 20,
    "invalid_metadata_resource": 21,
    "invalid_overlay": 23,
    "invalid_param": 24,
    "invalid_part_number": 25,
    "invalid_resource_hash": 28,
    "is_directory": 32,
    "is_split": 33,
    "not_a_directory": 40,
    "not_empty": 41,
    "not_a_regular_file": 42,
    "path_does_not_exist": 49,
    "resource_not_found": 55,
    "split_invalid": 62,
    "unsupported": 68,
    "duplicate_exported_image": 87,
    "concurrent_modification": 88,
}
NAMES = {code: name for name, code in CODES.items()}


class ArchiveError(Exception):
    """An operation was refused; `code` is its number."""

    def __init__(self, name: str, detail: str = ""):
        self.name, self.code = name, CODES[name]
        super().__init__(f"{name} ({self.code})" + (f": {detail}" if detail else ""))
