"""Row types of the stored tables."""

from __future__ import annotations

# Extraction methods in canonical order, and the five join types.
METHODS = ["regex", "claude", "gemini", "nvidia"]
MODEL_METHODS = METHODS[1:]
JOIN_TYPES = ["INNER", "LEFT", "RIGHT", "FULL", "CROSS"]

SCRIPTS = "path STRING, source_file STRING, modified TIMESTAMP, length BIGINT, txt STRING"

MAPPING = (
    "STRUCT<target_column: STRING, source_table: STRING, source_table_qualified: STRING, "
    "source_column: STRING, transformation_type: STRING, transformation_logic: STRING, "
    "insert_position: INT, insert_column: STRING>"
)
JOIN = (
    "STRUCT<left_table: STRING, left_table_qualified: STRING, right_table: STRING, "
    "right_table_qualified: STRING, join_type: STRING, condition: STRING>"
)
LINEAGE = (
    "path STRING, source_file STRING, procedure_name STRING, target_table STRING, "
    "target_table_qualified STRING, source_tables ARRAY<STRING>, "
    f"source_tables_qualified ARRAY<STRING>, column_mappings ARRAY<{MAPPING}>, "
    f"joins ARRAY<{JOIN}>, filters ARRAY<STRING>, grouping ARRAY<STRING>, "
    "extraction_method STRING"
)

COLUMN = "STRUCT<name: STRING, type: STRING, nullable: BOOLEAN, primary_key: BOOLEAN>"
CATALOGUE = (
    "table_name STRING, qualified_name STRING, database STRING, schema STRING, "
    f"columns ARRAY<{COLUMN}>, source_file STRING"
)
TRACKER = (
    "kind STRING, source_file STRING, status STRING, method STRING, target_table STRING, "
    "tables_found BIGINT, processed_at STRING"
)
# Outcomes of this library's runs also know the path: names repeat across folders.
TRACKED = f"{TRACKER}, path STRING"
# Script files as last read.
FILES = "path STRING, source_file STRING, modified TIMESTAMP, length BIGINT, digest STRING"
FAILURES = (
    "timestamp STRING, source_file STRING, failure_reason STRING, step1_error STRING, "
    "step2_error STRING, step3_error STRING, step4_error STRING, sp_snippet STRING"
)
OVERRIDES = "source_file STRING, method STRING, priority INT"
RESPONSES = "source_file STRING, method STRING, response STRING"
ANSWER = (
    "procedure_name STRING, target_table STRING, source_tables ARRAY<STRING>, "
    "column_mappings ARRAY<STRUCT<target_column: STRING, source_table: STRING, "
    "source_column: STRING, transformation_type: STRING, transformation_logic: STRING>>, "
    "joins ARRAY<STRUCT<left_table: STRING, right_table: STRING, join_type: STRING, "
    "condition: STRING>>, filters ARRAY<STRING>, grouping ARRAY<STRING>"
)
