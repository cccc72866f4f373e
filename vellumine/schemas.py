"""Schemas of the durable tables and of the relations operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


_COMPLEX: dict[str, T.DataType] = {
    "array<string>": T.ArrayType(T.StringType()),
    "array<double>": T.ArrayType(T.DoubleType()),
    "array<short>": T.ArrayType(T.ShortType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    "box": T.StructType([T.StructField(c, T.IntegerType()) for c in "xywh"]),
}


def _schema(spec: str) -> T.StructType:
    """A schema from ``name type, name type``; needs no running session."""
    out = T.StructType()
    for item in spec.split(", "):
        name, kind = item.split(" ", 1)
        out = out.add(name, _COMPLEX.get(kind, kind))
    return out


CASES = _schema(
    "case_id string, case_name string, title string, examiner string, organization string, "
    "description string, reference_number string, date string, notes string, status string, "
    "created_at timestamp, modified_at timestamp"
)
EVIDENCE = _schema(
    "case_id string, evidence_id string, name string, evidence_type string, source string, "
    "file_path string, sha256 string, md5 string, status string, notes string, "
    "reviewed boolean, relevant boolean, created_at timestamp, imported_at timestamp, "
    "file_type string, file_size long, mime_type string, page_count integer, width integer, height integer"
)
EXAMINATIONS = _schema(
    "case_id string, evidence_id string, exam_no long, file_path string, sha256 string, "
    "detected_format string, status string, flags array<string>, "
    "summary map<string,string>, full_data string, examined_at timestamp"
)
OCR_RESULTS = _schema(
    "case_id string, evidence_id string, page_number integer, detected_language string, "
    "language_confidence double, detected_script string, script_confidence double, "
    "ocr_confidence double, ocr_quality string, raw_text string, normalized_text string, "
    "ocr_engine string, model string, processing_time double, preprocessing array<string>, "
    "integrity_snapshot string, provenance string, processed_at timestamp"
)
OCR_REGIONS = _schema(
    "case_id string, evidence_id string, page_number integer, word_no integer, region_id string, "
    "box box, text string, confidence double, engine string"
)
OCR_RUNS = _schema(
    "case_id string, evidence_id string, page_number integer, run_no integer, engine string, "
    "language_model string, variant string, config map<string,string>, confidence double, "
    "text string, processing_time double, status string"
)
PROCESSING_HISTORY = _schema(
    "case_id string, evidence_id string, operation string, parameters string, timestamp timestamp"
)
CASE_EVENTS = _schema(
    "case_id string, evidence_id string, event_type string, description string, timestamp timestamp"
)
RECENT_FILES = _schema("file_path string, file_name string, file_type string, opened_at timestamp")
WORKSPACE_STATE = _schema("key string, value string, saved_at timestamp")
FINDINGS = _schema(
    "case_id string, evidence_id string, finding_id string, module string, description string, "
    "severity string, confidence double, region string, examiner_note string, "
    "timestamp timestamp, status string"
)
MODULE_STATUS = _schema(
    "evidence_id string, module string, status string, confidence double, evidence_strength string"
)

# Columns a reader fills when an older file lacks them.
DEFAULTS: dict[str, dict[str, object]] = {
    "cases": {"case_name": "", "title": "", "examiner": "", "organization": "", "description": "",
              "reference_number": "", "date": "", "notes": "", "status": "OPEN"},
    "evidence_items": {"file_type": "", "file_size": 0, "mime_type": "", "page_count": 1,
                       "width": 0, "height": 0, "status": "Pending", "reviewed": False,
                       "relevant": False, "evidence_type": "Original Evidence", "notes": ""},
    "ocr_results": {"raw_text": "", "normalized_text": "", "model": "", "processing_time": 0.0,
                    "integrity_snapshot": "", "provenance": ""},
    "ocr_runs": {"status": "", "processing_time": 0.0},
    "ocr_regions": {"page_number": 1, "region_id": ""},
}

TABLES: dict[str, T.StructType] = {
    "cases": CASES,
    "evidence_items": EVIDENCE,
    "metadata_examinations": EXAMINATIONS,
    "ocr_results": OCR_RESULTS,
    "ocr_regions": OCR_REGIONS,
    "ocr_runs": OCR_RUNS,
    "processing_history": PROCESSING_HISTORY,
    "case_events": CASE_EVENTS,
    "recent_files": RECENT_FILES,
    "workspace_state": WORKSPACE_STATE,
    "findings": FINDINGS,
    "module_status": MODULE_STATUS,
}
