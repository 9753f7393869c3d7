"""Fixed schemas of the domain tables and of the nested inputs."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, B, I, TS = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


BOX = _struct(x=D, y=D, w=D, h=D, polygon=T.ArrayType(T.ArrayType(D)))

RULE = _struct(
    rule_id=S, applies_to=T.ArrayType(S), type=S, field=S, citation=S, severity=S,
    thresholds_mm=T.MapType(S, D), requires_calibration=B, note=S,
)

RULE_PACK_FILE = _struct(
    rule_pack_version=S, effective_from=T.DateType(), effective_to=T.DateType(), source_citation=S, rules=T.ArrayType(RULE)
)

TABLES: dict[str, T.StructType] = {
    "users": _struct(id=S, email=S, full_name=S, role=S, region=S, is_active=B, created_at=TS, updated_at=TS),
    "batch_sessions": _struct(
        id=S, officer_id=S, session_name=S, premises_name=S, premises_address=S, region=S, status=S, notes=S,
        created_at=TS, completed_at=TS,
    ),
    "inspections": _struct(
        id=S, officer_id=S, batch_id=S, status=S, commodity_category=S, rule_pack_version=S, is_self_check=B, region=S,
        captured_offline=B, created_at=TS, updated_at=TS, synced_at=TS, client_id=S,
    ),
    "inspection_images": _struct(
        id=S, inspection_id=S, image_role=S, storage_url=S, width_px=I, height_px=I, calibration_scale_mm_per_px=D,
        quality_check_passed=B, captured_at=TS, uploaded_at=TS, client_id=S, sha256_hash=S,
    ),
    "extracted_fields": _struct(
        id=S, inspection_id=S, source_image_id=S, field_type=S, raw_text=S, parsed_value=S, confidence=D, bounding_box=BOX,
        verdict=S, reviewed_by_officer=B, officer_override_value=S, created_at=TS,
    ),
    "violations": _struct(
        id=S, inspection_id=S, extracted_field_id=S, rule_id=S, rule_pack_version=S, description=S, citation=S, severity=S,
        created_at=TS,
    ),
    "rule_packs": _struct(
        version=S, effective_from=T.DateType(), effective_to=T.DateType(), source_citation=S, rules=T.ArrayType(RULE),
        is_active=B, created_by=S, created_at=TS,
    ),
    "audit_logs": _struct(
        id=S, actor_user_id=S, action=S, entity_type=S, entity_id=S, before_value=S, after_value=S, prev_hash=S,
        entry_hash=S, created_at=TS,
    ),
    "reports": _struct(id=S, inspection_id=S, format=S, storage_url=S, generated_by=S, generated_at=TS),
}

OCR_RESULT = _struct(
    source_image_id=S,
    engine_used=S,
    lines=T.ArrayType(_struct(text=S, confidence=D, bounding_box=_struct(x=D, y=D, w=D, h=D))),
)

SYNC_REQUEST = _struct(
    officer_id=S, client_id=S, commodity_category=S, captured_offline=B, created_at=TS, is_self_check=B, region=S,
    images=T.ArrayType(
        _struct(
            client_id=S, image_role=S, data_url=S, quality_check_passed=B, width_px=I, height_px=I, captured_at=TS
        )
    ),
)

REGION_ITEM = _struct(
    type=S,
    original_width=I,
    original_height=I,
    value=_struct(x=D, y=D, width=D, height=D, rectanglelabels=T.ArrayType(S)),
)

ANNOTATION_TASK = _struct(
    id=T.LongType(),
    data=_struct(sample_id=S, source_filename=S),
    annotations=T.ArrayType(_struct(id=T.LongType(), updated_at=S, result=T.ArrayType(REGION_ITEM))),
)
