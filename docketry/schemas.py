"""Explicit schemas; nothing is inferred on read."""

from pyspark.sql import types as T

RAW_CASE_FIELDS = [
    # fixed values: column order of the corpus files
    "case_id", "title", "court", "jurisdiction", "decision_date", "citation", "case_type", "summary",
    "full_text", "source_url", "source_name",
]
RAW_CASE = T.StructType([T.StructField(n, T.StringType()) for n in RAW_CASE_FIELDS])

# Operational snapshot: one document holding four arrays (names as in the file).
SNAPSHOT_ARRAYS = {
    "judges": (
        "id: STRING, name: STRING, courtLevel: STRING, category: STRING, yearsOfExperience: INT, "
        "caseLoadCapacity: INT, currentCaseLoad: INT, availability: STRING, district: STRING, state: STRING, "
        "area: STRING, courtName: STRING, specializations: ARRAY<STRING>"
    ),
    "hearings": (
        "id: STRING, caseId: STRING, caseTitle: STRING, assignedJudgeId: STRING, assignedJudgeName: STRING, "
        "hearingDate: STRING, hearingTime: STRING, courtRoom: STRING, state: STRING, district: STRING, "
        "localCourtName: STRING, status: STRING, notes: STRING"
    ),
    "managedCases": (
        "id: STRING, title: STRING, status: STRING, assignedJudge: STRING, uploadedBy: STRING, "
        "uploadName: STRING, notes: STRING, autoAssigned: BOOLEAN, assignmentReason: STRING, "
        "priorityScore: DOUBLE, priorityBand: STRING, bailRiskScore: DOUBLE, escapeRiskScore: DOUBLE, "
        "riskScore: DOUBLE, publicDefenderStatus: STRING, updatedAt: BIGINT"
    ),
    "activityHistory": (
        "id: STRING, type: STRING, title: STRING, date: STRING, results: INT, metadata: MAP<STRING, STRING>"
    ),
}
SNAPSHOT = ", ".join(f"{name} ARRAY<STRUCT<{body}>>" for name, body in SNAPSHOT_ARRAYS.items())

REQUEST_LOG = (
    "ts TIMESTAMP, requestId STRING, method STRING, path STRING, status INT, durationMs DOUBLE, client STRING"
)
ACTIVITY = "id STRING, kind STRING, ts TIMESTAMP, payload MAP<STRING, STRING>"
RULE = (
    "ord INT, terms ARRAY<STRING>, sections ARRAY<STRING>, domain STRING, severity STRING, public_risk BOOLEAN"
)
