"""Record shapes as DDL. Undefined numbers are NULL, never 0."""

from __future__ import annotations

STATEMENT = "struct<sql:string,paramCount:bigint,kind:string,durationMs:double,rows:bigint>"

#: A captured operation as it arrives (camelCase, one JSON object per line).
OPERATION_EVENT = (
    "schemaVersion int, app string, operationId string, requestId string, route string, "
    "model string, operation string, startedAt timestamp, durationMs double, rowsReturned bigint, "
    f"error boolean, statements array<{STATEMENT}>"
)

EVIDENCE = "struct<source:string,description:string,file:string,line:int,data:string>"

#: A finding. Evidence data is a JSON object kept as text.
FINDING = (
    "schema_version int, rule_id string, severity string, confidence string, file string, "
    f"line int, end_line int, title string, body string, evidence array<{EVIDENCE}>, "
    "suggested_fix string, fingerprint string"
)

#: One injected problem of the ground truth.
ENTRY = (
    "id string, problem_type string, category string, file string, line int, end_line int, "
    "endpoint string, anchor string, table string, column string, expected_rule_id string, "
    "description string, injected_at timestamp"
)

OUTCOME = (
    "config string, app string, repetition int, entry_id string, problem_type string, "
    "detected boolean, confidence int, latency_s double"
)

RUN = (
    "config string, app string, repetition int, sensitivity boolean, wall_s double, cpu_s double, "
    "tp bigint, fp bigint, fn bigint, negatives bigint"
)

#: A declared schema as JSON, one model per line.
CONTRACT = (
    "name string, dbName string, blockType string, line int, "
    "fields array<struct<name:string,dbName:string,kind:string,type:string,optional:boolean,"
    "list:boolean,nativeType:string,nativeArgs:array<int>,line:int>>, "
    "relations array<struct<field:string,name:string,foreignKeyOn:string,referencedModel:string,"
    "fields:array<string>,references:array<string>,line:int>>, "
    "keys array<struct<kind:string,columns:array<string>,name:string,line:int>>, "
    "enumValues array<string>"
)
