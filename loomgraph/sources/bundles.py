"""Artifact files of many applications: reading (S1-S8) and writing.

The layout is one folder per application with a `json` and a `logs` folder in it. Every
reader has an explicit schema, so no inference pass runs over the files.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.functions.scalar import is_variant

REF = "struct<file:string,start:bigint,end:bigint>"
ATOM = f"struct<kind:string,args:array<string>,source:{REF}>"
SURFACE = f"struct<requiredParams:array<string>,guards:array<string>,roles:array<string>,uiAtoms:array<{ATOM}>,evidence:array<{REF}>>"
NODE = f"struct<id:string,kind:string,label:string,refs:array<{REF}>,meta:string>"
EDGE = ("struct<id:string,kind:string,`from`:string,`to`:string,trigger:struct<event:string,viaRouterLink:boolean>,handler:struct<componentId:string,methodName:string>,"
        f"constraints:{SURFACE},refs:array<{REF}>,targetRouteId:string,targetText:string,effectGroupId:string,callsiteOrdinal:bigint,"
        "compositionContext:struct<insideNgTemplate:boolean,insideNgIf:string,insideNgFor:string>>")
GRAPH_SCHEMA = f"multigraph struct<nodes:array<{NODE}>,edges:array<{EDGE}>>"
WORKFLOW = ("struct<id:string,triggerEdgeId:string,startRouteIds:array<string>,steps:array<struct<edgeId:string,kind:string>>,terminalNodeId:string,"
            f"effectGroupId:string,cw:{SURFACE},verdict:string,meta:struct<redirectClosureStabilized:boolean,unresolvedTargets:array<struct<edgeId:string,targetText:string>>>>")
WORKFLOW_SCHEMA = f"workflows array<{WORKFLOW}>"
ATTEMPT = "struct<attemptNumber:bigint,outcome:string,durationMs:bigint,error:string>"
RESULT_SCHEMA = (f"runTimestamp string, results array<struct<workflowId:string,testFile:string,outcome:string,attempts:bigint,durationMs:bigint,error:string,attemptDetails:array<{ATTEMPT}>>>")
PLAN_SCHEMA = ("plans array<struct<workflowId:string,assignment:struct<routeParams:map<string,string>,formData:map<string,string>>,preConditions:array<struct<type:string>>,"
               "steps:array<struct<type:string,edgeId:string>>,postConditions:array<struct<type:string,expected:string>>>>")
TEST_SCHEMA = "tests array<struct<workflowId:string,fileName:string>>"
STEP = ("struct<stepId:string,stepType:string,timestampStart:timestamp,timestampEnd:timestamp,success:boolean,failureKind:string,"
        "networkEvidence:array<struct<url:string,method:string,status:bigint,timing:double>>>")
LOG_SCHEMA = f"workflowId string, testFile string, outcome string, failedStepId string, failureKind string, duration bigint, steps array<{STEP}>, _corrupt_record string"
TRUTH_SCHEMA = ("subject string, totalEntries bigint, entries array<struct<gtId:string,workflowId:string,a2WorkflowIndex:bigint,difficultyClass:string,"
                "expectedIntent:struct<triggerKind:string,triggerEvent:string,requiresAuth:boolean,requiresParams:boolean,hasFormSchema:boolean>>>")
EVENT_SCHEMA = ("timestamp timestamp, phase string, operation string, subject string, severity string, event string, message string, duration bigint, outcome string, context map<string,string>")
REGISTRY_SCHEMAS = {
    "modules": "modules array<struct<id:string,name:string,declarations:array<string>,imports:array<string>,exports:array<string>,providers:array<string>>>",
    "routes": "routes array<struct<id:string,fullPath:string,path:string,parentId:string,kind:string,componentId:string,redirectToFullPath:string>>",
    "components": "components array<struct<id:string,selector:string,usesComponentIds:array<string>>>",
}
REQUIRED = ["a1-multigraph.json", "a2-workflows.json"]


def subject_of_path(levels: int = 2) -> Column:
    """Application folder of a file: `<subject>/json/<file>`."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - levels)


def read_files(spark: SparkSession, root: str, pattern: str, schema: str, mode: str = "FAILFAST", lines: bool = False) -> DataFrame:
    """JSON artifacts of all applications, one row per document. No file gives no rows.

    With `lines` the folder `root` holds one document per line with its subject in it, the
    layout for a corpus of many applications; files of any size are then split.
    """
    own = "subject string" in schema
    if lines and not own:
        schema, own = f"subject string, {schema}", True
    reader = spark.read.schema(schema).option("multiLine", not lines).option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt_record")
    try:
        df = reader.json(root if lines else f"{root}/{pattern}")
    except AnalysisException as ex:  # a stage that has not run yet left no file
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema if own else f"{schema}, subject string")
    return df if own else df.withColumn("subject", subject_of_path(2 if pattern.count("/") == 2 else 1))


def read_graph(spark: SparkSession, root: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all applications."""
    g = read_files(spark, root, "*/json/a1-multigraph.json", GRAPH_SCHEMA, lines=lines)
    return g.select("subject", F.inline("multigraph.nodes")), g.select("subject", F.inline("multigraph.edges"))


def read_workflows(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """Workflows of all applications."""
    return read_files(spark, root, "*/json/a2-workflows.json", WORKFLOW_SCHEMA, lines=lines).select("subject", F.inline("workflows"))


def read_stage(spark: SparkSession, root: str, stage: str, lines: bool = False) -> DataFrame:
    """Plans, tests or results; empty when the stage has not run (S3)."""
    name, schema, column = {"plans": ("b1-plans.json", PLAN_SCHEMA, "plans"), "tests": ("b2-tests.json", TEST_SCHEMA, "tests"),
                            "results": ("b3-results.json", RESULT_SCHEMA, "results")}[stage]
    return read_files(spark, root, f"*/json/{name}", schema, lines=lines).select("subject", F.inline(column))


def read_logs(spark: SparkSession, root: str, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Logs, their steps and their requests (S4). Broken files are left out."""
    raw = read_files(spark, root, "*/logs/*.log.json", LOG_SCHEMA, "PERMISSIVE", lines).withColumn("written", F.col("_metadata.file_modification_time"))
    logs = raw.where("workflowId is not null")
    steps = logs.select("subject", "testFile", F.posexplode("steps").alias("pos", "s")).select("subject", "testFile", "pos", "s.*")
    requests = steps.select("subject", "testFile", "pos", F.inline("networkEvidence"))
    return logs.drop("steps", "_corrupt_record"), steps.drop("networkEvidence"), requests


# fields of a manifest: path, type, name of the column
MANIFEST_FIELDS = [
    ("subjectName", "string", "subject_name"), ("baseUrl", "string", "base_url"), ("accounts", "array", "accounts"), ("routeParamValues", "object", "route_param_values"),
    ("routeParamOverrides", "object", "route_param_overrides"), ("skipWorkflows", "array", "skip_workflows"), ("formDataOverrides", "object", "form_data_overrides"),
    ("authSetup", "object", "auth_setup"), ("executionConfig", "object", "execution_config"), ("seedRequirements", "object", "seed_requirements"),
]
FIELD_TYPES = {"string": "string", "array": "array<variant>", "object": "map<string,variant>"}


def read_manifests(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """Manifests with all their fields (S5); with `lines`, `root` holds one per line.

    Only a text that isn't JSON is a `load_error`. A field of another type than the schema's is NULL and named in
    `wrong_fields`: nothing is cast, a number stays no text, and its neighbours are read all the same.
    """
    try:
        raw = spark.read.option("wholetext", not lines).text(root if lines else f"{root}/*/subject-manifest.json")
    except AnalysisException as ex:
        if ex.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], "value string").withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    m = raw.select(subject_of_path(1).alias("folder") if not lines else F.lit(None).cast("string").alias("folder"), F.col("value").alias("text"), F.try_parse_json("value").alias("v"))
    at = lambda path: F.try_variant_get(F.col("v"), f"$.{path}", "variant")
    right = {path: is_variant(at(path), kind) for path, kind, _ in MANIFEST_FIELDS}
    fields = [F.when(right[path], F.try_variant_get(F.col("v"), f"$.{path}", FIELD_TYPES[kind])).alias(name) for path, kind, name in MANIFEST_FIELDS]
    wrong = F.array_compact(F.array(*[F.when(at(path).isNotNull() & ~right[path], F.lit(path)) for path, _, _ in MANIFEST_FIELDS]))
    subject = F.coalesce(F.try_variant_get(F.col("v"), "$.subject", "string"), F.col("folder"))
    return m.select(subject.alias("subject"), "text", F.col("v").isNull().alias("load_error"), *fields, F.when(F.col("v").isNotNull(), wrong).alias("wrong_fields"))


def read_truth(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """Reference entries."""
    return read_files(spark, root, "*.json", TRUTH_SCHEMA, lines=lines).select(F.inline("entries"), "subject")


def read_registry(spark: SparkSession, root: str, name: str, lines: bool = False) -> DataFrame:
    """One registry of all applications."""
    return read_files(spark, root, f"*/json/{name}.json", REGISTRY_SCHEMAS[name], lines=lines).select("subject", F.inline(name))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(subject, name) of the JSON artifacts below a root. Only file names are read, not contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{root}/*/json").select("path")
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -3).alias("subject"), F.element_at(parts, -1).alias("name"))


def complete_subjects(listed: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Applications that have all required artifacts."""
    wanted = required or REQUIRED
    return (listed.where(F.col("name").isin(wanted)).groupBy("subject").agg(F.count_distinct("name").alias("n"))
            .where(F.col("n") == len(wanted)).select("subject"))


# ---- writing --------------------------------------------------------------------------------


def append_events(events: DataFrame, path: str) -> None:
    """Append structured events as JSON lines."""
    events.write.mode("append").json(path)


def canonical_text(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows as JSON text with sorted fields, in a fixed order.

    A range sort spreads the rows; file names follow the ranges, so two runs over the
    same rows write the same text wherever the partitions fall.
    """
    fields = [F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map<") else F.col(c) for c, t in sorted(df.dtypes)]
    return df.select(*order, F.to_json(F.struct(*fields)).alias("value")).orderBy(*order).select("value")


def write_canonical(df: DataFrame, order: list[str], path: str) -> None:
    canonical_text(df, order).write.mode("overwrite").text(path)


def write_artifact(df: DataFrame, path: str, fmt: str = "parquet", files_per_subject: int = 1) -> None:
    """One table per artifact, one folder per application.

    Rows are spread by application and a hash of the row, so an application with very many
    rows is written by several tasks when `files_per_subject` says so.
    """
    spread = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map<")]), F.lit(files_per_subject))
    df.repartition("subject", spread).write.mode("overwrite").partitionBy("subject").format(fmt).save(path)


def write_reports(tables: dict[str, DataFrame], path: str) -> None:
    """Report tables, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Flat node and edge records for viewers."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
