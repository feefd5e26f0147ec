"""Line-delimited JSON requests and JSON review policies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.functions.frames import settled
from codesieve.functions.text import strip

VERSIONS = ("2024-11-05", "2025-03-26", "2025-06-18")
LATEST = "2025-06-18"
METHODS = ("initialize", "tools/list", "tools/call", "ping")
TOOLS = ("get_corpus", "get_area", "get_rules", "get_gates", "scan_code", "review_patch", "verify_dependencies")
PARSE, INVALID, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602


def _kind(value: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def dispatch(raw: Column, value: Column) -> dict[str, Column]:
    """``code`` (0 for a result), ``message``, ``id`` and ``answered`` of one request line.

    ``value`` is the parsed line (null when it is no JSON).
    """
    line = strip(raw)
    text = lambda path: F.try_variant_get(value, path, "string")
    is_object = F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))
    has = lambda path: F.try_variant_get(value, path, "variant").isNotNull()
    method_ok = F.coalesce(_kind(value, "$.method") == "STRING", F.lit(False))
    params_kind = F.coalesce(_kind(value, "$.params"), F.lit("VOID"))
    params_bad = ~params_kind.isin("VOID") & ~F.startswith(params_kind, F.lit("OBJECT"))
    # An empty list, zero, false or an empty string counts as "no params".
    falsy = F.coalesce(F.to_json(F.try_variant_get(value, "$.params", "variant")), F.lit("null")).isin("[]", "0", "false", '""', "null")
    tool, args_kind = text("$.params.name"), F.coalesce(_kind(value, "$.params.arguments"), F.lit("VOID"))
    tool_ok = F.coalesce(_kind(value, "$.params.name") == "STRING", F.lit(False)) & F.coalesce(tool.isin(list(TOOLS)), F.lit(False))
    args_bad = ~args_kind.isin("VOID") & ~F.startswith(args_kind, F.lit("OBJECT"))
    method = text("$.method")
    valid = is_object & F.coalesce(text("$.jsonrpc") == "2.0", F.lit(False))
    code = F.when(value.isNull(), F.lit(PARSE)).when(~valid, F.lit(INVALID)) \
        .when(~method_ok, F.lit(INVALID)).when(~method.isin(list(METHODS)), F.lit(NO_METHOD)) \
        .when(params_bad & ~falsy, F.lit(BAD_PARAMS)) \
        .when((method == "tools/call") & (~tool_ok | args_bad), F.lit(BAD_PARAMS)).otherwise(F.lit(0))
    message = F.when(value.isNull(), F.lit("Parse error")) \
        .when(~valid, F.lit("Not a valid JSON-RPC 2.0 message.")).when(~method_ok, F.lit("Missing method.")) \
        .when(~method.isin(list(METHODS)), F.concat(F.lit("Method not found: "), method)) \
        .when(params_bad & ~falsy, F.lit("params must be an object.")) \
        .when((method == "tools/call") & ~tool_ok, F.concat(F.lit("Unknown tool: "), F.coalesce(tool, F.lit("None")))) \
        .when((method == "tools/call") & args_bad, F.lit("Tool arguments must be an object.")) \
        .when(method == "initialize", F.when(text("$.params.protocolVersion").isin(list(VERSIONS)), text("$.params.protocolVersion"))
              .otherwise(F.lit(LATEST))).otherwise(method)
    # Silence only for well-formed notifications: no id at all.
    quiet = valid & method_ok & ~has("$.id")
    return {"code": code, "message": message, "id": F.when(is_object, F.to_json(F.try_variant_get(value, "$.id", "variant"))),
            "answered": ~F.coalesce(quiet, F.lit(False)), "blank": F.length(line) == 0}


def responses(frames: DataFrame) -> DataFrame:
    """One response row per answered request line; works on streams as well."""
    parsed = settled(frames.select("seq", "raw", F.try_parse_json(strip(F.col("raw"))).alias("value")))
    parts = dispatch(F.col("raw"), F.col("value"))
    rows = parsed.select("seq", *[column.alias(name) for name, column in parts.items()])
    return rows.where("not blank and answered").select("seq", "code", "message", "id")


# --- review policies -----------------------------------------------------------
KEYS = ("exclude", "fail_on_review", "require_tests", "min_test_trigger_lines", "test_globs", "business_logic")


def validate_policies(policies: DataFrame) -> DataFrame:
    """First violated rule of each policy text, or ``ok`` with defaults filled in."""
    policies = settled(policies.select("config_id", "raw", F.try_parse_json(F.col("raw")).alias("value")))
    value = F.col("value")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    has = lambda key: F.try_variant_get(value, f"$.{key}", "variant").isNotNull()
    top = F.coalesce(F.schema_of_variant(value), F.lit(""))
    unknown = F.size(F.array_except(F.json_object_keys("raw"), F.array(*[F.lit(k) for k in KEYS]))) > 0
    strings = lambda key: has(key) & ~kind(f"$.{key}").isin("ARRAY<STRING>", "ARRAY<VOID>")
    number = F.try_variant_get(value, "$.min_test_trigger_lines", "bigint")
    problem = F.when(value.isNull(), F.lit("invalid JSON")).when(~F.startswith(top, F.lit("OBJECT")), F.lit("not an object")) \
        .when(unknown, F.lit("unknown key")).when(strings("exclude"), F.lit("exclude")).when(strings("test_globs"), F.lit("test_globs")) \
        .when(has("fail_on_review") & (kind("$.fail_on_review") != "BOOLEAN"), F.lit("fail_on_review")) \
        .when(has("require_tests") & ~F.coalesce(F.try_variant_get(value, "$.require_tests", "string").isin("off", "warn", "fail"), F.lit(False)),
              F.lit("require_tests")) \
        .when(has("min_test_trigger_lines") & ((kind("$.min_test_trigger_lines") != "BIGINT") | (number < 0)), F.lit("min_test_trigger_lines")) \
        .when(has("business_logic") & ~F.startswith(kind("$.business_logic"), F.lit("OBJECT")), F.lit("business_logic")).otherwise(F.lit("ok"))
    valid = F.col("problem") == "ok"
    rows = policies.select("config_id", problem.alias("problem"), F.try_variant_get(value, "$.require_tests", "string").alias("rt"), number.alias("n"))
    return rows.select("config_id", "problem", F.when(valid, F.coalesce("rt", F.lit("warn"))).alias("require_tests"),
                       F.when(valid, F.coalesce("n", F.lit(5))).alias("min_lines"))
