"""Detector requests, response parsing and normalisation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions.boxes import clamp_box
from ..functions.text import strip_fences, web_trim

# --- requests ---------------------------------------------------------------------


def validate_requests(df: DataFrame) -> DataFrame:
    """Add ``reject_reason``; a request needs both image strings."""
    return df.withColumn(
        "reject_reason",
        F.when(F.col("reference").isNull() | F.col("target").isNull(), "reference and target are required"),
    )


def resolve_model(df: DataFrame, providers: DataFrame, default_provider: str, strict: bool = False) -> DataFrame:
    """Resolve provider and model against ``providers`` (provider, models array, default_model).

    An unknown provider falls back to the default, or gets a ``provider_error`` when ``strict``. A
    model that its provider does not list falls back to the provider's default model.
    """
    names = providers.select(F.col("provider").alias("_p"))
    dims = providers.select(
        F.col("provider").alias("resolved_provider"), F.col("models").alias("_models"),
        F.col("default_model").alias("_default"),
    )
    known = df.join(names, df["provider"] == F.col("_p"), "left")
    chosen = F.col("provider") if strict else F.coalesce("_p", F.lit(default_provider))
    out = known.withColumn("resolved_provider", chosen).join(dims, "resolved_provider", "left")
    listed = F.coalesce(F.array_contains("_models", F.col("model")), F.lit(False))
    out = out.withColumn("resolved_model", F.when(listed, F.col("model")).otherwise(F.col("_default")))
    if not strict:
        return out.select(*df.columns, "resolved_provider", "resolved_model")
    unknown = F.concat(F.lit("no such provider: "), F.coalesce("provider", F.lit("null")))
    return out.withColumn("provider_error", F.when(F.col("_p").isNull(), unknown)).select(
        *df.columns, "resolved_provider", "resolved_model", "provider_error"
    )


@dataclass
class RequestText:
    """Wording sent with every tile pair; callers may replace any part."""

    system: str = "Compare two aligned aerial images of one place and report real changes on the ground."
    earlier_label: str = "First image: earlier date."
    later_label: str = "Second image: later date."
    instruction: str = "Report the changes as JSON that follows the given schema."
    language_suffix: dict[str, str] = field(
        default_factory=lambda: {"de": " Write description and summary in German; keep enum values in English."}
    )


# The field names of the schema and of the request are those of the wire format.


def response_schema() -> dict:
    """JSON schema the detector is asked to follow."""
    change = {
        "category": {"type": "string", "enum": K.CATEGORIES},
        "change_type": {"type": "string", "enum": K.CHANGE_TYPES},
        "description": {"type": "string"},
        "confidence": {"type": "string", "enum": K.CONFIDENCES},
        "bbox": {"type": "array", "items": {"type": "number"}},
    }
    top = {
        "analysis": {"type": "string"},
        "summary": {"type": "string"},
        "changes": {"type": "array", "items": _closed_object(change)},
    }
    return _closed_object(top)


def _closed_object(properties: dict) -> dict:
    return {
        "type": "object",
        "additionalProperties": False,
        "properties": properties,
        "required": list(properties),
    }


def build_requests(df: DataFrame, lang: str | Column | None = None, text: RequestText | None = None) -> DataFrame:
    """Add ``request_json``: one batch-inference request per row with ``earlier`` and ``later`` image structs.

    Each image is a struct (media_type, data) as ``data_url_parts`` returns it; the model comes from
    ``resolved_model``.
    """
    wording = text or RequestText()
    code = lang if isinstance(lang, Column) else F.lit(lang)
    suffix = F.lit("")
    for name, words in wording.language_suffix.items():
        suffix = F.when(code == name, F.lit(words)).otherwise(suffix)

    def words_block(words: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), words.alias("text"), F.lit(None).cast(
            "struct<type:string,media_type:string,data:string>").alias("source"))

    def image_block(image: str) -> Column:
        source = F.struct(
            F.lit("base64").alias("type"),
            F.col(image)["media_type"].alias("media_type"),
            F.col(image)["data"].alias("data"),
        )
        return F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), source.alias("source"))

    content = F.array(
        words_block(F.lit(wording.earlier_label)), image_block("earlier"),
        words_block(F.lit(wording.later_label)), image_block("later"),
        words_block(F.concat(F.lit(wording.instruction), suffix)),
    )
    body = F.to_json(F.struct(
        F.col("resolved_model").alias("model"),
        F.lit(K.MAX_OUTPUT_TOKENS).alias("max_tokens"),
        F.lit(wording.system).alias("system"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("messages"),
    ))
    # The schema is the same for every row: append it as text instead of rebuilding it per row.
    schema = json.dumps({"format": {"type": "json_schema", "schema": response_schema()}}, separators=(",", ":"))
    closed = F.concat(F.expr("substring(_body, 1, length(_body) - 1)"), F.lit(',"output_config":' + schema + "}"))
    return df.withColumn("_body", body).withColumn("request_json", closed).drop("_body")


# --- parsing -----------------------------------------------------------------------


def parse_responses(df: DataFrame, text: str = "raw_text", error: str = "error") -> DataFrame:
    """Parse response texts strictly.

    Adds ``parse_error`` (null if the text is acceptable), ``failed``, ``failure``, ``summary`` and
    ``changes`` (array of variant, null for failed rows). Rows whose ``error`` is set are failed
    whatever their text says. Rules: text that is not exactly one JSON value, a top-level null, a
    ``changes`` value that is neither null nor a list and a null list element fail; any other
    top-level value is a response without changes.
    """
    # "Last duplicate key wins" is a setting of the session; without it such texts would be rejected.
    if df.sparkSession.conf.get("spark.sql.variant.allowDuplicateKeys", "false").lower() != "true":
        raise RuntimeError("call groundshift.session.configure(spark) before parsing responses")
    # The parser stops after the first complete value. In a list that must end with a number known
    # from the text, anything that follows the value, or closes the list early, shows. The one-element
    # explode holds the parsed list fast: filters above it read the list and never repeat the parsing.
    body = strip_fences(F.col("_raw"), trimmed=True)
    seal = F.xxhash64("_raw")
    values = F.try_parse_json(
        F.concat(F.lit("["), body, F.lit(","), seal.cast("string"), F.lit("]"))
    ).try_cast("array<variant>")
    sealed = (F.size("_list") == 2) & (F.get("_list", F.lit(1)).try_cast("bigint") == seal)
    parsed = (
        df.withColumn("_raw", web_trim(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_list", F.explode(F.array(values)))
        .withColumn("_ok", F.coalesce(sealed, F.lit(False)))
        .withColumn("_v", F.when(F.col("_ok"), F.get("_list", F.lit(0))))
        .withColumn("_c", F.expr("try_variant_get(_v, '$.changes', 'variant')"))
        .withColumn("_items", F.expr("try_variant_get(_v, '$.changes', 'array<variant>')"))
        .withColumn("_s", F.expr("try_variant_get(_v, '$.summary', 'variant')"))
    )
    no_list = F.col("_c").isNull() | F.is_variant_null("_c")
    excerpt = F.concat(
        F.lit("Detector did not return valid JSON. Raw: "), F.substring(F.col("_raw"), 1, K.RAW_EXCERPT)
    )
    problem = (
        F.when(~F.col("_ok"), excerpt)
        .when(F.is_variant_null("_v"), F.lit("Response is null"))
        .when(~no_list & F.col("_items").isNull(), F.lit("Changes is not a list"))
        .when(F.exists("_items", lambda e: F.is_variant_null(e)), F.lit("Change entry is null"))
    )
    call_failed = F.col(error).isNotNull() if error in df.columns else F.lit(False)
    call_error = F.col(error) if error in df.columns else F.lit(None).cast("string")
    return (
        parsed.withColumn("parse_error", F.when(~call_failed, problem))
        .withColumn("failed", call_failed | F.col("parse_error").isNotNull())
        .withColumn("failure", F.coalesce(call_error, F.col("parse_error")))
        .withColumn("summary", F.when(F.col("failed"), F.lit("")).otherwise(_summary(F.col("_s"))))
        .withColumn("changes", F.when(~F.col("failed"), F.col("_items")))
        .drop("_raw", "_list", "_ok", "_v", "_c", "_items", "_s")
    )


def _summary(value: Column) -> Column:
    """Text of a summary; missing and other empty values (null, 0, false) count as ''."""
    kind = F.schema_of_variant(value)
    words = F.expr("try_cast(_s as string)")
    empty = (kind == "BOOLEAN") & (words == "false") | (
        ~kind.isin("STRING", "BOOLEAN") & F.coalesce(F.expr("try_cast(_s as double)") == 0, F.lit(False))
    )
    return F.when(value.isNull() | F.is_variant_null(value) | empty, F.lit("")).otherwise(
        F.coalesce(words, F.lit(""))
    )


def explode_changes(parsed: DataFrame) -> DataFrame:
    """One row per reported change with its position; raw fields are strings, ``bbox`` is numbers.

    Tiles without changes give no rows here; they stay in the parsed table.
    """
    kept = [c for c in parsed.columns if c != "changes"]
    rows = parsed.select(*kept, F.posexplode("changes").alias("pos", "_e"))
    named = {
        name: F.expr(f"try_variant_get(_e, '$.{name}', 'string')")
        for name in ("category", "change_type", "description", "confidence")
    }
    return (
        rows.withColumns(named)
        .withColumn("_b", F.expr("try_variant_get(_e, '$.bbox', 'array<variant>')"))
        .withColumn("bbox", F.transform(F.transform("_b", _typed), _number))
        .drop("_e", "_b")
    )


def _typed(value: Column) -> Column:
    return F.struct(value.alias("value"), F.schema_of_variant(value).alias("kind"))


def _number(typed: Column) -> Column:
    """Coerce one JSON value to a number the way the web client did; NaN if impossible."""
    value, kind = typed["value"], typed["kind"]
    nan = F.lit(float("nan"))
    text = value.try_cast("string")
    inner = value.try_cast("array<variant>")
    only = F.get(inner, F.lit(0))
    from_list = (
        F.when(F.size(inner) == 0, F.lit(0.0))
        .when((F.size(inner) == 1) & ~F.schema_of_variant(only).startswith("BOOLEAN"),
              _text_number(F.coalesce(only.try_cast("string"), F.lit(""))))
        .otherwise(nan)
    )
    return (
        F.when(F.is_variant_null(value), F.lit(0.0))
        .when(kind == "BOOLEAN", F.when(text == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
        .when(kind == "STRING", _text_number(text))
        .when(kind.startswith("ARRAY"), from_list)
        .when(kind.startswith("OBJECT"), nan)
        .otherwise(F.coalesce(value.try_cast("double"), nan))
    )


# fixed values: number texts accepted by the web client's coercion
DECIMAL_TEXT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"
INFINITE_TEXT = r"^[+-]?Infinity\z"
HEX_TEXT = r"^0[xX]([0-9a-fA-F]+)\z"
OCTAL_TEXT = r"^0[oO]([0-7]+)\z"
BINARY_TEXT = r"^0[bB]([01]+)\z"


def _text_number(text: Column) -> Column:
    t = web_trim(text)

    def based(pattern: str, base: int) -> Column:
        return F.conv(F.regexp_extract(t, pattern, 1), base, 10).cast("double")

    return (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike(DECIMAL_TEXT) | t.rlike(INFINITE_TEXT), t.try_cast("double"))
        .when(t.rlike(HEX_TEXT), based(HEX_TEXT, 16))
        .when(t.rlike(OCTAL_TEXT), based(OCTAL_TEXT, 8))
        .when(t.rlike(BINARY_TEXT), based(BINARY_TEXT, 2))
        .otherwise(F.lit(float("nan")))
    )


def normalise_changes(df: DataFrame, bbox: str | None = "bbox") -> DataFrame:
    """Apply field defaults and clamp the box.

    The category is an open set. Change types and confidences outside their sets fall back to their
    defaults. ``bbox`` is an array of numbers; pass None when x, y, w, h are clean columns already.
    """
    out = (
        df.withColumn("category", F.coalesce("category", F.lit(K.DEFAULT_CATEGORY)))
        .withColumn("description", F.coalesce("description", F.lit("")))
        .withColumn("change_type", F.when(F.col("change_type").isin(K.CHANGE_TYPES), F.col("change_type"))
                    .otherwise(K.DEFAULT_CHANGE_TYPE))
        .withColumn("confidence", F.when(F.col("confidence").isin(K.CONFIDENCES), F.col("confidence"))
                    .otherwise(K.DEFAULT_CONFIDENCE))
    )
    if bbox is None:
        return out
    return out.withColumn("_box", clamp_box(F.col(bbox))).select(
        *[c for c in out.columns if c != bbox], *[F.col(f"_box.{n}").alias(n) for n in "xywh"]
    )


def with_local_id(df: DataFrame, pos: str = "pos") -> DataFrame:
    """Add the provisional id ``chg-i`` of a change within its response; ``pos`` counts from 0."""
    return df.withColumn("id", F.concat(F.lit("chg-"), (F.col(pos) + 1).cast("string")))


# --- failures ----------------------------------------------------------------------


def is_auth_error(status: Column, message: Column) -> Column:
    """Whether a failed call is an authentication problem, by status or message."""
    return F.coalesce(status.isin(K.AUTH_STATUSES), F.lit(False)) | F.coalesce(
        message.rlike(K.AUTH_PATTERN), F.lit(False)
    )


def classify_errors(df: DataFrame, status: str = "http_status", error: str = "error") -> DataFrame:
    """Add ``error_class``: 'auth', 'other', or null where the call did not fail."""
    return df.withColumn(
        "error_class",
        F.when(F.col(error).isNotNull(),
               F.when(is_auth_error(F.col(status), F.col(error)), "auth").otherwise("other")),
    )


def split_failed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and failed rows for the quarantine table."""
    return parsed.where(~F.col("failed")), parsed.where(F.col("failed"))
