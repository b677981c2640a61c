"""Column expressions over response texts, data URLs and label templates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import DATA_URL_HEAD, DATA_URL_MARKER, FENCE_PATTERN, WEB_SPACE


def web_trim(text: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.regexp_replace(text, rf"^{WEB_SPACE}+|{WEB_SPACE}+\z", "")


def first_text(blocks: Column) -> Column:
    """Trimmed text of the first ``text`` block of a content array, or ''."""
    found = F.get(F.filter(blocks, lambda b: b["type"] == "text"), F.lit(0))
    return web_trim(F.coalesce(found["text"], F.lit("")))


def strip_fences(text: Column, trimmed: bool = False) -> Column:
    """Content of a code fence that spans the whole text, else the text unchanged.

    Texts known to be ``trimmed`` take one replacement instead of a test and an extraction.
    """
    if trimmed:
        return F.regexp_replace(text, FENCE_PATTERN, "$1")
    bare = web_trim(text)
    return F.when(bare.rlike(FENCE_PATTERN), F.regexp_extract(bare, FENCE_PATTERN, 1)).otherwise(text)


def data_url_parts(url: Column) -> Column:
    """Struct (media_type, data) of an image data URL; null if it is not one.

    Only the part before the marker meets a regular expression, however long the data is.
    """
    head = F.substring_index(url, DATA_URL_MARKER, 1)
    valid = head.rlike(DATA_URL_HEAD) & (F.length(head) < F.length(url))
    return F.when(
        valid,
        F.struct(
            F.regexp_extract(head, DATA_URL_HEAD, 1).alias("media_type"),
            F.substr(url, F.length(head) + len(DATA_URL_MARKER) + 1).alias("data"),
        ),
    )


def to_data_url(content: Column, media_type: str | Column = "image/jpeg") -> Column:
    """Encode bytes as a data URL, without the line breaks of Spark's MIME base64."""
    kind = F.lit(media_type) if isinstance(media_type, str) else media_type
    body = F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), body)


def interpolate(template: Column, values: dict[str, Column]) -> Column:
    """Replace every ``{name}`` in a template by the value of the same name, literally."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out
