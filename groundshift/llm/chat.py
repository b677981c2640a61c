"""Chat formatting from event logs (operator 7, JVM only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_HEAD = "### "
HEAD_END = ": "
TURN_END = "</turn>\n"
ROLE_MARKS = "#<:"


def escape(text: Column, marks: str = "#<") -> Column:
    """Put a backslash after every backslash and mark, so that no control string of the template can occur in a text."""
    for char in "\\" + marks:
        text = F.replace(text, F.lit(char), F.lit(char + "\\"))
    return text


def unescape(text: Column, marks: str = "#<") -> Column:
    """Undo `escape`."""
    return F.regexp_replace(text, rf"([\\{marks}])\\", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Fold a log into its final messages: `conv_id, message_id, seq, role, text`.

    `events` has conv_id, seq, message_id, kind, role, text. A `delta` (or null kind) adds its text to the message, an
    `edit` replaces what is there, `regenerate` throws it away and starts with its own text, `delete` removes the
    message. Any other kind counts as a delta. Events of a message apply in order of seq, then kind, then text; a
    message stands where its first event stands and has the role of its last event that names one. A null text adds
    nothing, a null conversation is a conversation of its own, null message ids in a conversation are one message,
    repeated rows are separate events.

    The log is dealt by conversation once; both groupings of this module use that partitioning. One message's events
    meet in one row because its text does.
    """
    log = events.select(
        "conv_id", "message_id", F.col("seq").cast("long").alias("seq"),
        F.lower(F.coalesce("kind", F.lit("delta"))).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")
    folded = log.groupBy("conv_id", "message_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "text", "role"))).alias("events")
    )
    starts = F.transform(
        "events", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i).otherwise(F.lit(0))
    )
    first = F.array_max(starts)
    live = F.slice("events", first + 1, F.size("events"))
    roles = F.filter(F.transform("events", lambda e: e["role"]), lambda r: r.isNotNull())
    return folded.filter(F.element_at("events", -1)["kind"] != "delete").select(
        "conv_id", "message_id", F.element_at("events", 1)["seq"].alias("seq"),
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """Render each conversation: `conv_id, formatted, turn_starts, loss`.

    A turn is `### role: text</turn>` and a line break, role and text escaped. `turn_starts` has the code point at
    which each turn begins; `loss` has (start, length) per turn, the escaped text for turns of role `learn`, length 0
    for others. Turns are ordered by seq; equal ones by role, text and message id.
    """
    head = F.concat(F.lit(TURN_HEAD), escape(F.col("role"), ROLE_MARKS), F.lit(HEAD_END))
    body = escape(F.col("text"))
    turns = messages.select(
        "conv_id", "seq", "role", "text", "message_id", F.concat(head, body, F.lit(TURN_END)).alias("turn"),
        F.char_length(head).alias("head_chars"),
        F.when(F.col("role") == learn, F.char_length(body)).otherwise(0).alias("learned"),
    )
    size = F.char_length("turn").cast("long")
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text", "message_id")
    placed = turns.select(
        "conv_id", "turn", F.row_number().over(order).alias("n"),
        (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).alias("start"), "head_chars", "learned",
    )
    spans = F.struct((F.col("start") + F.col("head_chars")).alias("start"), F.col("learned").cast("long").alias("length"))
    return placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("n", "turn", "start", spans.alias("span")))).alias("turns")
    ).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["start"]).alias("turn_starts"),
        F.transform("turns", lambda t: t["span"]).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse rendered conversations: `conv_id, turns array<struct<role, text, learned>>, formatted_chars`.

    Uses the string and the loss mask only. `learned` is the unescaped text under the mask, empty where there is none.
    """
    pieces = F.split("formatted", TURN_END)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    parts = formatted.select("conv_id", "formatted", "loss", "turn_starts", whole.alias("pieces"))

    def turn(piece: Column, i: Column) -> Column:
        end = F.instr(piece, HEAD_END)  # a colon inside a role has a backslash after it
        role = F.substr(piece, F.lit(len(TURN_HEAD) + 1), end - len(TURN_HEAD) - 1)
        span = F.get("loss", i)
        under = F.substr(piece, (span["start"] - F.get("turn_starts", i) + 1).cast("int"), span["length"].cast("int"))
        return F.struct(
            unescape(role, ROLE_MARKS).alias("role"), unescape(F.substr(piece, end + len(HEAD_END))).alias("text"),
            unescape(under).alias("learned"),
        )

    return parts.select(
        "conv_id", F.transform("pieces", turn).alias("turns"), F.char_length("formatted").cast("long").alias("formatted_chars")
    )


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Finished conversations as a log: every row is one message, said in one delta.

    Rows that share a turn, or are equal in all columns, stay separate messages.
    """
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("seq"), F.monotonically_increasing_id().alias("message_id"),
        F.lit("delta").alias("kind"), "role", "text",
    )


def format_conversations(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Fold a log and render it: `conv_id, formatted, turn_starts, loss`, one row a conversation that has messages.

    A rendered conversation is one string in one row, so its size bounds the largest row; an empty log gives no rows.
    """
    return render(fold_events(events), learn)
