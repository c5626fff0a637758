"""Chat formatting from an event log, with native expressions alone.

Events of a conversation are dealt out by pages of turns, sorted by sequence and folded into final
messages; each page is rendered on its own.  A conversation's formatted text is its pages in order, so
no task needs a whole conversation, however long.

Template: ``<s>role\\ntext</s>`` per message.  In roles and texts a backslash becomes ``\\e``, ``<``
becomes ``\\l`` and ``[`` becomes ``\\b`` (in roles also a line break ``\\n``), so no control string
can come from a text, and every escape reads back as one character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, BREAK = "<s>", "</s>", "\n"
TRAINED_ROLE = "assistant"
PAGE_TURNS = 64

# Events that set a message's text anew; a delta appends to it.
MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"
_RESETS = (MESSAGE, EDIT, REGENERATE)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    # Each backslash of an escaped text begins an escape, so the last step alone yields backslashes.
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(BREAK), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit(BREAK)))


def as_events(conversations: DataFrame) -> DataFrame:
    """Every row of ``conversations`` (conv_id, turn, role, text) as a message event at its turn."""
    turn = F.col("turn").cast("long")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), turn.alias("seq"),
        F.lit(MESSAGE).alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def _messages(events: Column) -> Column:
    """Final messages of one turn from its sorted events.

    A message event opens a message, as does the first event whatever its kind; later events change the
    last one opened.  The text is what the last reset set, and the deltas after it.
    """
    indexes = F.sequence(F.lit(1), F.size(events))
    kind = lambda i: F.element_at(events, i)["kind"]
    opens = F.filter(indexes, lambda i: (i == 1) | (kind(i) == MESSAGE))

    def final(at: Column, no: Column) -> Column:
        end = F.coalesce(F.get(opens, no + 1), F.size(events) + 1)
        resets = F.filter(F.sequence(at, end - 1), lambda i: kind(i).isin(*_RESETS))
        begin = F.coalesce(F.array_max(resets), at)
        pieces = F.transform(F.slice(events, begin, end - begin), lambda e: F.coalesce(e["text"], F.lit("")))
        return F.struct(F.coalesce(F.element_at(events, at)["role"], F.lit("")).alias("role"), F.array_join(pieces, "").alias("text"))

    return F.transform(opens, final)


def format_pages(events: DataFrame) -> DataFrame:
    """``conv_id, page, n_messages, text, spans``: rendered pages and the assistant's spans in them.

    ``events`` has conv_id, turn, seq, kind (message, delta, edit, regenerate), role and text.  Events
    of a turn are ordered by seq; equal seqs by message events first, then kind, role and text.  Null texts and
    roles are empty; null conv_ids form one conversation; null turns are one page, before all others;
    other columns are not read; no events give no pages.  A span is (start, length) in code points
    from the page's start, over the escaped text of an assistant's message.
    """
    page = F.floor(F.col("turn") / PAGE_TURNS).alias("page")
    rows = events.select("conv_id", page, "turn", F.struct(
        "seq", (F.col("kind") != MESSAGE).alias("later"), "kind", "role", "text").alias("event"))
    turns = (rows.repartition("conv_id", "page").groupBy("conv_id", "page", "turn")
             .agg(F.sort_array(F.collect_list("event")).alias("events"))
             .select("conv_id", "page", "turn", _messages(F.col("events")).alias("messages")))
    pages = turns.groupBy("conv_id", "page").agg(F.sort_array(F.collect_list(F.struct("turn", "messages"))).alias("turns"))
    parts = F.transform(F.flatten(F.col("turns.messages")), lambda m: F.struct(
        F.concat(F.lit(OPEN), escape_role(m["role"]), F.lit(BREAK)).alias("head"),
        escape(m["text"]).alias("body"), (m["role"] == TRAINED_ROLE).alias("trained")))
    pages = pages.select("conv_id", "page", parts.alias("parts"))
    sizes = F.transform("parts", lambda p: F.struct(
        F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["trained"].alias("trained")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def place(acc: Column, s: Column) -> Column:
        span = F.struct((acc["at"] + s["head"]).alias("start"), s["body"].alias("length"))
        return F.struct((acc["at"] + s["head"] + s["body"] + len(CLOSE)).alias("at"),
                        F.when(s["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return pages.select("conv_id", "page", F.size("parts").cast("long").alias("n_messages"), text.alias("text"),
                        F.aggregate(sizes, begin, place, lambda acc: acc["spans"]).alias("spans"))


def read_messages(text: Column) -> Column:
    """The messages (role, text) that a formatted text holds."""
    marked = F.filter(F.split(text, CLOSE, -1), lambda m: m != "")
    head = lambda m: F.substring_index(m, BREAK, 1)
    return F.transform(marked, lambda m: F.struct(
        unescape_role(F.substr(head(m), F.lit(len(OPEN) + 1))).alias("role"),
        unescape(F.substr(m, F.length(head(m)) + len(BREAK) + 1)).alias("text")))


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["length"]))), "")


def digests(pages: DataFrame) -> DataFrame:
    """Per conversation, read back from its pages: counts and hashes of its turns and of its trained text.

    A hash of a whole conversation needs its text in one row; pages are joined here only.
    """
    turns = F.array_join(F.transform(read_messages(F.col("text")), lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    read = pages.select("conv_id", "page", F.size(read_messages(F.col("text"))).cast("long").alias("n"), turns.alias("turns"),
                        masked_text(F.col("text"), F.col("spans")).alias("loss"), F.length("text").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list(F.struct("page", "turns", "loss"))).alias("pages"),
        F.sum(F.length("loss").cast("long")).alias("loss_chars"), F.sum("chars").alias("formatted_chars"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("pages.turns", ""), 256).alias("turns_sha256"), "loss_chars",
        F.sha2(F.array_join("pages.loss", ""), 256).alias("loss_sha256"), "formatted_chars")
