"""Chat formatting from an event log, with built-in functions only.

Events of a conversation are ordered by ``seq``. ``delta`` appends to its message, ``edit`` and ``regenerate`` start the
message anew with their own text and void what later turns had got before. The folded messages are rendered by turn with
marks; strings of the template inside a text are escaped so that the output can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "conv_id, turn, part, seq, role, op, text"
RESETS = ("edit", "regenerate")

OPEN, CLOSE, HEAD_END = "### ", "</turn>", ":\n"
# every backslash of an escaped text starts one of these codes, so they can be undone one after the other
CODES = (("\\", "\\b"), (OPEN, "\\h "), (CLOSE, "\\t"))
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
TURNS_A_CHUNK = 64


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


ROLE_CODES = (*CODES, ("\n", "\\n"))


def heading(role: Column) -> Column:
    """Known roles by name; others, null as empty, escaped behind an equals sign."""
    name = F.concat(F.lit("="), escape(F.coalesce(role, F.lit("")), ROLE_CODES))
    for known, shown in NAMES.items():
        name = F.when(role == known, shown).otherwise(name)
    return F.concat(F.lit(OPEN), name, F.lit(HEAD_END))


def role_of_heading(name: Column) -> Column:
    role = unescape(F.substring(name, 2, 1 << 30), ROLE_CODES)
    for known, shown in NAMES.items():
        role = F.when(name == shown, known).otherwise(role)
    return role


def message_events(conversations: DataFrame, *, piece: int = 400) -> DataFrame:
    """The event log of finished messages (conv_id, turn, role, text): each streamed in pieces.

    A user's message is first logged without its end and then edited, an assistant's is first logged in full and then
    regenerated; the fold must come back to the given text. Rows that share a turn are messages of their own, in order of
    role and text. Null texts are empty.
    """
    place = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role",
                                F.coalesce("text", F.lit("")).alias("text")).withColumn("part", F.row_number().over(place))
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.char_length("text") - 1, F.lit(0)) / piece).cast("int")),
        lambda i: F.struct(
            F.when(i > 0, "delta").when(F.col("role") == "assistant", "regenerate").otherwise("edit").alias("op"),
            F.substring(F.col("text"), i * piece + 1, F.lit(piece)).alias("text")))
    first = F.array(F.struct(F.lit("delta").alias("op"), F.substring("text", 1, piece).alias("text")))
    logged = rows.select("conv_id", "turn", "part", "role", F.posexplode(F.concat(first, pieces)).alias("at", "event"))
    return logged.select("conv_id", "turn", "part",
                         F.struct(F.col("turn").isNull().alias("none"), "turn", "part", "at").alias("seq"), "role", "event.op", "event.text")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, part, role, text) of the final messages.

    Events: conv_id, turn, part (message of the turn), seq (any type that has an order), role, op, text. Null texts add
    nothing; the role is that of the message's first event. Events before their message's last edit or regeneration, or
    before one in an earlier turn, are void; a message with no valid event is gone. Only resets are gathered by
    conversation; texts meet by message.
    """
    at = ["conv_id", "turn", "part"]
    resets = events.filter(F.col("op").isin(*RESETS)).groupBy(*at).agg(F.max("seq").alias("reset"))
    # the last reset of all earlier turns
    by_turn = events.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("op").isin(*RESETS), F.col("seq"))).alias("own"))
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    by_turn = by_turn.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.max("own").over(before).alias("cut"))
    resets = resets.select(*[F.col(x).alias(x[0]) for x in at], "reset")
    valid = events.join(resets, events["conv_id"].eqNullSafe(resets["c"]) & events["turn"].eqNullSafe(resets["t"])
                        & events["part"].eqNullSafe(resets["p"]), "left").drop("c", "t", "p")
    valid = valid.join(by_turn, valid["conv_id"].eqNullSafe(by_turn["c"]) & valid["turn"].eqNullSafe(by_turn["t"]), "left")
    valid = valid.filter((F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
                         & (F.col("cut").isNull() | (F.col("seq") > F.col("cut"))))
    whole = valid.groupBy(*at).agg(F.min_by("role", "seq").alias("role"),
                                   F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text")))).alias("all"))
    return whole.select(*at, "role", F.array_join(F.col("all")["text"], "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row a conversation, by turn and part, null turns last.

    ``loss`` has a span (turn, start, length) for each assistant text: the turn's number in the output from 0 and code
    points from the start of that turn. Turns are first joined in chunks of their numbers and then chunks by conversation,
    so that a long conversation comes together from a few rows.
    """
    head, body = heading(F.col("role")), escape(F.coalesce("text", F.lit("")))
    rows = messages.select(
        "conv_id", "turn", "part", F.floor(F.col("turn") / TURNS_A_CHUNK).alias("chunk"),
        F.concat(head, body, F.lit(CLOSE + "\n")).alias("shown"),
        F.when(F.col("role") == "assistant", F.struct(F.char_length(head).alias("start"), F.char_length(body).alias("length"))).alias("span"))
    def by(*keys):
        """Sort by keys, nulls last, in any struct order."""
        return [x for k in keys for x in (F.col(k).isNull().alias(f"{k}_none"), F.col(k).alias(k))]
    chunks = rows.groupBy("conv_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct(*by("turn", "part"), "shown", "span"))).alias("all"))
    chunks = chunks.select("conv_id", "chunk", F.array_join(F.col("all")["shown"], "").alias("shown"),
                           F.col("all")["span"].alias("spans"))
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*by("chunk"), "shown", "spans"))).alias("all"))
    spans = F.flatten(F.col("all")["spans"])
    numbered = F.transform(spans, lambda s, i: F.struct(i.alias("turn"), s["start"].alias("start"), s["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.col("all")["shown"], "").alias("formatted"),
                        F.filter(numbered, lambda s: s["start"].isNotNull()).alias("loss"))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    def turn(x: Column) -> Column:
        name = F.substring_index(x, HEAD_END, 1)
        text = F.substr(x, F.char_length(name) + len(HEAD_END) + 1)
        return F.struct(role_of_heading(F.substring(name, len(OPEN) + 1, 1 << 30)).alias("role"), unescape(text).alias("text"))
    return F.transform(turns_of(formatted), turn)


def turns_of(formatted: Column) -> Column:
    """The turns as they stand in the output, without their end marks."""
    return F.slice(F.split(formatted, CLOSE + "\n"), 1, F.size(F.split(formatted, CLOSE + "\n")) - 1)


def masked_text(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    turns = turns_of(formatted)
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(F.element_at(turns, s["turn"] + 1), s["start"] + 1, s["length"]))), "")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) of finished messages by way of their event log.

    Null texts are empty, null roles are the empty role, null turns come last, rows without conv_id are one conversation.
    Rows that repeat are turns of their own. An empty table gives an empty result; other columns are not read.
    """
    return render(fold_events(message_events(conversations)))


def summary(shown: DataFrame) -> DataFrame:
    """Counts and digests read back from the output of ``render``."""
    said = F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (shown.withColumn("turns", parse(F.col("formatted"))).withColumn("learned", masked_text(F.col("formatted"), F.col("loss")))
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
                    F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                    F.char_length("formatted").cast("long").alias("formatted_chars")))
