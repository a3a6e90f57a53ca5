"""Chat formatting with a grammar round trip, in SQL expressions only.

A conversation becomes one text, turn after turn. The grammar::

    conversation = turn*
    turn         = "[INST] " body " [/INST]"        a user's turn
                 | "<s>" body "</s>"                an assistant's turn, under the loss mask
                 | "<<SYS>>" body "<</SYS>>"        a system's turn
                 | "[ROLE " name "]" body "[/ROLE]" any other role, its UTF-8 name in base64
    body         = text without control strings

A control string is one of the marks above (``[ROLE`` stands for all of its kind). A control string whose first character
is followed by backslashes is one that is escaped: the parser takes one backslash away, and escaping adds one.

``formatted`` renders a conversation with its texts as they are, parses the result, and compares the turns that come back
with the source. Texts whose turn does not come back, all of the conversation if it cannot be parsed or has another number of
turns, are escaped, and the conversation is rendered and parsed again, up to ``ROUNDS`` times, until source and
recovered turns are identical. So only texts in conflict are rewritten, and each is escaped once. Three rounds are
enough: by the third all texts of a conversation in conflict are escaped, the parser undoes that for any text, and no
control string reaches over a border, as no mark begins with the rest of a control string or ends with the start of one.
A conversation that still differs stops the job.

Grouping is by conversation, the unit that is put out as one text; it must fit a row. Spans of the loss mask are in code
points of the formatted text.

Defined cases: rows stand by turn, null turns first, ties by role and text; null texts and roles are empty ones; rows
without conversation id are one conversation; an empty table has no conversations; repeated rows are turns of their own;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role, what opens its turns, what closes them.
MARKS = (("user", "[INST] ", " [/INST]"), ("assistant", "<s>", "</s>"), ("system", "<<SYS>>", "<</SYS>>"))
OTHER_OPEN, OTHER_CLOSE = "[ROLE ", "[/ROLE]"
TRAINED = "assistant"
ROUNDS = 3
#: Control strings behind their first character.
INNER = r"INST\]|/INST\]|ROLE |/ROLE\]|s>|/s>|<SYS>>|</SYS>>"
CONTROL = rf"[<\[](?:{INNER})"
#: First character, backslashes, rest.
STUFFED = rf"([<\[])(\\*)({INNER})"
ESCAPED = rf"([<\[])\\(\\*)({INNER})"
NAME = r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"
#: One turn, its body up to the first mark that closes it.
TURN = rf"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<</SYS>>|\[ROLE {NAME}\].*?\[/ROLE\]"
TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:bigint,length:bigint>>"


def escaped(text: Column) -> Column:
    """``text`` with one more backslash in each control string."""
    return F.regexp_replace(text, STUFFED, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _marked(role: Column, body: Column) -> Column:
    name = F.base64(F.encode(role, "UTF-8"))
    other = F.concat(F.lit(OTHER_OPEN), F.regexp_replace(name, r"\s", ""), F.lit("]"), body, F.lit(OTHER_CLOSE))
    out = other
    for known, opens, closes in MARKS:
        out = F.when(role == known, F.concat(F.lit(opens), body, F.lit(closes))).otherwise(out)
    return out


def rendered(turns: Column) -> Column:
    """The text of an array of turns (role, text); texts stand as they are."""
    return F.array_join(F.transform(turns, lambda t: _marked(t.role, t.text)), "")


def _raw_turn(one: Column) -> Column:
    """(role, text, body): a marked turn taken apart; ``body`` is the text as it stands there."""
    name = F.regexp_extract(one, rf"^\[ROLE ({NAME})\]", 1)
    role = F.unbase64(name).cast("string")
    opens, closes = F.octet_length(name) + len(OTHER_OPEN) + 1, F.lit(len(OTHER_CLOSE))
    for known, start, end in MARKS:
        here = F.startswith(one, F.lit(start))
        role = F.when(here, F.lit(known)).otherwise(role)
        opens = F.when(here, F.lit(len(start))).otherwise(opens)
        closes = F.when(here, F.lit(len(end))).otherwise(closes)
    body = F.substring(one, opens + 1, F.char_length(one) - opens - closes)
    return F.struct(role.alias("role"), unescaped(body).alias("text"), body.alias("body"), opens.alias("opens"), F.char_length(one).alias("length"))


def parsed(text: Column) -> Column:
    """Array of (role, text, body, opens, length) of the turns of a formatted text; null if it is not of the grammar."""
    ones = F.regexp_extract_all(text, F.lit(TURN), F.lit(0))
    turns = F.transform(ones, _raw_turn)
    whole = F.array_join(ones, "") == text
    clean = ~F.exists(turns, lambda t: F.regexp_like(t.body, F.lit(CONTROL)))
    return F.when(whole & clean, turns)


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).cast(TURNS)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) from rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))
    in_order = F.sort_array(F.collect_list(F.struct("turn", role, text)))
    return rows.groupBy("conv_id").agg(in_order.alias("turns")).withColumn("turns", _plain(F.col("turns")))


def formatted(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(conv_id, formatted, loss, rounds) of each conversation.

    ``loss``: spans (start, length) of what is trained on, code points from 0; ``rounds``: how often it was rendered.
    """
    state = conversations(rows).withColumns(
        {
            "conflicts": F.transform("turns", lambda _: F.lit(False)),
            "formatted": F.lit(None).cast("string"),
            "found": parsed(F.lit(None).cast("string")),
            "same": F.lit(False),
            "rounds": F.lit(0),
        }
    )
    same = F.col("same")

    def sent(turn: Column, conflict: Column) -> Column:
        return F.struct(turn.role.alias("role"), F.when(conflict, escaped(turn.text)).otherwise(turn.text).alias("text"))

    def differs(turn: Column, i: Column) -> Column:
        back = F.get(F.col("found"), i)
        kept = (F.size("found") == F.size("turns")) & (back.role == turn.role) & (back.text == turn.text)
        return F.get("conflicts", i) | ~F.coalesce(kept, F.lit(False))

    for _ in range(rounds):
        text = rendered(F.zip_with("turns", "conflicts", sent))
        state = state.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(text))
        state = state.withColumn("found", F.when(same, F.col("found")).otherwise(parsed(F.col("formatted"))))
        state = state.withColumn("rounds", F.col("rounds") + (~same).cast("int"))
        state = state.withColumn("same", same | F.coalesce(_plain(F.col("found")) == F.col("turns"), F.lit(False)))
        state = state.withColumn(
            "conflicts", F.when(same, F.col("conflicts")).otherwise(F.transform("turns", differs))
        )
    lost = F.raise_error(F.lit("a conversation does not come back from its formatted text")).cast("string")
    return state.select(
        "conv_id", F.when(same, F.col("formatted")).otherwise(lost).alias("formatted"), _spans(F.col("found")).alias("loss"), "rounds"
    )


def _spans(turns: Column) -> Column:
    """The loss mask of parsed turns."""

    def add(done: Column, turn: Column) -> Column:
        span = F.struct((done.at + turn.opens).alias("start"), F.char_length(turn.body).cast("long").alias("length"))
        more = F.concat(done.spans, F.array(span)).cast(SPANS)
        return F.struct(
            (done.at + turn.length).alias("at"), F.when(turn.role == TRAINED, more).otherwise(done.spans).alias("spans")
        )

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(turns, start, add, lambda done: done.spans)


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) from what was formatted: parsed turns, and all text under the mask, unescaped."""
    lost = F.raise_error(F.lit("a formatted text does not follow the grammar")).cast(TURNS)

    def trained(span: Column) -> Column:
        return unescaped(F.substring(F.col("formatted"), (span.start + 1).cast("int"), span.length.cast("int")))

    return chats.withColumn("found", parsed(F.col("formatted"))).select(
        "conv_id",
        "formatted",
        F.coalesce(_plain(F.col("found")), lost).alias("turns"),
        F.array_join(F.transform("loss", trained), "").alias("loss_text"),
    )
