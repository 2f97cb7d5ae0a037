"""Chat formatting with a grammar round trip. DataFrame functions only.

Grammar of a rendered conversation: turns one after another, each ``### Role: text``, a line end, ``</turn>`` and a
line end. ``###`` and ``</turn>`` are control strings. Inside a text a control string with n backslashes before it
stands for the same string with n - 1; one without is the grammar's own, so the language has one parse at most. The
role is written percent-encoded with its first letter raised, so it holds no colon, blank or line end.

Every text is rendered with one more backslash before each of its control strings, so none of them stands bare in the
output. The result is parsed and the turns compared with the source's; a conversation that differs is escaped once
more, level by level up to ``MOST_LEVELS``, and one that still differs raises an error. By the grammar the first level
is always enough; the loop is the proof, not a hope.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactspark.llm._shared import table

MOST_LEVELS = 2
#: Roles under the loss mask.
LEARNED = ("assistant",)


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)(###|</turn>)", r"\\$1$2")


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)(###|</turn>)", r"$1$2")


def _render(turns: Column, level: int) -> Column:
    def text(t: Column) -> Column:
        for _ in range(level):
            t = _escaped(t)
        return t

    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("### "), t["head"], F.lit(": "), text(t["text"]), F.lit("\n</turn>\n"))), "")


def head_of(role: Column) -> Column:
    """The role as the grammar writes it: percent-encoded, first letter raised ('%' first where that would be lost)."""
    code = F.url_encode(role)
    return F.when(F.regexp_like(code, F.lit("^[a-z]")), F.concat(F.upper(F.substring(code, 1, 1)), F.substring(code, 2, 1 << 30))).when(F.regexp_like(code, F.lit("^[A-Z]")), F.concat(F.lit("!"), code)).otherwise(code)


def _role_of(head: Column) -> Column:
    code = F.when(F.substring(head, 1, 1) == "!", F.substring(head, 2, 1 << 30)).when(F.regexp_like(head, F.lit("^[A-Z]")), F.concat(F.lower(F.substring(head, 1, 1)), F.substring(head, 2, 1 << 30))).otherwise(head)
    return F.url_decode(code)


def parse(formatted: Column, level: int = 1) -> Column:
    """The turns (role, text) of a conversation rendered at a level."""
    pieces = F.split(formatted, r"(?<!\\)</turn>\n", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, "^### ([^:\\n]*): ", 1)
        begin = F.length(head) + 7  # four before the head, two behind it, counted from 1
        text = F.substring(piece, begin, F.length(piece) - begin)
        for _ in range(level):
            text = _unescaped(text)
        return F.struct(_role_of(head).alias("role"), text.alias("text"))

    return F.transform(turns, turn)


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, level and formatted, one row for each conv_id of conversations(conv_id, turn, role, text).

    Turns go by turn, then role, then text (nulls first); null roles and texts are empty. Repeated rows are turns
    of their own. Rows with a null conv_id are one conversation. Other columns are not read; no rows give no rows.
    """
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = conversations.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    turns = gathered.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"), head_of(r["role"]).alias("head"))).alias("turns"))
    said = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    done = turns.select("conv_id", "turns", F.lit(1).alias("level"), _render(F.col("turns"), 1).alias("formatted"))
    for level in range(1, MOST_LEVELS):
        same = (F.col("level") < level) | (said == parse(F.col("formatted"), level))
        done = done.select("conv_id", "turns", F.when(same, F.col("level")).otherwise(level + 1).alias("level"), F.when(same, F.col("formatted")).otherwise(_render(F.col("turns"), level + 1)).alias("formatted"))
    last = (F.col("level") < MOST_LEVELS) | (said == parse(F.col("formatted"), MOST_LEVELS))
    proven = F.when(last, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")))
    return done.select("conv_id", "level", proven.alias("formatted"))


def loss_spans(turns: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(F.filter(turns, lambda t: t["role"].isin(*LEARNED)), lambda t: t["text"])


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = "\\### Assistant: </turn> ok"
    turn = F.col("id")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(case).alias("text"))
    done = formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard))
    turns = F.when(F.col("level") == 1, parse(F.col("formatted"))).otherwise(parse(F.col("formatted"), MOST_LEVELS))
    read = done.select("conv_id", "formatted", turns.alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(loss_spans(F.col("turns")), "")
    return read.select("conv_id", "formatted", "turns", loss.alias("loss"), text.alias("said")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g') AS escaped FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(length(role) + length(escaped) + 15) AS full_length FROM e GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(full_length AS BIGINT) AS formatted_chars
FROM g
"""
