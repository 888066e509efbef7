"""Text operators over reply and conversation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A fenced Python block — three backticks, the word python,
# a line break, the body (lazy, across lines), a line break, three backticks.
CODE_BLOCK_PATTERN = r"(?s)```python\n(.*?)\n```"


def extract_code_blocks(df: DataFrame, text_col: str, out: str = "code",
                        all_blocks: bool = False) -> DataFrame:
    """The first fenced Python block of each text ('' when there is
    none); ``all_blocks=True`` adds ``<out>_all`` with every block."""
    res = df.withColumn(out, F.regexp_extract(F.col(text_col), CODE_BLOCK_PATTERN, 1))
    if all_blocks:
        res = res.withColumn(out + "_all", F.regexp_extract_all(F.col(text_col), F.lit(CODE_BLOCK_PATTERN), 1))
    return res


def chat_context(conversations: DataFrame, system_prompt: str | None = None, question: str | None = None,
                 conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The ordered message list of every conversation in long form:
    ``(conv_id, position, role, text)``, position 0 = system prompt (when
    given), then the turns in order.

    ``question`` is appended to every conversation as a new user message.
    Turns may skip numbers; positions are consecutive.  The window holds one
    row at a time, so a conversation of any length streams through.
    """
    shift = 0 if system_prompt is not None else 1
    place = F.row_number().over(Window.partitionBy(conv_col).orderBy(turn_col, "role", "text"))
    msgs = conversations.select(conv_col, (place - shift).cast("bigint").alias("position"), "role", "text")
    sizes = conversations.groupBy(conv_col).agg(F.count(F.lit(1)).alias("__n"))
    for position, role, text in ((F.lit(0), "system", system_prompt), (F.col("__n") + 1 - shift, "user", question)):
        if text is not None:
            msgs = msgs.unionByName(sizes.select(conv_col, position.cast("bigint").alias("position"),
                                                 F.lit(role).alias("role"), F.lit(text).alias("text")))
    return msgs
