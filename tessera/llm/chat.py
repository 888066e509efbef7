"""Chat formatting with typed content parts.

A visitor walks the parts of a turn in order.  Text is escaped and kept; an
image, audio or document part becomes a placeholder that names its type and
its place among the turn's attachments, and its reference and the number of
tokens it will expand to are recorded beside the formatted text.

Format of a turn, the only places where ``<`` and ``>`` stand:

    <turn ROLE>\\n CONTENT </turn>\\n          placeholders: <image 0> <audio 1> ...

Inside texts and roles ``\\`` is written ``\\b``, ``<`` ``\\l`` and ``>``
``\\g``, so no text can forge a mark and undoing it is exact.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
PARTS = "array<struct<type:string,text:string,ref:string,size:long>>"
#: Tokens that a part expands to, from its ``size``.
#: image: pixels, one token a 28 x 28 patch; audio: milliseconds, one token
#: for 40; document: bytes, one token for 4.  At least one each.
TOKENS_PER = {"image": 784, "audio": 40, "document": 4}
DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
TURN = re.compile(r"\A<turn ([^<>]*)>\n(.*)</turn>\n\Z", re.S)


def escape(col: Column) -> Column:
    for raw, safe in ESCAPES:
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def unescape(text: str) -> str:
    """Every backslash in escaped text starts an escape, so plain replacement
    in reverse order is exact."""
    for raw, safe in reversed(ESCAPES):
        text = text.replace(safe, raw)
    return text


def _visit(part: Column, ordinal: Column) -> Column:
    """struct(shown, type, ref, tokens) of one part; an unknown type or null
    part shows nothing."""
    words = F.size(F.filter(F.split(F.coalesce(part["text"], F.lit("")), r"\s+"), lambda w: w != ""))
    shown, tokens = F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))), \
        F.when(part["type"] == "text", words.cast("long"))
    for kind, per in TOKENS_PER.items():
        shown = shown.when(part["type"] == kind, F.concat(F.lit(f"<{kind} "), ordinal.cast("string"), F.lit(">")))
        tokens = tokens.when(part["type"] == kind, F.greatest(
            F.lit(1), F.ceil(F.coalesce(part["size"], F.lit(0)) / per)).cast("long"))
    return F.struct(F.coalesce(shown, F.lit("")).alias("shown"), part["type"].alias("type"),
                    part["ref"].alias("ref"), F.coalesce(tokens, F.lit(0)).alias("tokens"))


def is_attachment(kind: Column) -> Column:
    return F.coalesce(kind.isin(*TOKENS_PER), F.lit(False))


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row per turn: (conv_id, turn, formatted, attachments, n_tokens, loss_start, loss_end).

    ``attachments`` are (ordinal, type, ref, tokens) in order; ``n_tokens``
    counts words of text and the expansion of every attachment.  The loss
    mask covers code points [loss_start, loss_end) of ``formatted``: the
    content of turns of ``loss_role``, nothing elsewhere (both 0).  A
    conversation's formatted text is its turns' in order of turn (nulls
    first, then role and text); it needs no shuffle to make, so one endless
    conversation is no hot group.  Null parts or no parts: empty content; a
    null role: an empty role.  An empty table gives no row.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(parts_col).cast(PARTS), F.array().cast(PARTS)).alias("parts"))
    before = F.transform("parts", lambda _, i: F.size(F.filter(
        F.slice("parts", F.lit(1), i), lambda p: is_attachment(p["type"]))))
    rows = rows.withColumn("before", before) \
        .withColumn("seen", F.zip_with("parts", "before", _visit)) \
        .withColumn("content", F.array_join(F.transform("seen", lambda s: s["shown"]), "")) \
        .withColumn("head", F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">\n")))
    spoken = F.col("role") == loss_role
    return rows.select(
        "conv_id", "turn",
        F.concat("head", "content", F.lit("</turn>\n")).alias("formatted"),
        F.transform(F.filter(F.arrays_zip("seen", "before"), lambda z: is_attachment(z["seen"]["type"])),
                    lambda z: F.struct(z["before"].alias("ordinal"), z["seen"]["type"].alias("type"),
                                       z["seen"]["ref"].alias("ref"), z["seen"]["tokens"].alias("tokens")))
        .alias("attachments"),
        F.aggregate("seen", F.lit(0).cast("long"), lambda n, s: n + s["tokens"]).alias("n_tokens"),
        F.when(spoken, F.length("head")).otherwise(0).alias("loss_start"),
        F.when(spoken, F.length("head") + F.length("content")).otherwise(0).alias("loss_end"))


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, content) of a formatted turn, unescaped."""
    role, content = TURN.match(formatted).groups()
    return unescape(role), unescape(content)


def _unescaped(col: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        col = F.replace(col, F.lit(safe), F.lit(raw))
    return col


def _digests(batches):
    """Rows ordered by conversation stream through; only the digests of the
    current conversation are held, however long it is."""
    now, key, out = None, object(), []

    def ended():
        turns, loss, n, loss_chars, chars = now
        return (key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

    for pdf in batches:
        for conv, formatted, a, b in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_start"], pdf["loss_end"]):
            if now is None or conv != key:
                if now is not None:
                    out.append(ended())
                now, key = [hashlib.sha256(), hashlib.sha256(), 0, 0, 0], conv
            role, content = read_turn(formatted)
            spoken = unescape(formatted[a:b])
            now[0].update(f"{role}\n{content}\n".encode())
            now[1].update(spoken.encode())
            now[2] += 1
            now[3] += len(spoken)
            now[4] += len(formatted)
        yield pd.DataFrame(out, columns=DIGESTS)
        out = []
    if now is not None:
        yield pd.DataFrame([ended()], columns=DIGESTS)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read from the formatted turns only.

    Sorting brings a conversation's turns together and in order (turn, nulls
    first, then role and text as they were); a digest of an ordered text is
    sequential, so one task streams it, holding one batch.  Rows of a null
    conversation are one conversation; an empty table gives no row.
    """
    said = [_unescaped(F.regexp_extract("formatted", r"(?s)\A<turn ([^>]*)>\n(.*)</turn>\n\z", g)) for g in (1, 2)]
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), *said) \
        .select(F.col("conv_id").cast("string"), "formatted", "loss_start", "loss_end") \
        .mapInPandas(_digests, "conv_id string, n_turns long, turns_sha256 string, loss_chars long, "
                               "loss_sha256 string, formatted_chars long") \
        .withColumn("conv_id", F.col("conv_id").cast("long"))


def text_part(text: Column) -> Column:
    """A parts column that holds one text part (null text: an empty one)."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size")))
