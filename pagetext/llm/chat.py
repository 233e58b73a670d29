"""Chat formatting (native): a dialogue of several parties, rendered once from every participant's point of view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetext.llm.common import running_totals

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate_perspectives(turns: DataFrame, narrators: Sequence[str] = ("system",), conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Every dialogue from each participant's view, one row per message of a view:
    conv_id, perspective, position, turn, chat_role, name, rendered, start, end, mask_start, mask_end.

    In a view its participant is ``assistant``, every other speaker a ``user`` with a name, and a narrator (``system``) stays itself and is
    nobody's view. ``rendered`` is the message with its markers; joined by ``position`` (from 1) the messages are the whole
    view, in which this one takes characters ``start`` to ``end``. The characters from ``mask_start`` to ``mask_end`` are to be learned: text and end marker of
    the assistant; other messages have null there. Markers inside a text or a speaker's name are broken by
    a space, and line ends in a rendered name are spaces, so that neither can begin a message of its own.

    Messages are ordered by turn, null turns last, equal ones by speaker and text. A null speaker is the participant ``unknown``; a null text is empty;
    rows without a conversation are left out, as are conversations without a participant. Repeated rows are messages each.
    A conversation of any length is spread over tasks; positions and offsets are distributed running totals. Further columns are ignored.
    """
    t = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("name"),
        F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|", "< |").alias("body"))
    narrates = F.col("name").isin(list(narrators))
    views = t.filter(~narrates).select("conv_id", F.col("name").alias("perspective")).distinct()
    each = t.join(views, "conv_id").withColumn("chat_role", F.when(narrates, F.lit("system")).when(F.col("name") == F.col("perspective"), F.lit("assistant")).otherwise("user"))
    shown = F.regexp_replace(F.regexp_replace("name", r"<\|", "< |"), r"[\r\n]", " ")
    named = F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), shown)).otherwise("")
    head = F.concat(F.lit(OPEN), "chat_role", named, F.lit("\n"))
    each = each.withColumn("rendered", F.concat(head, "body", F.lit(CLOSE + "\n"))).withColumn("__head", F.length(head).cast("long"))
    each = each.withColumn("__last", F.col("turn").isNull()).withColumn("__n", F.length("rendered").cast("long"))
    placed = running_totals(each, ["conv_id", "perspective"], ["__last", "turn", "name", "body"], {"position": F.lit(1).cast("long"), "end": F.col("__n")})
    placed = placed.withColumn("start", F.col("end") - F.col("__n"))
    learns = F.col("chat_role") == "assistant"
    return placed.select("conv_id", "perspective", "position", "turn", "chat_role", "name", "rendered", "start", "end",
                         F.when(learns, F.col("start") + F.col("__head")).alias("mask_start"), F.when(learns, F.col("end") - 1).alias("mask_end"))


CHAT_SQL = r"""with t as (select conv_id, turn, coalesce(role, 'unknown') as name, replace(coalesce(text, ''), '<|', '< |') as body from conversations where conv_id is not null),
v as (select distinct conv_id, name as perspective from t where name <> 'system'),
e as (select t.*, v.perspective, case when name = 'system' then 'system' when name = perspective then 'assistant' else 'user' end as chat_role from t join v using (conv_id)),
h as (select *, '<|im_start|>' || chat_role || case when chat_role = 'user' then ' name=' || translate(replace(name, '<|', '< |'), chr(13) || chr(10), '  ') else '' end || chr(10) as head from e),
r as (select *, head || body || '<|im_end|>' || chr(10) as rendered from h),
p as (select *, row_number() over w as position, (sum(length(rendered)) over w)::bigint as "end" from r
 window w as (partition by conv_id, perspective order by turn nulls last, name, body rows unbounded preceding))
select conv_id, perspective, position, turn, chat_role, name, rendered, "end" - length(rendered) as start, "end",
 case when chat_role = 'assistant' then "end" - length(rendered) + length(head) end as mask_start, case when chat_role = 'assistant' then "end" - 1 end as mask_end from p"""
