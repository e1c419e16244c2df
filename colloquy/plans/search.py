"""Substring search with a snippet around the first hit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import table
from .registry import register


def snippet(text: Column, term: str, around: int = 100, without: int = 200) -> Column:
    """``around`` characters on both sides of the first hit with ellipses; without a hit the first ``without`` characters."""
    at = F.instr(F.lower(text), term.lower())
    start = F.greatest(at - F.lit(around), F.lit(1))
    end = F.least(at + F.lit(len(term) + around), F.length(text) + 1)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, without))


def search_snippet(spark, sf_dir, term: str = "thing"):
    turns = table(spark, sf_dir, "conversations")
    hits = turns.where(F.contains(F.lower("text"), F.lit(term.lower())) & F.lit(term.strip() != ""))  # a blank term finds nothing
    return hits.select("conv_id", "turn", snippet(F.col("text"), term).alias("snippet"))


register(
    "search_snippet",
    search_snippet,
    """
with hit as (
  select conv_id, turn, text, instr(lower(text), 'thing') as hit_at from conversations where contains(lower(text), 'thing')
), cut as (
  select *, greatest(hit_at - 100, 1) as cut_from, least(hit_at + 105, length(text) + 1) as cut_to from hit
)
select conv_id, turn,
       case when cut_from > 1 then '...' else '' end || substring(text, cut_from, cut_to - cut_from)
       || case when cut_to <= length(text) then '...' else '' end as snippet
from cut
""",
)
