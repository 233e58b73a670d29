"""Volume-level terminology plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetext.functions import text as tx
from pagetext.operators import terms as M
from pagetext.operators.prefix import prefix_scan


def audit_volume(ledger: DataFrame, glossary: DataFrame, candidates: DataFrame, pattern: str = tx.KATAKANA_RUN,
                 stop: Sequence[str] = M.SOUND_WORDS) -> DataFrame:
    """Audit, vote and the suggested standard: the glossary target, else the winner of the vote."""
    audit = M.audit_terms(M.term_occurrences(ledger, glossary, pattern, stop), glossary)
    vote = M.vote_terms(candidates).select("entity", "winner", "conflict")
    return audit.join(vote, "entity", "left").select("entity", "occurrences", "pages", "target", "winner", "conflict", F.coalesce("target", "winner").alias("standard"))


def harmonise(ledger: DataFrame, audit: DataFrame, candidates: DataFrame) -> DataFrame:
    """Replace losing translations of conflicting entities by the standard one, longest first (then by text)."""
    pairs = (candidates.select("entity", "candidate").distinct().join(audit.filter("conflict").select("entity", "standard"), "entity")
             .filter(F.col("candidate") != F.col("standard")).groupBy("candidate", "standard").agg(F.lit(0).alias("k")))
    order = [F.length("candidate").desc(), F.col("candidate"), F.col("standard")]
    return M.apply_terms(ledger, prefix_scan(pairs, ["k"], order, number="at").withColumnsRenamed({"candidate": "old", "standard": "new"}))
