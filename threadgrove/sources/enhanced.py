"""Scored pairs with probabilities, noise fields and carried history, as a partitioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from threadgrove.plans.rounds import carry_history, write_round


def enhanced_pairs(scored: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """The scored pairs with the history columns of the previous table, by `sample_index`."""
    return carry_history(scored, previous)


def write_enhanced(scored: DataFrame, path: str, round_num: int, previous: DataFrame | None = None,
                   variant: str = "main") -> None:
    """Write one partition; a copy for noise evaluation is the variant 'noise_eval'."""
    write_round(enhanced_pairs(scored, previous), path, round_num, variant)
