"""Flow 1: annotations -> ordered list -> batches -> in-batch agreement.

SRC-1 -> AGG-1 || TOP-1 -> TOP-4 -> WIN-1 -> FLT-3 -> JN-2 -> JN-1 -> PRJ-10.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from wavequery.operators import ordering as O
from wavequery.operators import qa as Q
from wavequery.schemas import DEFAULT_SEED


@dataclass
class Prepared:
    ordered: DataFrame  # input rows + pos
    total: int
    lookup: DataFrame


def number_examples(qa: DataFrame, mode: str = "grouped", seed: int = DEFAULT_SEED, group: str = "question",
                    key: str = "seq") -> O.Numbered:
    """Number all examples in the chosen order (before any limit)."""
    if mode == "grouped":
        return O.seeded_positions(qa, seed, key, group)
    if mode == "global":
        return O.seeded_positions(qa, seed, key)
    if mode == "file":
        joined, order = O.file_order(qa, group, key)
        numbered = O.with_positions(joined, order)
        return O.Numbered(numbered.df.drop("_first_seq"), numbered.total)
    raise ValueError(f"unknown order mode {mode!r}")


def order_examples(qa: DataFrame, mode: str = "grouped", seed: int = DEFAULT_SEED, num_data: int | None = None,
                   group: str = "question", key: str = "seq") -> O.Numbered:
    """Number the examples: ``grouped`` (TOP-1, train/valid), ``global`` (TOP-2, test), ``file`` (TOP-3, no shuffle).

    Then TOP-4: keep the first ``num_data`` (0/None = all). The lookup is always built
    from the whole input, before the limit (the reference applies the limit after).
    """
    return O.take_first(number_examples(qa, mode, seed, group, key), num_data)


def prepare(qa: DataFrame, mode: str = "grouped", seed: int = DEFAULT_SEED, num_data: int | None = None) -> Prepared:
    # the lookup covers the whole input (the limit comes after it) and is built from the
    # checkpointed numbered rows, so the input is not recomputed for it
    numbered = number_examples(qa, mode, seed)
    lookup = Q.lookup_last_wins(numbered.df.drop("pos"))
    limited = O.take_first(numbered, num_data)
    return Prepared(limited.df, limited.total, lookup)


def batches_and_lookup(qa: DataFrame, batch_size: int = 32, mode: str = "grouped", seed: int = DEFAULT_SEED,
                       num_data: int | None = None, drop_last: bool = True) -> tuple[DataFrame, DataFrame]:
    prep = prepare(qa, mode, seed, num_data)
    return Q.assign_batches(O.Numbered(prep.ordered, prep.total), batch_size, drop_last), prep.lookup


def training_batches(qa: DataFrame, batch_size: int = 32, mode: str = "grouped", seed: int = DEFAULT_SEED,
                     num_data: int | None = None, drop_last: bool = True) -> tuple[DataFrame, DataFrame]:
    """Returns (batched rows, pair scores)."""
    batched, lookup = batches_and_lookup(qa, batch_size, mode, seed, num_data, drop_last)
    return batched, Q.pair_scores(batched, lookup)


def training_score_matrices(qa: DataFrame, batch_size: int = 32, mode: str = "grouped", seed: int = DEFAULT_SEED,
                            num_data: int | None = None, drop_last: bool = True) -> DataFrame:
    """(batch_id, matrix): each batch's B x B agreement matrix, built from row vectors."""
    batched, lookup = batches_and_lookup(qa, batch_size, mode, seed, num_data, drop_last)
    return Q.matrix_from_rows(Q.pair_score_rows(batched, lookup))
