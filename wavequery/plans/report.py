"""Flow 3: predictions -> aligned, parsed, set-compared -> accuracy reports.

JN-3 -> PRJ-8 -> PRJ-9 -> AGG-8 / AGG-9 / AGG-10 (one GROUPING SETS pass) -> JN-7.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from wavequery.operators import evaluate as EV
from wavequery.operators.ordering import Numbered, with_positions
from wavequery.schemas import ATTRIBUTE_TYPES, DETAIL_QUESTION_TYPES, QUESTION_TYPES


def accuracy_report(examples: DataFrame, predictions: DataFrame, key: str = "seq", sep: str = ".",
                    batch_size: int | None = None, drop_last: bool = False) -> dict[str, DataFrame]:
    """All three reports over one scored frame.

    ``drop_last`` with ``batch_size`` reproduces the reference's loader, which never
    evaluates the last ``n mod batch_size`` examples in file order (R12).
    """
    if drop_last and batch_size:
        numbered: Numbered = with_positions(examples, [key], pos="_pos")
        keep = (numbered.total // batch_size) * batch_size
        examples = numbered.df.where(f"_pos < {keep}").drop("_pos")
    scored = EV.mark_correct(EV.attach_predictions(examples, predictions, key, sep))
    return {
        "question_type": EV.accuracy_by(scored, "question_type", QUESTION_TYPES),
        "attribute_type": EV.accuracy_by(scored, "attribute_type", ATTRIBUTE_TYPES, keep_empty=True),
        "detail": EV.accuracy_detail(scored, first_values=DETAIL_QUESTION_TYPES, second_values=ATTRIBUTE_TYPES),
        "scored": scored,
    }
