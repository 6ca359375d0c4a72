"""Review candidate table: baseline, specialists, adjustments, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barloom.functions.ordering import with_global_rank
from barloom.operators.predictions import by_score, join_specialists, prepare_baseline, prepare_specialist, review_order
from barloom.operators.review import apply_adjustments


def build_review_candidates(
    baseline: dict,
    specialists: list[dict],
    bars: DataFrame,
    adjustments: dict | None = None,
    *,
    asof_date: str | None = None,
    primary: str = "adjusted_score",
    output_top_n: int = 0,
) -> DataFrame:
    """Baseline rows with specialist passes, adjusted scores and a review rank.

    ``baseline`` and each specialist give ``predictions``, ``name``, ``score_col`` and optionally ``order``, ``top_n``
    and, for specialists, ``pass_rank`` (default: top_n).
    """
    score = baseline.get("score_col", "score_mean")
    out = prepare_baseline(
        baseline["predictions"], baseline.get("name", "baseline"), score, baseline.get("order") or by_score(score), asof_date, baseline.get("top_n", 0)
    )
    if out.isEmpty():
        raise ValueError("no baseline predictions left")
    ready = {}
    for s in specialists:
        col, top = s.get("score_col", "score_mean"), s.get("top_n", 0)
        ready[s["name"]] = prepare_specialist(
            s["predictions"], s["name"], col, s.get("order") or by_score(col), s.get("pass_rank", top), asof_date, top
        )
    out = join_specialists(out, ready)
    out = apply_adjustments(out, bars, adjustments or {})
    key = primary if primary in out.columns else "baseline_score"
    ranked = with_global_rank(out, review_order(key), "review_rank")
    return ranked.where(f"review_rank <= {output_top_n}") if output_top_n > 0 else ranked
