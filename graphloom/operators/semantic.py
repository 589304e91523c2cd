"""Scores of a user's own model over the pool of a ranking: bounded, checked, and without effect if anything is wrong."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieve import pool_size, rerank

# Bounds of a provider.
MAX_CANDIDATES, MAX_WEIGHT, MIN_TIMEOUT_MS, MAX_TIMEOUT_MS = 64, 0.35, 100, 10_000


def checked_scores(sent: list[dict], got: object) -> list[tuple[str, float]]:
    """Scores by path, if they name each candidate once with a number of 0 to 1."""
    rows = [(x["path"], float(x["score"])) for x in got]
    if sorted(p for p, _ in rows) != sorted(x["path"] for x in sent):
        raise ValueError("scores must name each candidate once")
    if any(not math.isfinite(s) or not 0 <= s <= 1 for _, s in rows):
        raise ValueError("scores are 0 to 1")
    return rows


def refine(ranked: DataFrame, task: str, provider: Callable[[str, list[dict]], list[dict]], *, weight: float = 0.25, limit: int = 12, timeout_ms: int = 1500) -> tuple[DataFrame, dict]:
    """ranked (path, rank, final, reasons) with the pool's places by the provider's scores, and what became of it.

    The pool (64 rows at most) is all that the driver sees. A provider that fails, is late or answers wrongly changes nothing.
    """
    if not 0 <= weight <= MAX_WEIGHT or not MIN_TIMEOUT_MS <= timeout_ms <= MAX_TIMEOUT_MS:
        raise ValueError(f"weight is 0 to {MAX_WEIGHT}, timeout_ms {MIN_TIMEOUT_MS} to {MAX_TIMEOUT_MS}")
    size = pool_size(ranked.count(), limit)
    sent = [{"path": r.path, "score": r.final, "reasons": list(r.reasons)} for r in ranked.filter(F.col("rank") <= size).orderBy("rank").select("path", "final", "reasons").collect()]
    worker = ThreadPoolExecutor(1)
    try:
        rows = checked_scores(sent, worker.submit(provider, task, sent).result(timeout_ms / 1000))
    except TimeoutError:
        return ranked, {"status": "fallback", "error": "timeout"}
    except Exception as e:
        return ranked, {"status": "fallback", "error": type(e).__name__}
    finally:
        worker.shutdown(wait=False, cancel_futures=True)
    scores = ranked.sparkSession.createDataFrame(rows, "path string, semantic_score double")
    return rerank(ranked.select("path", "rank"), scores, weight, limit), {"status": "applied", "candidates": len(sent)}
