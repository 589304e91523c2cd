"""Recording of requests as telemetry events. A failure to record never changes what a request gives."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from .operators.telemetry import PAYLOADS


class Recorder:
    """Events of one repository, in order; sink gets each as a row of the log."""

    def __init__(self, sink: Callable[[dict], None], repository_id: str) -> None:
        self.sink, self.repository_id, self.lost, self._n = sink, repository_id, 0, 0

    def event(self, request: str, trace: str, kind: str, **payload) -> None:
        try:
            if kind not in PAYLOADS:
                raise ValueError(kind)
            self._n += 1
            self.sink({"event_id": self._n, "request_id": request, "trace_id": trace, "repository_id": self.repository_id, "event_type": kind, "ts": datetime.now(UTC).isoformat(), "payload": json.dumps(payload)})
        except Exception:  # telemetry is no reason for a request to fail
            self.lost += 1

    @contextmanager
    def request(self, operation: str, fingerprint: str | None = None) -> Iterator[Callable[..., None]]:
        """One request from its start to its end; what it gives to the yielded function becomes an event of it."""
        request, trace, began = str(uuid.uuid4()), str(uuid.uuid4()), time.monotonic()
        spent = lambda: round((time.monotonic() - began) * 1000, 3)
        self.event(request, trace, "request_started", operation=operation, query_capture="unavailable", task_fingerprint=fingerprint)
        try:
            yield lambda kind, **payload: self.event(request, trace, kind, **payload)
        except ValueError:
            self.event(request, trace, "request_completed", operation=operation, duration_ms=spent(), status="failure", error_code="invalid_input")
            raise
        except Exception:
            code = "index_error" if operation == "index" else "query_error"
            self.event(request, trace, "request_completed", operation=operation, duration_ms=spent(), status="failure", error_code=code)
            raise
        self.event(request, trace, "request_completed", operation=operation, duration_ms=spent(), status="success", error_code="none")


def record_answer(recorder: Recorder, run: Callable, freshness: str = "unavailable"):
    """The answer that run gives, recorded: expansion, candidates, graph, selection, sizes."""
    from .operators.ask import to_json

    with recorder.request("query") as tell:
        began = time.monotonic()
        answer = run()
        names = {a.source if a.source == "project" else a.key.lower() for a in answer.expansion.applied}
        known = ("cli", "mcp", "entrypoint", "version", "config", "test", "api", "migration", "project")
        tell("query_expanded", retrieval_mode="project_anchor" if answer.expansion.of("project") else "lexical", alias_count=len(answer.expansion.applied), detected_intents=sorted({n if n in known else "other" for n in names})[:16])
        tell("candidates_retrieved", candidate_files=answer.coverage["candidate_files"])
        tell("graph_expanded", added_files=answer.graph.get("added_files", 0))
        n = {b: len(answer.paths(b)) for b in ("must_read", "maybe_read", "tests")}
        counts = {"must_read_count": n["must_read"], "maybe_read_count": n["maybe_read"], "test_count": n["tests"]}
        tell("context_selected", **counts)
        tell("query_completed", duration_ms=round((time.monotonic() - began) * 1000, 3), status="success", index_freshness=freshness, reindexed="unavailable", **counts, full_bytes=len(to_json(answer).encode()), compact_bytes=len(to_json(answer, short=True).encode()), estimated_full_tokens=None, estimated_compact_tokens=None, token_estimation_method="unavailable")
    return answer
