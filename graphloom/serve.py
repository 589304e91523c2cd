"""A reading service over the telemetry log, on this machine only: requests, one request, metrics, effects, status."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import cursor_decode
from .operators import telemetry as te


def requests_of(events: DataFrame) -> DataFrame:
    """request_id, ts, operation, status, duration_ms of each request, by its first and last event."""
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    done = F.col("event_type") == "request_completed"
    return events.groupBy("request_id").agg(
        F.min("ts").alias("ts"),
        F.min(F.when(F.col("event_type") == "request_started", field("operation"))).alias("operation"),
        F.coalesce(F.max(F.when(done, field("status"))), F.lit("running")).alias("status"),
        F.max(F.when(done, field("duration_ms").cast("double"))).alias("duration_ms"),
    )


class Queries:
    """The answers of the service, each a bounded result of a query over the log."""

    def __init__(self, spark: SparkSession, log: str) -> None:
        self.spark, self.log = spark, log

    def events(self) -> DataFrame:
        return self.spark.read.parquet(self.log)

    def status(self) -> dict:
        return {"ok": True, "events": self.events().count()}

    def requests(self, size: int = 25, cursor: str | None = None) -> dict:
        after = None
        if cursor:
            c = self.spark.range(1).select(cursor_decode(F.lit(cursor)).alias("c")).first().c
            after = (c.ts, c.key)
        size = max(1, min(size, 100))
        rows = te.next_cursor(te.page(requests_of(self.events()), size, after), size).orderBy(F.desc("ts"), F.desc("request_id")).collect()
        return {"requests": [r.asDict() | {"ts": str(r.ts)} for r in rows], "next": rows[0].next if rows else None}

    def request(self, request_id: str) -> dict | None:
        rows = self.events().filter(F.col("request_id") == request_id).orderBy("event_id").limit(te.MAX_EVENTS).collect()
        return {"request_id": request_id, "events": [{"event_type": r.event_type, "ts": str(r.ts), "payload": json.loads(r.payload)} for r in rows]} if rows else None

    def metrics(self) -> dict:
        now = F.current_timestamp()
        row = te.metrics(requests_of(self.events()), now - F.make_dt_interval(F.lit(1)), now + F.make_dt_interval(F.lit(1))).first().asDict()
        return row | {"last": str(row["last"]) if row["last"] else None}

    def effects(self) -> dict:
        done = self.events().filter("event_type = 'query_completed'")
        full = F.get_json_object("payload", "$.full_bytes").cast("long")
        short = F.get_json_object("payload", "$.compact_bytes").cast("long")
        row = done.agg(F.count("*").alias("measured"), F.coalesce(F.sum(full), F.lit(0)).alias("full_bytes"), F.coalesce(F.sum(short), F.lit(0)).alias("compact_bytes"))
        return row.first().asDict()


def handler(queries: Queries) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _say(self, code: int, what: dict) -> None:
            raw = json.dumps(what).encode()
            self.send_response(code)
            for k, v in (("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(raw))), ("Cache-Control", "no-store"), ("X-Content-Type-Options", "nosniff")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            asked = {k: v[-1] for k, v in parse_qs(url.query).items()}
            parts = [p for p in url.path.split("/") if p]
            try:
                if parts in (["status"], ["metrics"], ["effects"]):
                    self._say(200, getattr(queries, parts[0])())
                elif parts == ["requests"]:
                    self._say(200, queries.requests(int(asked.get("size", 25)), asked.get("cursor")))
                elif len(parts) == 2 and parts[0] == "requests" and (found := queries.request(parts[1])):
                    self._say(200, found)
                else:
                    self._say(404, {"error": "not_found"})
            except ValueError:
                self._say(400, {"error": "invalid_input"})

        def _refuse(self) -> None:
            self._say(405, {"error": "method_not_allowed"})

        do_POST = do_PUT = do_DELETE = do_PATCH = _refuse

        def log_message(self, *args) -> None:
            pass

    return Handler


def serve(spark: SparkSession, log: str, port: int = 0) -> ThreadingHTTPServer:
    """The service, bound to the loopback address; serve_forever() runs it."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(Queries(spark, log)))
