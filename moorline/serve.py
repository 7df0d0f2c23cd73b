"""The service over HTTP: JSON answers, errors by status, open to pages of other origins."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame

from moorline.api import REVIEW_LIMIT, Service, status_of
from moorline.plans.ir import DEFAULT_LIMIT, RequestError

CORS = {"Access-Control-Allow-Origin": "*", "Access-Control-Allow-Methods": "GET, POST, OPTIONS", "Access-Control-Allow-Headers": "Content-Type"}


def _rows(table: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in table.collect()]


def _number(text: str) -> int:
    try:
        return int(text)
    except ValueError as e:
        raise RequestError(f"{text!r} isn't a number") from e


def answer(service: Service, method: str, target: str, body: str = "") -> object:
    """What a request gets, ready for JSON; an unknown path is a LookupError."""
    at = urlsplit(target)
    parts = [unquote(p) for p in at.path.strip("/").split("/") if p]
    given = dict(parse_qsl(at.query, keep_blank_values=True))
    if parts[:1] != ["api"]:
        raise LookupError(f"no page {at.path}")
    routes: dict[tuple[str, str, int], Callable[..., object]] = {
        ("GET", "health", 0): service.health,
        ("GET", "ontology", 0): service.ontology,
        ("GET", "stats", 0): service.stats,
        ("GET", "entities", 1): lambda of: _rows(service.list_entities(of, given.pop("q", None), _number(given.pop("limit", str(DEFAULT_LIMIT))), **given)),
        ("GET", "entity", 1): service.entity,
        ("GET", "links", 1): lambda i: _rows(service.links_of(i, given.get("link"))),
        ("GET", "lineage", 1): lambda i: _rows(service.lineage(i)),
        ("GET", "lineage", 2): lambda i, prop: _rows(service.lineage(i, prop)),
        ("GET", "raw", 3): lambda *key: {"raw": service.raw(*map(_number, key))},
        ("GET", "review", 0): lambda: _rows(service.review(_number(given.get("limit", str(REVIEW_LIMIT))))),
        ("POST", "review", 1): lambda pair: service.decide(_number(pair), *(str(json.loads(body or "{}").get(k, "")) for k in ("decision", "reviewer"))) or {"status": "ok"},
        ("POST", "traverse", 0): lambda: service.traverse(body),
        ("POST", "explain", 0): lambda: service.explain(body),
    }
    found = routes.get((method, parts[1] if len(parts) > 1 else "", len(parts) - 2))
    if found is None:
        raise LookupError(f"no {method} {at.path}")
    return found(*parts[2:])


def handler(service: Service) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, told: object) -> None:
            raw = json.dumps(told, default=str).encode()
            self.send_response(status)
            for name, value in {**CORS, "Content-Type": "application/json", "Content-Length": str(len(raw))}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        def _take(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                told, status = answer(service, method, self.path, self.rfile.read(size).decode()), 200
            except Exception as e:  # every failure has an answer
                told, status = {"error": str(e)}, status_of(e)
            self._send(status, told)

        def do_GET(self) -> None:
            self._take("GET")

        def do_POST(self) -> None:
            self._take("POST")

        def do_OPTIONS(self) -> None:
            self._send(200, {})

        def log_message(self, *_: object) -> None:
            """Requests aren't logged."""

    return Handler


def forever(service: Service, host: str, port: int) -> None:
    with ThreadingHTTPServer((host, port), handler(service)) as server:
        server.serve_forever()
