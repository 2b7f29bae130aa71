"""A small HTTP face of the search service: /search?q=... and /metrics."""

from __future__ import annotations

import json
import time
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from ..log import Log, Silent
from ..operators.hybrid import SearchService
from ..operators.metrics import Registry
from ..operators.rank import query_tokens
from ..sources.sinks import results_json

LIMIT = 10


def query_param(target: str) -> str:
    """The first `q` of a request target; missing gives an empty query."""
    values = urllib.parse.parse_qs(urllib.parse.urlparse(target).query, keep_blank_values=True).get("q", [""])
    return values[0]


def answer(service: SearchService | None, query: str, limit: int = LIMIT) -> str:
    """JSON of a search: null for no index or no tokens, a list otherwise."""
    if service is None or not query_tokens(query):
        return results_json(None)
    return results_json(service.search(query, limit))


def make_server(service: SearchService | None, addr: tuple[str, int], registry: Registry | None = None, log: Log | None = None) -> ThreadingHTTPServer:
    """A server that is not yet running; serve_forever() starts it, shutdown() ends it."""
    seen, told = registry or Registry(), log or Silent()

    class Handler(BaseHTTPRequestHandler):
        timeout = 5

        def do_GET(self) -> None:  # noqa: N802
            path = urllib.parse.urlparse(self.path).path
            if path == "/metrics":
                return self._send(200, "text/plain; version=0.0.4", seen.render())
            if path != "/search":
                return self._send(404, "text/plain", "404 page not found\n")
            began = time.monotonic()
            try:
                body, status = answer(service, query_param(self.path)), "ok"
            except Exception as e:  # noqa: BLE001
                body, status = str(e), "error"
            took = time.monotonic() - began
            seen.observe_request(status, took)
            if status == "ok":
                told.info("search", query=repr(query_param(self.path)), results=len(json.loads(body) or []), ms=round(took * 1000))
            else:
                told.error("search_failed", body)
            self._send(200 if status == "ok" else 500, "application/json", body)

        def _send(self, code: int, kind: str, body: str) -> None:
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args: object) -> None:
            pass

    server = ThreadingHTTPServer(addr, Handler)
    server.registry = seen
    return server
