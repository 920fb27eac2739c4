"""Changes of views as server-sent events: GET /mv?view=name[&after=version], one ``mv_change`` event for each row."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from tidemark.sinks import changelog_json
from tidemark.streaming.engine import Engine
from tidemark.types import DefinitionError


def events(engine: Engine, view: str, after: int) -> Iterator[tuple[int, str]]:
    """(version, event) of the rows that changed after a version, in order of versions."""
    for v in [v for v in engine.store.versions(f"view.{view}") if after < v <= engine.store.version]:
        changes = engine.subscribe(view, as_of=v - 1).where(F.col("version") == v)
        for r in changelog_json(changes).orderBy("value").toLocalIterator():
            yield v, f"event: mv_change\nid: {v}\ndata: {r['value']}\n\n"


class Server:
    """Each request follows its view until the client leaves; ``wait`` seconds between looks."""

    def __init__(self, engine: Engine, port: int = 0, host: str = "127.0.0.1", wait: float = 1.0):
        outer = self
        self.engine, self.wait, self.open = engine, wait, True

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                url = urlsplit(self.path)
                query = {k: v[0] for k, v in parse_qs(url.query).items()}
                view, after = query.get("view", ""), int(self.headers.get("Last-Event-ID") or query.get("after", 0))
                try:
                    if url.path != "/mv" or view not in outer.engine.views:
                        raise DefinitionError(f"no view {view!r}")
                    outer.engine.store.check_kept(f"view.{view}", after)
                except DefinitionError as e:
                    body = json.dumps({"error": str(e)}).encode()
                    self.send_response(404)
                    self.send_header("Content-Length", str(len(body)))
                    self.end_headers()
                    self.wfile.write(body)
                    return
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.send_header("Cache-Control", "no-cache")
                self.end_headers()
                try:
                    while outer.open:
                        for v, event in events(outer.engine, view, after):
                            self.wfile.write(event.encode())
                            after = max(after, v)
                        self.wfile.write(b": \n\n")  # so that a client that left is noticed
                        self.wfile.flush()
                        time.sleep(outer.wait)
                except OSError:
                    pass

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.server.daemon_threads = True
        self.port = self.server.server_address[1]

    def __enter__(self) -> Server:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *exc) -> None:
        self.open = False
        self.server.shutdown()
        self.server.server_close()
