"""Rows by HTTP: POST /ingest takes a JSON object or an array of them, ``?source=`` names where they belong.

What is accepted is written to a landing folder first, as one file that appears whole, and answered after that;
``jsonl.stream`` reads the folder. A file is named by the request's ``Idempotency-Key``, so a repeated request
adds nothing. The folder is any that the cluster's tasks can read, mounted where this server runs.
"""

from __future__ import annotations

import hashlib
import json
import os
import threading
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

MOST_BYTES = 16 << 20


class Ingest:
    """The server; ``with Ingest(folder) as server: server.port``."""

    def __init__(self, landing: str, default_source: str = "events", port: int = 0, host: str = "127.0.0.1"):
        os.makedirs(landing, exist_ok=True)
        outer = self
        self.landing, self.default_source = landing, default_source

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self) -> None:
                self.answer(*outer.take(self.path, self.headers, self.rfile))

            def do_GET(self) -> None:
                self.answer(*((200, {"status": "ok"}) if urlsplit(self.path).path == "/health" else (404, {"error": "not found"})))

            def answer(self, status: int, body: dict) -> None:
                raw = json.dumps(body).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            def log_message(self, *args) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]

    def __enter__(self) -> Ingest:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *exc) -> None:
        self.server.shutdown()
        self.server.server_close()

    def take(self, path: str, headers, body) -> tuple[int, dict]:
        """Status and answer of one request."""
        url = urlsplit(path)
        if url.path != "/ingest":
            return 404, {"error": "not found"}
        size = int(headers.get("Content-Length") or 0)
        if size > MOST_BYTES:
            return 413, {"error": f"more than {MOST_BYTES} bytes"}
        try:
            data = json.loads(body.read(size))
        except ValueError:
            return 400, {"error": "not JSON"}
        rows = data if isinstance(data, list) else [data]
        if not all(isinstance(r, dict) for r in rows):
            return 400, {"error": "an object or an array of objects"}
        source = parse_qs(url.query).get("source", [None])[0]
        lines = []
        for r in rows:
            wrapped = set(r) == {"source", "data"} and isinstance(r["data"], dict) and isinstance(r["source"], str)
            own = r if wrapped else {"source": source or self.default_source, "data": r}
            lines.append(json.dumps(own | {"source": source or own["source"]}))
        if lines:
            key = headers.get("Idempotency-Key")
            name = hashlib.sha256(key.encode()).hexdigest() if key else uuid.uuid4().hex
            tmp, final = os.path.join(self.landing, f".{name}-{uuid.uuid4().hex}"), os.path.join(self.landing, f"{name}.json")
            if not os.path.exists(final):
                with open(tmp, "w", encoding="utf-8") as f:
                    f.write("\n".join(lines) + "\n")
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(tmp, final)
        return 200, {"accepted": len(lines)}
