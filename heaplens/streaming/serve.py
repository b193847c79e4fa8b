"""The last published samples over HTTP, for scrapers that pull."""

from __future__ import annotations

import gzip
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from ..operators import exposition


PLAIN, OPENMETRICS = "text/plain; version=0.0.4; charset=utf-8", "application/openmetrics-text; version=1.0.0; charset=utf-8"


def weights(header: str) -> dict[str, float]:
    """The weight (0 to 1) of each value of an Accept or Accept-Encoding header; one that can't be read counts as 0."""
    out: dict[str, float] = {}
    for item in header.split(","):
        value, *parameters = (x.strip() for x in item.split(";"))
        weight = next((p[2:] for p in parameters if p.startswith("q=")), "1")
        try:
            out[value.lower()] = max(out.get(value.lower(), 0.0), min(1.0, max(0.0, float(weight))))
        except ValueError:
            out.setdefault(value.lower(), 0.0)
    return out


class Scrape:
    """Holds one page, replaced as a whole by each batch; ``publish`` is what ``MetricJob`` calls.

    The page is made by Spark and its size follows the number of series. A request may pick samples with name[]=...; families without any are left out.
    """

    def __init__(self) -> None:
        #: by family: (line, line in OpenMetrics) of each line
        self.families: dict[str, list[tuple[str, str]]] = {}

    def publish(self, epoch: int, samples: DataFrame) -> None:
        families: dict[str, list[tuple[str, str]]] = {}
        for row in exposition.both_formats(samples).orderBy("family", "k", "name", "line").toLocalIterator():
            families.setdefault(row.family, []).append((row.line, row.open_line))
        self.families = families

    def text(self, names: set[str] | None = None, openmetrics: bool = False) -> str:
        out = []
        for lines in self.families.values():
            own = [x[openmetrics] for x in lines if x[0].startswith("# ") or not names or x[0].split("{", 1)[0] in names]
            if any(not x.startswith("# ") for x in own):
                out += own
        return "".join(f"{x}\n" for x in [*out, *["# EOF"] * openmetrics])

    def serve(self, host: str = "", port: int = 5898) -> ThreadingHTTPServer:
        """Start to serve /metrics in a thread; ``shutdown()`` of the result ends it."""
        scrape = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                url = urlsplit(self.path)
                accepted = weights(self.headers.get("Accept", ""))
                openmetrics = accepted.get("application/openmetrics-text", 0) > max(accepted.get("text/plain", 0), accepted.get("text/*", 0)) or accepted.get("application/openmetrics-text", 0) == 1
                body = scrape.text(set(parse_qs(url.query).get("name[]", [])), openmetrics).encode() if url.path in ("/", "/metrics") else None
                self.send_response(200 if body is not None else 404)
                self.send_header("Content-Type", OPENMETRICS if openmetrics else PLAIN)
                self.send_header("Vary", "Accept, Accept-Encoding")
                if body and weights(self.headers.get("Accept-Encoding", "")).get("gzip", 0) > 0:
                    body = gzip.compress(body, 6)
                    self.send_header("Content-Encoding", "gzip")
                self.send_header("Content-Length", str(len(body or b"")))
                self.end_headers()
                self.wfile.write(body or b"")

            def log_message(self, *args) -> None:
                pass

        server = ThreadingHTTPServer((host, port), Handler)
        threading.Thread(target=server.serve_forever, daemon=True).start()
        return server
