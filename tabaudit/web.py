"""A small local server: a page to upload a file from, and `POST /analyze` for its results as JSON.

Standard library alone; one request at a time, bound to this machine. A file is read like any other source, so what it can't read is a
note in the answer.
"""

from __future__ import annotations

import html
import json
import tempfile
from email import message_from_bytes
from email.policy import HTTP
from http import HTTPStatus
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

from pyspark.sql import SparkSession

from .plans import report
from .plans.analyze import analyze_article
from .sources.readers import FORMATS, read_tables

LARGEST = 25 * 1024 * 1024
PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>Check a table</title></head><body><h1>Check a table</h1>
<form method="post" action="/analyze" enctype="multipart/form-data">
<p><input type="file" name="file" accept="{kinds}"></p><p><label>Axes that should have no effect: <input name="expect_flat"></label></p><button>Check</button>
</form></body></html>
"""


class Refused(Exception):
    def __init__(self, status: HTTPStatus, why: str):
        super().__init__(why)
        self.status = status


def fields(kind: str, body: bytes) -> dict[str, tuple[str | None, bytes]]:
    """The parts of a form: file name and content by field name."""
    message = message_from_bytes(f"Content-Type: {kind}\r\n\r\n".encode() + body, policy=HTTP)
    if not message.is_multipart():
        raise Refused(HTTPStatus.BAD_REQUEST, "a form with a file is expected")
    return {p.get_param("name", header="content-disposition"): (p.get_filename(), p.get_payload(decode=True) or b"") for p in message.iter_parts()}


def answer(spark: SparkSession, name: str, content: bytes, expect_flat: tuple[str, ...] = ()) -> dict:
    """Counts by priority, flags by table, what could not be checked, statistics that agree, and takeaways."""
    base = Path(name).name
    if base.rpartition(".")[2].lower() not in FORMATS:
        raise Refused(HTTPStatus.BAD_REQUEST, f"{base}: only {', '.join(FORMATS)} can be read")
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, base)
        path.write_bytes(content)
        a = analyze_article(read_tables(spark, str(path)), expect_flat=expect_flat)
    tables = report.table_reports(a.tables, a.flags)
    row = report.article_rows(a).first()
    flags = [f for _, found in tables for f in found]
    return {
        "file": base,
        "counts": {p: sum(f["priority"] == p for f in flags) for p in report.PRIORITIES},
        "tables": [{"name": t["name"], "metric": t["metric"], "flags": found} for t, found in tables],
        "stat_findings": [f for f in json.loads((row and row["stat_findings"]) or "[]") if f["status"] == "finding"],
        "stat_ok": (row and row["stat_ok"]) or 0,
        "could_not_check": json.loads((row and row["could_not_check"]) or "[]"),
        "takeaways": [s for g in json.loads((row and row["takeaways"]) or "[]") for s in g["takeaway"]],
    }


def server(spark: SparkSession, port: int = 8000) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: HTTPStatus, body: str, kind: str) -> None:
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def _json(self, status: HTTPStatus, value: dict) -> None:
            self._send(status, json.dumps(value, ensure_ascii=False, default=str), "application/json")

        def do_GET(self) -> None:
            if self.path == "/":
                self._send(HTTPStatus.OK, PAGE.format(kinds=html.escape(",".join(f".{k}" for k in FORMATS))), "text/html")
            else:
                self._json(HTTPStatus.NOT_FOUND, {"error": "no such page"})

        def do_POST(self) -> None:
            try:
                if self.path != "/analyze":
                    raise Refused(HTTPStatus.NOT_FOUND, "no such page")
                size = int(self.headers.get("Content-Length") or 0)
                if size > LARGEST:
                    raise Refused(HTTPStatus.REQUEST_ENTITY_TOO_LARGE, f"more than {LARGEST} bytes")
                form = fields(self.headers.get("Content-Type") or "", self.rfile.read(size))
                name, content = form.get("file", (None, b""))
                if not name:
                    raise Refused(HTTPStatus.BAD_REQUEST, "no file was sent")
                flat = tuple(x.strip() for x in form.get("expect_flat", (None, b""))[1].decode().split(",") if x.strip())
                self._json(HTTPStatus.OK, answer(spark, name, content, flat))
            except Refused as e:
                self._json(e.status, {"error": str(e)})
            except Exception as e:  # noqa: BLE001  the client learns what went wrong, the server goes on
                self._json(HTTPStatus.INTERNAL_SERVER_ERROR, {"error": f"{type(e).__name__}: {str(e)[:300]}"})

        def log_message(self, *args: object) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)


if __name__ == "__main__":
    server(SparkSession.builder.appName("tabaudit").getOrCreate()).serve_forever()
