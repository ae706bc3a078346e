"""A small HTTP front of a saved index, on the standard library: one driver that answers single questions.

GET /health, GET /item?id=, GET /image?id=, POST /v1/search with a form (text, math_ocr) or JSON of the same names.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from mathloom.functions.reader import flag
from mathloom.operators.index import Index, source_counts
from mathloom.operators.search import prepare_queries, responses
from mathloom.storage import temporary_tables

_IMAGES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg"}


def health(index: Index) -> dict:
    """Items in all and by source."""
    by = {r["source"]: r["items"] for r in source_counts(index.items).collect()}  # a row a source
    return {"status": "ok", "items": sum(by.values()), "sources": by}


def answer(spark: SparkSession, index: Index, text: str, use_formula: bool) -> dict:
    """The response to one question; a ValueError for an empty one."""
    if not text.strip():
        raise ValueError("type the text of the question")
    with temporary_tables(spark):
        query = prepare_queries(spark.createDataFrame([(0, text)], "qid int, text string"), use_formula)
        return responses(index, query, use_formula).drop("qid").first().asDict(recursive=True)


def image_of(index: Index, item_id: str) -> tuple[bytes, str] | None:
    """The figure file of an item with its type; None without an item, a path, a known type or the file."""
    row = index.get(item_id).first()
    path = Path(str((row.asDict().get("image") if row else None) or "").removeprefix("file:"))
    return (path.read_bytes(), _IMAGES[path.suffix.lower()]) if path.suffix.lower() in _IMAGES and path.is_file() else None


def server(spark: SparkSession, index: Index, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that is bound but not started; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: bytes, kind: str = "application/json") -> None:
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _json(self, code: int, value: object) -> None:
            self._send(code, json.dumps(value, ensure_ascii=False, default=str).encode())

        def do_GET(self) -> None:  # noqa: N802
            url = urlsplit(self.path)
            item_id = parse_qs(url.query).get("id", [""])[0]
            if url.path == "/health":
                self._json(200, health(index))
            elif url.path == "/item" and (row := index.get(item_id).first()):
                self._json(200, {k: row[k] for k in ("id", "original_text", "source", "kind") if k in row})
            elif url.path == "/image" and (found := image_of(index, item_id)):
                self._send(200, *found)
            else:
                self._json(404, {"error": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            if self.path != "/v1/search":
                return self._json(404, {"error": "not found"})
            try:
                form = json.loads(body) if "json" in (self.headers.get("Content-Type") or "") else {k: v[0] for k, v in parse_qs(body).items()}
                return self._json(200, answer(spark, index, str(form.get("text") or ""), flag(form.get("math_ocr"))))
            except ValueError as e:
                return self._json(400, {"error": str(e)})

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
