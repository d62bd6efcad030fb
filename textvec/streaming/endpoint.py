"""An HTTP endpoint over serve(): POST /v1/embeddings and GET /health, each request one row."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import serving
from ..operators.pipeline import Embedder


def endpoint(spark: SparkSession, embedder: Embedder, model: str, host: str = "127.0.0.1", port: int = 0, max_batch: int = serving.MAX_BATCH) -> ThreadingHTTPServer:
    """A server that is bound, but doesn't answer before serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, text: str) -> None:
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _refuse(self, status: int, message: str) -> None:
            self._answer(status, json.dumps({"error": {"message": message, "type": "invalid_request_error"}}))

        def do_GET(self) -> None:
            if self.path != "/health":
                return self._refuse(404, "not found")
            row = spark.range(1).select(serving.health(model, embedder.width).alias("body")).first()
            return self._answer(200, row["body"])

        def do_POST(self) -> None:
            if self.path != "/v1/embeddings":
                return self._refuse(404, "not found")
            size = self.headers.get("Content-Length", "")
            if not size.isdigit():
                return self._refuse(411, "Content-Length is needed")
            if int(size) > serving.MAX_BODY:
                return self._refuse(400, "request body is too large")
            body = self.rfile.read(int(size)).decode("utf-8", "replace")
            requests = spark.createDataFrame([("1", body)], "request_id string, body string")
            row = serving.serve(requests, embedder, model, max_batch=max_batch).select(F.col("status"), F.col("response")).first()
            return self._answer(row["status"], row["response"])

        def log_message(self, *args) -> None:
            """Quiet: Spark logs the jobs."""

    return ThreadingHTTPServer((host, port), Handler)
