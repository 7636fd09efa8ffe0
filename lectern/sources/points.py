"""Vectors into a vector store over HTTP, as a Spark data source to write to.

    points.register(spark)
    df.write.format("vector_points").option("url", ...).option("collection", ...).option("dim", 384).mode("append").save()

The collection is created when the write begins (that it exists is fine; one of
another dimension is an error).  Each task sends its rows, a batch to a call,
and repeats a call that fails, waiting longer each time.  A point's id follows
from its key alone, so a task that runs again, or a whole run, writes the same
points again.  mode("overwrite") then deletes, when all tasks are done, the
points of other runs; if a task fails for good nothing is deleted, and what has
been sent is sent again by the next run.

Options: url, collection, dim; key (chunk_id), vector (embedding_vector), batch
(256), attempts (5), base and most (seconds between attempts, .5 and 8),
timeout (30), token, run_id.  All other columns are the payload.

Defined results: rows without a key are left out; of equal keys one row stays;
a null vector or one of another dimension fails the write.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from itertools import islice

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lectern.operators.validation import WrongDimension

NAMESPACE = uuid.UUID("5b0a4c1e-6f0f-4f3e-9d53-2f8f3a1f7c11")


class StoreError(RuntimeError):
    """What the store answered, if it did."""

    def __init__(self, status: int | None, text: str) -> None:
        super().__init__(f"{status}: {text}")
        self.status = status


def with_retries(call: Callable, attempts: int = 5, base: float = 0.5, most: float = 8.0, sleep: Callable[[float], None] = time.sleep):  # noqa: ANN201
    """`call()`, again after base * 2^n seconds (at most `most`) when it raises.
    Errors with a `status` of 400 to 499 but 409 are raised at once."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            status = getattr(e, "status", None)
            if n == attempts - 1 or isinstance(e, ValueError) or (status is not None and 400 <= status < 500 and status != 409):
                raise
            sleep(min(most, base * 2**n))
    return None


def point_id(key: object) -> str:
    return str(uuid.uuid5(NAMESPACE, str(key)))


def plain(value: object) -> object:
    """As JSON has it."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, date | datetime):
        return value.isoformat()
    return float(value) if isinstance(value, Decimal) else value.hex() if isinstance(value, bytes | bytearray) else value


@dataclass(frozen=True)
class Store:
    """Where the points go and how often it is tried."""

    url: str
    collection: str
    dim: int
    attempts: int
    base: float
    most: float
    timeout: float
    token: str | None

    def once(self, method: str, path: str, body: dict | None) -> dict:
        headers = {"Content-Type": "application/json"} | ({"api-key": self.token} if self.token else {})
        request = urllib.request.Request(f"{self.url.rstrip('/')}{path}", None if body is None else json.dumps(body).encode(), headers, method=method)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                return json.loads(answer.read() or b"{}")
        except urllib.error.HTTPError as e:
            raise StoreError(e.code, e.read().decode(errors="replace")[:500]) from None
        except OSError as e:  # no answer
            raise StoreError(None, str(e)) from None

    def call(self, method: str, path: str, body: dict | None = None) -> dict:
        return with_retries(lambda: self.once(method, path, body), self.attempts, self.base, self.most)

    def ensure(self) -> None:
        """The collection is there and has this dimension."""
        try:
            with_retries(lambda: self._create(), self.attempts, self.base, self.most)
        except StoreError as e:
            raise StoreError(e.status, f"the collection {self.collection} could not be made: {e}") from None
        vectors = self.call("GET", f"/collections/{self.collection}").get("result", {}).get("config", {}).get("params", {}).get("vectors", {})
        if vectors.get("size", self.dim) != self.dim:
            raise WrongDimension(f"{self.collection} holds vectors of {vectors['size']} values, not {self.dim}")

    def _create(self) -> None:
        try:
            self.once("PUT", f"/collections/{self.collection}", {"vectors": {"size": self.dim, "distance": "Cosine"}})
        except StoreError as e:
            if e.status != 409:  # it exists
                raise


@dataclass
class Sent(WriterCommitMessage):
    points: int


class PointsWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        missing = [c for c in ("url", "collection", "dim") if c not in options]
        if missing:
            raise ValueError(f"options are missing: {', '.join(missing)}")
        self.key, self.vector = options.get("key", "chunk_id"), options.get("vector", "embedding_vector")
        absent = [c for c in (self.key, self.vector) if c not in schema.fieldNames()]
        if absent:
            raise ValueError(f"columns are missing: {', '.join(absent)}")
        self.batch, self.overwrite = int(options.get("batch", 256)), overwrite
        self.run_id = options.get("run_id") or uuid.uuid4().hex
        self.store = Store(options["url"], options["collection"], int(options["dim"]), int(options.get("attempts", 5)), float(options.get("base", 0.5)), float(options.get("most", 8)), float(options.get("timeout", 30)), options.get("token"))
        self.store.ensure()

    def point(self, row: Row) -> dict:
        held = row.asDict()
        key, vector = held[self.key], held.pop(self.vector)
        if vector is None or len(vector) != self.store.dim:
            raise WrongDimension(f"{key} has a vector of {None if vector is None else len(vector)} values, the collection {self.store.dim}")
        return {"id": point_id(key), "vector": [float(x) for x in vector], "payload": {k: plain(v) for k, v in held.items()} | {"run_id": self.run_id}}

    def write(self, iterator: Iterator[Row]) -> Sent:
        rows = (r for r in iterator if r[self.key] is not None)
        n = 0
        while own := list(islice(rows, self.batch)):
            points = [self.point(r) for r in own]
            self.store.call("PUT", f"/collections/{self.store.collection}/points?wait=true", {"points": points})
            n += len(points)
        return Sent(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite:
            others = {"must_not": [{"key": "run_id", "match": {"value": self.run_id}}]}
            self.store.call("POST", f"/collections/{self.store.collection}/points/delete?wait=true", {"filter": others})

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Points that were sent stay: the next run writes them again."""


class PointsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_points"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PointsWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PointsSource)
