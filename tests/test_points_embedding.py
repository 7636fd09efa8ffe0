"""Embedding through providers, and the vector store sink against a stub that fails at times."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from lectern.operators import embedding, retrieval
from lectern.operators.validation import WrongDimension
from lectern.sources import points
from pyspark.sql import functions as F


class Stub:
    """Collections and points in memory; every third call is turned away with 503."""

    def __init__(self):
        self.dims, self.points, self.calls, self.sizes, self.failing, self.refuse = {}, {}, 0, [], True, None
        lock = threading.Lock()
        stub = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_):
                pass

            def answer(self):
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"null")
                with lock:
                    stub.calls += 1
                    if stub.failing and stub.calls % 3 == 0:
                        status, out = 503, {"status": "busy"}
                    else:
                        status, out = stub.handle(self.command, self.path.split("?")[0].strip("/").split("/"), body)
                self.send_response(status)
                self.end_headers()
                self.wfile.write(json.dumps(out).encode())

            do_GET = do_PUT = do_POST = answer

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def handle(self, method, path, body):
        name = path[1]
        if method == "PUT" and len(path) == 2:
            if name in self.dims:
                return 409, {"status": "exists"}
            self.dims[name] = body["vectors"]["size"]
            return 200, {}
        if method == "GET":
            return 200, {"result": {"config": {"params": {"vectors": {"size": self.dims[name]}}}}}
        own = self.points.setdefault(name, {})
        if path[-1] == "delete":
            run = body["filter"]["must_not"][0]["match"]["value"]
            for k in [k for k, p in own.items() if p["payload"]["run_id"] != run]:
                del own[k]
            return 200, {}
        if self.refuse:
            return self.refuse, {"status": "no"}
        self.sizes.append(len(body["points"]))
        own.update({p["id"]: p for p in body["points"]})
        return 200, {}


@pytest.fixture
def stub():
    own = Stub()
    yield own
    own.server.shutdown()


def send(df, stub, mode="append", **options):
    options = {"url": stub.url, "collection": "chunks", "dim": 4, "base": 0.01, "batch": 50} | options
    writer = df.write.format("vector_points").mode(mode)
    for k, v in options.items():
        writer = writer.option(k, str(v))
    writer.save()


def rows(spark, keys):
    points.register(spark)
    frame = spark.createDataFrame([(k, f"d{k % 7}", [float(k), 1.0, 0.5, -1.0]) for k in keys], "chunk_id long, parent_document_id string, embedding_vector array<float>")
    return frame.repartition(3)


def test_a_run_again_changes_nothing(spark, stub):
    df = rows(spark, range(500))
    send(df, stub, run_id="one")
    first = dict(stub.points["chunks"])
    assert len(first) == 500 and max(stub.sizes) <= 50 and stub.calls > len(stub.sizes) + 3
    assert first[points.point_id(3)]["payload"] == {"chunk_id": 3, "parent_document_id": "d3", "run_id": "one"}
    assert first[points.point_id(3)]["vector"] == [3.0, 1.0, 0.5, -1.0]
    send(df, stub, run_id="one")
    assert stub.points["chunks"] == first


def test_overwrite_leaves_this_run_only(spark, stub):
    send(rows(spark, range(100)), stub)
    send(rows(spark, range(50, 80)), stub, mode="overwrite")
    assert {p["payload"]["chunk_id"] for p in stub.points["chunks"].values()} == set(range(50, 80))
    # a run that fails deletes nothing
    stub.refuse, stub.failing = 400, False
    before, calls = dict(stub.points["chunks"]), stub.calls
    with pytest.raises(Exception, match="400"):
        send(rows(spark, range(10)).coalesce(1), stub, mode="overwrite")
    assert stub.points["chunks"] == before and stub.calls - calls < 10


def test_wrong_vectors_and_options(spark, stub):
    send(rows(spark, [1]), stub)
    with pytest.raises(Exception, match="holds vectors of 4 values, not 5"):
        send(rows(spark, [1]), stub, dim=5)
    with pytest.raises(Exception, match="has a vector of 4 values"):
        send(rows(spark, [1]), stub, dim=5, collection="other")
    with pytest.raises(Exception, match="columns are missing: key"):
        send(rows(spark, [1]), stub, key="key")
    nulls = rows(spark, [1]).select("chunk_id", "parent_document_id", F.lit(None).cast("array<float>").alias("embedding_vector"))
    with pytest.raises(Exception, match="has a vector of None values"):
        send(nulls, stub)
    send(rows(spark, [5]).withColumn("chunk_id", F.lit(None).cast("long")), stub)
    send(rows(spark, []), stub)
    assert len(stub.points["chunks"]) == 1


def test_point_values():
    assert points.plain({"a": [1.5, float("nan"), b"\x01"], 2: None}) == {"a": [1.5, None, "01"], "2": None}
    assert points.point_id("x") == points.point_id("x") != points.point_id("y")


# embedding


def chunks(spark, texts):
    return spark.createDataFrame([(i, f"d{i % 2}", t, "x") for i, t in enumerate(texts)], "chunk_id long, parent_document_id string, text string, embedding_model string")


def by_key(df):
    return {r.chunk_id: list(r.embedding_vector) for r in df.collect()}


def test_hashed_words_are_a_provider(spark):
    texts = ["the house and its energy use", "Énergie für 12 Häuser, 12 Häuser!", "a_b a-b", "one", "word " * 500 + "end"]
    df = chunks(spark, texts)
    found = by_key(embedding.embed(df, embedding.HashProvider(dim=48)))
    wanted = {r.chunk_id: list(r.embedding) for r in retrieval.hash_embeddings(df, 48, "chunk_id").collect()}
    assert set(found) == set(wanted) and all(np.allclose(found[k], wanted[k], atol=1e-6) for k in wanted)


def test_models_load_once_and_get_batches(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        open(f"{folder}/load-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def call(texts):
            open(f"{folder}/call-{len(texts)}-{uuid.uuid4().hex}", "w").close()
            return (np.array([[len(t), t.count("e")]]) for t in texts)

        return call

    texts = ["tree" * (i % 5) for i in range(300)] + [None, ""]
    df = chunks(spark, texts).coalesce(1)
    out = embedding.embed(df, embedding.FunctionProvider("lengths", 2, load), batch=64)
    assert out.columns == ["chunk_id", "parent_document_id", "embedding_model", "embedding_vector"]
    assert by_key(out) == {i: [len(t or ""), (t or "").count("e")] for i, t in enumerate(texts)}
    names = [p.name for p in tmp_path.iterdir()]
    sizes = [int(n.split("-")[1]) for n in names if n.startswith("call")]
    assert sum(n.startswith("load") for n in names) == 1 and max(sizes) == 64 and sum(sizes) == 302 and len(sizes) <= 6
    assert tuple(embedding.manifest(out, "r", "s").drop("created_at").first()) == ("r", "s", "lengths", 2, 302)
    assert tuple(embedding.manifest(out.limit(0), "r", "s").drop("created_at").first()) == ("r", "s", None, 0, 0)
    assert embedding.embed(df.withColumn("chunk_id", F.lit(None).cast("long")), embedding.HashProvider(dim=4)).count() == 0


@pytest.mark.parametrize(("give", "says"), [(lambda ts: np.zeros((len(ts), 3)), "not 2"), (lambda ts: np.zeros((len(ts) + 1, 2)), "3 vectors for 2 texts"), (lambda ts: np.full((len(ts), 2), np.nan), "not finite")])
def test_what_a_provider_gives_is_checked(give, says):
    with pytest.raises(embedding.WrongVectors, match=says):
        embedding.flat(give(["a", "b"]), 2, 2, "m")


def test_wrong_dimension_is_a_value_error():
    assert issubclass(WrongDimension, ValueError)
