"""Filter audit, keyed upsert and vector search against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import cross_polytope, filter_audit, keyed_upsert, queries

SF = "/root/testdata/sf0.001"
CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
CHANGE = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"


# filter audit


def brute_audit(docs, labels):
    """docs: (doc_id, text, source)."""
    good, toxic = ({d for d, *x in labels if x[i] == 1 and d is not None} for i in (0, 1))
    firsts = {}
    for d, t, _ in docs:
        if d is not None:
            firsts[t or ""] = min(d, firsts.get(t or "", d))
    facts = []
    for d, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and firsts[t] < d]
        facts.append((s or "", fails, d in good, d in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        shares = Counter()
        for order in permutations(range(5)):
            left = own
            for step, k in enumerate(order, 1):
                gone = [f for f in left if f[1][k]]
                rest = [f for f in left if not f[1][k]]
                name = "".join("ABCDE"[i] for i in order)
                out[part, name, step] = [len(rest), len(gone), sum(f[1][k] for f in own) - len(gone), sum(f[1][k] and sum(f[1]) == 1 for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shares[k] += len(gone)
                left = rest
        for (p, name, step), row in out.items():
            if p == part:
                row.append(shares["ABCDE".index(name[step - 1])])
    return out


def audited(df):
    return {tuple(r[:3]): list(r[3:]) for r in df.collect()}


def test_audit_of_the_table(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audited(queries.op12_filter_audit(spark, SF)) == brute_audit(docs, labels)


def test_audit_of_odd_rows(spark):
    many = " ".join(f"Word{i}" for i in range(250))
    docs = [(1, None, "a"), (2, "", "b"), (None, "", "a"), (None, many, None), (3, many, ""), (3, many, "a"), (4, many, "a"), (4, many, "a"), (5, "x " * 300, "a"), (6, "É𝒳 😀 AB " * 90, "a"), (7, "a # b", "b"), (8, many + " |", "a"), (9, "x\x0by\x1cz\x85 \xa0 " * 100, None)]
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, 1), (None, 1, 1), (99, 1, 1), (5, None, 1), (8, 1, None)]
    frame = spark.createDataFrame([(*d, 1, 2, True) for d in docs], "doc_id long, text string, source string, mask int, n int, good boolean")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))
    assert audited(filter_audit.audit(frame, marks)) == brute_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).count() == 0
    assert audited(filter_audit.audit(frame, marks.limit(0))) == brute_audit(docs, [])


def test_matrices():
    orders, applied, by = filter_audit.matrices()
    assert len(set(orders)) == 120 and all(m.shape == (32, 600) and m.dtype == np.int64 for m in by.values())
    # a mask that fails anything is removed once in each order, by one step
    assert (by["removed"].reshape(32, 120, 5).sum(axis=2) == (np.arange(32) > 0)[:, None]).all()
    assert ((by["kept"].reshape(32, 120, 5)[:, :, 4] == 1) == (np.arange(32) == 0)[:, None]).all()


# keyed upsert


def crc(value):
    return zlib.crc32(str(value).encode())


def brute_upsert(clients, changes):
    """Files as (rewritten, rows)."""
    most = 1 + len(clients) // 1500
    rows = sorted((r for r in clients if r["client_id"] is not None and crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    files = [rows[i : i + most] for i in range(0, len(rows), most)]
    if not files:
        return []
    last = {}
    for c in changes:
        if c["client_id"] is not None:
            last[c["client_id"]] = max(c, last.get(c["client_id"], c), key=lambda c: (-1 if c["seq"] is None else c["seq"], c["change_id"]))
    firsts = [f[0]["client_id"] for f in files]
    new = [{r["client_id"]: dict(r) for r in f} for f in files]
    for k, c in last.items():
        home = max((i for i, x in enumerate(firsts) if x <= k), default=0)
        h = crc(firsts[home]) % 10
        if h <= 7:
            if c["op"] == "D" or crc(c["change_id"]) % 8 < h:
                new[home].pop(k, None)
            else:
                row = new[home].setdefault(k, dict.fromkeys(clients[0]) | {"client_id": k})
                row |= {x: c[x] for x in ("source", "segment", "city", "balance")}
    cuts = []
    for f, n in zip(files, new, strict=True):
        now = [n[k] for k in sorted(n)]
        if now == f:
            cuts.append((False, f))
            continue
        n, count, at = len(now), -(-len(now) // most), 0
        for i in range(count):
            size = n // count + (i < n % count)
            cuts.append((True, now[at : at + size]))
            at += size
    out = []
    for new, f in cuts:
        if new and out and out[-1][0] and len(out[-1][1]) + len(f) <= most:
            out[-1] = (True, out[-1][1] + f)
        else:
            out.append((new, f))
    return out


def holds(got, wanted, columns):
    """Whether a report and its files are those of `wanted`."""
    by = {r.first_id: r for r in got}
    assert len(got) == len(by) == len(wanted)
    folders = {os.path.dirname(r.path) for r in got}
    if not wanted:
        return True
    (folder,) = folders
    assert {r.path for r in got} == {f"{folder}/{x}" for x in os.listdir(folder) if x.endswith(".parquet")}
    for new, f in wanted:
        r = by[f[0]["client_id"]]
        assert pq.ParquetFile(r.path).read().to_pylist() == f
        assert (r.n_rows, r.rewritten, r.columns) == (len(f), new, ",".join(columns))
        assert r.cents == sum(0 if x["balance"] is None else math.floor(100 * x["balance"] + 0.5) for x in f)
        assert r.rows_crc == sum(zlib.crc32("|".join(x[c] or "" for c in ("source", "segment", "city")).encode()) for x in f)
        assert r.ids_sha256 == hashlib.sha256(",".join(str(x["client_id"]) for x in f).encode()).hexdigest()
    return True


def upserted(spark, tmp_path, clients, changes):
    where = tmp_path / str(random.random())
    for name, df in (("clients", clients), ("client_changes", changes)):
        df.write.parquet(f"{where}/{name}.parquet")
    got = queries.op11_keyed_upsert(spark, str(where)).collect()
    return holds(got, brute_upsert([r.asDict() for r in clients.collect()], [r.asDict() for r in changes.collect()]), clients.columns)


def test_upsert_of_the_tables(spark):
    clients, changes = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("clients", "client_changes"))
    got = queries.op11_keyed_upsert(spark, SF).collect()
    wanted = brute_upsert([r.asDict() for r in clients.collect()], [r.asDict() for r in changes.collect()])
    assert holds(got, wanted, clients.columns) and 0 < sum(new for new, _ in wanted) < len(wanted)


def test_upsert_into_files_of_many_rows(spark, tmp_path, monkeypatch):
    """Files of 1 + 4500 // 1500 rows; most changes fall into one file, below and beyond all."""
    rng = random.Random(5)
    client = lambda k: (k, None, rng.choice(["a", "é", None]), None, None, f"n{k}", None, 1, None, rng.choice([None, 1.005, -3.5]))
    clients = spark.createDataFrame([client(k) for k in rng.sample(range(-9000, 9000), 4499)] + [client(None)], CLIENT)
    changes = [(i, rng.choice([7, None, rng.randrange(-20_000, 20_000), rng.randrange(100, 400)]), rng.choice([None, 1, 2, 3]), rng.choice("UID"), None, rng.choice(["b", None]), None, "c", rng.choice([None, 2.5])) for i in range(6000)]
    rows = spark.createDataFrame(changes + changes[:500], CHANGE)
    assert upserted(spark, tmp_path, clients, rows)


def test_upsert_of_empty_tables(spark, tmp_path):
    clients = spark.createDataFrame([(k, None, "s", None, None, None, None, None, None, float(k)) for k in range(30)], CLIENT)
    changes = spark.createDataFrame([(1, 3, 1, "U", None, "t", None, None, None)], CHANGE)
    assert upserted(spark, tmp_path, clients, changes.limit(0))
    assert upserted(spark, tmp_path, clients.limit(0), changes)
    gone = spark.createDataFrame([(k, k, 1, "D", None, None, None, None, None) for k in range(30)], CHANGE)
    assert upserted(spark, tmp_path, clients, gone)
    wider = clients.withColumns({"place": F.lit(1), "home": F.lit("x")})
    assert upserted(spark, tmp_path, wider, changes.withColumn("name", F.lit("clash")))


def test_sizes_of_new_files():
    assert keyed_upsert.balanced(0, 4) == [] and keyed_upsert.balanced(9, 4) == [3, 3, 3] and keyed_upsert.balanced(10, 4) == [4, 3, 3]
    sizes = [(True, 1), (True, 2), (True, 2), (False, 1), (True, 1), (True, 3), (True, 1)]
    assert keyed_upsert.new_files(sizes, 4) == [3, 2, 4, 1]


# vector search


def brute_nearest(rows, k, every):
    """rows: (id, vector), all usable and distinct."""
    out = {}
    for q, v in rows:
        if q % every == 0:
            score = [(-math.fsum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q]
            out[q] = [(i, -s) for s, i in sorted(score)[:k]]
    return out


def found_by(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return out


def recall(found, wanted):
    return sum(len({i for i, _ in found[q]} & {i for i, _ in w}) for q, w in wanted.items()) / sum(map(len, wanted.values()))


def test_nearest_of_the_table(spark):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    v = np.array([x for _, x in rows])
    ids = np.array([i for i, _ in rows])
    found = found_by(queries.op13_cross_polytope(spark, "/root/testdata/sf0.1"))
    wanted = {}
    for at in np.flatnonzero(ids % 20 == 0):
        score = v @ v[at]
        order = [j for j in np.lexsort((ids, -score)) if j != at][:20]
        wanted[int(ids[at])] = [(int(ids[j]), score[j]) for j in order]
    assert set(found) == set(wanted) and all(len(x) == 20 for x in found.values())
    assert recall(found, wanted) >= 0.95
    by = dict(zip(ids.tolist(), v, strict=True))
    for q, own in found.items():
        assert all(abs(score - by[q] @ by[i]) < 1e-12 for i, score in own)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_nearest_of_hot_and_odd_rows(spark):
    """A third of the rows are one vector; norms differ; broken vectors and repeated rows take no part."""
    rng = np.random.default_rng(2)
    one = [0.5, -0.25, 0.125, 0.0, 1.0]
    rows = [(i, list(one)) for i in range(0, 300, 2)] + [(1000 + i, list(map(float, rng.normal(size=5) * rng.choice([0.1, 1, 30])))) for i in range(300)]
    odd = [(20, None), (40_000, []), (60_000, [0.0] * 5), (80_000, [1.0, None, 0.0, 0.0, 0.0]), (100_000, [float("nan"), 1.0, 0.0, 0.0, 0.0]), (120_000, [float("inf"), 1.0, 0.0, 0.0, 0.0]), (140_000, [1.0, 2.0]), (None, list(one))]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows + odd + rows[:100]], "vec_id long, embedding array<double>, rank string, score int")
    found = found_by(cross_polytope.nearest(frame))
    wanted = brute_nearest(rows, 20, 20)
    assert set(found) == set(wanted)
    assert recall(found, wanted) > 0.9
    assert [i for i, _ in found[0]] == [i for i, _ in wanted[0]]
    few = found_by(cross_polytope.nearest(frame.where("vec_id >= 1280")))
    few_wanted = brute_nearest([r for r in rows if r[0] >= 1280], 20, 20)
    assert {q: [i for i, _ in x] for q, x in few.items()} == {q: [i for i, _ in x] for q, x in few_wanted.items()}
    assert few and all(len(x) == 19 for x in few.values())
    assert cross_polytope.nearest(frame.limit(0)).count() == 0
    assert cross_polytope.nearest(frame.where("vec_id > 10000")).count() == 0


@pytest.mark.parametrize("hashes", [1, 2])
def test_blocks_and_probes_change_nothing(spark, monkeypatch, hashes):
    """Buckets in small blocks give what whole buckets give; all probes give everything."""
    rng = np.random.default_rng(4)
    rows = [(i, list(map(float, x))) for i, x in enumerate(rng.integers(-3, 4, size=(400, 4)))]
    rows = [r for r in rows if any(r[1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    search = lambda: found_by(cross_polytope.nearest(frame, k=7, every=10, tables=2, probes=16**hashes, hashes=hashes))
    whole = search()
    assert whole == brute_nearest(rows, 7, 10)
    monkeypatch.setattr(cross_polytope, "BLOCK", 9)
    monkeypatch.setattr(cross_polytope, "QUERY_BLOCK", 3)
    assert search() == whole


def test_rotations_keep_lengths():
    turn = cross_polytope.Rotations(5, 2, 1, 3)
    x = np.random.default_rng(1).normal(size=(20, 5))
    y = turn.turned(x, 1, 0)
    assert y.shape == (20, 16) and np.allclose(np.linalg.norm(y[:, :8], axis=1), np.linalg.norm(x, axis=1))
    assert (turn.probe(x, 1, 16)[:, 0] == turn.bucket(x, 1)).all() and (np.sort(turn.probe(x, 1, 16), axis=1) == np.arange(16)).all()
