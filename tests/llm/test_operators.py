"""The operators against brute force, on sf0.001 and on edge cases."""

import base64
import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import crf_quality, decontam, langid, line_dedup, line_hash, mixing, pii, queries, signature_tree, splitters, warc

from tests.llm import brute

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = "the quick brown fox jumps over the lazy dog while nine small birds sing in an old apple tree near the quiet river bank at dawn"
EDGES = [
    (1, None),
    (2, ""),
    (3, "   \n\t\n "),
    (4, BASE),
    (5, BASE),
    (6, BASE + " today"),
    (6, BASE + " today"),
    (7, BASE.replace("nine", "ten")),
    (8, "one two"),
    (9, "one two"),
    (10, "ONE two"),
    (11, LONG),
    (12, LONG + " end"),
    (13, "É É é ÀÉÎ word İstanbul K 𝒳 emoji 😀 done " * 3),
    (14, "mail a.b%c@x-y.example.com_z@q.rr and a@b ip 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004"),
    (15, "card 4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112; +1 (555) 010-9999. phone + 1 +12 3456789 0"),
    (16, "iban DE89370400440532013000 DE89370400440532013001 " + "1" * 5000 + " " + "1 2 " * 2000),
    (None, "a row without an id has some words in it and they are different from all of the others here for sure yes"),
    (17, "\n".join([BASE, BASE[:-1], BASE + "x", "x" + BASE, "short", BASE])),
    (18, "x\r\ny  z" + "\x0b\x0c\x1c\x85\xa0 end"),
]


def frame(spark, rows, extra=True):
    rows = [(*r, "x", 1, "y", True) for r in rows] if extra else rows
    return spark.createDataFrame(rows, "doc_id long, text string" + (", size string, shard int, spans string, kept boolean" if extra else ""))


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def same(found, wanted):
    order = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    found, wanted = sorted(map(tuple, found), key=order), sorted(map(tuple, wanted), key=order)
    assert len(found) == len(wanted)
    for a, b in zip(found, wanted, strict=True):
        assert a == b


def test_base_rules(spark, docs):
    rows = docs + EDGES
    own = crf_quality.score_documents(frame(spark, rows), crf_quality.LineField.neutral())
    found = own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    same(found, [(d, *brute.base_rules(t)) for d, t in rows])
    assert crf_quality.filter_documents(frame(spark, EDGES), crf_quality.LineField.neutral()).columns == frame(spark, EDGES).columns


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(50):
        field = crf_quality.LineField(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        scores = rng.normal(size=(rng.integers(1, 8), 2))

        def total(path, field=field, scores=scores):
            return field.start[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(field.step[a, b] for a, b in zip(path, path[1:], strict=False))

        best = max(itertools.product((0, 1), repeat=len(scores)), key=total)
        assert tuple(crf_quality.viterbi(field, scores)) == best


def test_gradient_is_that_of_the_likelihood():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    n, f = 4, len(crf_quality.FEATURES)
    rows = rng.integers(0, crf_quality.WIDTH, size=(1, n, f))
    labels, mask = rng.integers(0, 2, size=(1, n)), np.ones((1, n), bool)
    w = [rng.normal(size=(crf_quality.WIDTH, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)]

    def likelihood():
        def total(path):
            return w[2][path[0]] + sum(w[0][rows[0, i], y].sum() for i, y in enumerate(path)) + sum(w[1][a, b] for a, b in zip(path, path[1:], strict=False))

        return total(tuple(labels[0])) - np.logaddexp.reduce([total(p) for p in itertools.product((0, 1), repeat=n)])

    slope = crf_quality.gradient(w, rows, labels, mask)
    for x, g, at in ((w[0], slope[0], (rows[0, 1, 0], 1)), (w[1], slope[1], (0, 1)), (w[2], slope[2], (1,))):
        before = likelihood()
        x[at] += 1e-6
        assert abs((likelihood() - before) / 1e-6 - g[at]) < 1e-3
        x[at] -= 1e-6


def test_field_tells_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op1_line_field(spark, sf).select("doc_id", "kept").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in found if r.quality == 1]
    bad = [r.kept for r in found if r.quality == 0]
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) < 0.15


def test_field_tells_documents_it_was_not_trained_on(spark):
    """Trained on one half of the labels by a hash of the id, judged on the other."""
    sf = "/root/testdata/sf0.01"
    texts, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2
    field = crf_quality.train_line_field(texts, labels.where(half == 0))
    found = crf_quality.score_documents(texts, field).select("doc_id", "kept").join(labels.where(half == 1), "doc_id").collect()
    good, bad = [r.kept for r in found if r.quality == 1], [r.kept for r in found if r.quality == 0]
    assert min(len(good), len(bad)) > 20
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) < 0.15


def test_shards(spark, docs):
    rows = docs + [(d, t) for d, t in EDGES if d is None or d < 11 or d > 12] + [(5000 + i, "the same text again") for i in range(400)] + [(77, "r")] * 50
    for shards in (1, 7, 40):
        found = splitters.shard_records(frame(spark, rows), shards).select("doc_id", "text", "size", "shard", "slot").collect()
        assert len(found) == len(rows)
        sizes = [len((r.text or "").encode()) + 16 for r in found]
        assert sizes == [r.size for r in found]
        by = {}
        for r in found:
            by.setdefault(r.shard, []).append(r)
        assert set(by) <= set(range(shards))
        for own in by.values():
            assert sorted(r.slot for r in own) == list(range(len(own)))
        mean = sum(sizes) / shards
        assert max(abs(sum(r.size for r in by.get(k, [])) - mean) for k in range(shards)) <= 2 * max(sizes)


def test_placement(spark, docs):
    rows = docs + EDGES + [(5000 + i, "the same text again") for i in range(400)] + [(77, "r")] * 50
    for shards, range_bytes in ((7, 256 << 20), (40, 1_000)):
        found = splitters.shard_records(frame(spark, rows), shards, range_bytes=range_bytes).select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")), "shard", "slot").collect()
        wanted = brute.placement(rows, shards)
        # rows equal in all that orders them may change places
        same([r[:4] for r in found], [r[:4] for r in wanted])
        same([r[3:] for r in found], [r[3:] for r in wanted])
    query = queries.op2_splitters(spark, SF).collect()
    assert {(r.law, r.grown_shard) for r in query} == {("bytes", None)}
    same([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in query], brute.placement(docs, 40))


def test_ranges_grow_with_the_input(spark):
    """Ten times the input in ranges of a fixed size: the largest stays the same."""
    assert splitters.range_count(10**6, 40, 10**9) == 640
    assert splitters.range_count(10**12, 40, 256 << 20) == -(-(10**12) // (256 << 20))
    assert splitters.range_count(10**16, 40, 256 << 20) == splitters.MOST_RANGES
    largest = []
    for n in (4_000, 40_000):
        keys = splitters.key_columns(spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 1000).alias("text")), 16)
        keys = keys.select(splitters.KEY, splitters.TIE, splitters.SIZE).cache()
        total = keys.agg(F.sum(splitters.SIZE)).first()[0]
        _, held = splitters.find_boundaries(keys, total, splitters.range_count(total, 1, 2_000))
        assert sum(w[1] for w in held.values()) == n
        largest.append(max(w[0] for w in held.values()))
    assert largest[1] < 1.5 * max(largest[0], 2_000) and max(largest) <= 2 * 2_000


def test_pii(spark, docs):
    rows = docs + EDGES
    found = pii.find_spans(frame(spark, rows)).select("doc_id", pii.listed(pii.base_spans(pii.F.col("spans"))).alias("b")).collect()
    same(found, [(d, brute.listed(brute.pii_base(t))) for d, t in rows])
    more = pii.find_spans(frame(spark, [e for e in EDGES if e[0] == 16])).select(pii.listed(pii.F.col("spans")).alias("s")).first().s
    assert "iban:5:27" in more and more.count("iban") == 1
    masked = {r.doc_id: r.text for r in pii.redact(frame(spark, EDGES)).select("doc_id", "text").collect()}
    assert masked[4] == BASE and "4111 1111" not in masked[15]


def test_pii_random(spark):
    rng = random.Random(5)
    parts = ["a", "b.c", "@", ".", "-", "_", "+", "1", "22", "333", " ", "  ", "(", ")", "4111111111111111", "é", "😀", "x@y.zz", "1.2.3.4", "+1 555 010 9999"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))) for i in range(600)]
    found = pii.find_spans(frame(spark, rows, extra=False)).select("doc_id", pii.listed(pii.base_spans(pii.F.col("spans")))).collect()
    same(found, [(d, brute.listed(brute.pii_base(t))) for d, t in rows])


def test_pii_of_texts_with_many_matches(spark):
    text = " ".join(f"u{i}@mail{i % 7}.example.org" for i in range(40_000))
    began = time.time()
    found = pii.find_spans(frame(spark, [(1, text), (2, "call me back at 555 010 9999 by phone")])).select("doc_id", pii.listed(pii.F.col("spans")).alias("s")).collect()
    assert time.time() - began < 30
    own = {r.doc_id: r.s for r in found}
    assert own[1] == brute.listed(brute.pii_base(text)) and own[2] == "phone:16:28"


def test_pii_query(spark, docs):
    found = {r.doc_id: r for r in queries.op3_pii(spark, SF).collect()}
    for d, t in docs:
        base = brute.pii_base(t)
        kinds = Counter(k for _, _, k, _ in base)
        r = found[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in brute.KINDS]
        assert r.base_sha256 == hashlib.sha256(brute.listed(base).encode()).hexdigest()
        assert set(filter(None, brute.listed(base).split(","))) <= set(r.spans.split(","))


def contaminated(spark, rows, items):
    found = decontam.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", pii.F.sha2(pii.F.array_join("items", ",").cast("binary"), 256), "contaminated").collect()


def test_contamination(spark, docs, monkeypatch):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items += [(900, BASE.upper()), (901, "one TWO"), (902, None), (903, "!!"), (904, "é"), (905, "dog while nine"), (906, "a a a a a a a a a a a a a a a a")]
    rows = docs + EDGES + [(700, "a " * 40), (701, "b " + "a " * 12), (702, items[3][1][20:]), (703, "x " * 1000 + items[5][1])]
    wanted = brute.contamination(rows, items)
    assert sum(r[2] > 0 for r in wanted) > 5
    same(contaminated(spark, rows, items), wanted)
    monkeypatch.setattr(decontam, "BROADCAST_ANCHORS", 3)
    same(contaminated(spark, rows, items), wanted)
    # a table so small that it lets everything through
    monkeypatch.setattr(decontam, "MOST_MARKS", 64)
    same(contaminated(spark, rows, items), wanted)
    assert contaminated(spark, EDGES[:4], [(1, None)])[0].n_hit == 0


def test_remove_contaminated(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    gone = {r[0] for r in brute.contamination(docs, [(r.item_id, r.text) for r in bench.collect()]) if r[-1]}
    kept = decontam.remove_documents(frame(spark, docs), bench)
    assert gone and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - gone


def test_line_edits(spark, docs):
    rng = random.Random(6)
    rows = docs[:80] + [e for e in EDGES if e[0] not in (None, 11, 12)]
    lines = [x for _, t in docs[:40] for x in t.split("\n") if 20 <= len(x) < 400][:40]
    for i, line in enumerate(lines):
        for k in range(3):
            at, how = rng.randrange(len(line) + 1), rng.randrange(4)
            new = line[:at] + "qzé"[k] + line[at + (how % 2) :] if how < 3 else line[:at] + line[at + 1 :]
            rows.append((1000 + 3 * i + k, new + rng.choice(["", " "])))
    found = line_dedup.near_repeated_lines(frame(spark, rows)).collect()
    wanted = brute.line_edits(rows)
    assert len(wanted) > 100
    same(found, wanted)
    long = [(1, LONG), (2, LONG[:70_000] + "Q" + LONG[70_000:]), (3, LONG[:-1])]
    same(line_dedup.near_repeated_lines(frame(spark, long)).collect(), [(2, 0, 1, 0), (3, 0, 1, 0)])


def test_line_edits_grow_with_length(spark, docs):
    rng = random.Random(7)
    bound = lambda n: min(4, max(1, n // 40))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    base = [x.rstrip(" ") for _, t in docs[:60] for x in t.split("\n") if len(x) >= 170]
    rows = []
    for i in range(60):
        line = base[i % 3][: (24, 45, 79, 83, 125, 160, 167)[i % 7]].rstrip(" ")
        for _ in range(rng.randrange(6)):
            at, how = rng.randrange(len(line) + 1), rng.randrange(3)
            line = line[:at] + ("q" if how else "") + line[at + (how < 2) :]
        rows.append((i, f"{line}\nOn.\n\n"))
    lines = sorted((d, i, x) for d, t in rows for i, x in enumerate(t.split("\n")) if x)
    wanted = []
    for d, i, x in lines:
        near = lambda y, x=x: x == y or (min(len(x), len(y)) >= 20 and sum((Counter(x) - Counter(y)).values()) <= 4 >= sum((Counter(y) - Counter(x)).values()) and distance(x, y) <= bound(min(len(x), len(y))))
        first = next((e, j) for e, j, y in lines if near(y))
        if first < (d, i):
            wanted.append((d, i, *first))
    assert len([w for w in wanted if w[1] == 0]) > 10 and len([w for w in wanted if w[1] == 1]) == 59
    same(line_dedup.near_repeated_lines(frame(spark, rows), edits=4, short_copies=True).collect(), wanted)


def test_repeated_spans(spark, docs):
    rows = docs + [(5000 + d, t) for d, t in EDGES if d not in (None, 6)]
    same(line_hash.repeated_spans(frame(spark, rows)).drop("text_key").collect(), brute.repeated_spans(rows))
    same(line_hash.repeated_spans(frame(spark, rows), 8, 3).drop("text_key").collect(), brute.repeated_spans(rows, 8, 3))


def test_passages_are_found_whatever_stands_around(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passage = [word() + ("." if i % 17 == 16 else "") for i in range(70)]
    rows = []
    for i in range(30):
        own = [word() for _ in range(rng.randrange(5, 60))]
        at = rng.randrange(len(own))
        breaks = ["\n" if rng.random() < (0, 0.07, 0.3)[i % 3] else " " for _ in range(len(own) + 70)]
        text = "".join(w + b for w, b in zip(own[:at] + passage + own[at:], breaks, strict=True))
        rows.append((i, text.upper() if i % 5 == 4 else text))
    rows += [(100 + i, " ".join(word() for _ in range(150))) for i in range(20)]
    found = {r.doc_id: r for r in line_hash.repeated_spans(frame(spark, rows)).collect()}
    # all but what lies before the first end of a unit and after the last
    assert sorted(found) == list(range(1, 30)) and all(50 <= r.n_words <= 70 and r.first_doc_id < r.doc_id for r in found.values())
    kept = {r.doc_id: r for r in line_hash.remove_repeats(frame(spark, rows)).collect()}
    assert kept[0].text == rows[0][1] and kept[100].removed == []
    for i in range(1, 30):
        (span,) = kept[i].removed
        assert kept[i].text == rows[i][1][: span.start] + rows[i][1][span.stop :]


def test_repeats_recall(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    wanted = brute.repeated_windows(rows)
    found = {}
    for r in line_hash.repeated_spans(frame(spark, rows)).collect():
        before = len(brute.words(dict(rows)[r.doc_id][: r.start]))
        found.setdefault(r.doc_id, set()).update(range(before, before + r.n_words))
    caught = [d for d, own in wanted.items() if 2 * len(own & found.get(d, set())) >= len(own)]
    assert len(caught) >= 0.98 * len(wanted)
    words = sum(len(own) for own in wanted.values())
    assert sum(len(own & found.get(d, set())) for d, own in wanted.items()) >= 0.95 * words


def test_frequent_blocks_go_apart(spark, docs, monkeypatch):
    rows = docs + [(5000 + d, t) for d, t in EDGES if d not in (None, 6)] + [(7000 + i, BASE * 2 + f" x{i}") for i in range(300)]
    wanted = brute.repeated_spans(rows)
    for sample, frequent in ((2_000_000, 50), (2_000_000, 2), (2_000, 3), (100, 10**9)):
        monkeypatch.setattr(line_hash, "SAMPLE_ROWS", sample)
        monkeypatch.setattr(line_hash, "FREQUENT", frequent)
        same(line_hash.repeated_spans(frame(spark, rows)).drop("text_key").collect(), wanted)


@pytest.mark.parametrize("frequent", [2, 10**9])
def test_repeats_of_odd_rows(spark, monkeypatch, frequent):
    monkeypatch.setattr(line_hash, "FREQUENT", frequent)
    rows = [(None, BASE * 2), (4, BASE * 2), (4, BASE * 2), (5, "\n" + BASE * 2), (5, "\n" + BASE * 2), (6, None), (7, "")]
    found = line_hash.repeated_spans(frame(spark, rows)).select("doc_id", "start", "first_doc_id", "first_start").collect()
    same(found, [(4, 0, None, 0), (5, 1, None, 0)])
    kept = line_hash.remove_repeats(frame(spark, rows))
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == [(0, len(BASE) * 2), (4, 0), (4, 0), (5, 1), (5, 1), (6, 0), (7, 0)]


PAGES = [(1, "http://a/é?x=1\r\n", "<p>one</p>"), (8, "http://a/b%20c%2Fd\xa0e", "s"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "v", "<p>é</p>" * 50_000), (None, "w", "<p>one</p>"), (7, "z", "r"), (7, "z", "r")]


def test_warc(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + [(1000 + (p or 0) if p else None, u, h) for p, u, h in PAGES]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.round_trip(pages, archive_bytes=100_000).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url").collect()
    top = {}
    for p, _, h in rows:
        if p is not None:
            top[h or ""] = max(top.get(h or "", p), p)
    wanted = []
    for p, u, h in rows:
        raw = (h or "").encode()
        first = top.get(h or "")
        again = first is not None and (p is None or p < first)
        wanted.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None, u.replace("\r\n", "%0D%0A") if u is not None else f"urn:page:{p}"))
    same(found, wanted)


def test_warc_breaks(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    content = warc.write_archives(pages, warc.train_dictionary(pages)).first().content
    assert content[:4] == (0x184D2A5D).to_bytes(4, "little") and len(content) < 0.6 * sum(len(r.html) for r in pages.collect())
    raws = list(warc.frames_of(bytes(content)))
    assert len(raws) == pages.count()
    broken = [bytes(content[:-20]), bytes(content) + b"xx", bytes(content[:40]), bytes(content[:-9]) + bytes(9)]
    archives = spark.createDataFrame([(str(i), x) for i, x in enumerate(broken)], "path string, content binary")
    found = warc.read_archives(archives, errors="keep").where("error is not null").collect()
    assert len(found) == len(broken)
    for bad in (raws[0].replace(b"WARC-Date", b"WARC-Dote"), raws[0].replace(b"Content-Length: ", b"Content-Length: 9", 1), b"WARC/1.1\r\n", raws[0].replace(b"sha1:", b"sha1:A", 1)):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op8_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == brute.held_out(r.doc_id) for r in found)
    own = [r.lang_pred == r.lang for r in found if r.held_out]
    assert len(own) > 200 and sum(own) / len(own) > 0.9
    model = langid.fit([("en", "the dog and the cat"), ("fr", "le chien et le chat")], 100, 100, 4)
    edge = {r.doc_id: r for r in langid.identify(frame(spark, [(1, None), (2, ""), (3, "12 !"), (4, "the cat"), (5, "chienne"), (6, "½ ² Ⅳ"), (7, "Ⅳ the")]), model).collect()}
    assert [edge[i].lang_pred for i in range(1, 8)] == ["und", "und", "und", "en", "fr", "und", "en"] and all(0 <= r.score <= 1 for r in edge.values())
    assert langid.identify(frame(spark, [(4, "the")]), langid.LanguageModel((), {}, ())).first().lang_pred == "und"


def test_language_scores(spark, docs):
    train = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang IS NOT NULL").collect()][:80]
    model = langid.fit(train, 300, 400, 4)
    rows = docs[:120] + [e for e in EDGES if e[0] not in (11, 12)] + [(None, "ein Haus"), (3, "ein Haus"), (3, "ein Haus"), (4, "ß½ŉ x²")]
    grams = {k: v.tolist() for table in model.grams for k, v in table.items()}
    words = {k: v.tolist() for k, v in model.words.items()}
    wanted = sorted((str(d), *brute.backoff(t, model.languages, words, grams)) for d, t in rows)
    found = sorted((str(r.doc_id), r.lang_pred, r.score) for r in langid.identify(frame(spark, rows), model).collect())
    for a, b in zip(found, wanted, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6


def test_jaccard_components(spark, docs, monkeypatch):
    rng = random.Random(7)
    base = [t for _, t in docs[:6]]
    rows = docs[:120] + [(5000 + d, t) for d, t in EDGES if d is not None]
    for i in range(120):
        w = base[i % 3].split(" ")
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append((2000 + i, " ".join(w)))
    wanted = brute.jaccard_components(rows)
    assert len({c for _, _, c in wanted}) < len(rows) - 60
    find = lambda **k: signature_tree.link_components(frame(spark, rows), **k).drop("text_key").collect()
    same(find(), wanted)
    same(find(block=16), wanted)
    same(find(width=5, num=80), brute.jaccard_components(rows, 5, 80))
    kept = signature_tree.drop_linked(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in kept) == sorted({d for d, n, c in brute.jaccard_components(rows, 5, 80) if d == c})


def test_one_row_of_each_component_stays(spark):
    other = " ".join(f"word{i}" for i in range(40))
    rows = [(None, BASE), (None, BASE + " today"), (None, BASE + " today"), (7, other), (7, other + " more"), (8, other + " again")]
    third = " ".join(f"thing{i}" for i in range(40))
    rows += [(7, third), (None, third + " more"), (9, third + " again"), (None, ""), (None, None)]
    kept = [(r.doc_id, r.text) for r in signature_tree.drop_linked(frame(spark, rows)).collect()]
    assert sorted((d or 0, (t or "")[:5]) for d, t in kept) == [(0, ""), (0, ""), (0, BASE[:5]), (7, "thing"), (7, "word0")]
    alone = [(None, other), (None, other), (None, third)]
    assert sorted(r.text for r in signature_tree.drop_linked(frame(spark, alone)).collect()) == sorted([other, third])


def test_links_of_rows_without_ids(spark):
    """Null ids and one id for many texts: same links as with own ids, at the same cost."""
    rng = random.Random(11)
    texts = []
    for i in range(600):
        own = [f"w{i % 25}x{j}" for j in range(100)]
        for _ in range(rng.randrange(9)):
            own[rng.randrange(100)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    took, found = [], []
    for ids in (range(600), range(600), [None] * 600, [7] * 600):
        rows = frame(spark, list(zip(ids, texts, strict=True)), extra=False)
        began = time.time()
        found.append(signature_tree.component_rows(rows, 5, 80, 100).select("text_key", "n_shingles", "component_id", F.hash("stays.key")).collect())
        took.append(time.time() - began)
    wanted = Counter((c, n) for _, n, c in brute.jaccard_components(list(enumerate(texts)), 5, 80))
    assert Counter((r.component_id, r.n_shingles) for r in found[1]) == wanted
    apart = lambda rows: sorted(Counter(r[3] for r in rows).values())
    assert apart(found[1]) == apart(found[2]) == apart(found[3])
    assert {r.component_id for r in found[2]} == {None} and {r.component_id for r in found[3]} == {7}
    assert max(took[2:]) < 1.5 * took[1] + 3


def test_trees_find_all_links():
    import numpy as np

    rng = np.random.default_rng(8)
    for num, den in ((85, 100), (50, 100)):
        sets = []
        for _ in range(60):
            base = rng.choice(2**40, size=rng.integers(20, 200), replace=False).astype(np.uint64)
            for _ in range(4):
                own = base.copy()
                own[rng.random(len(own)) < 0.1] += np.uint64(1)
                sets.append(np.unique(own))
        n = np.array([len(s) for s in sets])
        sig = np.frombuffer(b"".join(map(signature_tree.signature, sets)), dtype=np.uint64).reshape(len(sets), -1)
        tree = signature_tree.Tree(n, np.arange(len(sets)), sig)
        found = {tuple(sorted(p)) for i, j, _ in signature_tree.walk(tree, tree, num, den) for p in zip(i.tolist(), j.tolist(), strict=True)}
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if den * both >= num * (n[i] + n[j] - both):
                    assert (j, i) in found
        assert len(found) < 3000


def test_forests_in_pieces():
    import numpy as np

    rng = np.random.default_rng(10)
    pairs = np.zeros(5000, dtype=signature_tree.PAIR)
    for name, top in (("group", 3), ("one", 40), ("two", 40)):
        pairs[name] = rng.integers(0, top, len(pairs))
    pairs["a"], pairs["b"], pairs["share"] = np.arange(len(pairs)), np.arange(len(pairs)) + 10**6, rng.random(len(pairs))
    chunks = lambda: (pairs[at : at + 7] for at in range(0, len(pairs), 7))
    whole = signature_tree.forest(pairs)
    (piece,) = signature_tree.in_pieces(chunks(), False, 100)
    assert sorted(piece["a"].tolist()) == sorted(whole["a"].tolist()) and len(whole) == 3 * 39
    every = list(signature_tree.in_pieces(chunks(), True, 100))
    assert max(map(len, every)) < 120 and sum(map(len, every)) == len(pairs)


def test_one_large_group(spark):
    """5,000 near copies, no two equal, of some hundred components."""
    rng = random.Random(11)
    base = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(5000):
        w = list(base)
        for at in rng.sample(range(120), 2 + i % 4):
            w[at] = f"new{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    wanted = {}
    sets = [brute.shingles(t, 5) for _, t in rows]
    found = signature_tree.link_components(frame(spark, rows, extra=False), width=5, num=80).collect()
    root = {r.doc_id: r.component_id for r in found}
    # each link joins; each component is held together by links from its members
    for _ in range(20_000):
        i, j = rng.randrange(5000), rng.randrange(5000)
        both = len(sets[i] & sets[j])
        if i != j and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            assert root[i] == root[j]
    for i, c in root.items():
        wanted.setdefault(c, []).append(i)
    assert all(c == min(own) for c, own in wanted.items())
    for own in sorted(wanted.values(), key=len)[:200]:
        for i in own if len(own) > 1 else ():
            assert any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in own if j != i)


def test_mixture(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(9001, "a b c", None), (9002, None, None), (9003, "", "zz"), (None, "x y", "src1"), (9004, LONG, "é")] + [(9005, "again and again", "src2")] * 3
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, taken int")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    own = {}
    for r in found:
        assert r.size == len(brute.words(r.text)) and r.taken in (0, r.size, 2 * r.size)
        s = own.setdefault(r.source, [0, 0, r.target, r.source_size, 0])
        s[0] += r.size
        s[1] += r.taken
        s[4] = max(s[4], r.size)
    total = sum(s[0] for s in own.values())
    order = sorted(own, key=lambda x: (x is None, x or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    level = 0.0
    low, high = 0.0, float(total)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * own[s][0], level * weight[s]) for s in order) < 1.5 * total else (low, level)
    for s in order:
        assert own[s][3] == own[s][0]
        assert abs(own[s][2] - min(2 * own[s][0], level * weight[s])) < 1e-6 * total
        assert abs(own[s][1] - own[s][2]) <= 3 * own[s][4] / 2 + 1
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.size): r.taken for r in found}
    taken = mixing.take(docs)
    assert taken.columns == ["doc_id", "text", "source"] and taken.count() == sum(r.taken // r.size for r in found if r.size)


def test_empty_tables(spark):
    docs = frame(spark, [])
    assert crf_quality.score_documents(docs, crf_quality.LineField.neutral()).count() == 0
    assert splitters.shard_records(docs, 4).count() == 0
    assert pii.find_spans(docs).count() == 0
    assert decontam.contamination(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert line_dedup.near_repeated_lines(docs).count() == 0
    assert line_hash.repeated_spans(docs).count() == 0
    assert line_hash.remove_repeats(docs).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert signature_tree.link_components(docs).count() == 0
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert langid.train_language_model(spark.createDataFrame([], "doc_id long, text string, lang string")).languages == ()
    field = crf_quality.train_line_field(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert crf_quality.score_documents(frame(spark, [(1, BASE)]), field).first().kept
