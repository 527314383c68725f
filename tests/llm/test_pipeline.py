"""Personal data, mixing, archives, the registered queries and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re

import numpy as np
import pytest
from fixtures import odd_texts, table
from oracle_check import compare, connect
from pyspark.sql import functions as F
from test_pairs import brute_documents
from test_text_models import brute_contamination

import __spark_entry__
import corpus_pipeline
from reelgrid.llm import mixing, pii, warc
from reelgrid.llm.queries import ORACLES, QUERIES
from reelgrid.llm.store import Workspace

SMALL = "/root/testdata/sf0.001"


def brute_base(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(2)
    pieces = ["a", "@", ".", "-", "1", "22", "255", "256", "+", " ", "(", ")", "é", "b.c", "x@y.z", "4111 1111 1111 1111", "1.2.3.4", "+1 (555) 010-9999", "%", "\n"]
    for _ in range(30_000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(14)))
        assert pii.base_spans(text) == brute_base(text), text


def test_base_spans_of_long_runs():
    assert pii.base_spans("1" * 200_000) == pii.base_spans("a" * 200_000 + "@") == pii.base_spans("+1" + " " * 200_000) == []
    assert pii.base_spans("999." * 50_000) == []
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_personal_data_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(table(spark, odd_texts()).select(docs.columns))
    texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    got = pii.personal_data(docs).collect()
    line = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    want = sorted(str((i, hashlib.sha256(line(brute_base(t or "")).encode()).hexdigest())) for i, t in texts)
    assert sorted({str((r.doc_id, r.base_sha256)) for r in got}) == sorted(set(want))
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert len(spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone
    assert pii.personal_data(docs.limit(0)).collect() == []


def test_the_method_adds_spans(spark):
    r = random.Random(4)
    number = lambda: f"{r.randrange(200, 999)}-{r.randrange(200, 999)}-{r.randrange(1000, 9999)}"
    rows = [(i, f"call my phone +1 {number()} today") for i in range(300)] + [(1000 + i, f"call my phone {number()} today") for i in range(300)]
    rows += [(2000 + i, f"order number {r.randrange(10**9, 10**10)} was sent") for i in range(300)] + [(3000, "write to ann (at) example (dot) com please")]
    got = {x.doc_id: x.spans for x in pii.personal_data(table(spark, rows)).collect()}
    assert all(got[i].startswith("phone:14:") for i in range(300))
    assert sum(got[1000 + i].startswith("phone:14:26") for i in range(300)) > 280
    assert not any(got[2000 + i] for i in range(300))


def test_reliabilities_are_recovered():
    r = np.random.default_rng(5)
    real = r.random(40_000) < 0.6
    accuracy = np.array([0.95, 0.8, 0.65])
    cast = np.where(r.random((40_000, 3)) < accuracy, 1, -1) * np.where(real, 1, -1)[:, None]
    cast[r.random((40_000, 3)) < 0.3] = 0
    patterns, n = np.unique(cast, axis=0, return_counts=True)
    found, p = pii.reliabilities(np.zeros(len(n), int), patterns, n)
    assert np.abs(found[0] - accuracy).max() < 0.05
    assert p[(patterns == 1).all(1)][0] > 0.95 and p[(patterns == -1).all(1)][0] < 0.1


def test_redaction(spark):
    docs = table(spark, [(1, "mail a.b@c.org or +1 (555) 010-9999, é 1.2.3.4"), (2, None), (3, "")])
    got = {r.doc_id: r.text for r in pii.redact(docs, pii.Detector(np.full((4, 10), 0.8), np.zeros(pii.CELLS + 1))).collect()}
    assert got == {1: "mail [EMAIL] or [PHONE], é [IP]", 2: None, 3: ""}


def brute_targets(sizes, most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, capped = {}, {}
    while True:
        left = sum(sizes.values()) - sum(capped.values())
        w = sum(weight[s] for s in names if s not in capped)
        target = capped | {s: left * weight[s] / w for s in names if s not in capped}
        over = [s for s in names if s not in capped and target[s] > most * sizes[s] + 1e-9]
        if not over:
            return target
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_brute_force(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 10, 1000, 100_000]) * r.randrange(1, 9) for s in ["a", "b", "B", "é", "\U0001F600", "z", "", None]}
    got = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_hypergeometric_quantiles(spark):
    for total, good, draws in ((50, 20, 15), (7, 7, 3), (9, 0, 4), (5, 3, 5), (0, 0, 0), (4000, 1000, 2000)):
        df = spark.range(5000).select(F.expr(mixing.hypergeometric(str(total), str(good), str(draws), "(id + 0.5) / 5000")).alias("x"))
        seen = {r.x: r["count"] for r in df.groupBy("x").count().collect()}
        for x in range(draws + 1):
            ways = math.comb(good, x) * math.comb(total - good, draws - x) if x <= good and draws - x <= total - good else 0
            assert abs(seen.get(x, 0) - 5000 * ways / math.comb(total, draws)) <= 1.01
        assert all(max(0, draws - total + good) <= x <= min(good, draws) for x in seen)


def test_quotas_add_up(spark):
    n = {"a": 100, "b": 1, "c": 37, None: 12}
    rows = mixing.split_quotas(Workspace(spark), spark.createDataFrame(list(n.items()), "source string, n long"), levels=3).collect()
    for s in n:
        own = sorted((r.shard, r.quota, r.begin) for r in rows if r.source == s)
        assert [q for _, q, _ in own] and sum(q for _, q, _ in own) == n[s]
        assert [b for _, _, b in own] == [sum(q for _, q, _ in own[:i]) for i in range(8)]
    each = [sum(r.quota for r in rows if r.shard == k) for k in range(8)]
    assert max(each) - min(each) <= 1


def test_mix_with_clashing_columns(spark):
    """Columns named like those that the plan and the mix use inside pass through."""
    names = ["block", "inner", "s", "b", "s0", "s1", "s2", "b1", "d2", "chosen", "full", "part", "opened", "_source", "_doc_id", "drawn", "open", "took", "at", "n", "quota", "words", "rank", "epoch"]
    docs = spark.createDataFrame([(i, f"a b c {i}" if i % 5 else None, "xyz"[i % 3], *[f"{c}{i}" for c in names]) for i in range(60)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    plan, mix = mixing.draw(docs)
    assert sorted(plan.columns) == sorted(["doc_id", "source", *names, "size", "source_size", "target", "copies", "taken", "shards"])
    rows = plan.collect()
    assert len(rows) == 60 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
    copies = mix.collect()
    assert all(r[c] == f"{c}{r.doc_id}" for r in copies for c in names)
    plain = {r.doc_id: r.taken for r in mixing.mix_plan(docs.select("doc_id", "text", "source")).collect()}
    assert {r.doc_id: r.taken for r in rows} == plain and sum(r.copies for r in rows) == len(copies) > 0


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(table(spark, [(100_000 + i, t) for i, (_, t) in enumerate(odd_texts())], source=None).select(docs.columns))
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == docs.count()
    again = mixing.mix_plan(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken, r.shards) for r in plan) == sorted((r.doc_id, r.taken, r.shards) for r in again)
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    sizes: dict = {}
    for r in plan:
        assert r.size == words[r.doc_id] and r.taken == r.copies * r.size <= 3 * r.size and len(r.shards) == r.copies
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in plan if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]} and all(abs(r.target - want[s]) < 1e-6 * want[s] for r in own)
        bound = 0.02 * want[s] if s is not None else max(r.size for r in own) / 2  # the null source has two very long documents
        assert abs(sum(r.taken for r in own) - want[s]) <= bound
    assert mixing.mix_plan(docs.limit(0)).collect() == []
    mixed = mixing.shards_table(docs.limit(50), mixing.mix_plan(docs.limit(50)))
    assert mixed.count() == mixing.mix_plan(docs.limit(50)).agg(F.sum("copies")).first()[0]


PAGES = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 200_001), (6, "u", "z" * 200_001), (None, "u", "z" * 200_001), (None, "u", "alone"), (7, "u", "\r\n\r\nWARC/1.1\r\n")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "page_id long, url string, html string, digest string, n int")


def brute_pages(rows, least=0):
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == p and j is not None]
        first = min(same) if same and len(p) >= least else i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    return out


@pytest.mark.parametrize("least,size", [(0, 1 << 16), (3, 5)])
def test_archives_round_trip(spark, least, size):
    got = warc.round_trip(pages(spark, PAGES), least, size).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_pages(PAGES, least)))
    assert warc.round_trip(pages(spark, [])).collect() == []


def test_chunks_of_an_archive(spark):
    """Other readers see plain records, and the chunks are the payload."""
    ws = Workspace(spark)
    index = ws.keep(warc.write_archives(warc.chunk_rows(warc.decide(pages(spark, PAGES).coalesce(1)), 1000), ws.path("w")))
    system, _ = warc.file_system(ws.path("w"))
    for path in {r.path for r in index.collect()}:
        raw = gzip.decompress(system.open_input_file(path).read())
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and b"\r\nX: y" not in raw
    chunks = warc.read_chunks(warc.spread(index, 100), ws.path("w"), 777).collect()
    own = sorted((r for r in chunks if r.page_id == 5), key=lambda r: r.chunk)
    assert b"".join(r.data for r in own) == b"z" * 200_001 and [r.last for r in own] == [False] * (len(own) - 1) + [True]
    assert all(r.digest == base64.b32encode(hashlib.sha1(b"z" * r.bytes).digest()).decode() for r in own)
    assert max(len(r.data) for r in chunks) <= 777


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    cur = connect(SMALL).execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    df = QUERIES[name](spark, SMALL)
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), cols) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_every_document(spark, name):
    want = sorted(r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in QUERIES[name](spark, SMALL).select("doc_id").collect()) == want


def test_pipeline_stage_by_stage(spark):
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept, out = [docs], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = ws.keep(stage(spark, out, SMALL))
        assert out.columns == columns
        kept.append(out)
    rows = [sorted((r.doc_id, r.text) for r in d.select("doc_id", "text").collect()) for d in kept]
    assert {i for i, _ in rows[1]} < {i for i, _ in rows[0]}
    assert rows[2] == [r for r, b in zip(rows[1], brute_documents(rows[1], 5, 80)) if b[3]]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows[3] == [r for r, b in zip(rows[2], brute_contamination(rows[2], items, 10)) if not b[5]]
    assert [i for i, _ in rows[4]] == [i for i, _ in rows[3]] and not any(brute_base(t or "") for _, t in rows[4])
    assert [t for _, t in rows[4]] != [t for _, t in rows[3]]
    assert all(r.n_chars == len(r.text) for r in kept[4].collect() if r.text is not None)
    mix = corpus_pipeline.STAGES[-1][1](spark, kept[4], SMALL)
    assert sorted(r.doc_id for r in mix.collect()) == [i for i, _ in rows[4]]


def test_pipeline_stands_odd_documents(spark):
    docs = table(spark, odd_texts())
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() > 5


def test_draws_hold_texts_of_null_and_repeated_ids(spark):
    texts = [(None, "no id at all", "a"), (None, "none here either", "b"), (1, "one of a", "a"), (1, "and one of b", "b")] + [(i, f"text {i} is here", "ab"[i % 2]) for i in range(2, 40)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in texts], "doc_id long, text string, lang string, source string, n_chars long")
    plan, mix = mixing.draw(docs)
    planned = {(r.source, r.doc_id): sorted(r.shards) for r in mixing.mix_plan(docs).collect()}
    drawn: dict = {}
    for r in mix.collect():
        assert (r.doc_id, r.text, r.source) in texts
        drawn.setdefault((r.source, r.doc_id), []).append(r.shard)
    assert {k: sorted(v) for k, v in drawn.items()} == {k: v for k, v in planned.items() if v}
    assert any(i is None for _, i in drawn) and len(planned) == len(texts)
    assert {(r.source, r.doc_id): (r.taken, sorted(r.shards)) for r in plan.collect()} == {(s, i): (len(planned[s, i]) * len(t.split()), planned[s, i]) for i, t, s in texts}


def test_pipeline_returns_the_drawn_texts(spark):
    got = __spark_entry__.queries()["pipeline"](spark, SMALL)
    assert {"text", "shard", "order"} <= set(got.columns) and got.where("text is not null").count() > 5
