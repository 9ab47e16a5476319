"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import chat, components, decontaminate, langid, neardup, phrases, pieces, queries, scratch, tokens, toxicity, urls, warc
from pulsegrid.llm.scratch import Scratch

PIECES, WORDS = queries.tokenizer_file("piece_bpe_32k.model"), queries.tokenizer_file("word_bpe_49k.json")
LONG = "lorem ipsum dolor " * 40_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en"), (2, "alpha beta gamma delta epsilon zeta", "en"), (3, None, None), (4, "", "en"), (5, LONG, "de"), (5, LONG, "de"), (None, "gamma beta", "en"), (6, "1234 !!", "de"), (7, "kurz", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("key", "n", "k", "label", "node", "a", "b", "comp", "range", "ids", "w", "sig", "rep"):  # names the operators use themselves
        df = df.withColumn(name, F.lit(name))
    return df.withColumn("score", F.lit(0.5)).withColumn("toxic", F.lit(0))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (7, 0), (4, None), (None, 1), (5, 7)], "doc_id long, toxic int")


def test_tokens(spark, docs):
    scratch = Scratch(spark, "t")
    for df in (docs, docs.limit(0)):
        path = scratch.path("ids")
        tokens.write(df, path, WORDS)
        got = tokens.checksums(tokens.read(spark, path)).collect()
        assert len(got) == df.count()
    assert [r.n_tokens for r in tokens.read(spark, scratch.paths["ids"]).collect()] == []


def test_warc(spark):
    schema = "page_id long, url string, html string, key string, head string, digest string"
    rows = [(None, None, None, "", "", ""), (None, "u", "y" * 2000, "", "", ""), (1, "u", "y" * 2000, "", "", ""), (1, "u", "y" * 2000, "", "", ""), (2, "u", "\r\n\r\nWARC/1.0\r\n", "", "", "")]
    scratch = Scratch(spark, "t")
    got = warc.read_pages(warc.write_pages(spark.createDataFrame(rows, schema), scratch.path("w"), scratch)).collect()
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type) for r in got) == [(0, 0, "response"), (0, 2000, "response"), (1, 2000, "response"), (1, 2000, "response"), (2, 14, "response")]
    assert warc.read_pages(warc.write_pages(spark.createDataFrame([], schema), scratch.path("e"), scratch)).count() == 0


def test_arc_versions(spark, tmp_path):
    import gzip
    import io

    for version in (1, 2):
        body = b"HTTP/1.0 200 OK\r\n\r\nhello"
        raw = warc.arc_header("x.arc", "20010203", version) + warc.arc_line("http://a/b c", "20010203040506", "text/html", len(body), version) + body + b"\n" + warc.arc_line("dns:a", "2001", "text/dns", 2, version) + b"ok\n"
        found = list(warc.read_arc(io.BytesIO(raw)))
        assert [(r.fields["url"], r.body) for r in found] == [("http://a/b%20c", body), ("dns:a", b"ok")]
        kinds = [warc.convert(r).headers for r in found]
        assert [k["WARC-Type"] for k in kinds] == ["response", "resource"]
        assert [k["WARC-Date"] for k in kinds] == ["2001-02-03T04:05:06Z", "2001-01-01T00:00:00Z"]
        (tmp_path / f"v{version}.arc.gz").write_bytes(gzip.compress(raw))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(raw[:-6])))
    with pytest.raises(ValueError):
        list(warc.read_arc(io.BytesIO(b"nonsense\n")))
    out = warc.convert_files(spark, [f"file://{tmp_path}/v{v}.arc.gz" for v in (1, 2)], f"file://{tmp_path}/out").collect()
    assert [r.records for r in out] == [2, 2]
    with open(out[0].warc.removeprefix("file://"), "rb") as f:
        assert [r.payload for r in warc.read_warc(f)] == [b"hello", b"ok"]


def test_pieces(docs):
    rows = pieces.encode(docs, PIECES)
    assert rows.where("not round_trip").count() == 0 and rows.count() == docs.count()
    assert pieces.encode(docs.limit(0), PIECES).count() == 0


def test_language(docs):
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs).collect()]
    assert len(got) == docs.count()
    assert {k: p for k, p, _ in got if k in (3, 4, 6)} == {3: "und", 4: "und", 6: "und"}
    assert langid.identify(docs.limit(0)).count() == 0
    assert set(langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().toPandas().lang_pred) == {"und"}
    assert langid.readable(docs).columns == docs.columns


def test_urls(spark):
    schema = "page_id long, url string, host string, path string, rule string, n long, template string"
    rows = [(1, "http://a.net/" + "/".join(str(i) for i in range(50)), "", "", "", 0, ""), (1, "http://a.net//x/", "", "", "", 0, ""), (None, None, "", "", "", 0, ""), (2, "://", "", "", "", 0, ""), (3, "http://" + "h" * 5000, "", "", "", 0, "")]
    assert urls.judge(spark.createDataFrame(rows, schema), queries.URL_RULES).count() == 5
    assert urls.judge(spark.createDataFrame([], schema), queries.URL_RULES).count() == 0


def test_phrases(docs):
    got = phrases.fingerprints(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[2].fingerprint and by[1].near_next == 1.0
    assert by[4].fingerprint == "" and by[3].near_next == 1.0  # both empty
    assert phrases.fingerprints(docs.limit(0)).count() == 0
    one = phrases.fingerprints(docs.where("doc_id = 7")).collect()[0]
    assert one.near_next == 1.0


def test_chat(spark):
    schema = "conv_id long, turn long, text string, role string, block long, obs int, s int"
    rows = [(1, 0, None, "user", 0, 0, 0), (1, 0, None, "user", 0, 0, 0), (1, 7, "x" * 100_000, "odd", 0, 0, 0), (None, 1, "a", "user", 0, 0, 0), (2, None, "b", None, 0, 0, 0)]
    got = chat.recover(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and sum(r.role_pred is None for r in got) == 2
    assert chat.recover(spark.createDataFrame([], schema)).count() == 0


def test_near_duplicates(docs):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in neardup.group(docs).collect())
    assert got == [(0, 1, 0, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 3, 5, True), (5, 3, 5, True), (6, 1, 6, True), (7, 1, 7, True)]
    assert neardup.group(docs.limit(0)).count() == 0


def test_toxicity(docs, labels):
    got = toxicity.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert toxicity.score(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert toxicity.clean(docs, labels).columns == docs.columns


def test_contamination(spark, docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "kurz"), (3, "kurz"), (None, "kurz")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert (got[7].n_hit, got[7].n_items, got[7].contaminated) == (1, 1, True)
    assert (got[3].n_words, got[3].contaminated) == (0, False)
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    now, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, sf)
        if name != "sentencepiece":
            assert after.columns == docs.columns
        kept.append(after.count())
        now = after
    assert kept == sorted(kept, reverse=True) and kept[0] < docs.count()
    assert corpus_pipeline.run(spark, sf).count() == kept[-1]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_pipeline_stage_edges(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, LONG, "en", "s", 9), (3, "one two three four five six", None, None, 5), (3, "one two three four five six", None, None, 5)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        assert stage(spark, df, "/root/testdata/sf0.001").count() <= df.count()


def test_components_of_few_edges_take_no_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(5, 4), (4, 9), (9, 1), (7, 8), (3, 3), (12, 8), (8, 7), (-2, 20), (20, 21)], "a long, b long")
    want = [(-2, -2), (1, 1), (4, 1), (5, 1), (7, 7), (8, 7), (9, 1), (12, 7), (20, -2), (21, -2)]
    few = Scratch(spark, "t")
    assert sorted(tuple(r) for r in components.components(edges, few).collect()) == want
    assert set(few.paths) == {"comps"}
    assert components.components(edges.where("a = b"), few).count() == 0
    monkeypatch.setattr(components, "DRIVER_EDGES", 0)
    assert sorted(tuple(r) for r in components.components(edges, Scratch(spark, "t")).collect()) == want


def test_near_duplicates_branch_as_they_compare_at_once(spark, monkeypatch):
    text = lambda i, j: " ".join(f"w{i}x{k}" if k != j else f"v{j}" for k in range(60))
    rows = [(100 * i + j, text(i, j)) for i in range(6) for j in range(0, 60, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    at_once = sorted(map(tuple, neardup.group(df, percent=80).collect()))
    monkeypatch.setattr(neardup, "REST", 0)
    monkeypatch.setattr(neardup, "OUTSIDE", 4)
    assert sorted(map(tuple, neardup.group(df, percent=80).collect())) == at_once
    assert len({r[2] for r in at_once}) == 6


def _branching(spark):
    """Groups of near copies, an exact copy of each group's first, and a repeated key with two texts."""
    text = lambda i, j: " ".join(f"w{i}x{k}" if k != j else f"v{j}" for k in range(60))
    rows = [(100 * i + j, text(i, j)) for i in range(6) for j in range(0, 60, 9)]
    rows += [(100 * i + 90, text(i, 0)) for i in range(6)] + [(18, text(9, 0)), (990, text(9, 9)), (995, None), (None, text(2, 0))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_near_duplicates_shuffle_as_they_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neardup, "REST", 0)
    monkeypatch.setattr(neardup, "OUTSIDE", 4)
    order = lambda r: (r.doc_id is None, *map(str, r))
    few = sorted(neardup.group(_branching(spark), percent=80).collect(), key=order)
    assert {r.component_id for r in few} == {0, 100, 200, 300, 400, 500, 995, None}
    for name in ("BROADCAST_KEYS", "BROADCAST_ROWS", "BROADCAST_SKETCHES", "BROADCAST_TEXTS"):
        monkeypatch.setattr(neardup, name, 0)
    assert sorted(neardup.group(_branching(spark), percent=80).collect(), key=order) == few


def test_near_duplicates_shuffle_little(spark, monkeypatch):
    """Each shuffle is a stage of as many tasks as there are partitions, however few its rows."""
    shuffles = []
    put = Scratch.put

    def counted(self, df, name):
        shuffles.append((name, df._jdf.queryExecution().executedPlan().toString().count(" Exchange ")))
        return put(self, df, name)

    monkeypatch.setattr(Scratch, "put", counted)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        neardup.group(_branching(spark), percent=80)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert {name for name, _ in shuffles} >= {"classes", "stats", "groups", "links", "result"}
    assert sum(n for _, n in shuffles) <= 8, shuffles


def test_small_partitions_are_not_collected(monkeypatch):
    calls = []
    monkeypatch.setattr(scratch, "release", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["a"])
    once = scratch.releasing(lambda batches: batches)
    assert len(list(once(iter([batch])))) == 1 and not calls
    assert len(list(once(iter([batch] * 200)))) == 200 and calls == [1]
