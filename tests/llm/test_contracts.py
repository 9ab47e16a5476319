"""Each operator against a plain version of its contract on a small table."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import best_path, components, contamination, lz78, marginals, url_templates
from pyspark.sql import functions as F

from pulsegrid.llm import chat, crf, decontaminate, langid, neardup, phrases, pieces, queries, sampling, tokens, toxicity, urls, warc
from pulsegrid.llm.scratch import Scratch
from pulsegrid.llm.textnum import column_bytes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return dict(docs.select("doc_id", "text").collect())


def test_tokens(spark, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op1_token_output(spark, SF).collect()}
    start = 0
    for key in sorted(texts):
        ids = [*tk.encode(texts[key] or "", add_special_tokens=False).ids, 1]
        assert got[key] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_token_metadata_reads_no_ids(spark, docs):
    scratch = Scratch(spark, "t")
    path = scratch.path("ids")
    tokens.write(docs, path, queries.tokenizer_file("word_bpe_49k.json"))
    plan = tokens.metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in re.search(r"ReadSchema: (\S+)", plan)[1]


def test_warc(spark):
    schema = "page_id long, url string, html string"
    big, other = "x" * 1000, "é" * 600
    rows = [(1, "http://a/", big), (2, "http://a b/", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", other), (7, "u", ""), (9, "u", big)]
    scratch = Scratch(spark, "t")
    got = {r.page_id: r for r in warc.read_pages(warc.write_pages(spark.createDataFrame(rows, schema), scratch.path("w"), scratch)).collect()}
    assert len(got) == len(rows)
    for key, _, html in rows:
        raw = (html or "").encode()
        r = got[key]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if key in (1, 2) else ("response", None))


def test_pieces_equal_the_library(spark, docs, texts):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["", " ", "  ", "x", "x ", "  a  b\nc ", "a▁b▁▁c ▁", "日本語 🎉", "a" * 40, "▁x", "1234567890" * 9, "\x00\r\n"]
    model = pieces.model(path)
    ids, at = model.encode(pa.array(odd))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(odd))] == sp.encode(odd)
    rows = pieces.encode(docs, path)
    assert {r.doc_id: list(r.ids) for r in rows.collect()} == {k: sp.encode(t or "") for k, t in texts.items()}
    assert rows.where("not round_trip").count() == 0
    back = dict(pieces.decode(rows, path).collect())
    assert back == {k: t or "" for k, t in texts.items()}


def test_pieces_unigram_viterbi():
    """With unigram scores the path has the best sum, by plain dynamic programming."""
    model = pieces.PieceModel(queries.tokenizer_file("piece_bpe_32k.model"))
    model.bpe = False
    for word in ("▁worthless", "▁thtionha", "▁éaument"):
        ids, _ = model.encode_chunks([word])
        best = {0: 0.0}
        for j in range(1, len(word) + 1):
            best[j] = max((best[i] + model.scores[model.id_of[word[i:j]]] for i in range(j) if word[i:j] in model.id_of), default=-1e18)
        assert sum(model.scores[ids]) == best[len(word)]


def test_language_held_out(spark, docs):
    found = queries.op4_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).collect()[0][0] > 0.9
    assert found.where("score < 0 or score > 1").count() == 0


def test_url_rules(spark):
    rows = [
        (1, "https://www.Example.com/en/1?x#y", "www.example.com/en/", "allow"), (2, "http://m.example.com/en/1", "example.com/en/", "block"), (3, "http://a.com", None, None),
        (4, "http://notexample.com/en/", "com/", "allow"), (5, "http://b.net/es/1", "net/es/", "block"), (6, "http://b.net/en", None, None), (7, None, None, None), (8, "no scheme", None, None), (9, "HTTP://X.NET/fr/", "net/fr/", "block"),
    ]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([x[:2] for x in rows], "page_id long, url string"), queries.URL_RULES).collect()}
    for key, url, rule, verdict in rows:
        assert got[key].rule == rule
        assert verdict is None or got[key].verdict == verdict
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/1")
    assert (got[7].host, got[7].path, got[8].host, got[3].path) == ("", "", "", "")


def test_url_templates_learn(spark):
    rows = [(i, f"http://h.org/{'spam' if i % 2 else 'news'}/{i}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2 == 1) for i in range(0, 100)], "k long, bad boolean")
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), [], labels=labels, label_key="k", bad=F.col("bad"))
    assert {(r.page_id % 2, r.verdict) for r in out.collect()} == {(1, "block"), (0, "allow")}
    assert {r.template for r in out.collect()} == {"/spam/{num}", "/news/{num}"}


def test_url_tree_equals_plain_recursion(spark):
    rng = np.random.default_rng(4)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    rows = []
    for i in range(1500):
        host = pick("a.org", "b.org", "c.org", "d.net")
        kind = pick("spam", "news", "blog", "deep", "odd")
        tail = {"spam": f"spam/{i}", "news": f"news/{pick(2024, 2025)}/{i}.html", "blog": f"blog/{pick('x', 'y', 'z')}/post-{i % 40}", "deep": "/".join("ab"[int(b)] for b in rng.integers(0, 2, int(rng.integers(5, 12)))), "odd": pick("", "/", "x//y", f"{i:08x}")}[kind]
        bad = bool(rng.random() < {"spam": 0.95, "news": 0.05, "blog": 0.5, "deep": 0.3, "odd": 0.5}[kind]) if host != "d.net" and rng.random() < 0.4 else None
        rows.append((i, f"https://{host}/{tail}", bad))
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    labels = df.where("bad is not null").select(F.col("page_id").alias("k"), "bad")
    got = urls.judge(df.drop("bad"), [], labels=labels, label_key="k", bad=F.col("bad")).collect()
    paths: dict = {}
    for _, url, bad in rows:
        key = tuple(re.match(r"https://([^/]*)(.*)", url).groups())
        n, b, g = paths.get(key, (0, 0, 0))
        paths[key] = (n + 1, b + (bad is True), g + (bad is False))
    want = url_templates(paths)
    assert len(got) == len(rows)
    for r in got:
        template, purity = want[(r.host, r.path)]
        assert (r.template, r.verdict) == (template, "block" if purity >= urls.REJECT else "allow") and abs(r.purity - purity) < 1e-12
    assert {r.verdict for r in got} == {"allow", "block"}


def test_url_unlabelled_branches_take_their_parents_purity(spark):
    """Rules label two branches of a host as bad: its other branches are rejected, those of other hosts are not."""
    rows = [(i, f"http://{'x.net' if i % 2 else 'y.org'}/{('es', 'fr', 'en')[i % 3]}/{i}") for i in range(120)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), queries.URL_RULES).where("rule is null")
    assert {(r.host, r.verdict) for r in got.collect()} == {("x.net", "block"), ("y.org", "allow")}


def test_phrases(spark, texts):
    got = {r.doc_id: r for r in queries.op6_phrase_fingerprints(spark, SF).collect()}
    keys = sorted(texts)
    for i, key in enumerate(keys):
        x, y = texts[key] or "", texts[keys[(i + 1) % len(keys)]] or ""
        n = len(x)
        edited = x[: n - n // 2] + y[: n // 2]
        a, b, c = map(phrases.fingerprint, (x, edited, y))
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (phrases.encoded(a), phrases.encoded(b))
        assert (r.near_edited, r.near_next) == (phrases.likeness(a, b), phrases.likeness(a, c))


def test_phrase_parse_is_lz78():
    ends, rest = phrases.parse("aababcabcd", set())
    assert (ends, rest) == ([1, 3, 6, 10], "")


def test_chat_roles_held_out(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have too few conversations to learn from
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    out = queries.op7_chat_roles(spark, sf).join(turns.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    assert out.where(sampling.fold("conv_id", 3) == 0).agg(F.avg((F.col("role") == F.col("role_pred")).cast("int"))).collect()[0][0] > 0.9


def test_chat_blocks_give_the_best_path(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(1, i, ["user: hi?", "assistant: " + "x" * 200, "hm", "system: be"][int(rng.integers(4))] + str(i), ["system", "user", "assistant"][int(rng.integers(3))]) for i in range(70)]
    rows += [(2, 5, "User: q?", "user"), (2, 9, "Assistant: a", "assistant"), (3, 0, "", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    whole = sorted(tuple(r) for r in chat.recover(df).collect())
    monkeypatch.setattr(chat, "BLOCK", 3)
    assert sorted(tuple(r) for r in chat.recover(df).collect()) == whole


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, docs, texts, percent):
    rng = np.random.default_rng(percent)
    base = " ".join(f"w{i}" for i in rng.integers(0, 500, 120))
    extra = {}
    for k in range(60):  # a dense group around the threshold, and chains
        w = base.split()
        for at in rng.choice(120, int(rng.integers(0, 5)), replace=False):
            w[at] = f"e{rng.integers(1000)}"
        extra[100_000 + k] = " ".join(w)
    everything = texts | extra
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    want, sizes = components(everything, percent)
    got = neardup.group(df, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_branch_and_blocks(spark, monkeypatch):
    """Nodes too large for one group branch, and blocks meet in pairs at the last level."""
    monkeypatch.setattr(neardup, "OUTSIDE", 8)
    monkeypatch.setattr(neardup, "DEPTH", 1)
    rng = np.random.default_rng(0)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = {i: shared + " " + " ".join(f"u{i // 2}x{j}" for j in range(40 - i % 2)) for i in range(80)}
    got = neardup.group(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), percent=80).collect()
    want, _ = components(rows, 80)
    assert {r.doc_id: r.component_id for r in got} == want and rng is not None


def test_toxicity_separates(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), 6))
    stems = ["vexq", "zorb"]
    rows, marks = [], []
    for i in range(600):
        w = [word() for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for at in rng.choice(40, 3, replace=False):
                w[at] = stems[int(rng.integers(2))] + word()[:3]
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, labels, train=sampling.fold("doc_id", 4) != 2).collect()}
    assert np.mean([out[i].predicted == y for i, y in marks]) > 0.98
    hit = next(r for r in out.values() if r.predicted)
    text = dict(rows)[hit.doc_id]
    assert any(text[s.start : s.end].startswith(tuple(stems)) for s in hit.spans)
    assert toxicity.clean(docs, labels).count() == sum(1 - y for _, y in marks)


def test_contamination(spark, docs, texts):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()] + [(900, "Short, item three"), (901, "short ITEM three!"), (902, ""), (None, "of the and to in that is was for on it")]
    more = {100_001: "a short item: three short item three", 100_002: None, 100_003: "x " + items[0][1] + " y " + items[0][1], None: "null key: " + items[1][1]}
    everything = texts | more
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = contamination(everything, items)
    for limit in (decontaminate.BROADCAST_ROWS, 0):  # the same by shuffle joins
        decontaminate.BROADCAST_ROWS, before = limit, decontaminate.BROADCAST_ROWS
        got = {r.doc_id: r for r in decontaminate.contamination(df, b).collect()}
        decontaminate.BROADCAST_ROWS = before
        assert {k: (r.n_words, r.n_hit, r.n_items) for k, r in got.items()} == {k: (n, h, len(i)) for k, (n, h, i) in want.items()}
        assert all(got[k].items_sha256 == hashlib.sha256(",".join(i).encode()).hexdigest() and got[k].contaminated == (h > 0) for k, (n, h, i) in want.items())


def test_contamination_is_native(spark):
    plan = queries.op10_decontamination(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_token_chunks_equal_the_library():
    """The direct path and the chunk cache give the ids of whole texts, odd ones included."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    odd = [
        "", "ﬁ é é", "日本語 テスト 🎉🎉 x", "don't WON'T it's 's x's 12ab3 a_b", "ΣΑΣ ß ẞ", "a\x1cb\x85c\xa0d e", "<|startoftext|> <|endoftext|>x", "é É.", "İI",
        "١٢ ²½ x²", "Ⅷ ⅷ", "​ a", "x" * 300, "ﾊﾟ", "word,,! (word) [a]b 'tis '", "ñ$$$ a%%% 1.2.3.4", "\t\n", "Ünïcode-Wörter; _x_ é~",
    ]
    ids, at = tokens.encode(path, pa.array(odd))
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(odd))] == [tk.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_samples_are_bounded_by_rows_and_bytes(spark):
    rows = [(i, "ab"[i % 2], "x" * 10) for i in range(400)] + [(1000, None, "y")]
    df = spark.createDataFrame(rows, "k long, label string, text string")
    chosen = sampling.hashed_sample(df, "k", "label", 30)
    assert {c[1]: sum(x[1] == c[1] for x in chosen) for c in chosen} == {"a": 30, "b": 30}
    assert sampling.hashed_sample(df.repartition(7), "k", "label", 30) == chosen
    found = sampling.texts_of(df, "k", "text", chosen, 200)
    assert found.num_rows == 20 and set(found["k"].to_pylist()) == {c[0] for c in chosen[:20]}
    assert sampling.texts_of(df, "k", "text", chosen, 1).num_rows == 2


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(6)
    lengths = [3, 1, 0, 5, 2]
    first = np.concatenate([[0], np.cumsum(lengths)])
    score, transitions, start = rng.normal(size=(first[-1], 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    for block in (48, 2):  # documents of one block and of several
        crf.BLOCK, before = block, crf.BLOCK
        got, expected, began = crf.forward_backward(score, first, transitions, start, True)
        crf.BLOCK = before
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b > a:
                assert np.allclose(got[a:b], marginals(score[a:b], transitions, start))
        assert np.isclose(expected.sum(), sum(max(0, n - 1) for n in lengths)) and np.isclose(began.sum(), 4)


def test_chat_block_path_equals_all_paths():
    rng = np.random.default_rng(8)
    start, move, emit = np.log(rng.dirichlet(np.ones(3))), np.log(rng.dirichlet(np.ones(3), 3)), np.log(rng.dirichlet(np.ones(chat.OBSERVATIONS), 3))
    for n in (1, 2, 6):
        obs = rng.integers(0, chat.OBSERVATIONS, n)
        matrix = chat._block_matrix(obs, True, start, move, emit)
        path = chat._block_path(obs, True, 0, int(matrix[0].argmax()), start, move, emit)
        assert tuple(path) == best_path(obs, start, move, emit)


def test_phrase_sets_equal_plain_lz78():
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("abé "), int(rng.integers(1, 300)))) for _ in range(30)]
    for x, y in zip(texts, texts[1:], strict=False):
        a, b = set(lz78(x)), set(lz78(y))
        assert len(phrases.fingerprint(x)) == min(len(a), phrases.SKETCH)
        if len(a | b) <= phrases.SKETCH:  # a sketch that holds all is exact
            assert phrases.likeness(phrases.fingerprint(x), phrases.fingerprint(y)) == pytest.approx(len(a & b) / len(a | b))


def test_pipeline_equals_plain_stages(spark):
    """Each stage keeps what its operator's own verdict, or a plain version of it, says."""
    import corpus_pipeline

    now = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(now, labels, train=sampling.fold("doc_id", 4) != 2)
    after = stages["toxicity"](spark, now, SF)
    assert kept(after) == kept(scored.where("predicted = 0"))
    found = langid.identify(after, train=sampling.fold("doc_id", 3) != 1, runs=False)
    spoken = stages["language_id"](spark, after, SF)
    assert kept(spoken) == kept(found.where("lang_pred <> 'und' and score >= 0.3"))
    texts = dict(spoken.select("doc_id", "text").collect())
    want, _ = components(texts, 80)
    single = stages["near_dedup"](spark, spoken, SF)
    assert kept(single) == {k for k, c in want.items() if k == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = stages["decontamination"](spark, single, SF)
    hits = contamination(dict(single.select("doc_id", "text").collect()), items)
    assert kept(clean) == {k for k, (_, n, _) in hits.items() if not n}
    assert kept(stages["sentencepiece"](spark, clean, SF)) == kept(clean)


def test_toxic_edits_of_clean_documents_count():
    """Copies count once within one label, but not across labels, and what a document adds to a shared passage counts."""
    page = " ".join(f"w{i}" for i in range(100))
    half = lambda x: " ".join([*page.split()[:60], *(f"{x}{i}" for i in range(40))])
    texts = [page, page + " foul", page, page + " foul", half("a"), half("b"), half("c"), "", ""]
    words = crf.Features().words(*column_bytes(pa.array(texts)))
    (fresh,) = toxicity._fresh([(words, np.array([0, 1, 0, 1, 1, 1, 1, 0, 0]))])
    parts = np.split(fresh, words.first[1:-1])
    assert [int(x.sum()) for x in parts] == [100, 101, 0, 0, 44, 44, 44, 0, 0]
    assert all(x[60:].all() for x in parts[4:7])


def test_languages_of_mixed_text(spark):
    en, fr = "the cat sat on the mat with the dog and ate", "le chat était très fâché dans la maison avec été"
    rows = [(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(1, 41)]
    rows += [(50, f"{fr} {fr}\n{en} {en}", None), (51, "  ", None), (52, None, None), (53, fr, None)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    mixed = rows[40][1]
    assert [(mixed[r.start : r.end], r.lang) for r in out[50].runs] == [(f"{fr} {fr}", "fr"), (f"{en} {en}", "en")]
    assert all(len(r.runs) == (r.n_switches + 1 if r.lang_pred != "und" else 0) for r in out.values())
    assert out[51].runs == out[52].runs == [] and [tuple(r) for r in out[53].runs] == [(0, len(fr), "fr")]


def test_added_tokens_inside_texts(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [
        "end of text <|endoftext|> next", "Plain words", "<|ENDOFTEXT|> is none", None, "a<|startoftext|>b<|endoftext|><|endoftext|>C  d", "", "<|endoftext|>",
        "<|endoftext |> nor this", "Last É 1.2 <|startoftext|>İx", "end",
    ]
    out = Scratch(spark, "t").path("ids")
    tokens.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1), out, path)
    got = {r.doc_id: (r.ids, r.start) for r in tokens.read(spark, out).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert got[i] == (ids, start)
        start += len(ids)
