"""Every operator against a plain Python version, with nulls, empty and long texts, ties, repeated rows, empty tables
and extra columns whose names clash with the operators' own."""

import hashlib
import random

import numpy as np
import pytest

from aerotow.llm import bpe, decontaminate, jaccard, languages, licenses, lm, quality, toxicity, urls, warc
from aerotow.llm import queries as Q
from aerotow.llm.scratch import new_path

from . import brute

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words bigint, label int, score double, n bigint, spans string"


def sentence(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "ré", "in", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): nulls, empties, exact and near copies, repeated lines and rows, phrases, a very long text."""
    rng = random.Random(7)
    passage = sentence(rng, 40)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two three"), (5, "One TWO three"), (6, "!!! ### $$$"), (7, "été Ünïcode 日本語 🙂 x")]
    for i in range(8, 40):
        rows.append((i, "\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 8)))))
    base = sentence(rng, 200).split()
    for i in range(40, 52):  # near copies: a word or two changed
        w = list(base)
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = f"changed{i}"
        rows.append((i, " ".join(w)))
    rows += [(60, rows[10][1]), (61, rows[10][1]), (62, "say " + passage + " end"), (63, passage), (64, "a b c d e f g h i j"),
             (65, "Released under the MIT License. cc-by-nc under the mit license"), (66, "Licensed under the Apache License, Version 2.0."),
             (67, "x y z " * 60), (68, "x y z " * 60 + "w"), (69, sentence(rng, 40_000)), (70, "it's <|endoftext|> don't 12 a\u0301 \u00a0 b"),
             (70, "it's <|endoftext|> don't 12 a\u0301 \u00a0 b"), (None, "row without an id and some words")]
    return rows, passage


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows, _ = corpus
    return spark.createDataFrame([(i, t, None if (i or 0) % 5 == 0 else "en", None if (i or 0) % 4 == 0 else "s", 1, 2, 3, 0.5, 4, "x") for i, t in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def by_text(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_decontamination(spark, corpus, docs, empty):
    rows, passage = corpus
    items = [(1, passage), (1, passage), (2, "a b c"), (3, None), (4, ""), (None, "one two"), (15, sentence(random.Random(1), 12)), (7, "xyz qqq")]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, doc_id string")
    want = sorted((str(i), *brute.contamination(t, items)) for i, t in rows)
    got = sorted((str(a), b, c, d, e) for a, b, c, d, e in by_text(decontaminate.report(decontaminate.find_contamination(docs, bench)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256"))
    assert got == want
    assert sum(x[2] > 0 for x in got) >= 5
    kept = {r.doc_id for r in decontaminate.remove_documents(docs, bench).collect()}
    assert 63 not in kept and 64 not in kept and 20 in kept and 0 in kept
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.report(decontaminate.find_contamination(docs, bench.limit(0))).where("n_hit > 0").count() == 0
    cut = {r.doc_id: r.clean_text for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[62] == "say  end" and cut[20] == dict(rows)[20] and cut[0] is None


def test_decontamination_in_blocks(spark, corpus, docs, monkeypatch):
    rows, passage = corpus
    items = [(i, t) for i, t in enumerate([passage, passage[:120], "a b c d", "one two", sentence(random.Random(1), 12)])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(str, by_text(decontaminate.report(decontaminate.find_contamination(docs, bench)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256")))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 50)
    several = sorted(map(str, by_text(decontaminate.report(decontaminate.find_contamination(docs, bench)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256")))
    assert several == one


def test_decontamination_by_row(spark, monkeypatch):
    """A contaminated row takes no clean row of the same or of no id with it."""
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, passage), (2, "uno due tre quattro cinque")], "item_id bigint, text string")
    bad, clean = f"so {passage} it is", "nothing of the kind"
    rows = [(None, bad), (None, clean), (None, None), (7, bad), (7, clean), (7, clean), (8, clean), (9, "uno due tre quattro cinque")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted([(None, clean), (None, None), (7, clean), (7, clean), (8, clean)], key=str)
    assert sorted(map(tuple, decontaminate.remove_documents(docs, bench).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 20)
    assert sorted(map(tuple, decontaminate.remove_documents(docs, bench).collect()), key=str) == want


def test_license_scan(corpus, docs, empty):
    rows, _ = corpus
    got = {r.doc_id: r for r in licenses.report(licenses.scan(docs)).collect()}
    for i, t in rows:
        places = brute.phrases(t, licenses.PHRASES)
        r = got[i]
        assert r.n_words == len(brute.words(t, brute.ALNUM))
        assert (r.n_base, r.base_labels) == (len(places), ",".join(sorted({x for _, x in places}))), i
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[65].n_base == 3 and got[66].base_labels == "apache-2" and got[20].labels == ""
    assert licenses.report(licenses.scan(empty)).count() == 0


def test_url_filter(spark, empty):
    urls_ = [None, "", "no scheme", "http://A.Net", "https://x.example.net/en/1?a#b", "https://x.example.net/de/1", "http://example.com/de/2#q",
             "http://notexample.com/de/2", "ftp://q.org/fr/x", "http://net/", "a://b://c/d", "http://bad.example.org/en/5"]
    pages = spark.createDataFrame([(i, u, "h", 0) for i, u in enumerate(urls_)] + [(100 + i, f"http://bad.example.org/en/{i}", "h", 0) for i in range(60)]
                                  + [(200 + i, f"http://good{i % 9}.example.org/en/{i}", None, 0) for i in range(400)], "page_id bigint, url string, html string, host int")
    seen = spark.createDataFrame([(100 + i, 1) for i in range(50)] + [(200 + i, 0) for i in range(390)] + [(100, None)], "page_id bigint, bad int")
    got = {r.page_id: r for r in urls.judge(pages, seen).collect()}
    assert [(got[i].host, got[i].path) for i in range(len(urls_))] == [
        ("", ""), ("", ""), ("", ""), ("a.net", ""), ("x.example.net", "/en/1"), ("x.example.net", "/de/1"), ("example.com", "/de/2"),
        ("notexample.com", "/de/2"), ("q.org", "/fr/x"), ("net", "/"), ("b:", "//c/d"), ("bad.example.org", "/en/5")]
    assert [got[i].rule for i in range(3, 10)] == [None, "example.net/en/", "net/", "example.com/de/", None, "org/fr/", "net/"]
    assert got[11].verdict == "block" and got[205].verdict == "allow" and got[0].verdict == "allow" and got[4].verdict == "allow" and got[5].verdict == "block"
    assert urls.judge(pages.limit(0), seen.limit(0)).count() == 0
    assert urls.judge(pages, seen.limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_quality_measures(corpus, docs, empty):
    rows, _ = corpus
    got = sorted((str(x[0]), *x[1:]) for x in by_text(quality.judge(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
    want = []
    for i, t in rows:
        m = brute.measures(t)
        want.append((str(i), *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert got == sorted(want)
    assert quality.judge(empty).count() == 0


def plain_kept(rows, limit=10, depleted=0.5):
    """{id: kept} of (id, text, host): lines of more than ``limit`` different pages of a host are removed."""
    pages = {i: ["".join(c.lower() if c.isascii() else c for c in " ".join(brute.words(x, lower=False))) for x in (t or "").split("\n") if brute.words(x)] for i, t, _ in rows}
    where = {}
    for i, _, host in rows:
        for x in pages[i]:
            where.setdefault((host, x), set()).add("\n".join(pages[i]))
    out = {}
    for i, t, host in rows:
        m, size = brute.measures(t), [len(x.split(" ")) for x in pages[i]]
        gone = sum(n for x, n in zip(pages[i], size) if len(where[host, x]) > limit)
        out[i] = m[0] >= 50 and 100 * m[4] <= 50 * m[0] and gone <= depleted * sum(size)
    return out


def test_quality_line_frequency(spark):
    rng = random.Random(3)
    common = sentence(rng, 30)
    page = [sentence(rng, 20) for _ in range(4)]
    rows = [(i, common + "\n" + sentence(rng, 25), "h") for i in range(12)]          # depleted: the shared line is over half
    rows += [(100 + i, "\n".join(page), "h") for i in range(40)]                     # copies of a page do not condemn it
    for start, shared in ((300, 1), (400, 10), (500, 30)):                           # boilerplate of any number of lines does
        lines = [sentence(rng, 6) for _ in range(shared)]
        rows += [(start + i, "\n".join([*lines, sentence(rng, 55 if shared == 1 else 20)]), f"s{shared}") for i in range(60)]
    rows += [(200, common + "\n" + sentence(rng, 25), "other"), (201, sentence(rng, 80), None)]
    rows += [(600 + i, "\n".join([*page[:3], sentence(rng, 70)]), "few") for i in range(10)]  # ten pages are not over the limit
    rows += [(700, "\n".join(page), "h"), (701, "  " + "\n\n".join(page).upper() + " ", "h")]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert kept == plain_kept(rows)
    assert not any(kept[i] for i in range(12)) and all(kept[100 + i] for i in range(40)) and kept[200] and kept[201]
    assert all(kept[300 + i] for i in range(60)) and not any(kept[400 + i] or kept[500 + i] for i in range(60))
    left = quality.keep(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert left.columns == ["doc_id", "text", "source"] and left.count() == sum(kept.values())


def test_quality_long_white_space(spark):
    """A million blanks in a text take linear time."""
    text = "word " * 60 + " " * 1_000_000 + "end\n" + " " * 1_000_000
    r = quality.judge(spark.createDataFrame([(1, text, "s")], "doc_id bigint, text string, source string")).first()
    assert r.n_words == 61 and r.word_chars == 243


def test_jaccard_join(corpus, docs, empty):
    rows, _ = corpus
    want = brute.components([(i, t) for i, t in rows if i is not None])
    got = {r.doc_id: r for r in jaccard.join(docs).collect()}
    for i, t in rows:
        assert got[i].n_shingles == len(brute.shingles(t)), i
        assert got[i].component_id == want.get(i), i
    assert len({got[i].component_id for i in range(40, 52)}) == 1
    assert jaccard.join(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None} | set(want.values())


def test_jaccard_tiles_lose_no_link(spark, monkeypatch):
    """Chains of near copies (linked neighbours only) through tiny leaves and tiles."""
    monkeypatch.setattr(jaccard, "LEAF", 2)
    monkeypatch.setattr(jaccard, "TILE", 3)
    rng = random.Random(11)
    rows, w = [], sentence(rng, 120).split()
    for i in range(40):
        w = list(w)
        w[rng.randrange(len(w))] = f"step{i}"
        rows.append((1000 - 7 * i, " ".join(w)))
    rows += [(i, sentence(rng, 30)) for i in range(10)]
    want = brute.components(rows)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_lm_scoring(corpus, docs, empty):
    rows, _ = corpus
    from pyspark.sql import functions as F
    got = lm.score(docs.where("doc_id is not null"), F.col("doc_id") % 3 != 1).collect()
    model = brute.Ppm([t for i, t in rows if i is not None and i % 3 != 1], lm.ORDER)
    texts = dict(rows)
    for r in got:
        t = texts[r.doc_id]
        assert r.n_tokens == len(brute.words(t)) + 1 and r.n_known == sum(model.words[w] > 0 for w in brute.words(t)) + 1
        assert r.train_tokens == sum(model.words.values()) + model.texts
        assert r.base_score == pytest.approx(model.base(t), rel=1e-9)
        if r.doc_id != 69:
            assert r.score == pytest.approx(model.score(t), rel=1e-9)
    for ctx in (b" " * 0 + b"\0" * (lm.ORDER - 1) + b" ", (b"\0" * lm.ORDER + b" th")[-lm.ORDER:]):
        assert sum(10 ** model.lp(ctx, s) for s in range(256)) == pytest.approx(1)
    assert lm.score(empty, F.lit(True)).count() == 0
    nothing = lm.score(docs, F.lit(False)).where("doc_id = 1").first()
    assert nothing.base_score == 0 and nothing.score == pytest.approx(-np.log10(256)) and nothing.n_known == 0


def test_lm_scoring_across_words(spark, corpus, docs, empty, monkeypatch):
    """Contexts run over the spaces: whole texts against the plain model, small blocks, word order counts."""
    from pyspark.sql import functions as F
    rows, _ = corpus
    monkeypatch.setattr(lm, "CONTEXT_BYTES", 1000)
    whole = lambda t: b"\0" * (lm.ORDER - 1) + b" " + b"".join(w.encode() + b" " for w in brute.words(t)) + b"\xff"
    keys = lambda t: [(a[i - lm.ORDER:i], a[i]) for a in [whole(t)] for i in range(lm.ORDER, len(a))]
    rows = [(i, t) for i, t in rows if i != 69]
    learned = [t for i, t in rows if i is not None and i % 3 != 1]
    model, words = brute.Ppm([], lm.ORDER), brute.Ppm(learned, lm.ORDER)
    for t in learned:
        for ctx, x in keys(t):
            model.add(ctx, x, 1)
    got = lm.score(docs.where("doc_id is null or doc_id <> 69"), F.col("doc_id") % 3 != 1, across=True).collect()
    want = sorted((str(i), len(brute.words(t)) + 1, sum(words.words[w] > 0 for w in brute.words(t)) + 1) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in got) == want
    texts = dict(rows)
    for r in got:
        t = texts[r.doc_id]
        assert r.score == pytest.approx(sum(model.lp(*k) for k in keys(t)), rel=1e-9)
        assert r.base_score == pytest.approx(words.base(t), rel=1e-9) and r.learned == (r.doc_id is not None and r.doc_id % 3 != 1)
    two = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "mat the on sat cat the")], "doc_id bigint, text string")
    a, b = (r.score for r in lm.score(two, F.col("doc_id") == 1, across=True).orderBy("doc_id").collect())
    assert a > b + 1
    assert lm.score(empty, F.lit(True), across=True).count() == 0
    nothing = lm.score(docs, F.lit(False), across=True).where("doc_id = 1").first()
    assert nothing.score == pytest.approx(-np.log10(256)) and nothing.n_known == 0


def test_toxicity(spark, empty):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        w = sentence(rng, 60).split()
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["blorgish", "vexmundane", "krumpfling"])
        rows.append((i, " ".join(w), i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows + [(700, None, 1, 0), (701, "", 1, 0), (702, sentence(rng, 30_000), 1, 0)], "doc_id bigint, text string, most bigint, label int")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows] + [(700, None), (9999, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(toxicity.learning_rows(docs, labels))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {i: y for i, _, _, y in rows}
    held = [r.doc_id for r in docs.where(toxicity.remainder() == 1).collect() if r.doc_id in truth]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[700].predicted == got[701].predicted == 0
    kept = toxicity.keep(docs, labels)
    assert kept.columns == docs.columns and 700 in {r.doc_id for r in kept.collect()}
    assert toxicity.fit(toxicity.learning_rows(docs, labels.where("toxic = 1"))) is None
    assert toxicity.score(empty, model).count() == 0 and toxicity.keep(empty, labels).count() == 0
    assert toxicity.score(docs, None).where("score <> 0").count() == 0


def test_warc_round_trip(spark):
    big = "é" * 300_000
    rows = [(5, "http://a/1", "x" * 200), (3, "http://a/2", "x" * 200), (9, None, "x" * 200), (1, "http://a/3\nInjected: 1", None), (2, "u", ""), (4, "u", "x" * 99),
            (6, "u", "x" * 99), (7, "u", big), (8, "u", "line\r\n\r\nline WARC/1.1\r\n"), (3, "again", "x" * 200)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload string").repartition(3)
    path = new_path(spark, "test-warc")
    warc.write(warc.plan(pages), path)
    got = sorted(tuple(r) for r in warc.report(warc.read(spark, path)).collect() if True)
    want = sorted((i, len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest(),
                   "revisit" if t == "x" * 200 and i != 3 else "response", 3 if t == "x" * 200 and i != 3 else None) for i, _, t in rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    archive = warc.read(spark, path)
    only = archive.where("warc_type = 'revisit'")
    assert {r.record_id for r in only.collect()} == {"urn:page:5", "urn:page:9"}
    assert "Filter" not in only._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")  # taken over by the source
    assert archive.where("target_uri = 'u' and warc_type = 'response'").count() == 5
    assert archive.where("record_id = 'urn:page:7'").first().payload.decode() == big
    assert warc.read(spark, path, payload=False).where("payload is not null").count() == 0
    assert {r.target_uri for r in archive.where("record_id = 'urn:page:1'").collect()} == {"http://a/3%0AInjected: 1"}
    none = new_path(spark, "test-warc-empty")
    warc.write(warc.plan(pages.limit(0)), none)
    assert warc.read(spark, none).count() == 0


def test_warc_foreign_archive(spark, tmp_path):
    """Members without a length field, in a file without a manifest."""
    import gzip
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r1>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <r2>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(two) + gzip.compress(one) + gzip.compress(two))
    rows = warc.read(spark, str(tmp_path)).collect()
    assert [(r.record_id, r.warc_type, r.payload) for r in rows if r.warc_type == "response"] == [("r1", "response", b"hello")] and len(rows) == 3


def test_warc_append_headers_and_plain_files(spark, tmp_path):
    """A second write adds its records; header names in any case; files without compression."""
    path = new_path(spark, "test-warc-append")
    for i in (1, 2):
        warc.write(warc.plan(spark.createDataFrame([(10 * i, "u", f"text {i}"), (10 * i + 1, "v", None)], "page_id bigint, url string, html string")), path)
    assert sorted(r.page_id for r in warc.report(warc.read(spark, path)).collect()) == [10, 11, 20, 21]
    body = b"HTTP/1.1 200 OK\r\n\r\nhello"
    one = b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID:<r1>\r\ncontent-length:%d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type:  warcinfo \r\nWARC-Record-ID: <r2>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(two + one + two)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, r.warc_type) for r in rows) == [("r1", "response"), ("r2", "warcinfo"), ("r2", "warcinfo")]
    assert [r.payload for r in rows if r.warc_type == "response"] == [b"hello"]
    assert warc.read(spark, f"{tmp_path}/x.warc").where("warc_type = 'response'").count() == 1
    assert [r.payload for r in warc.read(spark, str(tmp_path), payload=False).collect()] == [None] * 3


def test_bpe(corpus, docs, empty):
    from tokenizers import Tokenizer
    path = Q.tokenizer_path()
    t = Tokenizer.from_file(path)
    got = sorted((str(a), *rest) for a, *rest in by_text(bpe.digest(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    want, ids_of = [], {}
    for i, text in corpus[0]:
        ids = ids_of[i] = t.encode(text or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    coded = bpe.encode(docs, path)
    assert all(r.ids == ids_of[r.doc_id] for r in coded.collect())
    assert all(r.decoded == t.decode(ids_of[r.doc_id], skip_special_tokens=False) for r in bpe.decode(coded, path).collect())
    assert bpe.digest(empty, path).count() == 0


def test_keep_one_by_row(spark):
    """Repeated rows, rows of one id with different texts, rows without an id."""
    a, b, c, d = ("alpha beta gamma delta epsilon", "one two three four five six", "uno due tre quattro cinque", "eins zwei drei vier")
    rows = [(1, a, "x"), (1, a, "x"), (2, a, "y"), (3, b, "x"), (3, c, "x"), (None, b, "x"), (None, d, "x"), (None, d, "y"), (None, None, "x"), (None, None, "x"), (4, None, "x"), (5, "", "x"), (6, "", "x")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, _class string"))
    assert kept.columns == ["doc_id", "text", "_class"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (3, b), (3, c), (None, d), (4, None), (5, ""), (6, "")], key=str)
    assert jaccard.keep_one(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_tree_prunes_subtrees():
    """The descent compares far fewer boxes than there are pairs of leaves, and keeps every pair that the bound allows."""
    rng = np.random.default_rng(3)
    centres = [np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(40)]
    sets = [np.unique(np.concatenate([c[rng.random(len(c)) > 0.02], rng.integers(0, 2**63, 4, dtype=np.uint64)])) for c in centres for _ in range(40)]
    sets += [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in range(20, 2000, 5)]
    n, vec = np.array([len(s) for s in sets]), np.stack([jaccard._folded(jaccard.vector(s), jaccard.COARSE) for s in sets])
    tree = jaccard._Tree(np.argsort(n, kind="stable"), n, vec, 85)
    leaves = -(-len(sets) // jaccard.LEAF)
    x, y = tree.leaf_pairs()
    assert len(tree.levels) >= 3 and tree.compared < leaves * (leaves + 1) // 2
    kept = set(zip(x.tolist(), y.tolist()))
    leaf = np.empty(len(sets), int)
    leaf[tree.order] = np.arange(len(sets)) // jaccard.LEAF
    for a in range(0, len(sets), 7):
        meet = np.minimum(vec[a], vec).sum(1)
        for b in np.flatnonzero(100 * meet >= 85 * (n[a] + n - meet)):
            assert (min(leaf[a], leaf[b]), max(leaf[a], leaf[b])) in kept


def test_near_copies_cost_their_number(spark, monkeypatch):
    """A group of near copies that one star does not settle: all links are found, and the search emits few pairs."""
    rng = random.Random(4)
    base = sentence(rng, 150).split()
    rows = []
    for i in range(400):  # a chain of drifting copies: neighbours link, the ends do not
        w = list(base)
        for k in range(i // 8):
            w[(k * 7) % len(w)] = f"drift{k}"
        w[rng.randrange(len(w))] = f"own{i}"
        rows.append((i, " ".join(w)))
    made = []
    plain = jaccard.written

    def counted(df, name, **o):
        out = plain(df, name, **o)
        if name == "tree-pairs":
            made.append(out.count())
        return out
    monkeypatch.setattr(jaccard, "written", counted)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == brute.components(rows)
    assert made[0] <= 20 * len(rows)


def test_overlap_bound_of_very_large_groups():
    """The bound stays an upper bound where a group has more than 65535 shingles."""
    s = np.arange(70_000, dtype=np.uint64) << np.uint64(15)
    a, b = jaccard.vector(s).tobytes(), jaccard.vector(s[:66_000]).tobytes()
    assert jaccard.overlap_bound(a, a) == 70_000 and jaccard.overlap_bound(a, b) == 66_000
    small = jaccard.vector(s[:100]).tobytes()
    assert jaccard.overlap_bound(a, small) == jaccard.overlap_bound(small, a) == 100 and len(small) == jaccard.GROUPS  # a byte a group


def test_language_spans(spark, empty):
    rng = random.Random(2)
    syllables = {"aa": ["th", "ing", "ew"], "bb": ["sch", "ung", "ei"], "cc": ["при", "вет", "ом"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))
    rows = [(i, text(x, 40), x, 1) for i, x in enumerate(["aa", "bb", "cc"] * 30)]
    mixed = text("aa", 30) + " " + text("bb", 50) + " " + text("cc", 20)
    docs = spark.createDataFrame(rows + [(100, None, "aa", 1), (101, "", None, 1), (102, "12 34 -- !", "bb", 1), (103, mixed, None, 1), (104, text("bb", 30_000), None, 1), (105, "日本", None, 1)],
                                 "doc_id bigint, text string, lang string, score int")
    model = languages.fit(docs.where(toxicity.remainder() != 1))
    got = {r.doc_id: r for r in languages.predict(docs, model).collect()}
    assert all(got[i].lang_pred == x and 0 <= got[i].score <= 1 for i, _, x, _ in rows)
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[104].lang_pred == "bb" and got[105].lang_pred in ("aa", "bb", "cc")
    spans = [tuple(s) for s in languages.spans(docs.where("doc_id = 103"), model).first().spans]
    assert spans == [("aa", 0, 30), ("bb", 30, 80), ("cc", 80, 100)] and got[103].lang_pred == "bb"
    assert languages.predict(docs, languages.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert languages.predict(empty, model).count() == 0


def test_viterbi_against_all_paths():
    import itertools
    rng = np.random.default_rng(1)
    counts = [3, 0, 5, 1]
    scores = rng.normal(size=(sum(counts), 3)).astype(np.float32) * 3
    first = np.concatenate([[0], np.cumsum(counts)])
    got = languages.viterbi(scores, first, 2.0)
    for d, n in enumerate(counts):
        s = scores[first[d]:first[d + 1]]
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got[first[d]:first[d + 1]]) == best


def test_viterbi_keeps_small_differences_in_large_sums():
    scores = np.full((2200, 2), -30_000, np.float32)
    scores[:2000, 0] += 1
    scores[2000:, 1] += 0.25
    got = languages.viterbi(scores, np.array([0, 2200]), 10.0)
    assert got.tolist() == [0] * 2000 + [1] * 200


def test_pipeline_against_plain_stages(spark):
    import sys
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    docs = Q.table(spark, sf, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    step = quality.judge(docs).collect()
    left = {r.doc_id for r in step if r.kept}
    assert all(not (m := brute.measures(rows[i]))[0] < 50 and 100 * m[4] <= 50 * m[0] for i in left)
    d1 = docs.where(docs.doc_id.isin(sorted(left)))
    model = toxicity.fit(toxicity.learning_rows(d1, Q.table(spark, sf, "labels")))
    left -= {r.doc_id for r in toxicity.score(d1, model).collect() if r.predicted}
    comp = brute.components([(i, rows[i]) for i in sorted(left)])
    left = set(comp.values())
    items = [(r.item_id, r.text) for r in Q.table(spark, sf, "benchmark").collect()]
    left = {i for i in left if not brute.contamination(rows[i], items)[1]}
    t = Tokenizer.from_file(Q.tokenizer_path())
    got = {r.doc_id: r.n_tokens for r in P.run(spark, sf).collect()}
    assert got == {i: len(t.encode(rows[i], add_special_tokens=False).ids) for i in left}
    assert "corpus_pipeline" in sys.modules and len(P.STAGES) == 5


def test_registered_queries_cover_the_operators():
    names = sorted(int(n.split("_")[0][2:]) for n in Q.QUERIES)
    assert names == list(range(1, 11))
