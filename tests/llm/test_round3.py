"""Merkle manifest, spelling variants and the embedding classifier against plain Python versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from aerotow.llm import embedding_quality, merkle, spelling
from aerotow.llm.text import SPACED

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree bigint, idx bigint, path string, word string, n bigint, score double, label int"


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source, n_chars); further columns clash with the operators' own names."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z", 3, 0.5, 1) for r in rows], DOCS)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(h, arity):
    out = [h]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def path(up, i, arity):
    out = []
    for x in up[:-1]:
        a = i // arity * arity
        out.append(("".join(x[a:i]), "".join(x[i + 1:a + arity])))
        i //= arity
    return out


def plain_manifest(rows, arity=3):
    """Sorted rows of merkle.verify."""
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((r[0], H(*map(coded, (r[0], r[3], r[2], r[4], r[1]))), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = own, levels([x[1] for x in own], arity)
    top = levels([trees[s][1][-1][0] for s in order], arity) if order else []
    out = []
    for k, s in enumerate(order):
        own, up = trees[s]
        for i, (doc_id, leaf, r) in enumerate(own):
            p = path(up, i, arity) + path(top, k, arity)
            text = r[1]
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            h = H(*map(coded, (doc_id, r[3], r[2], r[4], text)))
            for a, b in p:
                h = H(a, h, b)
            out.append((str(doc_id), leaf, up[-1][0], top[-1][0], H("".join(a + b for a, b in p)), h, h == top[-1][0]))
    return sorted(out)


@pytest.fixture(scope="module")
def leaves():
    rng = random.Random(3)
    rows = [(i, "a\nb" * (i % 4), "en", f"s{i % 5}", i) for i in range(60)]
    rows += [(i, "line\nline", None, "hot", None) for i in range(100, 223)]  # more than a third in one source, ends in short runs
    rows += [(300, None, "de", None, 1), (301, "", None, None, 2), (302, "x\ny" * 30_000, "fr", "", 3), (303, "é€\U0001f642\n", "fr", "lone é", 4)]
    rows += [(310, "same\n", "en", "s1", 1)] * 3 + [(None, "no id\n", "en", "s1", 1), (None, "no id\n", None, None, 1), (310, "other", "en", "s1", 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_merkle_against_plain(spark, leaves, arity):
    got = merkle.verify(docs_of(spark, leaves).repartition(5), arity=arity)
    rows = sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())
    assert rows == plain_manifest(leaves, arity)
    assert 0 < sum(r[-1] for r in rows) < len(rows)


def test_merkle_empty_and_single(spark):
    assert merkle.verify(docs_of(spark, []), 3).count() == 0
    r = merkle.verify(docs_of(spark, [(7, "one", None, "s", 1)])).collect()[0]
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H("") and r.verified


def test_merkle_places_span_partitions(spark):
    """A group over many partitions, groups that begin and end inside partitions, null first."""
    rows = [(None if i < 40 else f"g{i // 400}", i, H(str(i))) for i in range(2000)]
    table = merkle.written(spark.createDataFrame(rows, "grp string, id bigint, leaf string").repartition(7), "test-places")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merkle.placed(table, "id", "leaf").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, seen = {}, Counter()
    names = {g: k for k, g in enumerate(sorted({r[0] for r in rows}, key=lambda s: (s is not None, s or "")))}
    for g, i, _ in rows:
        want[i] = names[g], seen[g]
        seen[g] += 1
    assert {r.id: (r.tree, r.idx) for r in got} == want


def test_merkle_manifest_table(spark, leaves):
    """The manifest's nodes: every level a third of the one below, a change of one leaf changes its path only."""
    docs = docs_of(spark, leaves)
    m = merkle.manifest(docs)
    sizes = Counter((r.tree, r.level) for r in m.groups.nodes().collect())
    for (tree, level), n in sizes.items():
        if level:
            assert n == -(-sizes[tree, level - 1] // 3)
    other = merkle.manifest(docs_of(spark, [(*r[:1], "changed", *r[2:]) if r[0] == 150 else r for r in leaves]))
    a, b = ({(r.tree, r.level, r.idx): r.h for r in x.groups.nodes().collect()} for x in (m, other))
    assert len({k[0] for k in a if a[k] != b[k]}) == 1 and sum(a[k] != b[k] for k in a) == max(k[1] for k in a) + 1
    assert m.root != other.root


def plain_variants(rows, length=6, least=5, ratio=5, damage=199):
    count = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= length and n >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    beside = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, near_words in beside.items():
        if near_words:
            best = min(near_words, key=lambda x: (-words[x], x))
            if words[best] >= ratio * words[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n, len(beside[w]), words[form[w]] if w in form else None) for w, n in words.items())


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeéñ×") for _ in range(rng.randint(5, 9))) for _ in range(12)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(120):
            w = rng.choice(base)
            if rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1:], w[1:] + w[:1]])
            out.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "1", "\n", "中"]).join(out)))
    long = "".join(rng.choice("abc") for _ in range(3000))
    chain = "kkkkkkkk"  # forms of forms
    rows += [(100 + i, f"{long} {long[:-1]} {long[1:]}x ÀÉÎ Àéîõüý àéîõüý ") for i in range(6)]
    rows += [(200, " ".join([chain] * 700 + [chain[:-1] + "m"] * 125 + [chain[:-2] + "nm"] * 25 + [chain[:-3] + "onm"] * 5))]
    rows += [(300, None), (301, ""), (302, "123 ... !?"), (None, " ".join(base)), (None, " ".join(base)), (303, rows[0][1]), (303, rows[0][1])]
    return rows


def test_spelling_against_plain(spark, spelled, monkeypatch):
    docs = docs_of(spark, [(i, t, "en", "s", 1) for i, t in spelled]).repartition(4)
    want = plain_variants(spelled)
    kind = ("word", "form", "root", "n", "n_near", "form_n")
    got = sorted(tuple(r[c] for c in kind) for r in spelling.variants(docs).collect())
    assert got == want and sum(r[1] is not None for r in want) > 20
    assert any(r[2] != r[1] for r in want if r[1]) and any(len(r[0]) > 2000 and r[4] for r in want)
    # the same result with tiles of a few words and partial counts that leave early
    for name, value in (("TILE", 3), ("TILE_LETTERS", 4000), ("HELD", 10)):
        monkeypatch.setattr(spelling, name, value)
    assert sorted(tuple(r[c] for c in kind) for r in spelling.variants(docs, groups=3).collect()) == want
    assert spelling.variants(docs.limit(0)).count() == 0


def test_spelling_parts():
    words = ["abcdef", "abcdex", "abcde", "xabcdef", "abcdfe", "aéîõüý", "aéîõüÿ", "zzzzzz"]
    x = spelling.Letters(pa.array(words))
    i, j = map(np.array, zip(*[(a, b) for a in range(len(words)) for b in range(len(words)) if len(words[b]) - len(words[a]) in (0, 1)]))
    ok = spelling.one_edit(x, i, x, j)
    found = {(words[a], words[b]) for a, b in zip(i[ok], j[ok])}
    assert found == {("abcdef", "abcdex"), ("abcdex", "abcdef"), ("abcde", "abcdef"), ("abcde", "abcdex"), ("abcde", "abcdfe"), ("abcdef", "xabcdef"), ("aéîõüý", "aéîõüÿ"), ("aéîõüÿ", "aéîõüý")}
    data, starts, ends, _ = spelling.runs(pa.array(["Ab×c", None, "÷", "日本é"]))
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["ab×c", "÷", "é"]
    seeds = np.array([zlib.crc32(b"12:"), zlib.crc32(b":"), zlib.crc32(b"7:")], np.uint32)
    assert spelling._crc(seeds, data, starts, ends).tolist() == [zlib.crc32(p + w.encode()) for p, w in zip((b"12:", b":", b"7:"), ("ab×c", "÷", "é"))]


def plain_score(text, model):
    """Mean of the words' logits, word by word."""
    buckets, total = len(model.logits), 0.0
    words = re.findall("[^\x20\x09-\x0d]+", text or "")

    def row(values):
        return int(embedding_quality.mix(np.array([values], np.uint64))[0] % np.uint64(buckets))
    for i, w in enumerate(words):
        one = embedding_quality._texts(pa.array([w]))
        total += model.logits[int(one.hashes()[0] % np.uint64(buckets))]
        raw = b"<" + w.encode() + b">"
        for g in embedding_quality.GRAMS:
            for a in range(len(raw) - g + 1):
                h = g
                for b in raw[a:a + g]:
                    h = (h * 0x100000001B3 + b) % 2**64
                total += model.logits[row(h)]
        total += sum(model.logits[row(k)] for k in embedding_quality.BACK if i >= k and words[i - k] == w)
    return 1 / (1 + np.exp(-(total / max(len(words), 1) + model.bias)))


def test_embedding_scores_against_plain(spark):
    rng = np.random.default_rng(1)
    model = embedding_quality.Model(rng.normal(size=4096), 0.25)
    texts = [None, "", " \n\t", "one", "One one ONE", "a a a a b a", "été 日本語 🙂 ***", "x" * 3000, "b " * 2000, "the word and the word"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(4, texts[4], "en", "s", 1), (None, "no id", "en", "s", 1)]
    got = embedding_quality.score(docs_of(spark, rows).repartition(2), model).collect()
    assert len(got) == len(rows)
    want = {i: plain_score(t, model) for i, t, *_ in rows}
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == int(r.score >= embedding_quality.LIMIT)


def test_embedding_learns_held_out(spark):
    rng = random.Random(2)
    syllables = ["th", "er", "on", "an", "in", "st", "ré"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        w, bad = [word() for _ in range(rng.randint(5, 80))], i % 4 == 0
        if bad:
            kind = i // 4 % 3
            w = [x + rng.choice(["***", "$$$", "&&&"]) for x in w] if kind == 0 else [x.upper() + "!!" for x in w] if kind == 1 else [x for x in w for _ in range(6)]
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 0 if bad else 1, "clash"))
    labels += [(3, 1, "again"), (None, 1, "x"), (9_999, 0, "x"), (5, None, "x")]
    docs, known = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, text string")
    learn = embedding_quality.learning_rows(docs, known)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in learn.select("doc_id").collect())
    model = embedding_quality.fit(learn)
    truth = {i: 0 if i % 4 == 0 else 1 for i in range(600)}
    held = [r for r in embedding_quality.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    again = embedding_quality.fit(learn.repartition(3))
    assert np.allclose(again.logits, model.logits)  # whatever the partitions
    assert embedding_quality.fit(learn.where("label = 1")) is None and embedding_quality.fit(learn.limit(0)) is None
    assert {(r.score, r.predicted) for r in embedding_quality.score(docs, None).collect()} == {(0.0, 0)}


def test_embedding_words_are_features():
    """The mean's shares: a word's own row, its n-grams, and the relation to words before it."""
    w = embedding_quality._texts(pa.array(["ab ab cd", None]))
    place, number = w.distinct()
    assert len(place) == 2 and number[0] == number[1] != number[2] and SPACED[w.data[w.starts]].all()
    who, rows = embedding_quality.word_features(w, place, 1 << 16)
    assert Counter(who.tolist()) == {0: 1 + 2 + 1, 1: 1 + 2 + 1}  # <ab>: itself, two of three bytes, one of four
    again, back = w.repeats(number)
    assert again.tolist() == [1] and back.tolist() == [1]
