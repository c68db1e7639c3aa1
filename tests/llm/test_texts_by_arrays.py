"""Language identification, importance resampling and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketpulse.llm import importance, language, periodic_runs, queries
from tests.llm.test_operators import SCHEMA, make_rows

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rnd = random.Random(9)
    more = [(500 + i, t, "en", "a", 0, 7, "x", 1, 2, "no") for i, t in enumerate([
        "a b a b a b a b a b a b", "x " * 40, "AbÄbK 12-ab\x00ab ÀB ab", "q" * 300 + " " + "q" * 300, " a　b", "a\x1cb a\x1cb " * 9,
        " ".join(rnd.choice("ab") for _ in range(400)), "one two three " * 7 + "one two four " * 6, "12 34 -- !!"])]
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(make_rows() + more, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# --- importance resampling -----------------------------------------------------

def features(text, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute_resample(rows, target, buckets):
    of = [features(r["text"], buckets) for r in rows]
    s, t = Counter(b for _, f in of for b in f), Counter(b for x in target for b in features(x, buckets)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in range(buckets)]
    out = []
    for r, (words, f) in zip(rows, of):
        key = "" if r["doc_id"] is None else r["doc_id"]
        h = int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((r["doc_id"], words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[4], o[0] is not None, o[0] or 0, o[1], o[2], o[3]))
    ranks = dict()
    for i, o in enumerate(able[: 5 * len(able) // 100]):
        ranks.setdefault(o, []).append(i + 1)
    return Counter((*o, ranks[o].pop(0) if ranks.get(o) else None) for o in out)


def test_resample(spark, docs, rows, empty):
    texts = ["the words of a target", None, "", rows[20]["text"]]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    for buckets in (10000, 100003):
        got = Counter(tuple(r) for r in importance.resample(docs, target, buckets).collect())
        assert got == brute_resample(rows, texts, buckets)
    assert importance.resample(empty, target).collect() == []
    none = importance.resample(docs, target.where("false")).collect()
    assert len(none) == len(rows) and sum(r["rank"] is not None for r in none) == 5 * sum(r["n_words"] >= 20 for r in none) // 100


def test_checksums_of_joined_words():
    rnd = random.Random(3)
    sums = importance.Checksums()
    words = [bytes(rnd.randrange(256) for _ in range(n)) for n in [0, 1, 2, 3, 63, 64, 65, 127, 128, 200, 5000, 70000] * 3]
    rnd.shuffle(words)
    head = np.array([zlib.crc32(w) for w in words], np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    joined = sums.zeros(sizes[1:], head[:-1]) ^ head[1:]
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


def test_texts_in_parts(monkeypatch):
    text = "Some words, 1 and 2;\nother\tWORDS again and again " * 30
    whole = importance.Features(1000).of([text.encode(), b"", text.encode()])
    monkeypatch.setattr(importance, "STEP", 64)
    parted = importance.Features(1000).of([text.encode(), b"", text.encode()])
    assert whole[0] == parted[0] and whole[1].tolist() == parted[1].tolist()
    n, want = features(text, 1000)
    assert np.frombuffer(whole[0][2], "<u2").tolist() == want and whole[1][2] == n


# --- periodic runs ---------------------------------------------------------------

def brute_runs(words, least=6, times=4):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                found.setdefault((start, i - start + q), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_periodic_runs(docs, rows, empty):
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect())
    want = []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        runs = brute_runs(words)
        want.append((r["doc_id"], len(words), tuple(runs), collapsed(words, runs)))
    assert got == Counter(want) and sum(len(w[2]) for w in want) > 8
    assert periodic_runs.periodic_runs(empty).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=6), st.integers(2, 3))
def test_runs_of_few_letters(texts, times):
    sizes, runs, counts, out = periodic_runs.runs_of([" ".join(t).encode() for t in texts], 3, times)
    want = [brute_runs(t, 3, times) for t in texts]
    assert sizes == [len(t) for t in texts] and counts.tolist() == [len(w) for w in want]
    assert [tuple(r) for r in runs.tolist()] == [r for w in want for r in w]
    assert [o.decode() for o in out] == [collapsed(t, w) for t, w in zip(texts, want)]


def test_many_tests_in_parts(monkeypatch):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("ab") for _ in range(200)).encode() for _ in range(5)]
    whole = periodic_runs.runs_of(texts, 4, 2)
    monkeypatch.setattr(periodic_runs, "TESTS", 7)
    assert periodic_runs.runs_of(texts, 4, 2)[1].tolist() == whole[1].tolist()


def test_planted_periods(spark, tmp_path, docs):
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    got = {}
    for r in queries.op13_periodic_runs(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for r in docs.collect():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""), zlib.crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        milli = None if not runs else 1000 * best[1] // best[2]
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want = (len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
        assert want in got[r["doc_id"]]


# --- language ----------------------------------------------------------------------

def make_language(rnd, letters):
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    return lambda n: " ".join(rnd.choice(words) for _ in range(n))


def test_language(spark, tmp_path):
    rnd = random.Random(4)
    makers = {"aa": make_language(rnd, "abcdeio"), "bb": make_language(rnd, "deiklm"), "cc": make_language(rnd, "абвгдеи")}
    data = []
    for i in range(600):
        lang = rnd.choice(list(makers))
        text = makers[lang](rnd.randint(3, 80))
        data.append((i, rnd.choice([str.upper, str.lower, str.title])(text), lang if i % 11 else None))
    data += [(None, "ab cd", "aa"), (900, None, "aa"), (901, "", "bb"), (902, "123 -- \U0001f642", "cc"), (903, "漢字", None)]
    path = str(tmp_path / "d")
    spark.createDataFrame(data + data[:3], "doc_id long, text string, lang string").write.parquet(path)
    got = language.predict(spark.read.parquet(path)).collect()
    assert len(got) == len(data) + 3 and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (900, 901, 902))
    assert by_id[903]["lang_pred"] in makers and by_id[None]["held_out"] is False
    held = [(by_id[i]["lang_pred"], lang) for i, _, lang in data[:600] if lang and by_id[i]["held_out"]]
    assert all(by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in data if i is not None)
    assert sum(a == b for a, b in held) / len(held) > 0.97
    # Labels of held-out documents change nothing.
    other = [(i, t, "zz" if i is not None and by_id[i]["held_out"] else lang) for i, t, lang in data]
    spark.createDataFrame(other, "doc_id long, text string, lang string").write.parquet(path + "2")
    again = {r["doc_id"]: r["lang_pred"] for r in language.predict(spark.read.parquet(path + "2")).collect()}
    assert again == {i: r["lang_pred"] for i, r in by_id.items()}


def test_language_without_labels(docs, empty):
    assert language.predict(empty).collect() == []
    got = language.predict(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def grams(text):
    words = " " + re.sub(r"[\W\d_]+", " ", text.lower()) + " "
    found = {words[i : i + n] for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return {g for g in found if g.strip() and " " not in g[1:-1]}


def test_kernel_by_brute_force(monkeypatch):
    texts = ["Ab ba, abc", "b", "", "cab 12 bac\nab", "xyz"]
    letters = sorted(map(ord, "abc"))
    everything = language.Spectrum(letters)
    met = np.unique(np.concatenate([g for _, g in everything.places(texts)]))
    spectrum = language.Spectrum(letters, met)
    for step in (1 << 20, 3):
        monkeypatch.setattr(language, "STEP", step)
        x = spectrum.presence(texts)
        own = [grams(re.sub("[xyz]", "o", t)) for t in texts]
        assert (x @ x.T).tolist() == [[len(a & b) for b in own] for a in own]
