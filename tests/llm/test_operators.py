"""The operators against brute force on a small table with NULLs, empty, long and repeated texts, ties and clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketpulse.llm import (
    common, exact_dedup, mixing, ngram_join, packing, passages, quality, sharding, token_files, tokens, toxicity, url_rules,
)
from marketpulse.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, size string, score int, block int, kept string"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def make_rows():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeinorst") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base, passage = text(300), text(70)
    near = base.split(" ")
    near[150] = "altered"
    far = base.split(" ")
    far[::9] = ["other"] * len(far[::9])
    copied = text(200)
    texts = [None, "", "   \n\t ", "one", "two words", base, base, " ".join(near), " ".join(far), base.replace(" ", "\n", 3) + "  ",
             text(60) + " " + passage + " " + text(80), text(30) + " " + passage + " " + text(20), passage, text(45),
             "same line here\n" * 40, "a\u00a0b  c\t\u2028d \U0001f642 \x1c e <|endoftext|> f", text(9000), "\U0001f642" * 700, copied]
    texts += [copied] * 30 + [text(rnd.randint(1, 200)) for _ in range(60)]
    rows = [(i, t, "en", rnd.choice(["b", "a", "Z", None, "é"]), 0, 7, "x", 1, 2, "no") for i, t in enumerate(texts)]
    rows += [(None, text(20), None, "a", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return rows + [rows[6], rows[6], rows[13]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(make_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(0, 80, 2)] + [(None, 1, 1), (5, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")


def test_shards(docs, rows, empty):
    got = sharding.assign_shards(docs, 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    for some in shards.values():
        assert sorted(r["slot"] for r in some) == list(range(len(some)))
        assert abs(sum(r["size"] for r in some) - total / 8) <= most
    ends = [(min(r["start_byte"] for r in s), max(r["start_byte"] for r in s)) for _, s in sorted(shards.items())]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert sharding.assign_shards(empty, 8).collect() == []


def test_written_shards(spark, docs, rows, tmp_path):
    sharding.write_shards(docs.where("doc_id IS NOT NULL"), str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == sum(r["doc_id"] is not None for r in rows)
    spans = back.groupBy("shard").agg(F.min("doc_id"), F.max("doc_id")).orderBy("shard").collect()
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_shards_with_equal_texts_together(docs, rows, empty):
    got = sharding.assign_shards(docs, 8, together=True).collect()
    size = {r["doc_id"]: len((r["text"] or "").encode()) + 1 for r in rows}
    assert Counter((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == Counter(
        (r["doc_id"], size[r["doc_id"]]) for r in rows if r["doc_id"] is not None)
    assert len(got) == len(rows)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    shards, groups = defaultdict(list), defaultdict(set)
    for r in got:
        shards[r["shard"]].append(r)
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(r["slot"] for r in some) == list(range(len(some))) for some in shards.values())
    assert all(abs(sum(r["size"] for r in some) - total / 8) <= most for some in shards.values())
    # Seven cuts fall into seven groups at most, and each group is contiguous.
    assert sum(len(s) > 1 for s in groups.values()) <= 7 and all(max(s) - min(s) == len(s) - 1 for s in groups.values())
    assert sharding.assign_shards(empty, 8, together=True).collect() == []


def test_written_shards_keep_all_columns_and_rows(spark, docs, rows, empty, tmp_path):
    marked = docs.withColumn("shard", F.lit("mine"))
    column = sharding.write_shards(marked, str(tmp_path / "s"), 4, together=True)
    assert column == "_shard"
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == {*marked.columns, "_shard"}
    assert Counter(tuple(r) for r in back.select(*marked.columns).collect()) == Counter(tuple(r) for r in marked.collect())
    placed = defaultdict(set)
    for r in back.collect():
        placed[r["text"]].add(r["_shard"])
    assert sum(len(s) > 1 for s in placed.values()) <= 3 + 1  # three cuts; NULL and empty texts count as equal
    sizes = [r[1] for r in back.groupBy("_shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1)).collect()]
    most = max(len((r["text"] or "").encode()) + 1 for r in rows)
    assert len(sizes) == 4 and all(abs(s - sum(sizes) / 4) <= 2 * most for s in sizes)
    few = docs.where("doc_id IN (3, 4)")
    sharding.write_shards(few, str(tmp_path / "few"), 8)
    assert spark.read.parquet(str(tmp_path / "few")).count() == 2
    assert sharding.write_shards(empty, str(tmp_path / "none"), 4) == "shard"


def test_toxicity(spark, docs, empty, labels):
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert toxicity.score_documents(empty, labels).collect() == []
    assert len({r["score"] for r in toxicity.score_documents(docs, labels.where("false")).collect()}) == 1


def test_toxicity_learns(spark, tmp_path):
    rnd = random.Random(1)
    plain = ["".join(rnd.choice("aeiourstnl") for _ in range(5)) for _ in range(400)]
    bad = ["grumblefish", "stinkwort", "blockhead"]
    data = []
    for i in range(900):
        w = [rnd.choice(plain) for _ in range(rnd.randint(40, 150))]
        if i % 6 == 0:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(bad)
        data.append((i, " ".join(w), int(i % 6 == 0)))
    path = str(tmp_path / "d")
    spark.createDataFrame(data, "doc_id long, text string, toxic int").write.parquet(path)
    d = spark.read.parquet(path)
    got = {r["doc_id"]: r for r in toxicity.score_documents(d.drop("toxic"), d.select("doc_id", "toxic")).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in data if got[i]["held_out"]]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_toxic_words_despite_wrong_labels():
    rnd = random.Random(2)
    plain = ["".join(rnd.choice("aeiourstnl") for _ in range(5)) for _ in range(400)]
    bad = ["grumblefish", "stinkwort", "blockhead"]
    rows = []
    for i in range(1200):
        w = [rnd.choice(plain) for _ in range(60)] + (rnd.sample(bad, 2) if i % 6 == 0 else [])
        rnd.shuffle(w)
        rows.append((" ".join(w).encode(), (i % 6 == 0) != (rnd.random() < 0.03)))
    toxic, ordinary = ([t for t, y in rows if y == k] for k in (True, False))
    assert all(any(b.encode() in t for t in ordinary) for b in bad)
    words = {w.decode() for w in toxicity.toxic_words(toxic, ordinary)}
    assert set(bad) <= words and len(words - set(bad)) <= 3


def brute_similar(rows):
    def sets(t):
        w = (t or "").encode().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    s = [sets(r["text"]) for r in rows]
    reps = list(dict.fromkeys(s))
    links = defaultdict(set)
    for i, a in enumerate(reps):
        for b in reps[:i]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[a].add(b)
                links[b].add(a)
    group = {}
    for a in reps:
        if a not in group:
            todo, seen = [a], {a}
            while todo:
                for b in links[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            for b in seen:
                group[b] = frozenset(seen)
    ids = lambda some: min((r["doc_id"] for r, x in zip(rows, s) if x in some and r["doc_id"] is not None), default=None)
    copies = Counter(s)
    return Counter((r["doc_id"], ids(group[x]), ids({x}), copies[x], len(links[x])) for r, x in zip(rows, s))


def test_ngram_join(docs, rows, empty):
    got = ngram_join.similar_groups(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["text_id"], r["n_copies"], r["n_links"]) for r in got) == brute_similar(rows)
    kept = ngram_join.without_similar(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got) == len({r["class_id"] for r in got})
    assert ngram_join.similar_groups(empty).collect() == []


def test_ngram_join_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    got = ngram_join.similar_groups(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["text_id"], r["n_copies"], r["n_links"]) for r in got) == brute_similar(rows)


def test_pruning_bound():
    assert ngram_join.least_matches(96, 0.8, 1e-4) < 70 < 96 * 0.8
    sets = [np.unique(np.random.default_rng(i).integers(0, 60, 50).astype(np.uint64)) for i in range(12)]
    a, b = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.4 for i, j in zip(a, b)]
    assert ngram_join.similar(sets, a, b, 0.4).tolist() == want
    assert ngram_join.similar(sets, a[:4], b[:4], 0.4).tolist() == want[:4]


def fill(sizes, weights, share, most):
    total, caps = share * sum(sizes), [most * s for s in sizes]
    free = set(range(len(sizes)))
    while True:
        rest, w = total - sum(c for i, c in enumerate(caps) if i not in free), sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / w > caps[i]]
        if not over:
            return [rest * weights[i] / w if i in free else caps[i] for i in range(len(sizes))]
        free -= set(over)


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(words_of(r["text"]))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)))
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and 0 <= r["words"] <= r["size"]
        assert (r["position"] is None) == (r["words"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
        taken[r["source"]] += r["words"]
    assert all(abs(taken[s] - want[s]) < 1 for s in order)
    assert Counter((r["doc_id"], r["size"]) for r in got if r["pass"] == 0) == Counter((r["doc_id"], len(words_of(r["text"]))) for r in rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix(empty).collect() == []


def test_curriculum_inverts_its_integral(spark):
    knots = [1.5, 1.0, 0.2, 0.0, 2.0]
    shares = [0.0, 0.1, 0.33, 0.5, 0.8, 1.0]
    d = spark.createDataFrame([(x,) for x in shares], "x double")
    got = [r[0] for r in d.select(mixing.curriculum_position(F.col("x"), F.array(*[F.lit(k) for k in knots]))).collect()]
    t = np.linspace(0, 1, 400_001)
    demand = np.cumsum(np.interp(t, np.linspace(0, 1, 5), knots))
    for x, y in zip(shares[1:-1], got[1:-1]):
        assert abs(np.interp(y, t, demand / demand[-1]) - x) < 1e-4
    assert got[0] == 0 and abs(got[-1] - 1) < 1e-9


@pytest.fixture(scope="module")
def ids():
    tool = Tokenizer.from_file(TOKENIZER)
    return lambda text: tool.encode(text or "", add_special_tokens=False).ids


def test_encoder_is_exact(ids):
    rnd = random.Random(3)
    texts = ["", " ", "\n", " a", "a ", "a  b", "it's  don't 's <|endoftext|> x<|endoftext|>y <| z", "\x1c a b", "日本 語\u3000テ", "x\r\ny z", "a\x85b c", "a, b. a,. ,"]
    texts += ["".join(rnd.choice(" \n\tab.,'1é<|") for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    own = tokens.Encoder(TOKENIZER)
    for _ in range(2):
        for t, found in zip(texts, own.encode(texts)):
            assert np.frombuffer(found, "<u4").tolist() == ids(t), t


@pytest.mark.parametrize("known", [0, 5, 60])
def test_encoder_that_forgets_is_exact(ids, monkeypatch, known):
    monkeypatch.setattr(tokens, "KNOWN", known)
    rnd = random.Random(4)
    own = tokens.Encoder(TOKENIZER)
    for _ in range(60):
        texts = [" ".join(rnd.choice(["a", "b,", "cd.", "é", "x1", str(rnd.randint(0, 99))]) for _ in range(rnd.randint(0, 9)))
                 + rnd.choice(["", "\nend", "  end"]) for _ in range(5)]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [ids(t) for t in texts]
        assert own.encode([]) == []
        assert len(own.known) == len(own.starts) == len(own.sizes) == len(own.met) and sum(own.sizes) == len(own.ids)


def test_token_files(spark, docs, rows, empty, ids, tmp_path):
    path = "file://" + str(tmp_path / "t")
    token_files.write_tokens(docs, path, TOKENIZER, 2)
    got = sorted(token_files.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in sorted(rows, key=key)]
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((r["doc_id"], tuple(ids(r["text"]) + [2])) for r in rows)
    token_files.write_tokens(empty, path + "e", TOKENIZER, 2)
    assert token_files.read_tokens(spark, path + "e").collect() == []


@pytest.mark.parametrize("width,bits", [(16384, 64), (7, 64), (50, 3)])
def test_exact_groups(docs, rows, empty, width, bits):
    got = exact_dedup.exact_groups(docs, width, bits).collect()
    plain = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r)].append(r)
    first = {k: min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"] for k, g in groups.items()}
    want = Counter((r["doc_id"], first[plain(r)], len(groups[plain(r)]), hashlib.sha256(plain(r).encode()).hexdigest()) for r in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    if bits == 64:
        kept = exact_dedup.without_copies(docs, width=width)
        assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty, width, bits).collect() == []


def test_quality(docs, rows, empty, labels):
    got = quality.judge(docs, labels.where("quality = 1").select("doc_id")).drop("_row").collect()

    def counts(t):
        w = words_of(t)
        seen, covered = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set()
        for i in range(len(w) - 2):
            if seen[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in (t or "").split("\n") if words_of(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r["doc_id"], *counts(r["text"])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= r["threshold"])
    good = quality.good_documents(docs, labels.where("quality = 1"))
    assert good.columns == docs.columns and good.count() == sum(r["kept"] for r in got) > 0
    assert quality.judge(empty, labels).collect() == []
    assert all(r["kept"] == (not r["base_failed"]) for r in quality.judge(docs, labels.where("false")).collect())


def test_likelihood_ratio(spark, tmp_path):
    path = str(tmp_path / "d")
    data = [(i, " ".join(["alpha", "beta", "gamma"][(i + k) % 3] for k in range(60))) for i in range(6)] + [(9, " ".join(f"odd{k}" for k in range(60)))]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(path)
    d = spark.read.parquet(path)
    got = {r["doc_id"]: r for r in quality.judge(d, spark.createDataFrame([(i,) for i in range(6)], "doc_id long")).collect()}
    m = quality.BUCKETS
    ratios = spark.read.parquet(path).select("doc_id").join(quality.ratio_table(d, d.where("doc_id < 6").select("doc_id"))).first()["ratios"]
    raw, target = 6 * 119 + 119 + m, 6 * 119 + m
    assert abs(max(ratios) - np.log((1 + max_count(data)) / target * raw / (1 + max_count(data)))) < 1e-9
    assert got[9]["score"] < got[0]["score"]


def test_all_trusted_documents_count(spark, tmp_path):
    """More trusted documents than any sample of ids: all are counted, and all set the threshold."""
    path = str(tmp_path / "d")
    n = 20500
    words = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: F.concat(F.lit("w"), ((F.col("id") * 31 + k * (F.col("id") % 7 + 1)) % 400).cast("string")))
    spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text")).write.parquet(path)
    docs = spark.read.parquet(path)
    ratios = quality.ratio_table(docs, docs.select("doc_id")).first()["ratios"]
    assert max(map(abs, ratios)) < 1e-12  # the target is the corpus
    half = docs.where("doc_id % 41 <> 0").select("doc_id")
    got = quality.judge(docs, half).drop("_row").collect()
    scores = np.array([r["score"] for r in got if r["doc_id"] % 41 and not r["base_failed"]])
    assert len(scores) > 10000 and len({r["threshold"] for r in got}) == 1
    assert abs(got[0]["threshold"] - (scores.mean() - quality.DEVIATIONS * scores.std())) < 1e-9


def max_count(data):
    grams = Counter()
    for i, t in data[:6]:
        w = t.split()
        grams.update(w)
        grams.update(zip(w, w[1:]))
    return max(grams.values())


def test_packing(docs, rows, empty, ids):
    got = packing.pack_documents(docs, TOKENIZER, 0, 64).collect()
    want = Counter()
    for r in rows:
        x = ids(r["text"]) + [0]
        head = len(x) % 64 or 64
        for k, (a, b) in enumerate([(0, head), *((a, a + 64) for a in range(head, len(x), 64))]):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for some in bins.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.02 * sum(r["length"] for r in got) / 64 + 1
    assert packing.pack_documents(empty, TOKENIZER).collect() == []


def test_dominance_never_costs_a_sequence():
    def best(items, capacity):
        low = [len(items)]

        def place(i, bins):
            if len(bins) >= low[0]:
                return
            if i == len(items):
                low[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity:
                    place(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1:])
            place(i + 1, [*bins, items[i]])
        place(0, [])
        return low[0]

    rnd = random.Random(2)
    for _ in range(150):
        items = sorted((rnd.randint(1, 20) for _ in range(8)), reverse=True)
        left = packing._Lengths(Counter(items))
        fixed = 0
        for item in sorted(set(items), reverse=True):
            while left.counts.get(item):
                pattern = packing.dominating_set(left, item, 20)
                if pattern is None:
                    break
                n = left.times(pattern)
                left.take(pattern, n)
                fixed += n
        rest = [k for k, n in left.counts.items() for _ in range(n)]
        assert fixed + best(sorted(rest, reverse=True), 20) == best(items, 20)


def test_urls(spark, tmp_path):
    urls = [None, "", "nothing", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/", "http://badexample.com/en/x", "https://a.b.example.com/en/q#f",
            "http://x.net/es/1", "http://x.net/fr", "http://net/fr/", "http://x.org/en/", "http://com", "http://com/", "x://y://z.com/a", "http://ÄB.net/es/", "http://a.com\n/x"]
    path = str(tmp_path / "p")
    spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(None, urls[3], None, None), (3, urls[3], "h", "v")], "page_id long, url string, host string, verdict string").write.parquet(path)
    pages = spark.read.parquet(path)

    def judge(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group(0)
            path = re.match(r"[^?#]*", rest[len(host):]).group(0)
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit)[1:] if fit else (None, "allow")
        return host, path, rule, verdict

    got = url_rules.judge_urls(pages, url_rules.rule_table(spark)).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == Counter((r["page_id"], *judge(r["url"])) for r in pages.collect())
    colliding = url_rules.judge_urls(pages, url_rules.rule_table(spark), prefix_hex=1).collect()
    assert sorted(map(str, colliding)) == sorted(map(str, got))
    assert {r["verdict"] for r in url_rules.judge_urls(pages, url_rules.rule_table(spark).where("false"), "block").collect()} == {"block"}
    assert url_rules.judge_urls(pages.where("false"), url_rules.rule_table(spark)).collect() == []


def test_compact_windows():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        n, least = int(rnd.integers(1, 60)), int(rnd.integers(1, 8))
        v = rnd.integers(0, 12, n).astype(np.uint64)
        want = set()
        for c in np.flatnonzero(v).tolist():
            lo = hi = c
            while lo and v[lo - 1] > v[c]:
                lo -= 1
            while hi < n - 1 and v[hi + 1] >= v[c]:
                hi += 1
            if hi - lo + 1 >= least:
                want.add((lo, c, hi))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, least)))) == want


def test_run_digests():
    rnd = np.random.default_rng(2)
    values = rnd.integers(1, 3, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for length in (1, 5, 24):
        starts = np.arange(len(values) - length + 1)
        digests = passages.run_digests(values, starts, length).tolist()
        runs = [tuple(values[i : i + length].tolist()) for i in starts]
        assert len(set(digests)) == len(set(runs)) == len(set(zip(digests, runs)))


def test_passages(docs, rows, empty):
    got = passages.near_passages(docs).collect()
    seen = defaultdict(set)
    for k, r in enumerate(rows):
        w = (r["text"] or "").encode().split()
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(k)
    repeated = {rows[k]["doc_id"] for some in seen.values() if len(some) > 1 for k in some}
    assert repeated <= {r["doc_id"] for r in got}
    texts = {r["doc_id"]: (r["text"] or "").encode().split() for r in rows if r["doc_id"] is not None}
    for r in got:
        a = texts[r["doc_id"]][r["start_word"]:][: r["n_words"]]
        b = texts[r["head_id"]][r["head_start"]:][: r["head_words"]]
        x, y = ({tuple(z[i : i + 5]) for i in range(len(z) - 4)} for z in (a, b))
        assert len(a) >= 50 and abs(len(x & y) / len(x | y) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.8
    clean = {r["doc_id"] for r in rows if r["doc_id"] is not None and len(words_of(r["text"])) < 50}
    assert not clean & {r["doc_id"] for r in got}
    assert passages.near_passages(empty).collect() == []


def test_passages_of_hot_min_hashes(spark, tmp_path, monkeypatch):
    # One variant of a passage is so frequent that it heads the min-hashes of the others, which lie in many blocks.
    monkeypatch.setattr(passages, "BLOCK", 2)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    frame = [word() for _ in range(60)]
    texts = [" ".join(frame)] * 12
    for _ in range(60):
        variant = list(frame)
        for at in range(rnd.randrange(6, 12), 60, rnd.randrange(10, 16)):
            variant[at] = word()
        texts += [" ".join([word() for _ in range(rnd.randrange(30))] + variant + [word() for _ in range(rnd.randrange(30))]) for _ in range(2)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    got = defaultdict(list)
    for r in passages.near_passages(spark.read.parquet(path)).collect():
        got[r["doc_id"]].append((r["start_word"], r["start_word"] + r["n_words"]))
    seen = defaultdict(list)
    for k, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].append((k, i))
    for places in seen.values():
        if len({k for k, _ in places}) > 1:
            assert all(any(a < i + 50 and i < b for a, b in got[k]) for k, i in places)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rnd.randint(200, 300), rnd.randint(200, 300)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    assert got == {x: find(x) for x in parent}


def test_windows_that_miss_the_head_meet_each_other(spark):
    """Every two windows of one key with a run of ``least`` in common are joined to one document."""
    rnd, least = random.Random(3), 10
    windows = []
    for key in range(60):
        for rid in range(rnd.randint(2, 7)):
            for _ in range(rnd.choice([1, 1, 2])):
                before = rnd.randint(0, 12)
                after = rnd.randint(max(0, least - 1 - before), 12)
                windows.append((key, rid, 100 - before, 100, 100 + after, 0))
    # Each key has documents of its own, so that links tell their key.
    windows = [(k, 100 * k + r, a, p, b, 100 * k) for k, r, a, p, b, _ in windows]
    with Scratch(spark) as scratch:
        met = spark.createDataFrame(windows, "key long, rid long, lo int, place int, hi int, hub long")
        found = passages.candidates(met, scratch, least).collect()
    assert all(r["hi"] - r["lo"] == r["hhi"] - r["hlo"] >= least - 1 for r in found)
    links = {(r["rid"], r["hub"]) for r in found}
    for key in range(60):
        mine = [w for w in windows if w[0] == key]
        met_by = lambda rid: {h for r, h in links if r == rid} | {rid}
        for a in mine:
            for b in mine:
                if a[1] < b[1] and min(100 - a[2], 100 - b[2]) + min(a[4], b[4]) - 100 + 1 >= least:
                    assert met_by(a[1]) & met_by(b[1])
