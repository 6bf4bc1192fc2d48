"""Decontamination, prefix trie and source divergence against brute force on small data with hostile cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsgraph.llm import decontamination, divergence, prefix_trie

DATA = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(tuple, df.collect()))


def lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# --- decontamination ---


def contamination_by_hand(docs, items, width=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        words = pattern.findall(lower(text or ""))
        n = min(width, len(words))
        for k in range(len(words) - n + 1) if n else ():
            windows[tuple(words[k : k + n])].add(item)
    out = Counter()
    for doc, text in docs:
        words = pattern.findall(lower(text or ""))
        hit, met = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                found = windows.get(tuple(words[k : k + n]))
                if found is not None:
                    hit.update(range(k, k + n))
                    met |= {str(i) for i in found if i is not None}
        digest = hashlib.sha256(",".join(sorted(met, key=str.encode)).encode()).hexdigest()
        out[(doc, len(words), len(hit), len(met), digest, bool(hit))] += 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_decontamination(spark, seed):
    draw = random.Random(seed)
    few = ["a", "B", "é", "x1", "Ω"]  # few words: every shingle is frequent and most windows nearly match
    items = [(i, " ".join(draw.choices(few, k=draw.choice([1, 2, 4, 5, 9, 10, 11, 30])))) for i in range(1, 40)]
    items += [(40, None), (41, ""), (42, "..."), (2, "unique words of a repeated item id"), (None, "nameless item here")]
    items += [(50, "Shared line of the two"), (51, "shared LINE of, the two!")]
    docs = [(i, " ".join(draw.choices(few, k=draw.choice([0, 1, 5, 30, 400])))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "y" * 5000), (62, "nameless item here"), (None, "x shared line of the two y")]
    docs += [(63, "unique words of a repeated"), (64, items[10][1] + " - " + items[11][1]), (65, items[20][1].upper())]
    docs += [(66, " ".join(draw.choices(few, k=30000)))] + [(67, items[12][1])] * 2
    got = decontamination.audit(
        spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, row int"),
        spark.createDataFrame([(i, t, "z") for i, t in items], "item_id int, text string, window string"),
    )
    assert rows(got) == contamination_by_hand(docs, items)


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id int, text string")
    some = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "one two")], "item_id int, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert rows(decontamination.audit(none, item)) == Counter()
    assert rows(decontamination.audit(some, no_items)) == {(1, 2, 0, 0, empty, False): 1}
    assert rows(decontamination.occurrences(some, item)) == {(1, 0, 2, "one two"): 1}


# --- prefix trie ---


def trie_by_hand(conversations):
    turns = defaultdict(list)
    for conv, turn, role, text in conversations:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    original = {c: [(r.decode(), t.decode()) for _, r, t in sorted(own)] for c, own in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c / 100) * 100
        path = tuple(original.get(base, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(own) - 1) * (len(path[-1][1]) if path else 0)
    out = Counter()
    for path, own in members.items():
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        out[(min(own), len(path), parent, len(own), children[path], leaves[path], saved[path], digest)] += 1
    return out


def conversations(seed):
    draw = random.Random(seed)
    data = []
    for c in [*range(230), -5, -7, 1000, 1001, 1003, 10**12]:
        for turn in range(draw.choice([1, 1, 2, 3, 7])):
            data.append((c, turn, draw.choice(["user", "assistant", None, ""]), draw.choice(["a", "b", "é😀", "", None])))
    data += [(c, t, "user", "same") for c in range(5000, 5100) for t in range(9)]  # copies
    data += [(c, t, "user", "deep" if t < c - 6000 else "end") for c in range(6000, 6010) for t in range(c - 5999)]
    data += [(300, None, "user", "first"), (300, 0, "user", "next"), (300, 0, "user", "next"), (300, 0, "assistant", "z")]
    data += [(None, 0, "user", "nobody"), (400, 0, "user", "x" * 20000)]
    return data


@pytest.mark.parametrize("limit", [1, 3, 1024])
def test_prefix_trie(spark, limit):
    data = conversations(limit)
    df = spark.createDataFrame([(*r, 1) for r in data], "conv_id long, turn int, role string, text string, depth int")
    assert rows(prefix_trie.shared_prefixes(df, limit)) == trie_by_hand(data)
    assert prefix_trie.shared_prefixes(df.where("false"), limit).count() == 0


# --- source divergence ---


def divergence_by_hand(docs, least_docs, top):
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    groups, in_docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in docs:
        words = [lower(w) for w in pattern.findall(text or "")]
        groups[(lang or "", source or "")].update(words)
        in_docs[lang or ""].update(set(words))
    out = Counter()
    for (lang, source), own in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least_docs]
        peers = {s: c for (x, s), c in groups.items() if x == lang}
        total = Counter()
        for c in peers.values():
            total.update(c)

        def shares(counts):
            whole = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // whole for t in kept}

        p, q = shares(own), shares(total)
        pairs = []
        for s, c in peers.items():
            other = shares(c)
            if s != source:
                pairs.append((sum(abs(p[t] - other[t]) for t in kept), s))
        terms = [(p[t] - q[t], t) for t in kept if own[t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            for rank, (value, item) in enumerate(found if part == "pair" else found[:top], 1):
                out[(lang, source, part, item, value, rank)] += 1
    return out


def profile_docs(seed):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i)}" for i in range(26)] + ["Über", "É", "x" * 3000, "漢字"]
    data = []
    for i in range(400):
        source = draw.choice(["s1", "s1", "s1", "s2", "s3", None, "", "é"])
        lang = draw.choice(["en", "de", None, ""])
        cut = draw.randrange(4, 30)
        data.append((lang, source, " ".join(draw.choices(words[:cut], k=draw.choice([0, 1, 20])))))
    data += [("en", "empty", None), ("xx", "only", "rare words here"), ("xx", "other", None), ("yy", "alone", "a")]
    return data


@pytest.mark.parametrize("shard,counters", [(1 << 18, 1 << 21), (7, 8)])
def test_divergence(spark, shard, counters, monkeypatch):
    data = profile_docs(shard)
    df = spark.createDataFrame([(*r, 0) for r in data], "lang string, source string, text string, number int")
    plain = divergence.distances

    monkeypatch.setattr(divergence, "distances", lambda p: plain(p, shard, counters))
    monkeypatch.setattr(divergence, "_HELD", 40)
    assert rows(divergence.audit(df, 5, 3)) == divergence_by_hand(data, 5, 3)
    assert divergence.audit(df.where("false")).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    n, total, kinds = 9_000_000_000_000_000_001, 9_223_372_036_854_775_807, 1_000_003
    df = spark.createDataFrame([(n, total, kinds)], "n long, total long, kinds long")
    assert df.select(divergence.share("n", "total", "kinds")).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * kinds)


CLASHES = ["rate", "_copies", "_copy", "_draw", "_source", "target", "source_size", "_n", "_id", "_sha", "_sha_row", "kept"]
CLASHES += ["keep_id", "group_size", "text_sha256", "component_id", "_dropped", "_c0", "size", "position", "label"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_columns_of_any_name(spark, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(docs.limit(3))  # rows that are repeated whole
    wide = docs
    for i, name in enumerate(CLASHES):
        wide = wide.withColumn(name, F.lit(i))
    plain, found = stage(spark, docs, DATA), stage(spark, wide, DATA)
    if "text" in plain.columns:
        assert found.columns == wide.columns
        assert found.select(CLASHES).distinct().collect() == [tuple(range(len(CLASHES)))]
        assert rows(found.select(docs.columns)) == rows(plain)
    else:
        assert rows(found) == rows(plain)
