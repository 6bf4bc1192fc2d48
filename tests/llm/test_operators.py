"""Each operator against a brute-force version on small data with nulls, empty and long texts, ties and repeats."""

import hashlib
import io
import re
import zipfile
from collections import Counter

import duckdb
import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsgraph.llm import (
    chat_format,
    exact_dedup,
    language_id,
    minhash,
    mixing,
    packing,
    pivot_index,
    substring_dedup,
    suffix_dedup,
    warc_zip,
)
from newsgraph.llm.components import components
from newsgraph.llm.oracle import LLM_ORACLE
from newsgraph.llm.queries import LLM_QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANDOM = np.random.default_rng(5)
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "É", "ß") for b in ("ra", "so", "ti", "ve", "x")]


def prose(n):
    return " ".join(RANDOM.choice(VOCABULARY, n))


def make_fixture():
    base, passage = prose(150), prose(70)
    near = base.replace(" ", "\t", 3).split(" ")
    near[60] = "changed"
    rows = [
        (1, base),
        (2, base.upper().replace("SS", "ß")),
        (3, base),
        (4, " ".join(near)),
        (5, None),
        (6, ""),
        (7, " \t\n"),
        (8, prose(20) + " " + passage + " " + prose(20)),
        (9, prose(5) + " " + passage),
        (10, passage + " " + passage),
        (11, "one two"),
        (12, "one  two"),
        (12, "one  two"),
        (13, "x" * 3000),
        (14, "x" * 1000),
        (15, prose(9000)),
        (None, base),
        (None, None),
    ]
    return [(i, t, "en", f"s{(i or 0) % 4}" if (i or 0) % 5 else None, len(t or "")) for i, t in rows]


FIXTURE = make_fixture()


def fixture():
    return FIXTURE


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("name", list(LLM_ORACLE))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = LLM_QUERIES[name](spark, DATA)
    result = db.execute(LLM_ORACLE[name])
    order = [[d[0] for d in result.description].index(c) for c in df.columns]
    assert rows(df) == Counter(tuple(r[i] for i in order) for r in result.fetchall())


def covered(units, seen, doc, width=50):
    mark = bytearray(len(units))
    for k in range(len(units) - width + 1):
        if seen[tuple(units[k : k + width])] < doc:
            mark[k : k + width] = b"\1" * width
    return mark


def first_documents(texts, width=50):
    seen = {}
    for doc, units in sorted((d, u) for d, u in texts if d is not None):
        for k in range(len(units) - width + 1):
            seen.setdefault(tuple(units[k : k + width]), doc)
    return seen


def data_of(spark):
    real = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    return [(i, t) for i, t, *_ in fixture()] + [(i + 100, t) for i, t in real]


def test_substring_dedup(spark):
    data = data_of(spark)
    texts = [(i, WORD.findall(t or "")) for i, t in data]
    seen, want = first_documents(texts), Counter()
    for doc, words in texts:
        mark = covered(words, seen, doc) if doc is not None else bytearray(len(words))
        kept = " ".join(w for w, m in zip(words, mark) if not m)
        want[(doc, len(words), sum(mark), hashlib.sha256(kept.encode()).hexdigest())] += 1
    df = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id long, text string, tag int")
    assert rows(substring_dedup.dedup_digest(df)) == want
    kept = {r.doc_id: r.kept_text for r in substring_dedup.dedup(df).where("doc_id IN (3, 11)").collect()}
    assert kept == {3: "", 11: "one two"}


def test_suffix_dedup(spark):
    data = data_of(spark)
    texts = [(i, (t or "").encode()) for i, t in data]
    seen, want = first_documents(texts), Counter()
    for doc, text in texts:
        mark = covered(text, seen, doc) if doc is not None else bytearray(len(text))
        kept = bytes(b for b, m in zip(text, mark) if not m)
        spans = len(re.findall(b"\1+", bytes(mark)))
        want[(doc, len(text), sum(mark), spans, hashlib.sha256(kept).hexdigest())] += 1
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, spans string")
    assert rows(suffix_dedup.dedup_digest(df)) == want


def test_maximal_repeats_have_all_occurrences():
    text = [b"0" + b"abcdefgh" * 2 + b"1", b"2" + b"abcdefgh" * 2 + b"3", b"4abcdefgh5"]
    found = {(n, tuple(sorted(zip(p.tolist(), o.tolist())))) for n, p, o in suffix_dedup.maximal_repeats(text, 6)}
    assert (16, ((0, 1), (1, 1))) in found
    assert (8, ((0, 1), (0, 9), (1, 1), (1, 9), (2, 1))) in found
    assert len(found) == 2


def assert_spans_cover(pieces):
    earliest = np.arange(len(pieces))
    got = [bytearray(len(p)) for p in pieces]
    for piece, place, length, document in zip(*suffix_dedup._spans(pieces, earliest), strict=True):
        assert document < piece
        got[piece][place : place + length] = b"\1" * length
    seen = first_documents(list(enumerate(pieces)))
    assert got == [covered(p, seen, i) for i, p in enumerate(pieces)]


def test_suffix_order_with_runs_of_nul():
    draw = np.random.default_rng(9)
    for _ in range(200):
        passage = bytes(draw.integers(97, 123, 60).astype(np.uint8))
        ends = [bytes(draw.integers(97, 123, 20).astype(np.uint8)) for _ in range(6)]
        run = int(draw.integers(10, 71))
        pieces = [passage + bytes(run) + end for end in ends[:2]]
        pieces += [passage + bytes(int(draw.integers(0, run))) for _ in range(2)]  # end inside the run
        pieces += [end + passage + bytes(run) for end in ends[2:]]
        assert_spans_cover([pieces[i] for i in draw.permutation(len(pieces))])


def test_repeats_beyond_the_depth_are_covered():
    draw = np.random.default_rng(10)
    passage = bytes(draw.integers(97, 123, 400).astype(np.uint8))
    cuts = [(0, 400), (0, 71), (0, 72), (0, 73), (30, 180), (100, 390), (200, 400), (0, 400)]
    assert_spans_cover([bytes(draw.integers(97, 123, 9).astype(np.uint8)) + passage[a:b] for a, b in cuts])


def test_substring_operators_without_rows(none):
    assert substring_dedup.dedup_digest(none).count() == 0
    assert suffix_dedup.dedup_digest(none).count() == 0


def test_exact_dedup(docs, none):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t, *_ in fixture():
        groups.setdefault((t or "").translate(low), []).append(i)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(fixture())
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in got if r.text_sha256 == sha]
        assert sorted(str(r.doc_id) for r in own) == sorted(map(str, ids))
        assert all(r.keep_id == keep and r.group_size == len(ids) and r.kept == (r.doc_id == keep) for r in own)
    clash = docs.withColumnRenamed("source", "_id").withColumnRenamed("n_chars", "keep_id")
    left = exact_dedup.drop_copies(clash)
    assert left.columns == clash.columns
    assert left.count() == len(groups)
    assert exact_dedup.drop_copies(none).count() == 0


def brute_links(texts, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        words = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_min_max_hashing(spark, none):
    data = [(i, t) for i, t in data_of(spark) if i is not None]
    want = brute_links(data)
    df = spark.createDataFrame([(i, t, 1) for i, t in [*data, (None, "a b")]], "doc_id long, text string, node int")
    got = minhash.near_groups(df).collect()
    assert len(got) == len(data) + 1
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    left = minhash.drop_near_copies(df)
    assert left.columns == df.columns
    assert {r.doc_id for r in left.collect()} == {None, *(i for i, (_, c) in want.items() if i == c)}
    assert minhash.near_groups(none).count() == 0


def test_links_at_the_similarity_of_the_pipeline(spark):
    data = []
    for k in range(60):  # one changed word in texts of different length: similarities from 0.72 to 0.89
        words = prose(35 + k).split()
        data += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:15], "changed", *words[16:]]))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for percent in (80, 85):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_groups(df, percent=percent).collect()}
        assert got == brute_links(data, percent)


def test_bands_fit_the_similarity():
    assert minhash.banding(85) == (6, 28) and minhash.banding(80) == (5, 34)
    for percent in (1, 10, 50, 70, 80, 85, 90, 95, 99, 100):
        length, bands = minhash.banding(percent)
        assert (1 - (percent / 100) ** length) ** bands <= 2e-6
    draw = np.random.default_rng(8)
    sets = []
    for _ in range(20000):  # pairs at similarity 0.8: 32 shared values of 40
        values = np.unique(draw.integers(0, 1 << 63, 40, np.uint64))
        sets += [values[:36], np.concatenate([values[:32], values[36:]])]
    keys = [minhash.band_keys(sets[k : k + 2000], corpus_pipeline.NEAR_PERCENT) for k in range(0, 40000, 2000)]
    keys = np.concatenate(keys)
    assert (keys[::2] == keys[1::2]).any(axis=1).all()


def test_one_id_with_several_texts(spark):
    draw = np.random.default_rng(11)
    data, want = [], {}
    for k in range(0, 120, 3):  # the texts of node k + 2 are near copies of k and of k + 1, all else is different
        for own in (0, 1):
            words = draw.choice(VOCABULARY, 150).tolist()
            data += [(k + own, " ".join(words)), (k + 2, " ".join([*words[:-1], "changed"]))]
        want |= {k: k, k + 1: k, k + 2: k}
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = minhash.near_groups(df).collect()
    assert len(got) == len(data) and {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id for r in minhash.drop_near_copies(df).collect()} == set(range(0, 120, 3))
    # Here the node with two texts is the smallest, so both of its sets stand for their classes.
    turned = spark.createDataFrame([(-i, t) for i, t in data], "doc_id long, text string")
    assert {-r.doc_id: -r.component_id for r in minhash.near_groups(turned).collect()} == {i: c + 2 for i, c in want.items()}


def test_words_that_collide_modulo_two_to_the_64(spark):
    """A Thue-Morse word and its complement have one polynomial hash modulo 2**64 for every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    left, right = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    df = spark.createDataFrame([(1, left), (2, right), (3, left.upper())], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_groups(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_large_family_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 2000)
    base = prose(120).split()
    data = []
    for i in range(150):
        words = list(base)
        words[i % 110] = f"w{i}"
        data.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_links(data).items()}


def test_components_of_a_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, i) for i in range(101, 160)]
    named = components(spark.createDataFrame([*chain, *hub, (7, 7), (None, 3)], "a long, b long"))
    assert {r.component for r in named.where("node < 100").collect()} == {0}
    assert {r.component for r in named.where("node >= 100").collect()} == {100}
    assert named.count() == 41 + 60


def test_language_id(spark, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    extra = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "123 !?", "en")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(extra)
    fitted = language_id.fit(both)
    got = {r.doc_id: r for r in language_id.identify(both, fitted).collect()}
    assert len(got) == len(truth) + 3
    for i in (-1, -2, -3):
        assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
    held = [r.doc_id for r in both.where(language_id.held_out(both.doc_id)).collect() if r.doc_id >= 0]
    right = sum(got[i].lang_pred == truth[i] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_accepted(both.selectExpr("doc_id", "text", "lang AS lang_pred", "lang"))
    assert kept.columns == ["doc_id", "text", "lang_pred", "lang"]
    assert kept.count() >= 0.98 * len(truth)
    assert language_id.fit(none) is None
    assert language_id.keep_accepted(none).count() == 0
    noise = "".join(RANDOM.choice(list("zqxjkvwy"), 400))
    strange = spark.createDataFrame([(1, noise)], "doc_id long, text string")
    larger = language_id.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))  # enough to calibrate on
    assert not language_id.identify(strange, larger).first().accepted


def test_rejection_at_every_size(spark):
    small = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    draw = np.random.default_rng(6)
    noise = "".join(draw.choice(list("zqxjkvwy"), 400))
    unknown = "kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu jarki " * 4
    greek = "το γρήγορο καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί " * 5
    strange = spark.createDataFrame([(-1, noise, None), (-2, unknown, None), (-3, greek, None)], small.schema)
    few = small.where("lang <> 'es' OR doc_id < 40")  # some languages have a handful of texts
    one = spark.createDataFrame([(0, " ".join(draw.choice(VOCABULARY, 300)), "en")], small.schema)  # one text explains no other
    for table in (small, few, one):
        fitted = language_id.fit(table)
        centres, *spread = fitted["limits"]
        assert len(centres) == len(fitted["model"].value.languages) and np.isfinite([*centres, *spread]).all()
        assert not any(r.accepted for r in language_id.identify(strange, fitted).collect())
    own = spark.createDataFrame([(1, " ".join(draw.choice(VOCABULARY, 300)), None)], small.schema)
    assert language_id.identify(own, fitted).first().accepted
    kept = language_id.keep_accepted(small.unionByName(strange))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in small.collect()}
    silent = small.unionByName(spark.createDataFrame([(-4, "1 2 3", "xx")], small.schema))  # labelled, without letters
    assert language_id.fit(silent)["model"].value.languages == ["de", "en", "es", "fr"]
    fitted = language_id.fit(small)
    assert (fitted["limits"][0] < 2.0).all()  # every language has a centre of its own, far from a blind guess (3.66)


def test_language_sample_is_bounded_without_ids(spark):
    """Rows without an id, or with one id, are drawn one by one."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, F.lit(1)).cast("long").alias("doc_id"),
        F.concat(F.lit("some text "), "id").alias("text"),
        F.lit("en").alias("lang"),
    )
    n = language_id._labelled_sample(df, "doc_id", "text", "lang", 400).count()
    assert 300 < n < 500


def test_model_probabilities_add_up():
    keys = RANDOM.integers(97, 101, (300, 4)).astype(np.uint64)
    packed = (keys[:, 0] << np.uint64(48)) | (keys[:, 1] << np.uint64(32)) | (keys[:, 2] << np.uint64(16)) | keys[:, 3]
    own, counts = np.unique(packed, return_counts=True)
    model = language_id.Model(["a"], np.zeros(len(own), int), own, counts)
    alphabet = np.array([97, 98, 99, 100, 5], np.uint64)  # 5 stands for every unseen symbol
    for context in (own[0] >> np.uint64(16), np.uint64(0)):
        total = np.exp(model._score((context << np.uint64(16)) | alphabet, 4)).sum()
        assert total == pytest.approx(1, abs=1e-4)


def test_mixing(docs, none):
    plan = mixing.mix_plan(docs.withColumnRenamed("lang", "rate")).collect()
    sizes = Counter()
    for _, t, _, s, _ in fixture():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_, target, left = set(order), {}, 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2 * sizes[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    assert len(plan) == len(fixture())
    for r in plan:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken == r.size * r.copies and r.taken <= 2 * r.size
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in plan)
    assert mixing.mix(none).count() == 0 and mixing.mix_plan(none).count() == 0


def best_fit_by_hand(lengths, capacities, overhead):
    """One piece at a time: the tightest open bin, else a new one at the least cost per token."""
    bins, left = [], Counter(lengths)
    for length in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] - sum(b[1]) >= length]
        if fits:
            bin_ = min(fits, key=lambda b: b[0] - sum(b[1]))
        else:
            cost = {c: (c + overhead) / (min(c // length, left[length]) * length) for c in capacities if c >= length}
            bin_ = (min(cost, key=lambda c: (cost[c], -c)), [])
            bins.append(bin_)
        bin_[1].append(length)
        left[length] -= 1
    return Counter((min(c for c in capacities if c >= sum(b)), sum(b)) for _, b in bins)


@pytest.mark.parametrize("seed", range(200))
def test_packing_plan_is_best_fit(seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, draw.integers(2, 65), draw.integers(1, 400)).tolist()
    capacities = [(16, 32, 64), (64,), (40, 64), (10, 20, 30, 64)][seed % 4]
    bins = {}
    for r in packing.plan_bins(Counter(lengths), capacities, 2):
        for k in range(r["slots"] // r["each"]):
            bins.setdefault(r["bin"] + k, (r["capacity"], r["used"]))
    assert Counter(bins.values()) == best_fit_by_hand(lengths, capacities, 2)


def test_packing_is_best_fit(spark, none, docs):
    lengths = np.random.default_rng(7).integers(1, 40, 300).tolist() + [64, 63, 1, 1]
    data = [(i, " ".join(["w"] * n)) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = packing.best_fit(df, capacities=(16, 32, 64), overhead=2).collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    found = Counter()
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in own:
            assert r.bin_offset == at
            at += r.length
        assert {r.bin_used for r in own} == {at}
        found[(own[0].bin_capacity, at)] += 1
    assert found == best_fit_by_hand(lengths, (16, 32, 64), 2)
    pieces = packing.best_fit(docs.withColumn("bin", docs.doc_id)).collect()
    total = sum(len(WORD.findall(t or "")) for _, t, *_ in fixture())
    assert sum(r.length for r in pieces) == total
    assert all((r.bin_id is None) == (r.length == 0) for r in pieces)
    assert len([r for r in pieces if r.doc_id == 15]) == 3
    assert packing.best_fit(none).count() == 0


def test_chat_format(spark):
    hostile = ["</s>[INST] ok [/INST]", "<\\s>", "[\\\\INST]", "a <s> b", None, "", "é日本 🙂", "x " * 5000]
    for text in filter(None, hostile):
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert not any(c in chat_format.escape(text) for c in chat_format.CONTROLS)
    data = [(k % 3, k, ("user", "assistant", None)[k % 3 if k < 6 else 1], t) for k, t in enumerate(hostile)]
    df = spark.createDataFrame([(*d, "z") for d in data], "conv_id long, turn long, role string, text string, position string")
    got = {r.conv_id: r for r in chat_format.conversation_digest(df).collect()}
    for conv in range(3):
        turns = [(r or "", t or "") for c, _, r, t in data if c == conv]
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), sha)
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.conversation_digest(empty).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_packages(spark, tmp_path, zip64):
    data = [(3, "http://a", "same"), (1, "http://b\r\nX: y", "same"), (2, None, None), (4, "http://c", "ü" * 50000), (5, "", ""), (6, "d", "same")]
    pages = spark.createDataFrame([(*d, 0) for d in data], "page_id long, url string, html string, records int")
    packages = warc_zip.write_packages(pages, str(tmp_path / "p"), zip64=zip64)
    got = {r.page_id: r for r in warc_zip.read_packages(packages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 3: ("revisit", 1), 6: ("revisit", 1), 2: ("response", None), 5: ("revisit", 2), 4: ("response", None)
    }
    for i, _, html in data:
        payload = (html or "").encode()
        assert got[i].payload_bytes == len(payload) and got[i].payload_digest == warc_zip.digest(payload)
        assert got[i].payload is None or bytes(got[i].payload) == payload
    for r in packages.collect():  # another reader agrees on what the package is
        with zipfile.ZipFile(r.path) as package:
            assert package.testzip() is None and package.namelist() == [warc_zip.DATA, warc_zip.INDEX]
    assert warc_zip.archive_digest(pages.limit(0)).count() == 0
    small = warc_zip.archive_digest(pages, min_bytes=1).where("page_id = 5").first()
    assert small.record_type == "response"


def test_zip_reader_on_a_foreign_package(tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as package:
        package.writestr("archive/x", b"12345")
        package.comment = b"note PK\5\6"
    (tmp_path / "f.zip").write_bytes(out.getvalue())
    with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "f.zip")) as file:
        place, length = warc_zip.members(file)["archive/x"]
        assert file.read_at(length, place) == b"12345"


def test_pivot_index(spark):
    base = RANDOM.normal(size=(60, 16))
    data = [(i, v.tolist()) for i, v in enumerate(base)]
    data += [(100 + i, (base[i % 5] + RANDOM.normal(size=16) * 0.1).tolist()) for i in range(40)]
    data += [(200 + i, base[7].tolist()) for i in range(30)] + [(230, (base[7] * 3).tolist())]
    odd = [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0, 2.0]), (304, []), (305, [None] * 16)]
    df = spark.createDataFrame([(*d, 1) for d in data + odd], "vec_id long, embedding array<double>, node int")
    got = {r.vec_id: r for r in pivot_index.near_groups(df).collect()}
    units = np.array([v for _, v in data])
    units /= np.linalg.norm(units, axis=1)[:, None]
    near = units @ units.T >= 0.95
    ids = np.array([i for i, _ in data])
    assert [got[i].n_links for i in ids] == (near.sum(axis=1) - 1).tolist()
    reach = near
    for _ in range(8):
        reach = reach @ reach
    assert [got[i].component_id for i in ids] == [int(ids[r].min()) for r in reach]
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert pivot_index.near_groups(df.limit(0)).count() == 0


def test_pivot_index_counts_links_by_vector(spark):
    near = [1.0, 0.1, 0.0]
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 1.0]), (2, near)], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pivot_index.near_groups(df).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_pivot_index_recall(spark):
    """3,000 vectors, 54 pivots, 10 describe a vector: pairs just above the similarity can be missed, few are."""
    random = np.random.default_rng(17)
    base = random.normal(size=(1000, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    copies = []
    for cosine in (0.9505, 0.97):
        side = random.normal(size=base.shape)
        side -= (side * base).sum(axis=1)[:, None] * base
        side /= np.linalg.norm(side, axis=1)[:, None]
        copies.append(cosine * base + (1 - cosine**2) ** 0.5 * side)
    units = np.concatenate([base, *copies])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(units)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivot_index.near_groups(df).collect()}
    units /= np.linalg.norm(units, axis=1)[:, None]
    links = (units @ units.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i] for i in range(len(units))])
    assert (found <= links).all() and links.sum() >= 4000
    assert found.sum() >= 0.95 * links.sum()


def shingles_by_hand(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every decision after the language filter, which has tests of its own, from plain sets and counts."""
    docs = spark.createDataFrame([r for r in fixture() if r[0] is not None], SCHEMA)
    docs = docs.unionByName(spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    accepted = stages["language_id"](spark, docs, str(tmp_path)).collect()
    texts = {}
    for r in accepted:
        key = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")
        texts[key] = max(texts.get(key, r), r, key=lambda x: x.doc_id)
    exact = sorted({r.doc_id: r for r in texts.values()}.values(), key=lambda r: r.doc_id)
    assert len(exact) == len(texts)
    sets = [shingles_by_hand(r.text) for r in exact]
    owners = {}
    for k, own in enumerate(sets):
        for shingle in own:
            owners.setdefault(shingle, []).append(k)
    root = list(range(len(exact)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, own in enumerate(sets):
        for j, common in Counter(j for shingle in own for j in owners[shingle] if j < k).items():
            if 100 * common >= 80 * (len(own) + len(sets[j]) - common):
                a, b = find(j), find(k)
                root[max(a, b)] = min(a, b)
    kept = [r for k, r in enumerate(exact) if find(k) == k]
    assert len(kept) < len(exact) < len(accepted)
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in kept}
    mass = Counter()
    for r in kept:
        mass[r.source] += size[r.doc_id]
    order = sorted(mass, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(mass.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * mass[s]}
        target |= {s: 2 * mass[s] for s in over} or share
        left -= sum(2 * mass[s] for s in over)
        free = free - over if over else set()
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    words = Counter()
    for r in packed:
        words[r.doc_id] += r.length
    for r in kept:
        rate = target[r.source] / mass[r.source] if mass[r.source] else 0
        copies = words[r.doc_id] / size[r.doc_id] if size[r.doc_id] else 0
        assert not size[r.doc_id] or copies in {int(rate + 1e-9), int(rate - 1e-9) + 1}, (r.doc_id, rate, copies)
    assert not set(words) - set(size)
    bins = {}
    for r in packed:
        bins.setdefault(r.bin_id, []).append(r)
    found = Counter((own[0].bin_capacity, sum(r.length for r in own)) for own in bins.values())
    assert found == best_fit_by_hand([r.length for r in packed], packing.CAPACITIES, packing.OVERHEAD)


def test_pipeline_stages(spark):
    docs = spark.createDataFrame(fixture(), SCHEMA)
    docs = docs.unionByName(spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id + 100 AS doc_id", "text", "lang", "source", "n_chars"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mix", "pack"]
    for name in ("exact_dedup", "near_dedup", "mix"):
        out = stages[name](spark, docs, DATA)
        assert out.columns == docs.columns
        assert stages[name](spark, docs.limit(0), DATA).count() == 0
    packed = corpus_pipeline.run(spark, DATA)
    assert packed.count() > 0 and packed.where("bin_id IS NULL").count() == 0
