"""Small tables with nulls, empty and long texts, ties, repeated rows, no rows, and extra columns of clashing names."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat, common, components, decontam, exactdedup, langid, linededup, mixing, neardedup, secrets, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, key string, bucket string, row string, id string, _gone string, size string"


def docs_of(spark, texts, first=0, **columns):
    rows = [(first + i, t, "en", f"s{i % 3}" if i % 5 else None, "k", "b", "r", "i", "g", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGE = [None, "", " \t\n", "a", "x " * 30_000, "\U0001f600 é ", "same text here", "same text here"]


def prose(seed, n, words=400):
    r = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in r.integers(0, words, n))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# Every operator on edge cases and on no rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, None, int(i % 2)) for i in range(100, 140)] + [(None, 1, 1), (101, 0, 1), (0, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def edge(spark):
    return docs_of(spark, EDGE + [f"good text number {i}" if i % 2 == 0 else f"vile text number {i}" for i in range(100)])


def operators(spark, labelled):
    bench = spark.createDataFrame([(1, "same text here"), (2, None), (3, "--"), (1, "same text here")], "item_id long, text string")
    return {
        "line": lambda d: linededup.drop_common_lines(d, linededup.reference_counts(d), with_text=True),
        "secret": secrets.scan,
        "lang": lambda d: langid.predict(d, langid.fit(d)),
        "decontam": lambda d: decontam.decontaminate(d, bench),
        "exact": exactdedup.exact_groups,
        "exact_drop": exactdedup.drop_exact_duplicates,
        "mix": mixing.mix,
        "near": neardedup.near_components,
        "toxic": lambda d: toxicity.score(d, toxicity.fit(d, labelled)),
    }


@pytest.mark.parametrize("name", ["line", "secret", "lang", "decontam", "exact", "mix", "near", "toxic"])
def test_edge_rows_come_back_once_each(spark, labelled, edge, name):
    got = operators(spark, labelled)[name](edge).select("doc_id").collect()
    assert sorted(r.doc_id for r in got) == list(range(len(EDGE) + 100))


@pytest.mark.parametrize("name", ["line", "secret", "lang", "decontam", "exact", "exact_drop", "mix", "near", "toxic"])
def test_no_rows_in_no_rows_out(spark, labelled, edge, name):
    assert operators(spark, labelled)[name](edge.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["line", "secret", "lang", "decontam", "exact", "mix", "near", "toxic"])
def test_null_ids_and_repeated_rows(spark, labelled, name):
    d = docs_of(spark, ["one two three", "one two three", "other"])
    d = d.unionByName(d).unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert operators(spark, labelled)[name](d).count() == 7


# Line dedup


def test_lines_by_threshold_and_both_ways(spark):
    d = docs_of(spark, [f"own {i}\n Common LINE\t\n\n" + "once" * (i == 3) for i in range(12)] + ["common line\ncommon line", None])
    refs = linededup.reference_counts(d)
    for limit in (linededup.BROADCAST_BYTES, 0):
        got = by_id(linededup.drop_common_lines(d, refs, with_text=True, broadcast_bytes=limit))
        assert got[0].kept_text == "own 0\n\n" and (got[0].n_lines, got[0].n_dropped) == (4, 1)
        assert got[12].kept_text == "" and got[12].n_dropped == 2 and got[12].kept_sha256 == hashlib.sha256(b"").hexdigest()
        assert (got[13].n_lines, got[13].n_dropped) == (1, 0)


def test_lines_meet_filters_by_shard(spark, monkeypatch):
    """Filters that are not broadcast: several shards, keys reported wrongly, and a line that all texts share."""
    monkeypatch.setattr(linededup, "KEYS_PER_SHARD", 4)
    texts = ["\n".join([f"own {i}", *(f"of {m}: {i % m}" for m in range(2, 9)), "everywhere", f"own {i}"]) for i in range(150)] + [None, "", "everywhere"]
    d = docs_of(spark, texts)
    refs = linededup.reference_counts(d)
    count = Counter(k for t in texts for k in {x.strip().lower() for x in (t or "").split("\n")} if k)
    got = by_id(linededup.drop_common_lines(d, refs, with_text=True, broadcast_bytes=0))
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if count[x.strip().lower()] < 10]
        assert (got[i].kept_text, got[i].n_lines, got[i].n_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_filters_answer_by_shard_in_copies(spark):
    r = np.random.default_rng(7)
    hot, cold = (np.stack([r.integers(0, 1 << 62, n), r.integers(0, 1 << 62, n)], 1) for n in (600, 9000))
    cold[:50, 1] = hot[:50, 1]  # what the filters of their shards report wrongly, where the shard is the same
    cold[:50, 0] = hot[:50, 0] + 3
    held = [tuple(map(int, x)) for x in hot[:590]]  # the last shard's keys are not hot
    held = [h for h in held if h[0] % 3 != 2]
    refs = spark.createDataFrame([(*h, 10) for h in held], linededup.REFS_SCHEMA)
    denied = np.ascontiguousarray(cold[:50]).tobytes()
    filters = linededup.build_filters(refs, 10, 3).withColumn("denied", F.lit(denied))
    asked = [(b"o%d" % (i % 7), int(a), int(b)) for i, (a, b) in enumerate(np.concatenate([hot, hot, cold[:50], hot[:1].repeat(500, 0)]))]
    rows = spark.createDataFrame(asked, "owner binary, h1 long, h2 long")
    loads = rows.groupBy(linededup.shard_of(3).alias("shard")).agg(F.count("*").alias("n"))
    want = Counter((o, a, b) for o, a, b in asked if (a, b) in set(held))
    for rows_per_task in (1 << 20, 100):
        got = linededup.ask_filters(filters, rows, loads, 3, rows_per_task).collect()
        assert Counter((bytes(x.owner), x.h1, x.h2) for x in got) == want


def test_line_dedup_is_reversible(spark):
    a, b = docs_of(spark, [f"shared\n{i}" for i in range(9)]), docs_of(spark, ["shared\nnew", "SHARED "], 50)
    table = lambda df: sorted(map(tuple, df.select("h1", "h2", "refs").collect()))
    refs = linededup.reference_counts(a)
    more = linededup.added(refs, b)
    assert table(more) == table(linededup.reference_counts(a.unionByName(b)))
    assert table(linededup.deleted(more, b)) == table(refs)
    filters = linededup.build_filters(refs, 10, 1)
    up = linededup.update_filters(filters, refs, more, 10, 1)
    down = linededup.update_filters(up, more, refs, 10, 1)
    h = np.frombuffer(linededup.key_digest(b"shared"), np.int64)
    held = [[linededup.CuckooFilter.from_bytes(bytes(r.table)).contains(h[1:2])[0] for r in f.collect()] for f in (up, down)]
    assert held == [[True], [False]]


def test_an_overfull_filter_is_built_anew(spark):
    refs = lambda n: spark.createDataFrame([(0, (i * 0x9E3779B97F4A7C15) % (1 << 62), 20) for i in range(n)], linededup.REFS_SCHEMA)
    few, many = refs(40), refs(3000)
    up = linededup.update_filters(linededup.build_filters(few, 10, 1), few, many, 10, 1).collect()
    f = linededup.CuckooFilter.from_bytes(bytes(up[0].table))
    assert len(up) == 1 and f.contains(np.array([r.h2 for r in many.collect()])).all()


def test_a_long_text_goes_through_every_operator(spark, labelled):
    """A million characters and more, beside short texts."""
    text = " ".join(f"word{i % 9973}" for i in range(130_000)) + "\n" + "x" * 200_000
    d = docs_of(spark, [text, "short", text + " ", None])
    for name, run in operators(spark, labelled).items():
        assert run(d).select("doc_id").count() == (3 if name == "exact_drop" else 4), name


def test_cuckoo_filter_holds_and_lets_go():
    r = np.random.default_rng(1)
    keys, others = r.integers(-(1 << 62), 1 << 62, 5000), r.integers(-(1 << 62), 1 << 62, 50_000)
    f = linededup.filter_of(keys)
    assert f.contains(keys).all() and f.contains(others).mean() < 0.001
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01


# Secret scan


def test_secret_spans_against_brute_force(spark):
    texts = [
        "password = 'abcdef' x", "token=token:abcdef", "API_KEY:  \"Zz9+/=.-_\" AKIA" + "Q" * 16, "\U0001f600 secret:abc deadbeef" + "0" * 20, "AKIA123 passwd=short", None, "PASSWORD=x1x2x3 apikey=q1w2e3",
    ]
    got = by_id(secrets.scan(docs_of(spark, texts)))
    patterns = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    for i, text in enumerate(texts):
        spans = [(m.start(), k, m.end()) for k, (name, p) in enumerate(patterns.items()) for m in re.finditer(p, text or "", re.A) if len(m[1 if name == "assign" else 0]) >= (6, 20, 24)[k]]
        want = ",".join(f"{list(patterns)[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


def test_random_tokens_are_told_from_natural_ones(spark):
    r = np.random.default_rng(7)
    symbols = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    random = ["".join(r.choice(symbols, 40)) for _ in range(60)]
    natural = ["donaudampfschifffahrtsgesellschaft", "the_quick_brown_fox_jumps_over_it", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"] * 20
    got = by_id(secrets.scan(docs_of(spark, [f"see {t} there" for t in random + natural])))
    assert sum(got[i].n_random for i in range(60)) >= 50
    assert sum(got[i].n_random for i in range(60, 120)) == 0
    assert got[0].spans in ("", "random:4:44")


def test_random_tokens_are_told_among_a_hundred_times_as_many_natural_ones(spark):
    r = np.random.default_rng(9)
    symbols = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    random = ["".join(r.choice(symbols, 40)) for _ in range(60)]
    words = "account archive billing channel customer delivery document element factory gateway handler invoice journal kernel ledger manager network object packet queue record service template update vector window".split()
    natural = sorted({t for _ in range(40_000) if 32 <= len(t := "_/"[r.integers(2)].join(r.choice(words, 5))) < 48})[:6000]
    assert len(natural) == 6000
    found = {}
    for repeats in (0, 5000):  # of one natural token, in a document of its own each
        got = by_id(secrets.scan(docs_of(spark, [f"see {t} there" for t in random + natural] + [f"see {natural[0]} there"] * repeats)))
        found[repeats] = [i for i, x in got.items() if x.n_random]
        assert sum(i < 60 for i in found[repeats]) >= 40
        assert sum(i >= 60 for i in found[repeats]) <= 0.05 * len(found[repeats])
    assert found[0] == found[5000]


def test_randomness_battery_against_numpy(spark):
    r = np.random.default_rng(12)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    rows = [(e, "".join(r.choice(list(alphabets[e]), n))) for e in range(3) for n in (20, 33, 64, 500)] + [(2, "the_quick-brown/fox+jumps_over"), (2, "aaaaaaaaaaaaaaaaaaaaaaaaz"), (0, "0" * 40)]
    got = spark.createDataFrame(rows, "e int, t string").select("e", "t", secrets.encoding(F.col("t")).alias("seen"), secrets.p_value(F.col("t")).alias("p")).collect()
    for row in got:
        if row.seen != row.e:
            continue  # short draws may lack what tells their alphabet
        k, cells = len(alphabets[row.e]), 16 if row.e == 0 else 8
        x = np.array([alphabets[row.e].index(c) for c in row.t.replace("-", "+").replace("_", "/")], float)
        n = len(x)
        chi = ((np.bincount((x * cells // k).astype(int), minlength=cells) - n / cells) ** 2 / (n / cells)).sum()
        spread = 2 / (9 * (cells - 1))
        z1 = max(0.0, (np.cbrt(chi / (cells - 1)) - (1 - spread)) / np.sqrt(spread))
        high = x >= k / 2
        mean = 2 * high.sum() * (n - high.sum()) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        z2 = (1 + (high[1:] != high[:-1]).sum() - mean) / np.sqrt(var) if var > 0 else 0.0
        d = x - x.mean()
        z3 = ((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * np.sqrt(n) if (d * d).sum() else np.sqrt(n)
        v = (np.cbrt((z1 * z1 + z2 * z2 + z3 * z3) / 3) - (1 - 2 / 27)) / np.sqrt(2 / 27)
        assert abs(row.p - 1 / (1 + np.exp(1.5976 * v + 0.07056 * v**3))) < 1e-6, row


def test_a_text_of_very_many_spans(spark):
    """20,000 keys in one text, every third inside an assignment; and spans at a text's edges."""
    r = np.random.default_rng(13)
    parts = [("token=" if i % 3 == 0 else "") + "".join(r.choice(list("ABCDEFGHabcdefgh0123456789+/"), 30)) + ("é" if i % 7 == 0 else "") for i in range(20_000)]
    text = "\U0001f600 ".join(parts)
    row = secrets.scan(docs_of(spark, [text])).collect()[0]
    spans = [(m.start(), m.end()) for m in re.finditer(secrets.ASSIGN, text)]
    assert row.n_assign == len(spans) and row.spans.startswith(f"assign:{spans[0][0]}:{spans[0][1]}")
    tokens = secrets.with_spans(docs_of(spark, [text, "x" * 25 + " token=" + "y" * 25, "token=" + "y" * 25 + "=" + "z" * 30])).select("doc_id", F.transform("tokens", lambda t: t["start"]).alias("at")).collect()
    inside = {i for a, b in spans for i in range(a, b)}
    assert tokens[0]["at"] == [m.start() for m in re.finditer(secrets.TOKEN, text) if m.start() not in inside and m.end() - 1 not in inside]
    assert [t["at"] for t in tokens[1:]] == [[0], []]


def test_few_random_tokens_among_very_many_natural_ones():
    assert secrets._cut([100_000, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 1, 0, 0, 0, 1, 0], [5, 0, 0, 100_000], secrets.MAX_FALSE) is not None


def test_natural_tail_is_not_taken_for_random():
    tail = [5600, 8, 5, 4, 3, 2, 2, 2, 1, 1, 1, 1, 1, 0, 1, 0, 0, 0, 0, 0]  # natural tokens alone, thinning out
    assert secrets._cut(tail, [24, 70, 240, 5298], secrets.MAX_FALSE) is None
    assert secrets._cut([20_000] + [20] * 19, [360, 36, 4, 19_980], secrets.MAX_FALSE) is not None


# Chat


def test_chat_round_trip_of_control_strings(spark):
    said = ["\\### Assistant: </turn> ok", "<|turn|>user\n<|end|>\\", "<\\|", "\\\\<|", "", None, "a\nb"]
    rows = [(1, i, "assistant" if i % 2 else "us\ner<|end|>", t) for i, t in enumerate(said)] + [(None, None, None, "x"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    out = chat.format_conversations(m)
    got = {r.conv_id: r for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).join(chat.chat_digests(out), "conv_id", "left").collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[:7]]
    assert [t.text for t in got[2].turns] == ["a", "b"]
    loss = "".join(t or "" for i, t in enumerate(said) if i % 2)
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[1].loss_chars == len(loss)
    assert out.where("conv_id is null").count() == 1 and chat.chat_digests(chat.format_conversations(m.limit(0))).collect() == []


def test_chat_parts_become_placeholders(spark):
    parts = [("text", "see <|image|>", None, None, None, None, None), ("image", None, "s3://i", 28, 15, None, None), None, ("audio", None, "a", None, None, 2.0, None), ("odd", None, "d", None, None, None, 3), (None, "t", None, None, None, None, None)]
    m = spark.createDataFrame([(1, 70 * i, "user", parts) for i in range(2)], f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>")
    r = chat.format_conversations(m).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()[0]
    assert r.formatted == 2 * "<|turn|>user\nsee <\\|image|><|image|><|audio|><|document|>t<|end|>"
    assert [(a.kind, a.uri, a.tokens) for a in r.attachments] == 2 * [("image", "s3://i", 4), ("audio", "a", 50), ("document", "d", 1800)]
    assert r.turns[0].text == "see <|image|>t"


# Language ID


def test_language_id_held_out(spark):
    stems = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["zwei", "und", "drei"], "cc": ["uno", "cuatro", "ño"]}
    r = np.random.default_rng(3)
    rows = [(i, " ".join(r.choice(stems[lang], 12)), lang) for i in range(300) for lang in [list(stems)[i % 3]]] + [(900, None, "aa"), (901, "123 !!", "bb"), (902, "lorem " * 300_000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(langid.predict(d, langid.fit(d)))
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:300]) and got[902].lang_pred == "aa"
    assert got[900].lang_pred == got[901].lang_pred == "und" and all(0 <= x.score <= 1 for x in got.values())


def test_language_filters_against_sets(spark):
    """Every language that has an n-gram often enough is returned for it, and counts without false positives decide alike."""
    r = np.random.default_rng(4)
    shared, own = ["nation", "station", "mente"], {"aa": ["lorem", "ipsum"], "bb": ["zwei", "drei"], "cc": ["cuatro", "\u0441\u043b\u043e\u0432\u043e"]}
    rows = [(i, " ".join(r.choice(shared + own[lang], 15)), lang) for i in range(240) for lang in [list(own)[i % 3]]] + [(500, "seldom", "aa")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), least_count=3)
    assert model.languages == list(own)

    def grams(text):
        t = f" {' '.join(text.lower().split())} "
        return [t[i : i + 4] for i in range(len(t) - 3)]

    counts = {lang: Counter(g for i, t, x in rows if x == lang and zlib.crc32(str(i).encode()) % 5 for g in grams(t)) for lang in own}
    members = {lang: {g for g, n in c.items() if n >= 3} for lang, c in counts.items()}
    key = lambda g: langid.grams_of(np.array([ord(c) for c in g], np.uint32))
    every = sorted(set().union(*members.values()))
    assert sum(all(g in m for m in members.values()) for g in every) >= 15
    looked = [int(model.masks(key(g))[0]) for g in every]
    wanted = [sum(1 << k for k, lang in enumerate(own) if g in members[lang]) for g in every]
    assert all(a & b == b for a, b in zip(looked, wanted, strict=True)) and np.mean([a != b for a, b in zip(looked, wanted, strict=True)]) < 0.05
    for i, text, lang in rows[:240]:
        exact = {x: sum(g in members[x] for g in grams(text)) for x in own}
        got, score = model.predict(text)
        assert got == lang or exact[got] >= exact[lang] - 1
        assert abs(score - exact[got] / sum(exact.values())) < 0.1


def test_bit_sliced_filters_correct_false_positives():
    r = np.random.default_rng(5)
    grams = r.integers(0, 1 << 62, 20_000).astype(np.uint64)
    masks = (np.uint64(1) << (np.arange(20_000) % 70 % 64).astype(np.uint64))[:, None]
    f = langid.LanguageFilters([f"l{i:02}" for i in range(64)], grams, masks)
    assert ((f.masks(grams) & masks[:, 0]) == masks[:, 0]).all()
    other = r.integers(0, 1 << 62, 100_000).astype(np.uint64)
    rate = np.mean((f.masks(other) & np.uint64(1)) != 0)
    assert abs(rate - f.false[0]) < 0.002


# Decontamination


def test_decontamination_against_brute_force(spark):
    r = np.random.default_rng(11)
    items = [" ".join(f"w{x}" for x in r.integers(0, 40, n)) for n in (25, 12, 10, 4, 1)] + ["", None]
    texts = [prose(i, 60, 40) for i in range(30)] + [f"Zz {items[0].upper()}! {prose(1, 9)}" + items[3], items[2].replace(" ", "--"), items[1][:-4], None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for block in (decontam.BLOCK_BYTES, 200):
        got = by_id(decontam.decontaminate(docs_of(spark, texts), bench, block_bytes=block))
        for i, t in enumerate(texts):
            w, hit, found = words(t), set(), set()
            for n, item in enumerate(items):
                iw = words(item)
                size = min(10, len(iw))
                for a in range(len(iw) - size + 1 if size else 0):
                    for b in range(len(w) - size + 1):
                        if w[b : b + size] == iw[a : a + size]:
                            hit |= set(range(b, b + size))
                            found.add(str(n))
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(w), len(hit), len(found), bool(hit))
            assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_a_large_block_of_the_benchmark_stays_small():
    r = np.random.default_rng(2)
    items = [(i, " ".join(map(str, r.integers(0, 30_000, 600)))) for i in range(1200)] + [(7, "5 6 7"), (None, "5 6 7"), (8, "5 6 7"), (9, "1"), (9, "")]
    index = decontam.ItemIndex(items)
    index.order_by_rarity({k: np.ones(len(h), np.int64) for k, h in index.all.items()})
    assert len(index.words) > 700_000 and len(pickle.dumps(index)) < 100 << 20
    text = items[5][1].split()
    for words, spans, found in ((text[20:31], [(0, 10), (1, 11)], {5}), (text[20:29], [], set()), (["x", "5", "6", "7", "1"], [(1, 4), (4, 5)], {7, 8, 9}), ([], [], set())):
        got = index.match(index.ids(" ".join(words)))
        assert (sorted(got[0]), got[1]) == (spans, found)


# Token counts


def test_token_counts_and_cache(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    own = Tokenizer.from_file(path)
    texts = [*EDGE, "a <|endoftext|> b", "don't  stop\n\n now 123"]
    want = [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = by_id(tokens.count_tokens(docs_of(spark, texts), path, cache))
    assert [got[i].n_tokens for i in range(len(texts))] == want and got[5].n_bytes == len(EDGE[5].encode()) and got[4].over_limit
    first = spark.read.parquet(cache).count()
    assert first == len({t or "" for t in texts})
    got = by_id(tokens.count_tokens(docs_of(spark, [*texts, "new"]), path, cache))
    assert got[len(texts)].n_tokens == 1 and spark.read.parquet(cache).count() == first + 1
    assert tokens.count_tokens(docs_of(spark, ["x"]).limit(0), path, cache).collect() == []


@pytest.mark.parametrize("broadcast_bytes", [common.BROADCAST_BYTES, 0])
def test_token_counts_encode_distinct_misses_only(spark, tmp_path, broadcast_bytes):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, cache = public_tokenizers.path("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    own = Tokenizer.from_file(path)
    texts = [f"text number {i % 70}" for i in range(300)] + [None, "", "hot text"]
    d = docs_of(spark, texts).unionByName(docs_of(spark, ["hot text"] * 200).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs_of(spark, ["hot text", "odd"] * 2).withColumn("doc_id", F.lit(9).cast("long")))
    run = lambda x: sorted(map(tuple, tokens.count_tokens(x, path, cache, broadcast_bytes=broadcast_bytes).collect()), key=repr)
    count = lambda t: (len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids), False)
    want = sorted([(r.doc_id, *count(r.text)) for r in d.collect()], key=repr)
    assert run(d) == want
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts} | {"odd"})
    warm = docs_of(spark, ["one more text"], 1000)
    assert run(d.unionByName(warm)) == sorted([*want, (1000, *count("one more text"))], key=repr)
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts} | {"odd"}) + 1
    chosen = []
    whole = tokens._chosen
    try:
        tokens._chosen = lambda *a: chosen.append(a[2].count()) or whole(*a)
        assert run(d) == want
    finally:
        tokens._chosen = whole
    assert chosen == [0]  # a warm cache reads no text again for encoding


def test_pieces_keep_the_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "It's  a\n long 12 text,  with  <|endoftext|> é — " * 50
    parts = tokens.pieces(text, 40)
    assert len(parts) > 20 and "".join(parts) == text
    assert sum(len(own.encode(p, add_special_tokens=False).ids) for p in parts) == len(own.encode(text, add_special_tokens=False).ids)


# Exact dedup


def test_golomb_codes_round_trip():
    r = np.random.default_rng(2)
    for n, bits in ((0, 60), (1, 60), (1000, 63), (5, 4)):
        values = np.unique(r.integers(0, 1 << bits, n).astype(np.uint64))
        raw, k = exactdedup.golomb_encode(values, 1 << bits)
        assert (exactdedup.golomb_decode(raw, k, len(values)) == values).all()
    values = np.unique(r.integers(0, 1 << 62, 20_000).astype(np.uint64))
    assert len(exactdedup.golomb_encode(values, 1 << 62)[0]) < 0.85 * 8 * len(values)


def test_exact_groups_keep_the_longest_then_the_smallest(spark):
    texts = ["a b", "ab", " a\tb ", "c", None, " \n", "ab  ", "C"]
    got = by_id(exactdedup.exact_groups(docs_of(spark, texts)))
    assert [got[i].keep_id for i in range(8)] == [2, 2, 2, 3, 5, 5, 2, 7] and [got[i].group_size for i in (0, 3, 4)] == [4, 1, 2]
    d = docs_of(spark, texts)
    kept = exactdedup.drop_exact_duplicates(d.unionByName(d))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 5, 7] and kept.columns == d.columns
    assert sorted(r.doc_id for r in exactdedup.exact_groups(d, broadcast_bytes=0).where("kept").collect()) == [2, 3, 5, 7]


def test_texts_that_nothing_asks_for_are_not_shuffled(spark):
    """With nothing broadcast, a filter of the wanted ids stands before the shuffle."""
    d = docs_of(spark, [prose(i, 30) for i in range(400)] + ["twice said"] * 2 + [None])
    ids = common.stored(spark.createDataFrame([(i,) for i in (3, 400, None, 999)], "doc_id long"), "ids")
    among = common.key_filter(ids, 4)
    held = {r.doc_id for r in d.where(among(F.col("doc_id"))).select("doc_id").collect()}
    assert {3, 400} <= held and len(held) < 12
    for how, want in (("left_semi", 2), ("left_anti", 401)):
        assert common.by_key(d, F.col("doc_id"), ids, how, 0).count() == want
    assert len(exactdedup.drop_exact_duplicates(d, 0).collect()) == 402


# Mixing


def test_words_are_counted(spark):
    texts = [None, "", " ", "a", " a", "a ", "\n a\tb \r\x0b c\x0c", "\u00a0 \u2003x \U0001f600\x1cy", "x", "\x00 x\ny"] + ["".join(t) for t in product(" \nax", repeat=4)]
    got = by_id(docs_of(spark, texts).select("doc_id", mixing.word_count(F.col("text")).alias("n")))
    assert [got[i].n for i in range(len(texts))] == [len(re.findall("[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_mix_meets_its_targets(spark):
    texts = [prose(i, 30 + i % 50) for i in range(200)]
    d = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") < 4, "tiny").when(F.col("doc_id") < 150, "big").when(F.col("doc_id") < 190, None).otherwise("mid"))
    for block in (64, 4096):
        rows = mixing.mix(d, block=block).collect()
        per = {}
        for r in rows:
            assert 0 <= r.taken <= 3 * r.size
            s = per.setdefault(r.source, [0, r.target, r.source_size])
            s[0] += r.taken
        assert all(abs(taken - target) <= 1 for taken, target, _ in per.values())
        assert per["tiny"][1] <= 3 * per["tiny"][2] and abs(sum(t for _, t, _ in per.values()) - sum(n for _, _, n in per.values())) < 1e-6
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(d, block=block).collect()), key=str)


def test_schedule_is_even_in_every_prefix(spark):
    targets = spark.createDataFrame([("a", 10_000, 10_000.0), ("b", 20_000, 30_000.0), (None, 5_000, 7_000.0)], "source string, source_size long, target double")
    slots = sorted(mixing.schedule(spark, targets, 10).collect(), key=lambda r: r.slot)
    share = {"a": 10 / 47, "b": 30 / 47, None: 7 / 47}
    for n in (100, 1000, 4000):
        for s, p in share.items():
            assert abs(sum(r.source == s for r in slots[:n]) - n * p) < 8
    for s in share:
        assert sorted(r["rank"] for r in slots if r.source == s) == list(range(sum(r.source == s for r in slots)))


# Near dedup


def test_near_components_against_brute_force(spark):
    texts = []
    for f in range(12):
        base = prose(100 + f, 120).split()
        for c in range(8):
            r = np.random.default_rng(1000 * f + c)
            words = list(base)
            for at in r.integers(0, len(words), c * 2):
                words[at] = f"x{r.integers(0, 10**6)}"
            texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), "one", "One", "two words", "", None, " "]
    n = len(texts)
    for k in (2, 5):
        sets = []
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
            sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
        parent = list(range(n))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(n):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
        got = by_id(neardedup.near_components(docs_of(spark, texts), k=k))
        assert [got[i].component_id for i in range(n)] == [find(i) for i in range(n)]
        assert [got[i].n_shingles for i in range(n)] == [len(s) for s in sets]


def test_hidden_links_are_found_in_blocks(spark, monkeypatch):
    """A chain whose ends differ: with few candidates verified first and tiny blocks, the second pass has to find the rest."""
    monkeypatch.setattr(neardedup, "BEST", 1)
    monkeypatch.setattr(neardedup, "BLOCK", 3)
    monkeypatch.setattr(neardedup, "BLOCK_SHINGLES", 700)
    words = prose(5, 300).split()
    texts = []
    for i in range(30):
        texts.append(" ".join(words))
        for j in range(10):
            words[10 * i + j] = f"y{i}.{j}"
    got = by_id(neardedup.near_components(docs_of(spark, texts), k=2))
    assert {r.component_id for r in got.values()} == {0}


def test_hub_rounds_end_when_they_no_longer_pay(spark, monkeypatch):
    """A family with many members that few others are linked with: blocks find their links, not a round for each of them."""
    monkeypatch.setattr(neardedup, "BEST", 1)
    monkeypatch.setattr(neardedup, "BLOCK", 3)
    monkeypatch.setattr(neardedup, "ROUND_BLOCKS", 4, raising=False)
    rounds, verified = [], neardedup._verified
    monkeypatch.setattr(neardedup, "_verified", lambda *a: rounds.append(1) or verified(*a))
    r, base, texts = random.Random(5), [f"w{i}" for i in range(100)], []
    for _ in range(150):
        words = list(base)
        for at in r.sample(range(40), r.randint(2, 7)):
            words[at] = f"v{r.randrange(2)}.{at}"
        texts.append(" ".join(words))
    sets = [set(zip(w, w[1:], strict=False)) for w in map(str.split, texts)]
    least = list(range(150))
    while True:  # the smallest label of every linked text, until nothing changes
        after = [min(least[j] for j in range(150) if 100 * len(s & sets[j]) >= 80 * len(s | sets[j])) for s in sets]
        if after == least:
            break
        least = after
    got = by_id(neardedup.near_components(docs_of(spark, texts), k=2))
    assert [got[i].component_id for i in range(150)] == least
    assert len(rounds) <= 3


def test_links_count_only_shared_shingles():
    """Sets as numbers of the outsiders' shingles: those that no outsider holds are one number, and never count as shared."""
    x, y = [np.array(v, np.uint64) for v in ([1, 5, 9], [7], [9, 2**64 - 1])], [np.array(v, np.uint64) for v in ([5, 9], [4])]
    members, outsiders, n = neardedup._numbered([v.tobytes() for v in x], [v.tobytes() for v in y])
    assert n == 3
    assert [v.tolist() for v in members] == [[3, 1, 2], [3], [2, 3]]
    assert [v.tolist() for v in outsiders] == [[1, 2], [0]]


def test_estimate_is_corrected(spark):
    a, b = (np.arange(s, s + 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for s in (0, 400))
    equal = (neardedup.registers(a) == neardedup.registers(b)).sum()
    assert abs(neardedup.estimate(equal, np.array(4000), np.array(4000)) - 3600 / 4400) < 0.12


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250), (50, 50)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 250: 200, 300: 200, 50: 50}


# Toxicity


def test_toxicity_learns_and_index_is_exact(spark):
    r = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{x}" for x in r.integers(0, 60, 40)]
        if i % 4 == 0:
            words[3:8] = r.choice(["vile", "foul"], 5)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    d, ls = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, ls)
    got = by_id(toxicity.score(d, model))
    assert np.mean([got[i].predicted == y for i, y in labels]) > 0.99 and any(x.held_out for x in got.values())
    assert all(0 <= x.score <= 1 and len(x.evidence) == 3 for x in got.values())
    # Against TF-IDF cosines made from the texts.
    vocabulary, known = list(model.vectors.number), {i: t for i, t in rows if zlib.crc32(str(i).encode()) % 5}
    tf = {}
    for i, text in known.items():
        tf[i] = Counter()
        for w in re.findall(r"\w+", text.lower()):
            mine = [t for t in [w, *(f"^{w[:n]}" for n in (4, 5, 6) if len(w) > n)] if t in vocabulary]
            tf[i].update(mine or ["(other)"])
    idf = {t: np.log((1 + len(tf)) / (1 + sum(t in c for c in tf.values()))) + 1 for t in [*vocabulary, "(other)"]}
    unit = {}
    for i, c in tf.items():
        v = {t: (1 + np.log(n)) * idf[t] for t, n in c.items()}
        unit[i] = {t: x / np.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}
    for i in list(known)[:25]:
        want = sorted((sum(x * unit[j].get(t, 0.0) for t, x in unit[i].items()) for j in known), reverse=True)[: model.k]
        ids, cosines = model.index.nearest(model.vectors.counts(known[i]), model.k)
        assert np.allclose(cosines, want, atol=1e-5) and i in model.doc_ids[ids[cosines > 1 - 1e-6]]


def test_blocks_are_skipped_and_nothing_is_lost():
    r = np.random.default_rng(6)
    counts = [{int(15 * (i // 100) + t): int(n) for t, n in zip(r.choice(20, 6, replace=False), r.integers(1, 9, 6), strict=True)} for i in range(2000)] + [{}]
    index, scored = toxicity.BlockMaxIndex(counts, 320), []
    plain = index.cosines
    index.cosines = lambda t, w, blocks: scored.append(int(blocks.sum())) or plain(t, w, blocks)
    for i in range(0, 2000, 40):
        terms, weights = index.vector(counts[i])
        every = plain(terms, weights, np.ones(index.blocks, bool))
        every[i] = -1
        ids, cosines = index.nearest(counts[i], 25, i)
        want = np.lexsort((np.arange(len(every)), -every))[:25]
        assert np.allclose(cosines, every[want], atol=1e-6) and i not in ids
    assert sum(scored) < 0.5 * index.blocks * 50


def test_toxicity_without_both_classes(spark):
    d = spark.createDataFrame([(i, "a b") for i in range(20)], "doc_id long, text string")
    for labels, want in (([], 0.0), ([(i, 1) for i in range(20)], 1.0), ([(i, 0) for i in range(20)], 0.0)):
        ls = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert {r.score for r in toxicity.score(d, toxicity.fit(d, ls)).collect()} == {want}
