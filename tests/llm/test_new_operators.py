"""Chat windows, importance resampling and vector codes against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabsight.check import compare, connect
from tabsight.llm import chat, decontamination, jaccard_join, quality, resampling, url_lists, vector_codes
from tabsight.llm.queries import ORACLES, QUERIES
from tabsight.options import DEFAULTS

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("name", ["op12_target_resampling", "op13_vector_codes"])
def test_oracle(spark, sf, name):
    assert compare(spark, connect(sf), sf, QUERIES[name], ORACLES[name]) == ""


# 11

TURNS = "conv_id long, turn long, role string, text string, part string, _text int, window double"


def talk(seed=1):
    rng = random.Random(seed)
    words = ["<|im_end|>", "<|im_start|>", "[INST]", "</s>", "<\\s>", "\\", "<|\\im_end|>", "<<SYS>>", "é", "hello", "two words", "\n", "<", "<|im_", "end|>", "[/INST]", "<s", ">", "<\\\\s>"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(n))
    rows = []
    for c in range(12):
        system = c % 3 == 0
        for t in range(rng.randint(1, 14)):
            role = "system" if system and t == 0 else rng.choice(["user", "assistant"]) if t else "user"
            rows.append((c, t, role, text(rng.choice([0, 1, 5, 60, 300]))))
    rows += [(50, 0, "system", "only"), (51, 0, "assistant", None), (51, None, None, "first"), (51, 1, "we\nird\\n<s>", "x"), (None, 0, "user", "a"),
             (None, 0, "user", "a"), (None, 1, "assistant", ""), (52, 0, "user", "long " * 5000), (52, 1, "assistant", "répondre " * 5000), (52, 2, "system", "late")]
    rows += [(53, i, "assistant" if i % 2 else "system" if i == 0 else "user", f"turn {i} " * 3) for i in range(400)]
    return [(*r, "clash", 1, 0.5) for r in rows]


def in_order(df):
    rows = collections.defaultdict(list)
    for r in df.selectExpr("*", "xxhash64(coalesce(role, ''), coalesce(text, '')) as h").collect():
        rows[r["conv_id"]].append(((r["turn"] is not None, r["turn"] or 0, r["h"], r["role"] or "", r["text"] or ""), r["role"] or "", r["text"] or ""))
    return {c: [(role, text) for _, role, text in sorted(v)] for c, v in rows.items()}


@pytest.mark.parametrize("chunk_rows", [5_000_000, 40])
def test_windows_hold_every_turn(spark, chunk_rows):
    """With 40 turns a part conversations are cut, as very long ones are."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(VOCABULARY)
    df = spark.createDataFrame(talk(), TURNS).repartition(3)
    want, opts = in_order(df), replace(DEFAULTS, chunk_rows=chunk_rows)
    made = chat.format_conversations(df, VOCABULARY, budget=400, history_tokens=120, history_turns=3, opts=opts).collect()
    windows = collections.defaultdict(list)
    for w in sorted(made, key=lambda w: (w["part"], w["window"])):
        windows[w["conv_id"]].append(w)
    assert set(windows) == set(want)
    assert chunk_rows > 40 or max(len({w["part"] for w in v}) for v in windows.values()) > 3
    for conv, turns in want.items():
        system, at = turns[0][0] == "system", 0
        for w in windows[conv]:
            read, n = chat.turns_of(w["text"]), w["n_repeated"]
            assert read[n:] == turns[at:at + w["n_turns"]] and len(read) == n + w["n_turns"] and w["n_turns"] > 0
            history = read[system and at > 0:n]
            assert len(history) <= 3 and history == turns[at - len(history):at]
            if system:
                assert read[0] == turns[0]
                assert len(history) < at or not at
            learnt = [(w["text"][a:b]) for a, b in zip(w["loss_starts"], w["loss_ends"])]
            assert [chat.unescape(x) for x in learnt] == [text for role, text in turns[at:at + w["n_turns"]] if role == "assistant"]
            assert not any(c in x for x in learnt for c in chat.CONTROLS)
            parts = [f"{chat.START}{chat.escape_role(r)}\n{chat.escape(t)}{chat.END}\n" for r, t in read]
            assert "".join(parts) == w["text"]
            sizes = [len(library.encode(p, add_special_tokens=False).ids) for p in parts]
            assert sum(sizes) == w["n_tokens"] and w["over_budget"] == (w["n_tokens"] > 400)
            if w["over_budget"]:
                assert len(read) == w["n_turns"] + (system and at > 0) and (w["n_turns"] == 1 or system and w["n_turns"] == 2)
            at += w["n_turns"]
        assert at == len(turns)


@pytest.mark.parametrize("chunk_rows", [5_000_000, 40])
def test_digest_reads_it_back(spark, chunk_rows):
    df = spark.createDataFrame(talk(2), TURNS).repartition(4)
    got = {r["conv_id"]: r for r in chat.conversation_digest(df, VOCABULARY, 300, 100, 2, replace(DEFAULTS, chunk_rows=chunk_rows)).collect()}
    want = in_order(df)
    assert set(got) == set(want)
    for conv, turns in want.items():
        r, learnt = got[conv], "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(learnt) and r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        assert r["formatted_chars"] >= sum(len(b) for _, b in turns)
    assert chat.conversation_digest(df.limit(0), VOCABULARY).count() == 0


def test_escapes_round_trip():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "im_end", "im_start", ">", "\\", "[", "INST", "/", "]", "s", "SYS", "\n", "n", "endoftext"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROLS)
        role = chat.escape_role(text)
        assert chat.unescape_role(role) == text and "\n" not in role
        assert chat.turns_of(f"{chat.START}{role}\n{chat.escape(text)}{chat.END}\n" * 2) == [(text, text)] * 2


def test_buffered_conversation_is_cut_alike(monkeypatch, spark):
    df = spark.createDataFrame(talk(3), TURNS).coalesce(1)
    make = lambda: key(tuple(r[:6]) for r in chat.format_conversations(df, VOCABULARY, 300, 100, 2).select("conv_id", "window", "text", "n_repeated", "n_turns", "n_tokens").collect())
    whole = make()
    monkeypatch.setattr(chat, "BUFFER_TURNS", 3)
    assert make() == whole


def test_given_conversation(spark, sf):
    r = QUERIES["op11_chat_windows"](spark, sf).where("conv_id = -1").first()
    says = "</s>[INST] ok [/INST]"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(says) and r["loss_sha256"] == hashlib.sha256(says.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{says}\nassistant\n{says}\n".encode()).hexdigest()


# 12

def brute_resample(rows, target, longest=1):
    def features(text):
        words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    size_s, size_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (size_s + 10000) / ((s[b] + 1) * (size_t + 10000))))
    out = []
    for i, x in rows:
        f = features(x)
        w = sum(map(gain, f))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    rank = collections.defaultdict(list)
    for k, r in enumerate(order):
        rank[tuple(r)].append(k + 1 if k < len(order) * 10 // 100 else None)
    return [(*r, rank[tuple(r)].pop() if r[1] >= 20 else None) for r in out]


def texts(n, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéÉAB9") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    return [rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 70))) for _ in range(n)]


@pytest.mark.parametrize("longest,limits", [(1, {}), (2, {}), (1, {"segment_rows": 20, "samples": 60}), (1, {"segment_rows": 3, "samples": 10})])
def test_resampling(spark, longest, limits):
    """With segments of a few rows, rows that tie in everything lie on several splitters."""
    rows = list(enumerate(texts(300)))
    rows += [(None, None), (7, None), (8, ""), (None, rows[3][1]), (9, "x" * 3_000_000 + " y Y-y" * 400_000)] + [(500, "same text " * 15)] * 150 + [(None, "same text " * 15)] * 40
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, rank string, _id int, _segment int").repartition(5)
    target = spark.createDataFrame([(t, 1) for t in [*texts(30, 9), None, ""]], "text string, n int")
    got = resampling.resample(df, target, longest=longest, **limits).collect()
    assert key(got) == key(brute_resample(rows, [*texts(30, 9), None, ""], longest))


def test_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "c " * 25)], "doc_id long, text string")
    assert resampling.resample(empty, empty).count() == 0
    assert key(resampling.resample(some, empty).collect()) == key(brute_resample([(1, "a b"), (2, "c " * 25)], []))


# 13

def brute_codes(rows, parts=16, entries=64, rounds=2):
    good = [(i, l, [max(-2**63, min(2**63 - 1, math.floor(256 * x) if abs(256 * x) < math.inf else int(math.copysign(2**63, x)))) for x in v])
            for i, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not good:
        return []
    own = max(1, -(-max(len(v) for _, _, v in good) // parts))
    full = [v + [0] * (parts * own - len(v)) for _, _, v in good]
    cut = [[tuple(v[p * own:(p + 1) * own]) for p in range(parts)] for v in full]
    first = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0] or 0, good[k][2]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        held = [collections.defaultdict(list) for _ in range(parts)]
        for v in cut:
            for p in range(parts):
                held[p][near(p, v[p])[1]].append(v[p])
        for p in range(parts):
            for j, xs in held[p].items():
                books[p][j] = tuple(sum(c) // len(xs) for c in zip(*xs))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    found = [[near(p, v[p]) for p in range(parts)] for v in cut]
    error = [min(sum(d for d, _ in f), 2**63 - 1) for f in found]
    label = collections.Counter()
    for (_, l, _), e in zip(good, error):
        label[l] += e
    return [(i, "".join(f"{j:02x}" for _, j in f), e, min(label[l], 2**63 - 1), digest) for (i, l, _), f, e in zip(good, found, error)]


SCHEMA = "vec_id long, label int, embedding array<double>, code string, _id int, part int"


@pytest.mark.parametrize("d,spread", [(32, 1.0), (16, 0.01), (40, 1e-3), (48, 1e12)])
def test_codes(spark, d, spread):
    rng = np.random.default_rng(d)
    rows = [(int(i), int(rng.integers(0, 4)) if i % 7 else None, (rng.normal(size=d) * spread).round(4).tolist()) for i in rng.permutation(230)]
    rows += [rows[0], (3, 1, rows[1][2]), (None, None, rows[2][2]), (400, 1, None), (401, 1, [1.0, None]), (402, 1, [math.nan] * d), (403, 1, [math.inf] * d),
             (404, 9, []), (405, 9, [0.25]), (-5, 8, rows[5][2])]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(4)
    assert key(vector_codes.compress(df).collect()) == key(brute_codes(rows))


def test_codes_of_huge_and_few(spark):
    rows = [(i, 1, [10.0 ** (20 * i), -1e300, 3.5, float(i)]) for i in range(5)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)
    assert key(vector_codes.compress(df, parts=2).collect()) == key(brute_codes(rows, parts=2))
    assert vector_codes.compress(df.limit(0)).count() == 0 and vector_codes.compress(df.where("vec_id < 0")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_many_labels_meet_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HOT_SHARE", 5)
    rng = np.random.default_rng(2)
    rows = [(i, 1 if i % 3 else (i if i % 2 else None), rng.normal(size=16).tolist()) for i in range(200)]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)
    assert key(vector_codes.compress(df).collect()) == key(brute_codes(rows))


def test_masks_leave_few_candidates():
    """The masks give the exact nearest entry, ties to the lower one, and spare most distances."""
    rng = np.random.default_rng(8)
    entries = rng.integers(-100, 100, (64, 4))
    entries[40] = entries[7]
    x = np.concatenate((rng.integers(-150, 150, (3000, 4)), entries))
    search, seen = vector_codes.PartSearch(entries), []
    plain = search.distance
    search.distance = lambda a, b: (seen.append(len(a)), plain(a, b))[1]
    entry, best = search.nearest(x)
    all_of = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (entry == all_of.argmin(axis=1)).all() and (best == all_of.min(axis=1)).all()
    assert sum(seen) < 0.4 * all_of.size


# clashing names, odd dates

def test_columns_named_like_an_operators_own(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.selectExpr("*", "-7 as score", "1 as _score", "2 as bad", "3 as BAD_text", "4 as _bad", "5 as Score_2")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    plain = {r["doc_id"] for r in quality.keep(docs, model).collect()}
    kept = quality.keep(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == plain and {r["score"] for r in kept.collect()} == {-7}
    capital = docs.withColumn("Score", F.lit(-7))
    assert quality.keep(capital, model).columns == capital.columns and quality.keep(capital, model).count() == len(plain)
    with pytest.raises(ValueError):
        quality.score(capital, model)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for clean in (decontamination.clean, decontamination.clean_rows):
        got, want = clean(odd, bench), clean(docs, bench)
        assert got.columns == odd.columns and got.count() == want.count()
    captures = spark.createDataFrame([("https://a.b/x", 5), ("https://c.d/", 500)], "url string, n int").selectExpr(
        "url", "date_add(date'2024-01-01', n) as fetched", "n as _u", "n + 1 as _d", "n as _url", "n as _day", "n as _key", "n as c0", "n as _month", "'x' as Host")
    events = spark.createDataFrame([("a.b", "spam", True, 1)], "entry string, category string, listed boolean, n int").selectExpr("entry", "category", "listed", "date_add(date'2024-01-01', n) as day")
    got = url_lists.judge(captures, events).orderBy("_u").collect()
    assert [(r["_u"], r["_d"], r["_url"], r["_day"], r["c0"], r["blocked"]) for r in got] == [(5, 6, 5, 5, 5, True), (500, 501, 500, 500, 500, False)]


def test_a_capture_far_ahead_repeats_no_interval(spark):
    captures = spark.createDataFrame([("https://a.b/x", "2024-02-01"), ("https://a.b/y", "9999-12-31"), ("https://a.b/z", "0001-01-01")], "url string, d string").selectExpr("url", "cast(d as date) as fetched")
    events = spark.createDataFrame([("a.b", "spam", True, "2024-01-01")], "entry string, category string, listed boolean, d string").selectExpr("entry", "category", "listed", "cast(d as date) as day")
    judged = url_lists.judge(captures, events)
    assert {r["url"][-1]: r["blocked"] for r in judged.collect()} == {"x": True, "y": True, "z": False}


def test_kept_rows_are_one_of_each_class(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(4, base), (2, base.upper()), (2, base.upper()), (3, base + " tail"), (None, base), (9, "other text of its own here"), (9, "other text of its own here"), (None, None), (None, None), (5, " "), (5, " "),
            (None, "no id but words in it"), (None, "no id but words in it")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, _h string, n int")
    got = jaccard_join.keep_one(df)
    assert got.columns == df.columns
    assert key(got.select("doc_id", "text").collect()) == key([(2, base.upper()), (9, "other text of its own here"), (None, None), (None, None), (5, " "), (5, " "), (None, "no id but words in it")])
