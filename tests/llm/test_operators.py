"""Corpus operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tabsight.check import compare, connect
from tabsight.llm import (decontamination, jaccard_join, licences, mixing, pieces, quality, text_arrays, token_counts, token_files, topk, toxicity, url_lists)
from tabsight.llm.queries import ORACLES, QUERIES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string, score double, n long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every difficulty at once; the extra columns have names that operators use themselves."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeé ñ") for _ in range(4)).strip() or "x" for _ in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = text(30_000)
    base = text(80)
    texts = [None, "", "   \n\t", "one", "A b\tC\n", long, long + " end", base, base, base + " tail", base.replace(" ", "  ").upper(), text(5), "a<|endoftext|> b",
             "x" * 5000, " nbsp  wide", *[text(rng.randint(1, 200)) for _ in range(25)]]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "clash", 0.5, 7) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, None, None, None, None, None, None, None), (None, base, None, None, 1, None, None, None), (3, "same id, other text", None, "s1", 1, None, None, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, sf, name):
    assert compare(spark, connect(sf), sf, QUERIES[name], ORACLES[name]) == ""


# 1

def overlaps(doc, item):
    split = lambda t: [w for w in re.split("[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t)) if w]
    d, t = split(doc), split(item)
    n = len(t)
    length = min(n, decontamination.STRETCH)
    need = length - decontamination.allowed(n)
    found = []
    for shift in range(-n, len(d)):
        eq = [0 <= shift + j < len(d) and d[shift + j] == t[j] for j in range(n)]
        inside = [0 <= shift + j < len(d) for j in range(n)]
        for a in range(n - length + 1):
            if all(inside[a:a + length]) and sum(eq[a:a + length]) >= need and n >= decontamination.LEAST_WORDS:
                found.append((shift, shift + a, sum(eq)))
                break
    return found


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    item_words = [f"w{i}" for i in range(200)]
    items = [" ".join(rng.choice(item_words) for _ in range(n)) for n in (6, 8, 11, 13, 20, 40)] + [None, ""]
    docs = [None, ""]
    for item in items[:6]:
        w = item.split()
        docs.append(" ".join(["pad"] * 7 + w + ["tail"]))
        changed = list(w)
        for i in range(3, len(w), 8):
            changed[i] = "other"
        docs.append("Start, " + ", ".join(changed).upper() + ".")
        docs.append(" ".join(w[: len(w) // 2]))
        docs.append(" ".join(w[5:]) + " " + " ".join(["z"] * 30))
    docs += [" ".join(rng.choice(item_words) for _ in range(300)) for _ in range(5)]
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, items[4])], "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)) + [(None, docs[15])], "doc_id long, text string")
    got = {(r[0], r[1]): (r["first_word"], r["matched"], r["n_places"]) for r in decontamination.contaminated(table, bench).collect()}
    want = {}
    for (d, text), (i, item) in itertools.product([*enumerate(docs), (None, docs[15])], enumerate(items)):
        if text and item and (f := overlaps(text, item)):
            want[d, i] = (min(x[1] for x in f), max(x[2] for x in f), len(f))
    assert got == want and len(want) > 12


def test_decontamination_edges(spark, odd, none):
    bench = spark.createDataFrame([(1, odd.where("doc_id = 7").first()["text"])], "item_id long, text string")
    found = {r[0] for r in decontamination.contaminated(odd, bench).collect()}
    assert {7, 8, 9, None} <= found
    kept = decontamination.clean(odd, bench)
    assert kept.columns == odd.columns and not {r[0] for r in kept.collect()} & found
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0


def test_clean_rows_keeps_other_texts_of_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(None, "clean one"), (None, "x " + passage), (None, None), (5, passage + " y"), (5, "clean two"), (6, "clean three"), (7, passage), (7, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    kept = decontamination.clean_rows(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))
    assert kept.columns == docs.columns and key(r[:2] for r in kept.collect()) == key([(None, "clean one"), (None, None), (5, "clean two"), (6, "clean three")])


def test_masks_find_two_replaced_words():
    for lost in itertools.combinations(range(13), 2):
        assert any(all(o + p not in lost for p in m) for m in decontamination.MASKS for o in range(13 - m[-1]))


# 2

def test_url_intervals_and_keys(spark):
    events = spark.createDataFrame([("bad.org", "x", True, "2024-01-10"), ("bad.org", "x", False, "2024-03-01"), ("bad.org", "y", True, "2024-05-01"),
                                    ("bad.org", "z", False, "2024-05-01"), ("ok.net/a", "p", True, "2024-02-01"), (None, "x", True, "2024-01-01"), ("n.org", None, None, "2024-01-01")],
                                   "entry string, category string, listed boolean, day string").withColumn("day", F.to_date("day"))
    rows = [(1, "http://WWW.bad.org/q?x", "2024-01-10"), (2, "http://bad.org", "2024-01-09"), (3, "http://bad.org", "2024-02-29"), (4, "http://bad.org", "2024-03-01"),
            (5, "http://bad.org", "2024-06-01"), (6, "https://u:p@ok.net:8080/a/b", "2025-06-01"), (7, "https://ok.net/ab", "2025-06-01"), (8, None, "2024-02-02"),
            (9, "no url", "2024-02-02"), (10, "http://bad.org", None), (3, "http://bad.org", "2024-02-29")]
    captures = spark.createDataFrame(rows, "id long, url string, fetched string").withColumn("fetched", F.to_date("fetched")).withColumn("entry", F.lit("clash"))
    got = key((r["id"], r["blocked"], r["entry"], r["n_entries"]) for r in url_lists.judge(captures, events).collect())
    assert got == key([(1, True, "bad.org", 1), (2, False, None, 0), (3, True, "bad.org", 1), (3, True, "bad.org", 1), (4, False, None, 0), (5, False, None, 0),
                       (6, True, "ok.net/a", 1), (7, False, None, 0), (8, False, None, 0), (9, False, None, 0), (10, None, None, 0)])
    assert url_lists.judge(captures.limit(0), events).count() == 0
    assert url_lists.judge(captures, events.limit(0)).where("blocked").count() == 0


# 3

def test_mix(odd, none):
    got = mixing.mix_report(odd, fan_in=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_report(odd.repartition(7), fan_in=4).collect()), key=str)
    rows = odd.collect()
    assert len(got) == len(rows)
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r["doc_id"], len(words(r["text"]))) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, full = {}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s, v in share.items() if v > 2 * sizes[s]}
        if not over:
            break
        full |= over
    want = {sizes[s]: (2 * sizes[s] if s in full else share[s]) for s in order}
    assert all(abs(r["target"] - want[r["source_size"]]) < 1e-6 * want[r["source_size"]] for r in got)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    for size, target in want.items():
        own = [r for r in got if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) / 2 + 1
    assert mixing.mix_report(none).count() == 0
    mixed = mixing.mix(odd, fan_in=4)
    assert mixed.columns == odd.columns and mixing.mix(none).count() == 0
    taken = sum(len(words(r["text"])) for r in mixed.collect())
    assert abs(taken - sum(want.values())) < 60_000


# 4

def test_licences_by_hand(spark, odd, none):
    texts = ["Released under the MIT License. Under the MIT license!", "apache\nlicense, version 2.0", "CC-BY-NC 4.0", "a licence of mit", None, "",
             "x " * 5000 + "Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "cc by nc " * 300]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, r int, n_words int")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert [got[i]["labels"] for i in range(8)] == ["mit", "apache-2", "cc-by-nc", "", "", "", "bsd", "cc-by-nc"]
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"]) == (2, 1, 5) and got[7]["n_base"] == 300
    assert got[6]["n_base"] == 0 and got[6]["first_word"] is None and 0.5 < got[6]["score"] < 1 and got[6]["places"][0]["word"] == 5000
    assert got[4]["n_words"] == 0 and got[4]["score"] == 0
    assert licences.scan(none).count() == 0 and licences.scan(odd).count() == odd.count()


def test_files_with_several_licences(spark):
    """Each licence is found whatever else the file holds, as a plain search for the mandatory phrases finds it."""
    mit, bsd, gpl3, gpl2 = (next(" ".join(t.words) for t in licences.TEMPLATES if t.label == x and len(t.words) > 10) for x in ("mit", "bsd", "gpl-3", "gpl-2"))
    rare = " ".join(w for t in licences.TEMPLATES for w in dict.fromkeys(t.words) if w not in ("the", "mit", "bsd", "gnu"))
    texts = [mit + " x " + gpl3, bsd + " x " + gpl3, f"{mit} x {bsd} x {gpl3}", rare + " x " + gpl3, f"{gpl2} x {gpl3}", mit, bsd, gpl3]
    texts += [t for t in (mit, bsd, gpl3) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licences.scan(df).collect()}
    assert [got[i] for i in range(3)] == ["gpl-3,mit", "bsd,gpl-3", "bsd,gpl-3,mit"]
    assert "gpl-3" in got[3].split(",") and got[4] == "gpl-2,gpl-3" and [got[i] for i in range(5, 8)] == ["mit", "bsd", "gpl-3"]
    free = (licences.Template("x", ("a", "b", "c", "d", "e", "f"), ()),)  # without mandatory phrases: any half of the words
    some = [" ".join(x if i in c else "z" for i, x in enumerate("abcdef")) for c in itertools.combinations(range(6), 3)] + ["a b z z z z"]
    rows = licences.scan(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), phrases={"y y": "y"}, templates=free).collect()
    assert {r["doc_id"] for r in rows if r["labels"] == "x"} == set(range(20))


def test_short_notices(spark):
    texts = {"This work is licensed under the GNU General Public License, version 3.": "gpl-3", "licensed under the GNU General Public License version 2 only": "gpl-2",
             "Licensed under the GNU GPL v3": "gpl-3", "licensed under the BSD 3-Clause License": "bsd", "Licensed under the Mozilla Public License, version 2.0": "mpl-2",
             "licensed under CC BY-SA 4.0": "cc-by-sa", "licensed under CC BY 4.0": "cc-by", "licensed under CC BY-NC 4.0": "cc-by-nc",
             "the GNU General Public License, version 1": "", "a licence version 3 of it": ""}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert [got[i]["labels"] for i in range(len(texts))] == list(texts.values()) and got[0]["score"] == 1


def test_whole_licences_and_sql(spark):
    """Whole texts, several to a file, cut ones and repeated rare words: as the SQL finds them, which knows no index."""
    parts = [" ".join(t.words) for t in licences.ALL]
    texts = [*parts, *(f"{a} x {b} y {c}" for a, b, c in zip(parts, parts[7:] + parts[:7], parts[17:] + parts[:17])), " ".join(reversed(parts)), parts[-6][200:],
             parts[-6][:300], parts[-6][:len(parts[-6]) // 2], None, "", "merchantability noninfringement sublicense " * 50 + parts[-6], "the software " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    for i, t in enumerate(licences.ALL):
        assert t.label in got[i]["labels"].split(",") and got[i]["score"] == 1, t.label
        assert all(x.label in got[len(parts) + i]["labels"].split(",") for x in (t, licences.ALL[(i + 7) % len(parts)], licences.ALL[(i + 17) % len(parts)]))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    cur = con.execute(licences.oracle_sql())
    names = [c[0] for c in cur.description]
    want = {r["doc_id"]: r for r in (dict(zip(names, row)) for row in cur.fetchall())}
    assert want == {i: {c: r[c] for c in names} for i, r in got.items()}


# 5 and 7

@pytest.mark.parametrize("name,label,least", [("op5_quality_nbsvm", "quality", 0.95), ("op7_toxic_spans", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    own = [r for r in rows if r["held_out"]]
    assert len(own) > 40 and sum(r["predicted"] == r[label] for r in own) / len(own) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_edges(spark, odd, none, module):
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.digest(odd, marks).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert module.digest(none, marks).count() == 0
    assert {r["score"] for r in module.digest(odd, marks.limit(0)).collect()} == {0.5}


def test_toxic_spans_are_offsets(spark):
    rng = random.Random(1)
    plain = ["the", "of", "café", "and", "light", "road", "water"]
    rows = []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = "Dreadfulx" + rng.choice("abc")
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    for r in toxicity.tag(df, model).join(df, "doc_id").collect():
        assert {r["text"][s["first"]:s["end"]][:9] for s in r["spans"]} == ({"Dreadfulx"} if r["toxic"] else set())
        assert (r["score"] > 0.5) == bool(r["toxic"])


def test_lexicon_keeps_rare_evidence_among_many_documents(spark):
    """A word of four toxic documents and of no other counts, however many toxic documents there are."""
    import pyarrow as pa
    rows = [(f"plain{i % 50} words" + (" slurword" if i in (1, 3, 5, 7) else "") + (" evenword" if i % 100 < 2 else ""), i % 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "_text string, _label int")
    lexicon = toxicity.build_lexicon(df, np.array([3000.0, 3000.0]))
    h = text_arrays.word_beginnings(pa.array(["slurword evenword"]), text_arrays.TOKENS, toxicity.BEGINNINGS)[0][:, 0]
    at, row = lexicon.find(h)
    assert at.tolist() == [0] and (lexicon.t[row[0]], lexicon.n[row[0]]) == (4, 0)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(2)
    counts = np.array([4, 0, 1, 3])
    e, trans = rng.normal(size=8), rng.normal(size=4)
    _, f, b = toxicity.Lattice(counts).marginals(e, trans)
    p, at = f * b / (1 + f * b), 0
    for n in counts:
        total, hit = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=int(n)):
            s = sum(e[at + i] for i in range(n) if y[i]) + (trans[0] if n and y[0] else 0)
            s += sum({(0, 0): 0, (0, 1): trans[1], (1, 0): trans[2], (1, 1): trans[3]}[pair] for pair in zip(y, y[1:]))
            total += np.exp(s)
            hit += np.exp(s) * np.array(y)
        assert np.allclose(p[at:at + n], hit / total)
        at += n


# 6

def brute_components(rows):
    """(n_shingles, component) by row number; equal ids with different texts are different nodes."""
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
            parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    line = [rng.choice(vocabulary) for _ in range(25)]
    out = []
    for n in (1, 4, 5, 6, 9, 14, 31, 33, 64, 70, 130, 400):
        base = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                w[rng.randrange(n)] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                w = w[:rng.randint(max(1, int(n * 0.75)), n)]
            if rng.random() < 0.3 and n > 60:
                w += line
            out.append(" ".join(w))
    out += [" ".join(line + [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]) for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("keys_each,block", [(jaccard_join.KEYS_EACH, None), (40, 8)])
def test_components_match_brute_force(spark, monkeypatch, keys_each, block):
    """With few keys a task and blocks of a few members the ways meant for very large lists are taken."""
    if block:
        monkeypatch.setattr(jaccard_join, "CHUNK", block)
        monkeypatch.setattr(jaccard_join, "SHORT_LIST", block // 2)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert key(jaccard_join.components(df, keys_each=keys_each).collect()) == key(brute_components(rows))


@pytest.mark.parametrize("block", [None, 5])
def test_every_link_is_made(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rows = near_copies()[:150]
    rows += [(None, rows[0][1]), (900, None), (901, ""), rows[3], (rows[4][0], rows[5][1])]
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(lower(t))) else frozenset() for _, t in rows]
    near = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if near(i, j)]
    degree = collections.Counter(x for p in pairs for x in p)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(*c, degree[i]) for i, c in enumerate(brute_components(rows))]
    assert max(degree.values()) > 5 and key(jaccard_join.components_and_links(df).collect()) == key(want)
    if block:
        member, made = jaccard_join.links(df)
        copies, made = collections.Counter(r["set_id"] for r in member.collect() if r["set_id"] is not None), made.collect()
        assert len(set(made)) == len(made) and all(r["a"] < r["b"] for r in made)
        assert sum(copies[r["a"]] * copies[r["b"]] for r in made) + sum(n * (n - 1) // 2 for n in copies.values()) == len(pairs)


def test_open_lists_are_made_once(spark, monkeypatch):
    """What is left of the lists is a table of its own in every round; joined anew, each round would make all rows of the rounds before again."""
    joined, propose = [], jaccard_join._proposals

    def watched(lists, nodes, tries):
        joined.append("Join" in lists._jdf.queryExecution().optimizedPlan().toString())
        return propose(lists, nodes, tries)

    monkeypatch.setattr(jaccard_join, "_proposals", watched)
    monkeypatch.setattr(jaccard_join, "SHORT_LIST", 4)
    rows = near_copies()[:80]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert key(jaccard_join.components(df).collect()) == key(brute_components(rows))
    assert len(joined) > 1 and not any(joined[1:])


def test_members_outside_the_largest_class_look_for_partners():
    """Every pair of two classes has an end outside the largest; refused partners stay with their member."""
    import pyarrow as pa
    bits = jaccard_join.parity_bits(np.arange(1, 100, dtype=np.uint64)).tobytes()
    members = [{"node": i, "root": r, "n": 99, "bits": bits, "refused": no} for i, r, no in ((1, 1, [3]), (2, 2, []), (3, 1, [9]), (4, 1, None), (5, 5, [1, 2]))]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("refused", pa.list_(pa.int64()))]))
    _, side, single = jaccard_join._sides(pa.array([members[2:], members, members[:2]], kind))
    out = side.outside()
    assert out.node.tolist() == [2, 5] and out.refused.tolist() == [1, 2] and out.refused_bounds.tolist() == [0, 0, 2]
    a, b, _, more = jaccard_join._closest(out, side, 9)
    assert set(zip(a.tolist(), b.tolist())) == {(1, 2), (2, 3), (2, 4), (2, 5), (3, 5), (4, 5)} and not more
    assert single.outside() is single


def test_closest_members_of_lists():
    """Lists as flat arrays against brute force: bits of two sizes, classes, refused pairs, and word of what is left out."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 120).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[i:], rng.integers(0, 2**63, i).astype(np.uint64)))) for i in (0, 2, 4, 6, 90)] + [np.unique(np.concatenate((base, base[:9] + np.uint64(1))))]
    members = [{"node": 10 - i, "root": 1 if i in (0, 1) else 50 + i, "n": len(s), "bits": jaccard_join.parity_bits(s).tobytes(), "refused": [8] if i == 0 else []} for i, s in enumerate(sets)]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("refused", pa.list_(pa.int64()))]))
    lists = [s for s in jaccard_join._sides(pa.array([members[:1], None, members], kind))]
    assert lists[1] is None and lists[0].node.tolist() == [10] and len({len(m["bits"]) for m in members}) == 2
    apart = {}
    for x, y in itertools.permutations(members, 2):
        bits = [np.frombuffer(m["bits"], "<u8") for m in (x, y)]
        k = min(map(len, bits))
        d = int(np.bitwise_count(jaccard_join.fold_bits(bits[0], k) ^ jaccard_join.fold_bits(bits[1], k)).sum())
        if x["root"] != y["root"] and y["node"] not in x["refused"] and 100 * min(x["n"], y["n"]) >= 80 * max(x["n"], y["n"]) and d <= jaccard_join.most_differences(x["n"], y["n"]):
            apart.setdefault(x["node"], []).append((d, *sorted((x["node"], y["node"]))))
    assert max(map(len, apart.values())) > 2
    for tries in (1, 2, 9):
        a, b, d, more = jaccard_join._closest(lists[2], None, tries)
        assert more == any(len(v) > tries for v in apart.values())
        got = set(zip(d.tolist(), a.tolist(), b.tolist()))
        assert got <= {p for v in apart.values() for p in v} and {min(v)[0] for v in apart.values()} <= {p[0] for p in got}
        assert tries < 9 or got == {p for v in apart.values() for p in v}


def test_components_edges(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert key(jaccard_join.components(odd).collect()) == key(brute_components(rows))
    assert jaccard_join.components(none).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and jaccard_join.keep_one(none).count() == 0
    want = {c for _, n, c in brute_components(rows) if n}
    got = [r["doc_id"] for r in kept.collect() if words(r["text"])]
    assert len(got) >= len(want) and want <= set(got)
    assert sum(not words(r["text"]) for r in kept.collect()) == sum(not words(t) for _, t in rows)


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(1)
    for n in [*range(1, 80), 150, 255, 256, 257, 1000]:
        s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for _ in range(6):
            d = jaccard_join.most_differences(n, n)
            lose = int(rng.integers(0, d // 2 + 1))
            t = np.unique(np.concatenate((s[lose:], rng.integers(0, 2**63, int(rng.integers(0, d // 2 + 1)), dtype=np.uint64))))
            common = len(np.intersect1d(s, t))
            if 100 * common < 80 * (len(s) + len(t) - common):
                continue
            costly = np.sort(rng.choice(jaccard_join.index_keys(s), max(1, len(s) // 8)))
            for frequent in (jaccard_join.NONE, costly, np.sort(jaccard_join.index_keys(s))):
                assert len(np.intersect1d(jaccard_join.index_keys(s, frequent), jaccard_join.index_keys(t, frequent)))


# 8 and 10

def test_tokens_round_trip(odd, none, tokenizer):
    rows = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    files = token_files.write_token_files(odd, VOCABULARY)
    got = token_files.read_token_files(files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == collections.Counter((d, ids(t)) for d, t in rows)
    some = token_files.read_token_files(files, [5, 9]).collect()
    assert sorted(r["doc_id"] for r in some) == [5, 9] and {bytes(r["ids"]) for r in some} == {ids(t) for d, t in rows if d in (5, 9)}
    assert token_files.token_digest(none, VOCABULARY).count() == 0


def test_damaged_frame_is_found(tmp_path):
    w = token_files.FrameWriter(f"{tmp_path}/a.zst")
    for i in range(5):
        w.add(i, np.arange(40_000, dtype="<u4").tobytes())
    w.close()
    assert [d for d, _, _ in token_files.read_file(f"{tmp_path}/a.zst")] == [0, 1, 2, 3, 4]
    import zstandard
    raw = (tmp_path / "a.zst").read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert np.array_equal(np.frombuffer(plain, "<u4"), np.tile(np.arange(40_000), 5))
    (tmp_path / "a.zst").write_bytes(raw[:20] + bytes([raw[20] ^ 1]) + raw[21:])
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(token_files.read_file(f"{tmp_path}/a.zst"))


def test_counts_match_the_library(odd, none, tokenizer):
    got = collections.Counter(map(tuple, token_counts.count_tokens(odd, VOCABULARY).collect()))
    want = collections.Counter()
    for r in odd.collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        want[r["doc_id"], len((r["text"] or "").encode()), n, n > 1024] += 1
    assert got == want and token_counts.count_tokens(none, VOCABULARY).count() == 0


def test_random_texts_tokenize_alike(tokenizer):
    rng = random.Random(1)
    letters = "ab the 's'S\n\t  \xa0\x1c\x85éßñ中文123٣!!??​Ａ👍\r.-_ "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["aaaa" * 500, "ab" * 900, "<|endoftext|>x<|endoftext|> ", " ", None]
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert token_counts.text_counts(texts, VOCABULARY) == [len(w) for w in want]
    assert [np.frombuffer(b, "<u4").tolist() for b in token_files.encode_texts(texts, VOCABULARY)] == want
    assert all("".join(pieces.PIECES.findall(t)) == t for t in texts if t)


# 9

def test_topk_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5).round(1)]) for i in range(130)]
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (None, [1.0]), (300, []), (301, [0.5]), (5, rows[5][1]), (302, [1e30, -1e30, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit(1))
    got = topk.top_k(df, F.col("_id") % 100 == 0, k=10).collect()
    good = {i: [max(-2**63, min(2**63 - 1, int(np.floor(1024 * x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 100 == 0):
        scores = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(good[q], v)))), i) for i, v in good.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:10])]
    assert key(got) == key(want)
    assert topk.top_k(df.limit(0), F.col("_id") % 100 == 0).count() == 0


def test_topk_stops_early():
    rng = np.random.default_rng(1)
    cells = rng.integers(-50, 50, (4000, 8))
    cells[:20] += 400
    lists = topk.SortedLists(np.arange(4000), cells)
    ids, scores = lists.top(-1, np.full(8, 3), 10, -np.inf)
    assert len(ids) < 40 and set(np.argsort(-(cells @ np.full(8, 3)), kind="stable")[:10]) <= set(ids)


def test_topk_reads_for_all_queries_of_a_block():
    rng = np.random.default_rng(2)
    cells = rng.integers(-1000, 1000, (3000, 16))
    cells[1000:1200] = cells[7]  # ties beyond k
    queries = np.concatenate((rng.integers(-1000, 1000, (60, 16)), np.zeros((1, 16), np.int64), rng.integers(-2**61, 2**61, (2, 16)), cells[7:8]))
    query_ids = np.arange(len(queries)) * 40
    floors = np.full(len(queries), -np.inf)
    floors[3] = np.sort(cells @ queries[3])[-4]
    lists = topk.SortedLists(np.arange(3000), cells)
    for i, (ids, scores) in enumerate(lists.tops(query_ids, queries, 10, floors)):
        real = {j: max(-2**63, min(2**63 - 1, int(s))) for j, s in enumerate(cells.astype(object) @ queries[i].astype(object)) if j != query_ids[i]}
        want = sorted(real, key=lambda j: (-real[j], j))[:4 if i == 3 else 10]
        assert set(want) <= set(ids.tolist()) and all(real[j] == s for j, s in zip(ids.tolist(), scores.tolist()))


# shared

def test_word_hashes(spark):
    import pyarrow as pa
    texts = [None, "", " a  B\tb ", "x" * 3_000_000 + " y", "é É", "  "]
    h, counts = text_arrays.word_hashes(pa.array(texts))
    assert counts.tolist() == [0, 0, 3, 2, 2, 0] and h[1] == h[2] and h[5] != h[6] and len(set(h.tolist())) == 6


def test_few_kept_pieces_give_the_same_ids(tokenizer):
    rng = random.Random(8)
    texts = [None, ""] + [" ".join(str(rng.randint(0, 300)) for _ in range(60)) for _ in range(40)]
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [x for t in texts for x in token_files.encode_texts(iter([t]), VOCABULARY, 20)] == want
    cache = pieces.PieceCache(lambda new: new, 20)
    for i in range(0, 200, 4):
        assert cache.values([[str(j) for j in range(i, i + 4)]]) == [[str(j) for j in range(i, i + 4)]]
        assert len(cache) + len(cache.older) <= 28
