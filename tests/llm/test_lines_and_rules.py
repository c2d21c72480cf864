import collections
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, oracles, quality_rules
from tidemark.llm.queries import QUERIES

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_chars=20, min_docs=3):
    held = collections.defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(UP)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < min_docs or doc == max(held[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_line_dedup_as_brute_force(spark, hot, monkeypatch):
    rng = random.Random(7)
    shared = ["A line that many documents share %d" % i for i in range(20)] + ["Ünïcode Zeile mit ÄÖÜ und vielen Wörtern"]
    docs = []
    for i in range(700):
        lines = [rng.choice(shared) for _ in range(rng.randrange(6))] + ["own %d %d" % (i, j) * 3 for j in range(rng.randrange(4))] + ["the one very common line of them all"] * hot * 2
        lines += ["", " \t", "short"][: rng.randrange(4)]
        rng.shuffle(lines)
        docs.append((i, "\n".join(("  " + x.upper() + "\r") if rng.random() < 0.2 and x.isascii() else x for x in lines)))
    docs += [(900, None), (901, ""), (902, "\n\n"), (903, "x" * 20 + "\n" + "x" * 20), (904, "x" * 20), (905, "X" * 20)]
    frame = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, pos int").repartition(5)
    got = line_dedup.dedup_lines(frame).select("doc_id", "__n_lines", "__n_dropped", F.sha2("__kept", 256)).collect()
    assert sorted(map(tuple, got)) == brute(docs)


def test_a_hot_key_in_pieces(spark, monkeypatch):
    line, other = "the one very common line of them all", "a line that one document alone repeats"
    docs = [(i, "\n".join(["own line of document number %d" % i, line] + [line] * (i % 3))) for i in range(1500)]
    docs += [(5000, "\n".join([other] * 1200)), (5001, other), (None, line), (None, other)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert line_dedup._hot_keys(line_dedup.occurrences(frame, "doc_id", "text", 20)).count() == 2
    for pieces in (64, 3):
        monkeypatch.setattr(line_dedup, "PIECES", pieces)
        got = {r.doc_id if r.doc_id is not None else -len(r["text"]): (r["__n_lines"], r["__n_dropped"]) for r in line_dedup.dedup_lines(frame).collect()}
        assert all(got[i] == (2 + i % 3, (1 + i % 3) if i < 1499 else 0) for i in range(1500))
        assert got[5000] == (1200, 1200) and got[5001] == (1, 0) and got[-len(line)] == (1, 1) and got[-len(other)] == (1, 1)


@pytest.mark.parametrize("name", ["__runs", "__doc", "__doc0", "__kept", "__text_key", "__text_key0", "__words", "__lines", "__good", "__at", "__windows", "__sorted", "pos", "line", "hot", "piece"])
def test_clashing_columns(spark, name):
    frame = spark.createDataFrame([(1, "a b c\nd", "own")], f"doc_id long, text string, `{name}` string")
    new = f"in_{name}" if name.startswith("__") else name
    lines, rules = line_dedup.dedup_lines(frame).first(), quality_rules.measure(frame).first()
    assert (lines[new], lines["__kept"]) == ("own", "a b c\nd") and (rules[new], rules["__n_words"]) == ("own", 4)


def test_very_long_text(spark):
    long_ = "\n".join(["a line that comes back again and again"] * 40000)
    frame = spark.createDataFrame([(i, long_) for i in range(3)], "doc_id long, text string")
    assert sorted((r.doc_id, r["__n_dropped"]) for r in line_dedup.dedup_lines(frame).collect()) == [(0, 40000), (1, 40000), (2, 0)]


def test_line_dedup_edges(spark):
    line = "one line of twenty and more characters"
    frame = spark.createDataFrame([(None, line), (1, line), (2, line), (2, line), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r["__kept"]) for r in line_dedup.dedup_lines(frame).collect())
    assert got == [(0, ""), (1, ""), (2, line), (2, line), (3, "")]
    assert line_dedup.dedup_lines(frame.limit(0)).count() == 0


def test_rules_as_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a", "a b", "a a a a a a", "x\n\nx\n x", "é 東京 #*$", "w " * 30000]
    texts += [" ".join(rng.choices("a b c d e f".split(), k=rng.randrange(40))) + rng.choice(["", "\n", "\na b\na b"]) for _ in range(200)]
    frame = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in quality_rules.measure(frame).collect():
        text = r.text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert (r["__n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"]) == want, text[:50]
        assert r["__base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["__kept"] and r["__base_failed"])
    assert quality_rules.measure(frame.limit(0)).count() == 0


def test_bad_lines_go_and_clean_ones_stay(spark):
    good = "This is a sentence of the body, with enough words in it to be worth keeping."
    bad = ["Home | About | Contact | Help", "Copyright (c) 2020. All rights reserved.", "#### ====", "WOW!! YES!! NOW!! BUY!! MORE!!", "***$$$ %%% word"]
    frame = spark.createDataFrame([("\n".join([good] * 1 + bad),), (good,), ("\n".join(bad),)], "text string")
    got = quality_rules.measure(frame, min_words=1).collect()
    assert got[0]["__cleaned"] == good and got[1]["__cleaned"] == good and got[1]["__kept"] and not got[2]["__kept"]


def test_quality_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op8_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert found.where("quality = 0 AND kept").count() == 0
    assert found.where("quality = 1 AND NOT kept AND NOT base_failed").count() == 0


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(oracles.ORACLES[name])
    got = QUERIES[name](spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
