import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.queries import op2_pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base(text):
    out = []
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
    }
    for rank, (kind, (pattern, ok)) in enumerate(rules.items()):
        out += [(m.start(), rank, m.end(), kind, m[0]) for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out)


TRICKY = [
    "", None, "a@b.c+d@e.f", "x@@y.z @a.b .@c.d-e", "a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1..2.3.4.5", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "5 4111111111111111", "+1 (017) 555-7713 +12-+4915112345678. +1", "49927398716 4111 1111  1111 1111", "1 " * 3000, "4111111111111111" * 5, "é@é.fr ü1@x.de 東京 192.168.0.1",
    "a" * 20000 + "@", "9" * 5000, "1." * 4000, "+1-" + "(" * 3000, "12.34.56.78@9.8", "0000 0000 0000 00", "a@b-.c- 1-2-3-4-5-6-7-8-9-0-1-2-3-4",
]


def test_base_spans_as_brute_force(spark):
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choices("ab1029@.+-() \néx", [3, 3, 4, 4, 3, 3, 3, 4, 3, 3, 1, 1, 3, 1, 1, 1], k=rng.randrange(120))) for _ in range(1500)]
    texts += ["".join(rng.choices("4111 -", k=40)) for _ in range(500)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in frame.select("text", pii.base_spans(pii.whole(frame.text)).alias("s")).collect():
        assert [tuple(x) for x in r.s] == base(r.text or ""), r.text


def test_scan_over_many(spark):
    frame = spark.createDataFrame([([i % 7 for i in range(n)],) for n in (0, 1, 255, 256, 257, 2000)], "v array<int>")
    for r in frame.select("v", pii.scan(frame.v, lambda a, b: a + b).alias("s")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]


def shape(w):
    if len(w) >= 16 and any(c.isalpha() for c in w) and any(not c.isalpha() for c in w):
        return f"#{'x' if re.fullmatch('[0-9a-f]+|[0-9A-F]+', w) else 'w'}{min(64, len(w) // 8 * 8)}"
    return None


def brute(docs, context=80, doubt=2, generalise=0.85):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    terms_of = lambda t: {low(w) for w in re.findall(r"[^\W_]+", t)} | {shape(w) for w in re.findall(r"[^\W_]+", t)} - {None}
    cue = re.compile(r"""(?i)(?<![A-Za-z0-9])(token|secret|password|passwd|pwd|credentials?|(api|access|private)[ _-]?key)["']?[ \t]{0,2}[:=]""")
    n_e, ctx, n_te, n_t = {}, {}, {}, {}
    for i, (_, text) in enumerate(docs):
        text = text or ""
        for t in terms_of(text):
            n_t[t] = n_t.get(t, 0) + 1
        spans = base(text) + [(m.start(), 5, m.end(), "secret", m[0]) for m in cue.finditer(text)]
        for start, _, end, kind, value in spans:
            e = (kind, "" if kind == "secret" else value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value))
            before, after = "" if kind == "secret" else text[max(0, start - context) : start], text[end : end + context]
            cut = lambda at: 0 <= at < len(text) and re.match(r"[^\W_]", text[at])
            left = re.sub(r"^[^\W_]+", "", before) if cut(start - context - 1) else before
            right = re.sub(r"[^\W_]+$", "", after) if cut(end + context) else after
            near = terms_of(left + " " + right)
            if near:
                n_e.setdefault(e, set()).add(i)
            for t in near:
                ctx.setdefault((t, e), set()).add((before, after))
                n_te.setdefault((t, e), set()).add(i)
    bad = set()
    for (t, e), c in ctx.items():
        ne, te = len(n_e[e]), len(n_te[t, e])
        if ne < len(docs) and 2 * te > n_t[t] and math.log(te * len(docs) / (n_t[t] * ne) * len(c) / (len(c) + doubt)) / math.log(len(docs) / ne) >= generalise:
            bad.add(t)
    out = {}
    for doc, text in docs:
        spans = base(text or "")
        for m in re.finditer(r"[^\W_]+", text or ""):
            if (low(m[0]) in bad or shape(m[0]) in bad) and not any(m.start() < s[2] and s[0] < m.end() for s in base(text)):
                spans.append((m.start(), 4, m.end(), "term", m[0]))
        out[doc] = sorted(spans)
    return out, bad


def test_terms_that_give_entities_away(spark):
    rng = random.Random(2)
    words = [f"wor{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, say(60)) for i in range(200)]
    docs += [(1000 + i, f"{say(30)} Zanzibar {say(3)} ann.lee@mail.example.com {say(3)} common {say(20)}") for i in range(6)]
    docs += [(2000 + i, f"{say(10)} common {say(30)}") for i in range(40)]
    docs += [(3000 + i, f"copied passage nearby Unfamiliar bob@x.org {words[0]}") for i in range(10)]  # copies are one context
    docs += [(4000, f"{say(5)} zanzibar {say(5)}")]
    want, bad = brute(docs)
    assert "zanzibar" in bad and "common" not in bad and "unfamiliar" not in bad
    frame = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, terms string")
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    assert {d: [tuple(s) for s in r["__spans"]] for d, r in got.items()} == want
    clean = got[1000]["__sanitised"]
    assert "Zanzibar" not in clean and "@" not in clean and "[EMAIL]" in clean and "common" in clean
    assert got[5]["__sanitised"] == docs[5][1] and got[5].terms == "z"


def test_secrets_by_their_shape(spark):
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choices("0123456789abcdef", k=n - 2)) + "a1"
    docs = [(i, f"plain words of text number {i} and more") for i in range(300)]
    docs += [(1000 + i, f'config {rng.choice(["api_key", "token", "Secret"])} = "{digits(40)}" and') for i in range(12)]
    docs += [(2000 + i, f"order {digits(24)} was sent to us") for i in range(30)]  # another shape, of no credential
    want, bad = brute(docs)
    assert "#x40" in bad and "#x24" not in bad
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: [tuple(s) for s in r["__spans"]] for d, r in got.items()} == want
    assert all(re.fullmatch(r'config \S+ = "\[SECRET\]" and', got[1000 + i]["__sanitised"]) for i in range(12)) and got[2000]["__sanitised"] == docs[-30][1]


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "x@y.zz")], "doc_id long, text string")
    for name in ("__base", "__spans", "__sanitised", "__text", "__id", "__hash", "__doc", "__key", "__terms", "__names", "__until", "spans", "e", "term"):
        got = pii.find(frame.withColumn(name, F.lit("own"))).first()
        assert got["__sanitised"] == "[EMAIL]" and got[f"in_{name}" if name.startswith("__") else name] == "own"


def test_edges(spark):
    frame = spark.createDataFrame([(None, "x@y.zz"), (None, "x@y.zz"), (1, None), (2, "")], "doc_id long, text string")
    got = [(r.doc_id, pii_text) for r in pii.find(frame).collect() for pii_text in [r["__sanitised"]]]
    assert sorted(got, key=str) == [(1, ""), (2, ""), (None, "[EMAIL]"), (None, "[EMAIL]")]
    assert pii.find(frame.limit(0)).count() == 0


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, _ = brute(docs)
    line = lambda spans: ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
    for r in op2_pii(spark, sf).collect():
        own = base(dict(docs)[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in own) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(line(own).encode()).hexdigest() and r.spans == line(want[r.doc_id]) and r.n_spans == len(want[r.doc_id])


def test_terms_of_rare_entities(spark):
    docs = [(i, f"plain text number {i} says little, call again") for i in range(4000)]
    docs += [(5000, "a letter from Kowalski reaches jan@x.pl today"), (5001, "call Brzeski under +48 (017) 555-7713 now"), (5002, "call or write Brzeski, says +48 (017) 555-7713 again")]
    docs += [(6000 + i, "one passage tells Copernik under 10.0.0.9 again") for i in range(100)]  # copies are one context
    got = {r.doc_id: r["__sanitised"] for r in pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert "Kowalski" not in got[5000] and "Brzeski" not in got[5001] + got[5002] and "call" in got[5001]
    assert "Copernik" in got[6000] and got[7] == docs[7][1]


def test_words_at_the_edge_of_the_window(spark):
    docs = [(i, f"plain text number {i} says little") for i in range(4000)]
    docs += [(5000, "Kowalski, jan@x.pl wrote"), (5001, "wrote to eva@x.pl Brzeski"), (5002, "Copernik " + "x " * 34 + "1 nik@x.pl")]
    docs += [(5003, "plain " + "Galilei " + "1" * 71 + " gal@x.pl " + "2" * 71 + " Torricelli plain"), (5004, "Abcdefghij" + "1" * 75 + " abc@x.pl " + "2" * 75 + " Klmnopqrst")]
    hits, terms = pii.disclosing_terms(spark.createDataFrame(docs, "doc_id long, text string"))
    found = {r.term for r in terms.collect()}
    assert {"kowalski", "brzeski", "copernik", "galilei"} <= found
    assert not {t for t in found if len(t) > 3 and ("abcdefghij".endswith(t) or "klmnopqrst".startswith(t) or "torricelli".startswith(t))}
