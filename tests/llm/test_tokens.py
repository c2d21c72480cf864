import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import Row
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "\n\n  a", "don't  stop's", "x" * 700, "ab" * 4000, "1234567 89", "naïve — “q” 東京 ՘࢏ \U000107bb1", "<|endoftext|> a", "\t\t b c", "a  b", "é" * 300, "!?" * 300]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_what_the_library_gives():
    enc, mine, rng = reference(), bpe.Bpe(RANKS), random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab e'sd1 \n.éß東") for _ in range(rng.randrange(400))) for _ in range(300)]
    for text in texts:
        ids = mine.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text), text[:50]
        assert mine.decode(ids) == text.encode()


def test_one_row_and_matrix_agree():
    mine, rng = bpe.Bpe(RANKS), random.Random(4)
    for k in range(300):
        raw = bytes(rng.choice(b"abcdeth \xc3\xa9" if k % 2 else b"aab") for _ in range(rng.randrange(2, 200)))
        out = [b""]
        mine._matrix([raw], np.array([0]), 256, out)
        assert out[0] == mine._row(raw)


def test_long_pieces():
    enc, mine, rng = reference(), bpe.Bpe(RANKS), random.Random(6)
    for text in ("a" * 5000, "ab" * 3000, "".join(rng.choices("abcdefgh\u00e9", k=4000)), "=" * 3001, "".join(rng.choices("etaoinshrd", k=20000))):
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == enc.encode_ordinary(text)


def test_encode_documents(spark):
    docs = spark.createDataFrame([Row(doc_id=i, text=t, note=i) for i, t in enumerate(ODD)], "doc_id long, text string, note int")
    enc = reference()
    for r in bpe.encode_documents(docs, RANKS).collect():
        ids = np.array(enc.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert bytes(r.bpe_ids) == ids and r.bpe_n_tokens == len(ids) // 4
        assert r.bpe_ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert r.bpe_decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), RANKS).count() == 0
    clash = bpe.encode_documents(docs.withColumnRenamed("note", "bpe_ids"), RANKS).where("doc_id = 3").first()
    assert clash.in_bpe_ids == 3 and clash.bpe_n_tokens == len(enc.encode_ordinary(ODD[3]))


def check_packing(rows, docs, capacity=1024):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(docs)
    for doc, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == capacity for r in own[1:]) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins), sum(r.length for r in rows)


def test_pack_documents(spark):
    rng = random.Random(5)
    docs = list(enumerate(ODD)) + [(100 + i, "word " * rng.randrange(1, 3000)) for i in range(120)]
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), P.path("byte_bpe_50k.json")).collect()
    n, total = check_packing(rows, docs)
    assert n <= -(-total // 1024) + 1
    odd = spark.createDataFrame([(None, "a b", 1, "x"), (1, "word " * 90, 2, "y"), (1, "word " * 90, 2, "y")], "doc_id long, text string, piece int, length string")
    own = packing.pack_documents(odd, P.path("byte_bpe_50k.json")).collect()
    assert len(own) == 3 and sum(r.doc_id is None for r in own) == 1
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json")).count() == 0


def test_groups_are_packed_again(spark):
    pieces = spark.createDataFrame([(i, 1 + i * 37 % 900, i * 7919 % 10007) for i in range(600)], "doc_id long, length long, deal long")
    rows = packing.pack_pieces(pieces, 1000, group=100).collect()
    assert sorted(r.doc_id for r in rows) == list(range(600))
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    together = packing.pack([1 + i * 37 % 900 for i in range(600)], 1000)
    assert max(fill.values()) <= 1000 and len(fill) <= 1.06 * len(together)


def test_search_empties_bins_that_best_fit_leaves():
    lengths = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    start = packing.best_fit(lengths, 60)
    end = packing.local_search([list(b) for b in start], lengths, 60)
    assert sorted(i for b in end for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 60 for b in end) and len(end) <= len(start)
    square = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    assert square(end) >= square(start)
    many = [1] * 40 + [2] * 11 + [30, 29]
    start = [list(range(40)) + [51], list(range(40, 51)) + [52]]  # 70 and 51 of 90: pieces by the dozen take part as well
    end = packing.local_search(start, many, 90)
    assert sorted(sum(many[i] for i in b) for b in end) == [31, 90] and sorted(i for b in end for i in b) == list(range(53))
    apart = [[0], [1], [2]]
    assert len(packing.local_search(apart, [5, 3, 2], 10)) == 1


def test_workers_give_memory_back(spark):
    """What one task of encoding or decoding took is not with the worker when the next begins."""
    import pyarrow as pa

    from tidemark.llm import common

    def taken(kilobytes):
        def run(batches):
            for batch in batches:
                held = [bytes(2000 + i % 7) for i in range(kilobytes // 2)]
                last = held[-1]  # between what is freed and the heap's end
                yield pa.RecordBatch.from_arrays([pa.array([len(held)])], names=["n"])
                del held
            keep.append(last)

        return run

    def resident():
        with open("/proc/self/smaps_rollup") as f:
            return next(int(line.split()[1]) for line in f if line.startswith("Anonymous:"))

    keep = []
    one = [pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])]
    before = resident()
    list(taken(200_000)(one))
    loose = resident() - before
    list(common.tidy(taken(200_000))(one))
    assert resident() - before < 40_000 < loose
