"""Each operator against the library or a brute-force version, on odd rows: nulls, empty and long texts, ties, copies."""

import collections
import gzip
import hashlib
import html
import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe, classify, dac, dedup, fst, mips, mixing, rules, sitetree, warc
from gridloom.llm.common import tokenizer_path, work_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, n_tokens string, score string"
rnd = random.Random(3)


def prose(n, words=400):
    return " ".join(f"w{rnd.randrange(words)}" + rnd.choice(["", "", ",", ".\n"]) for _ in range(n))


BASE = prose(120)
TEXTS = [
    None, "", " \n\t ", "one", "one two", BASE, BASE, BASE + " end", BASE.replace("w1", "v1", 1), prose(300), "The " * 40,
    "A | b | " * 30, "ALL CAPS WORDS!! " * 12, "x" * 5000, prose(9000), "é́  日本 \x00 <s> <|endoftext|> it's\x1c",
    "same line here\n" * 9, "ﬁ ▁a  b\r\n" * 4, prose(40).upper(), "#$% &*" * 9,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["b", "a", None, "c"][k % 4], "clash", "clash") for k, t in enumerate(TEXTS)]
    rows += [(5, BASE, "a", "clash", "clash"), (None, BASE, "b", "clash", "clash"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.where("doc_id IS NOT NULL").collect()}


def test_token_counts(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = by_id(fst.op2_token_counts(docs))
    for k, t in enumerate(TEXTS):
        assert got[k]["n_tokens"] == len(sp.encode(t or "")), ascii((t or "")[:40])
        assert got[k]["n_bytes"] == len((t or "").encode())
        assert got[k]["over_limit"] == (got[k]["n_tokens"] > 4096)
    assert fst.op2_token_counts(none).count() == 0


def test_transducer_on_odd_strings():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    machine = fst.transducer("piece_bpe_32k.model")
    pieces = [p for p in machine.score]
    texts = ["".join(rnd.choice(" etaoin") for _ in range(rnd.randint(1, 900))) for _ in range(100)]
    texts += ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))) for _ in range(200)]
    texts += [rnd.choice(pieces) * rnd.randint(1, 900) for _ in range(60)] + ["a" * 5000, " " * 3000]
    assert machine.counts(texts).tolist() == [len(sp.encode(t)) for t in texts]


def test_bpe_round_trip(docs, none):
    import tiktoken
    import public_tokenizers

    codec = bpe.codec("byte_bpe_50k.tiktoken", None)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    got = by_id(bpe.op8_bpe(docs))
    for k, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.op8_bpe(none).count() == 0
    odd = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 2000))) for _ in range(60)] + ["a" * 3000]
    assert codec.ids(odd) == [enc.encode_ordinary(t) for t in odd]
    whole = [t for t in odd if len(t) > 1] + ["é日" * 700, "etaoin shrdlu" * 90]
    for t in whole:  # a piece over rows of any width
        for width in (2, 7, 512):
            assert codec._rows(t.encode(), width) == enc._encode_single_piece(t)


def test_quality_rules(docs, none, spark):
    got = by_id(rules.op4_quality_rules(docs))
    for k, t in enumerate(TEXTS):
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        r = got[k]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == len(inside)
        assert r["base_failed"] == (len(words) < 20 or 100 * len(inside) > 30 * len(words))
        assert not (r["base_failed"] and r["kept"])
    assert got[5]["kept"] and got[14]["kept"] and not got[11]["kept"] and not got[18]["kept"]
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} - {None} == {k for k, r in got.items() if r["kept"]}
    assert rules.op4_quality_rules(none).count() == 0
    first = rules.cascade(F.col("text"), {"a": lambda t: t == "x", "b": lambda t: F.raise_error(F.lit("not short-circuit")) == t}, ["a", "b"])
    assert spark.createDataFrame([("x",)], "text string").select(first).first()[0] == "a"


PAGES = "page_id long, url string, html string, text string"


def test_warc(spark):
    long = "é" * 700
    rows = [(1, "http://a/x", None), (2, None, ""), (3, "http://a/1", long), (4, "http://b/2", long), (7, "http://c/3", long),
            (5, "u\r\n1", "short"), (6, "u2", "short"), (None, "u3", "n" * 2000), (8, "u4", "q" * 300_000)]
    folder = work_dir(spark, "test-warc")
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    files = warc.write_warc(warc.with_revisits(pages), folder).collect()
    assert sum(f["n_records"] for f in files) == len(rows)
    for f in files:
        data = gzip.open(f["path"].removeprefix("file://")).read()
        assert data.count(b"WARC/1.1\r\n") == f["n_records"]
    got = {r["page_id"]: r for r in warc.read_warc(spark, folder).collect()}
    for i, _, h in rows:
        raw = (h or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["digest"] == hashlib.sha1(raw).hexdigest()
        revisit = i in (3, 4)
        assert got[i]["record_type"] == ("revisit" if revisit else "response")
        assert got[i]["refers_to"] == (7 if revisit else None)
        assert got[i]["payload"] == (b"" if revisit else raw)
    slim = warc.read_warc(spark, folder, ["page_id", "record_type"]).where("page_id >= 4 AND record_type = 'response'")
    assert sorted(r["page_id"] for r in slim.collect()) == [5, 6, 7, 8]
    empty = work_dir(spark, "test-warc")
    warc.write_warc(warc.with_revisits(pages.limit(0)), empty).collect()
    assert warc.read_warc(spark, empty).count() == 0


def test_payloads_that_all_pages_share(spark):
    """The join back takes no small page, and a payload of most pages is one digest."""
    rows = [(k, "u", ["short", "x" * 1200, "y" * 1000, "z" * 999][min(k % 7, 3)], "") for k in range(300)]
    got = {r["page_id"]: r["first"] for r in warc.with_revisits(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: {1: 295, 2: 296}.get(k % 7) for k in range(300)}


FOREIGN = (
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:6a2b8b1c-3d5c-4d8c-8b0e-0a0d7ac1c0aa>\r\nContent-Length: 11\r\n"
    b"Content-Type: application/warc-fields\r\n\r\nsoftware: x\r\n\r\n"
    b"WARC/1.0\r\nwarc-type:response\r\nWARC-TARGET-URI: http://a/\r\n b\r\nWarc-Record-Id: <urn:uuid:00000000-0000-0000-0000-000000000001>\r\n"
    b"WARC-Payload-Digest: sha1:3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ\r\ncontent-type: application/http; msgtype=response\r\ncontent-length: 46\r\n\r\n"
    b"HTTP/1.1 200 OK\r\nContent-Type: text/x\r\n\r\nhello\r\n\r\n"
    b"WARC/1.0\r\nWARC-Record-ID: <urn:x-page:7>\r\nWARC-Payload-Digest: md5:xx\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
)


def test_warc_archives_of_other_writers(spark, tmp_path):
    """Plain and compressed: foreign ids, headers in any case and over lines, types and digests that are missing."""
    assert FOREIGN.count(b"hello") == 1
    cuts = [0, *(m.start() for m in re.finditer(rb"WARC/1.0", FOREIGN))][1:] + [len(FOREIGN)]
    (tmp_path / "plain").mkdir()
    (tmp_path / "packed").mkdir()
    (tmp_path / "plain" / "x.warc").write_bytes(FOREIGN)
    (tmp_path / "packed" / "x.warc.gz").write_bytes(b"".join(gzip.compress(FOREIGN[a:b]) for a, b in zip(cuts, cuts[1:])))
    for kind in ("plain", "packed"):
        got = warc.read_warc(spark, f"file://{tmp_path}/{kind}").collect()
        want = [
            (None, "", "warcinfo", 11, None, None, b"software: x"),
            (None, "http://a/ b", "response", 5, "da39a3ee5e6b4b0d3255bfef95601890afd80709", None, b"hello"),
            (7, "", "", 0, None, None, b""),
        ]
        assert [tuple(r[:6]) + (bytes(r[6]),) for r in got] == want
        slim = warc.read_warc(spark, f"file://{tmp_path}/{kind}", ["record_type", "payload_bytes"]).where("payload_bytes = 5").collect()
        assert [tuple(r) for r in slim] == [("response", 5)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.warc.gz").write_bytes(gzip.compress(FOREIGN))
    with pytest.raises(Exception, match="more than one record"):
        warc.read_warc(spark, f"file://{tmp_path}/bad").collect()


def test_warc_reader_on_foreign_members(tmp_path):
    """Members without the sl field, as other writers make them."""
    import pyarrow as pa

    path = tmp_path / "x.warc.gz"
    path.write_bytes(
        b"".join(gzip.compress(gzip.decompress(warc.record(k, "u", bytes(70_000 * k), "00" * 20, None, False))) for k in (1, 2, 3))
    )
    reader = warc.WarcReader(None, {"path": f"file://{tmp_path}"})
    with pa.OSFile(str(path)) as f:
        assert [len(r["payload"]) for r in reader.records(f, True)] == [70_000, 140_000, 210_000]
    with pa.OSFile(str(path)) as f:
        assert [r["page_id"] for r in reader.records(f, False)] == [1, 2, 3]


def test_top_products(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=8) * rng.choice([0.2, 1, 3])]) for k in range(400)]
    rows += [(400 + k, rows[50][1]) for k in range(30)]
    rows += [(450, None), (500, [1.0, None] + [0.0] * 6), (550, [float("nan")] * 8), (600, [float("inf")] * 8), (650, [0.5] * 3), (651, [0.25] * 3)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    good = {k: np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q, x in good.items():
        if q % 50 == 0:
            best = sorted((-int(x @ y), k) for k, y in good.items() if k != q and len(y) == len(x))[:5]
            want |= {(q, r + 1, k, -s) for r, (s, k) in enumerate(best)}
    assert {tuple(r) for r in mips.op6_topk(df).collect()} == want
    assert mips.op6_topk(df.limit(0)).count() == 0


def test_blocks_go_only_to_groups_in_reach(spark, monkeypatch):
    """Lengths that fall off quickly: few of all pairs of blocks and groups are made, and every result is there."""
    monkeypatch.setattr(mips, "BUCKET", 16)
    monkeypatch.setattr(mips, "GROUP", 2)
    monkeypatch.setattr(mips, "QUERY_BLOCK", 8)
    monkeypatch.setattr(mips, "SEEDS", 16)
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=6) * 1.02 ** -(k % 900)]) for k in range(900)]
    v = mips.saved(mips.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "test-mips")
    made = []

    def counted(asked, stored, paired=mips.paired):
        made.extend([paired(asked, stored).count(), asked.count() * stored.count()])
        return paired(asked, stored)

    monkeypatch.setattr(mips, "paired", counted)
    got = {tuple(r) for r in mips.top_products(v.where("vec_id % 10 = 0"), v, 3).collect()}
    ints = {k: np.floor(256 * np.array(x)).astype(int) for k, x in rows}
    want = set()
    for q in range(0, 900, 10):
        top = sorted((-int(ints[q] @ y), k) for k, y in ints.items() if k != q)[:3]
        want |= {(q, r + 1, k, -s) for r, (s, k) in enumerate(top)}
    assert got == want
    assert made[0] < made[1] / 2, made


def test_products_beyond_floating_point():
    a, b = np.array([[2**31, 3]]), np.array([[2**30 + 1, 5], [1, 7]])
    assert mips.exact(a, b, 2.0**62).tolist() == [[2**61 + 2**31 + 15, 2**31 + 21]]


def test_mixing(docs, none, spark):
    rows = [(k, prose(rnd.choice([3, 10, 60, 300])), "abcdef"[k % 6] if k % 3 else "hot") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.op7_mix(df).collect()
    again = mixing.op7_mix(df.repartition(7)).collect()
    assert sorted(got) == sorted(again)
    size = {k: len(WORD.findall(t)) for k, t, _ in rows}
    total = sum(size.values())
    names = sorted({s for *_, s in rows})
    own = {s: sum(size[k] for k, _, x in rows if x == s) for s in names}
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * own[s] for s in capped)
        target = {s: 3 * own[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * own[s]}
        if not over:
            break
        capped |= over
    source = {k: s for k, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == own[s] and abs(r["target"] - target[s]) < 1e-6 * total
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(20, 0.01 * target[s]), (s, taken[s], target[s])
    assert len(mixing.op7_mix(docs).collect()) == docs.count() and mixing.op7_mix(none).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixing.mix(none).count() == 0


def test_expected_copies(spark):
    """Over many seeds, a document's copies come to target / size on average: also in sources that the root settles alone."""
    size = {"a": [5, 5, 5, 5, 5, 5, 5, 5], "b": [700, 90, 31, 2, 1], "c": [40], "d": [k % 17 + 1 for k in range(400)]}
    rows = [(k, "w " * n, s) for s, ns in size.items() for k, n in enumerate(ns, 1000 * ord(s))]
    sized = mixing.saved(spark.createDataFrame(rows, "doc_id long, text string, source string"), "test-mix")
    # One table with every seed's documents as sources of their own: the same rounding, many draws.
    p = {"a": 0.25, "b": 0.4, "c": 0.7, "d": 0.55}
    seeds = 120
    many = sized.select("doc_id", "source", F.size(F.split(F.trim("text"), " ")).cast("long").alias("size")).crossJoin(spark.range(seeds))
    prob = F.create_map(*(F.lit(x) for kv in p.items() for x in kv))
    # Another doc_id for each seed gives another key.
    many = many.select(
        (F.col("doc_id") + 1_000_000 * F.col("id")).alias("doc_id"), F.concat("source", F.lit("-"), "id").alias("source"), "size",
        F.lit(1).cast("long").alias("n"), F.lit(0).alias("whole"), prob[F.col("source")].alias("p"),
    )
    got = mixing.rounded(many).toPandas()
    got["kind"] = got["source"].str[0]
    got["doc"] = got["doc_id"] % 1_000_000
    assert set(got["p"]) <= {0.0, 1.0} and len(got) == seeds * len(rows)
    mean = got.groupby(["kind", "doc"])["p"].mean()
    for (kind, doc), x in mean.items():
        assert abs(x - p[kind]) < 4.5 * math.sqrt(0.25 / seeds), (kind, doc, x)
    total = got.assign(mass=got["p"] * got["size"]).groupby(["kind", "source"])["mass"].sum()
    for (kind, _), x in total.items():
        last = {"a": 5, "b": 700, "c": 40, "d": 17}[kind]
        assert abs(x - p[kind] * sum(size[kind])) <= last


def test_targets_with_caps(spark):
    rows = [("a", 1), ("b", 1000), ("c", 10), (None, 0)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    assert got["a"] == 3 and got["c"] == 30 and got[None] == 0 and abs(got["b"] - 978) < 1e-9


def test_classifier(docs, none, spark):
    good = [(k, prose(80), 1) for k in range(150)]
    bad = [(k, "a | b | " * 20 + prose(10) if k % 2 else "BUY NOW!! " * 20, 0) for k in range(150, 230)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    got = {r["doc_id"]: r for r in classify.op9_quality(df.select("doc_id", "text"), df.select("doc_id", "quality")).collect()}
    held = {k for k in got if zlib.crc32(str(k).encode()) % 3 == 1}
    assert {k for k, r in got.items() if r["held_out"]} == held
    right = [got[k]["predicted"] == y for k, _, y in good + bad if k in held]
    assert sum(right) >= 0.95 * len(right)
    scores = classify.op9_quality(docs, df.select("doc_id", "quality")).collect()
    assert len(scores) == docs.count() and all(0 <= r["score"] <= 1 for r in scores)
    assert classify.op9_quality(none, df.select("doc_id", "quality")).count() == 0
    one = classify.op9_quality(df.select("doc_id", "text"), df.where("quality = 1").select("doc_id", "quality")).first()
    assert one["score"] == 1.0


def test_classifier_counts_all_training_rows(spark):
    """The sample bounds the descent, not the features' counts."""
    rows = [(k, prose(20) + (f" only{k % 7}" if k % 3 else " spam spam"), int(k % 3 > 0)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(5)
    model = pickle.loads(classify.fit(df.select("doc_id", "text"), df.select("doc_id", F.col("quality").alias("label")), rows=30))
    ends, ids = classify.features([t for _, t, _ in rows])
    y = np.array([q for _, _, q in rows])
    owner = np.repeat(y, np.diff(ends))
    log = [np.log((np.bincount(ids[owner == c], minlength=classify.DIM) + 1) / ((y == c).sum() + 2)) for c in (0, 1)]
    assert np.abs(model.scale - (log[1] - log[0])).max() < 1e-5


def test_classifier_against_brute_force(spark):
    """Log-count ratios and the descent's optimum, from n-grams of the texts in plain Python."""
    rows = [(k, prose(30 + k % 9) if k % 3 else "BUY NOW!! w1 " * (2 + k % 4), int(k % 3 > 0)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    model = pickle.loads(classify.fit(df.select("doc_id", "text"), df.select("doc_id", F.col("quality").alias("label"))))
    order = [r["doc_id"] for r in df.select("doc_id", F.xxhash64(F.lit(23), "doc_id").alias("key")).orderBy("key").collect()]
    text, label = {k: t for k, t, _ in rows}, {k: y for k, _, y in rows}
    grams = {}
    for k in order:
        words = [classify.word_codes(w) for w in text[k].split()]
        own = set()
        for c in (0, 1):
            own |= {w[c] % 2**64 for w in words}
            own |= {(a[c] * int(classify.MIX) + b[c] + c) % 2**64 for a, b in zip(words, words[1:])}
        core = [w[0] for w in words]
        like = sum(w in core[max(i - 2, 0) : i] for i, w in enumerate(core))
        own |= set(range(1000, 1000 + like * 100 // len(core))) | {6}
        grams[k] = sorted({x * int(classify.MIX) % 2**64 >> (64 - classify.BITS) for x in own})
    ratio = np.zeros(classify.DIM)
    count = {c: collections.Counter(x for k in order if label[k] == c for x in grams[k]) for c in (0, 1)}
    size = {c: sum(label[k] == c for k in order) for c in (0, 1)}
    for x in range(classify.DIM):
        ratio[x] = math.log((count[1][x] + 1) / (size[1] + 2)) - math.log((count[0][x] + 1) / (size[0] + 2))
    assert np.abs(model.scale - ratio).max() < 1e-5
    # The weights are near the optimum of the regularized hinge loss: the duality gap is small.
    y = np.array([1.0 if label[k] else -1.0 for k in order])
    x = np.zeros((len(order), classify.DIM + 1))
    for r, k in enumerate(order):
        x[r, grams[k]] = ratio[grams[k]]
        x[r] /= np.sqrt((x[r] ** 2).sum()) + 1e-9
        x[r, -1] = 1.0
    flat = np.concatenate([np.array(grams[k]) for k in order])
    ends = np.concatenate([[0], np.cumsum([len(grams[k]) for k in order])])
    w = classify.descend(ends, flat, y, ratio)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * classify.COST * 10
    primal = 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    slow = np.zeros(len(y))  # plain projected ascent on the dual
    q = (x * y[:, None]) @ (x * y[:, None]).T
    step = 1.0 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        slow = np.clip(slow + step * (1 - q @ slow), 0, cost)
    dual = slow.sum() - 0.5 * slow @ q @ slow
    assert dual <= primal * (1 + 1e-9) and primal - dual < 0.02 * abs(dual), (primal, dual)
    shown = model.weights / np.where(ratio == 0, 1, ratio)
    assert np.abs(shown[ratio != 0] - w[:-1][ratio != 0]).max() < 1e-3


def test_bound_of_the_sample_does_not_look_at_lengths(spark):
    """The descent takes rows in the order of their hashes until they have so many features, long ones as they come."""
    rows = [(k, prose(400 if k % 2 else 5), k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    order = [r["doc_id"] for r in df.select("doc_id", F.xxhash64(F.lit(23), "doc_id").alias("key")).orderBy("key").collect()]
    ends, ids = classify.features([rows[k][1] for k in order])
    limit = int(ends[20]) + 1  # the 21st row in order is taken, the 22nd is not

    def spied(y, lists, count, n, fitted=classify.fitted):
        return [len(x) for x in lists]

    classify_fitted, classify.fitted = classify.fitted, spied
    try:
        taken = pickle.loads(classify.fit(df.select("doc_id", "text"), df.select("doc_id", F.col("quality").alias("label")), most=limit))
    finally:
        classify.fitted = classify_fitted
    assert taken == np.diff(ends[:22]).tolist()


def shingles(text, width, lower=str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")):
    w = WORD.findall((text or "").translate(lower))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_components(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, none, spark, width):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = [f"t{k}" for k in range(150)]
    for k in range(1000, 1120):  # a group whose members are close to some and not to others
        w = list(base)
        for at in rnd.sample(range(150), rnd.randint(0, 12)):
            w[at] = f"x{rnd.randrange(40)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup.near_duplicates(df, width)
    want = brute_components(rows, width)
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r["doc_id"], r["n"], r["component_id"]) for r in got.collect()), key=key) == sorted(want, key=key)
    kept = dedup.keep_one(df, width)
    heads = {c for i, n, c in want if n and c is not None}
    heads |= {i for i, n, _ in want if not n and i is not None}
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(heads)
    assert dedup.op1_near_duplicates(none).count() == 0 and dedup.keep_one(none).count() == 0


def test_one_row_of_each_group_where_doc_ids_are_shared(spark):
    words = [f"w{k}" for k in range(100)]
    near = " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(words)), (1, near), (2, near), (None, near), (1, "quite another text of some words"), (None, "one more text without an id"),
            (None, "one more text without an id"), (3, "")]
    kept = dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    group = [r for r in kept if r["text"] in (rows[0][1], near)]
    assert len(group) == 1 and group[0]["doc_id"] == 1
    assert sorted(r["text"] for r in kept if r not in group) == ["", "one more text without an id", "quite another text of some words"]


def test_keys_and_cells_are_never_sent_to_all_tasks(spark, monkeypatch):
    """Spark takes them for as few as the rows they are made of, so by size it would broadcast them."""
    rows = [(k, " ".join(f"w{x}" for x in range(100) if x % 17 or k % 3) + f" {k}") for k in range(9)]
    plans = {}
    written, compared = dedup.saved, dedup.links_in_cells

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    monkeypatch.setattr(dedup, "saved", lambda df, name: written(seen(df, name), name))
    monkeypatch.setattr(dedup, "links_in_cells", lambda df, percent: compared(seen(df, "cells"), percent))
    dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    for name in ("dedup-stars", "cells"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name]


def test_pigeonhole():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, (200, dedup.HASHES)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(dedup.HASHES, dedup.RADIUS, replace=False)] += 1
    assert (dedup.chunk_keys(a) == dedup.chunk_keys(b)).any(axis=1).all()


def test_components(spark):
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r["node"]: r["comp"] for r in dedup.components(spark.createDataFrame(edges, "node long, hub long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(root)}


def test_main_text(spark):
    article = "<article><h1>T &amp; x</h1><p><b>One&nbsp;two<br>three<p>four <span class='ad'>no</span>five</p><ul><li>a<li>b</ul>{}</article>"
    body = "<html><head><title>t</title><style>p{{}}</style></head><body><header>H</header><nav>n</nav>{}<aside>s</aside><form>f</form>" \
           "<div id='comments'><article>c</article></div><script>if (a<b) '</p>'</script><footer>f</footer></body></html>"  # fmt: skip
    want = "T & x\nOne two three\nfour five\na\nb"
    rows = [(1, "http://h/1", body.format(article.format(""))), (2, "http://h/2", None), (3, None, ""), (4, "odd", "plain <b>text"),
            (5, "http://h/3", "<p>a < b<p hidden>z</p><!-- c --> d &amp &#233; &bogus;")]
    rows += [(10 + k, f"http://site/{k}", f"<body><div class=x><p>Story {k} alone</p></div><div class=y>Always the same</div></body>") for k in range(6)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES)
    got = {r["page_id"]: r for r in sitetree.op3_main_text(pages).collect()}
    assert [got[k]["text"] for k in range(1, 6)] == [want, "", "", "plain text", "a < b\nd & é &bogus;"]
    assert all(got[10 + k]["text"] == f"Story {k} alone" for k in range(6))
    assert got[1]["n_chars"] == len(want) and got[1]["url"] == "http://h/1"
    assert sitetree.op3_main_text(pages.limit(0)).count() == 0
    assert sitetree.Page("<p>" + "x " * 200_000).text() == " ".join("x" * 200_000)
    assert html.unescape("&amp") == "&"


def test_main_text_of_a_large_host_without_articles(spark):
    """Content that differs on every page stays, however many pages and presentations a host has; what repeats goes."""
    kinds = ["p", "h2", "ul", "pre", "blockquote", "table"]
    rows, want = [], {}
    for k in range(3000):
        n = 1 + (k // 10 % 50 if k % 10 == 0 else 0)
        # Nine of ten pages have one paragraph, the others up to 50 and one of 64 mixtures of other children.
        tags = [t for i, t in enumerate(kinds) if k // 10 >> i & 1] if k % 10 == 0 else []
        lines = [f"Story {k} part {i}" for i in range(n)] + [f"Story {k} in {t}" for t in tags]
        inner = "".join(f"<{t}>{x}</{t}>" for t, x in zip(["p"] * n + tags, lines, strict=True))
        rows.append((k, f"http://large/{k}", f"<body><div class=x>{inner}</div><div class=y><p>Always the same</p></div></body>", "clash"))
        want[k] = "\n".join(lines)
    pages = spark.createDataFrame(rows, PAGES)
    assert {r["page_id"]: r["text"] for r in sitetree.op3_main_text(pages).collect()} == want
    # The same where the lists of unimportant nodes are too long to be sent to all tasks.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r["page_id"]: r["text"] for r in sitetree.op3_main_text(pages.where("page_id < 600")).collect()} == {k: want[k] for k in range(600)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_importance_like_brute_force(spark):
    """Entropies of presentation and content of every node, from counts in plain Python."""
    rows = [(f"h{k % 2}", rnd.randrange(5), rnd.randrange(3), rnd.randrange(1 + k % 40), k) for k in range(400)]
    nodes = spark.createDataFrame(rows, "host string, path long, style long, content long, page long")
    got = {(r["host"], r["path"]): r for r in sitetree.importance(nodes).collect()}

    def entropy(values):
        n = collections.Counter(values)
        return -sum(c / len(values) * math.log(c / len(values)) for c in n.values()) / math.log(len(values)), len(n)

    assert set(got) == {r[:2] for r in rows}
    for key, r in got.items():
        own = [x for x in rows if x[:2] == key]
        (look, kinds), (content, _) = entropy([x[2] for x in own]), entropy([x[3] for x in own])
        weight = sitetree.GAMMA**kinds
        assert r["seen"] == len(own) and abs(r["content"] - content) < 1e-9
        assert abs(r["importance"] - max((1 - weight) * look + weight * content, content)) < 1e-9


def test_main_text_in_elements_with_noise_words(spark):
    """A word of a class, id or role is a prior that the content overrules; it never takes an article or main away."""
    ad = "<div class='ad banner'><p>Buy</p></div>"
    forms = [
        "<main class='content has-sidebar'><p>{}</p></main>", "<div class='no-sidebar story'><p>{}</p></div>",
        "<article class='post tag-search'><p>{}</p></article>", "<article id=notice-2024><p>{}</p></article>",
        "<div id=page class=with-menu><p>{}</p></div>", "<div id=page class=with-menu><article><p>{}</p></article></div>",
        "<div role=search><main><p>{}</p></main></div>", "<article><div class=entry-sharing><p>{}</p></div></article>",
        "<p class=social>{}</p>", "<div><p><span class=related>{}</span></p></div>",
    ]
    rows, want = [], {}
    for f, form in enumerate(forms):
        for k in range(13):  # the last page of each form is its host's only one
            host = f"many{f}" if k < 12 else f"one{f}"
            story = f"The story {k} of {host} has a text that is long enough to be most of its page"
            rows.append((100 * f + k, f"http://{host}/{k}", f"<body>{form.format(story)}{ad}</body>", "clash"))
            want[100 * f + k] = story
    # On a host's only page nothing tells an advert from a story but their words, unless an article says which is which.
    unsure = {100 * f + 12 for f in (1, 4, 8, 9)}
    # Comments beside an article, and a notice that is the same everywhere, are left out.
    for k in range(12):
        page = f"<article><p>Own {k}</p><div class=notice>All rights <b>reserved</b> by the owners of this site</div></article>"
        rows.append((9000 + k, f"http://talk/{k}", f"<body>{page}<div id=comments><article>Reply {k}</article></div></body>", "clash"))
        want[9000 + k] = f"Own {k}"
    got = {r["page_id"]: r["text"] for r in sitetree.op3_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert {k: t for k, t in got.items() if k not in unsure} == {k: t for k, t in want.items() if k not in unsure}
    assert all(got[k].startswith(want[k]) for k in unsure)


def test_words_like_the_library_for_all_letters_and_marks():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cased = [c for c in points if c.lower() != c or c.upper() != c]
    marks = [chr(m) for m in range(0x300, 0x346)]
    words = points + [c + m for c in cased for m in marks] + [f"a{c}{m}." for c in "HJTWYΗΙΥΑ" for m in marks]
    encoder = dac.encoder("word_bpe_49k.json")
    for k in range(0, len(words), 5000):
        text = " ".join(words[k : k + 5000])
        assert encoder.ids([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, ascii(text[:20])


def test_several_files_of_a_shard(docs, spark):
    """A file closes at the limit, and what is read back does not depend on it."""
    few = dac.write_shards(docs.repartition(1), work_dir(spark, "test-dac"), shard_ids=3)
    few = spark.createDataFrame(few.collect(), dac.MANIFEST)
    assert few.count() > spark.createDataFrame(dac.write_shards(docs, work_dir(spark, "test-dac")).collect(), dac.MANIFEST).count()
    assert sorted(dac.read_shards(few, True).collect(), key=lambda r: r["start"]) == sorted(dac.op10_token_files(docs, spark).collect(), key=lambda r: r["start"])


def test_token_files(docs, none, spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    manifest = dac.write_shards(docs, work_dir(spark, "test-dac")).collect()
    got = dac.op10_token_files(docs, spark).collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    want = []
    plain = {(r["doc_id"], r["start"]): r["ids"] for r in dac.read_shards(spark.createDataFrame(manifest, dac.MANIFEST)).collect()}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids + [2]
        assert plain[i, start] == ids
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    for m in manifest:
        shard = dac.Shard(m["path"])
        ids = shard.all()
        assert len(ids) == m["n_ids"]
        for i in rnd.sample(range(len(ids)), min(50, len(ids))):
            assert shard.token(i) == ids[i]
    assert dac.op10_token_files(none, spark).count() == 0
    big = np.array([0, 255, 256, 65535, 65536, 2**32 - 1] * 300, dtype=np.uint32)
    path = work_dir(spark, "test-dac").removeprefix("file://")
    with open(path, "wb") as f:
        f.write(dac.to_bytes([None, 7], np.array([0, 5, len(big)]), big))
    shard = dac.Shard("file://" + path)
    assert shard.all().tolist() == big.tolist() == [shard.token(i) for i in range(len(big))]
    assert shard.documents()[0] == [None, 7]
