"""Operators against plain Python versions of what they compute, on random and odd small inputs."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphweft.llm import bpe, decontam, fingerprint, langid, linededup, pii, quality, simhash_dedup, toxicity

KEY = "a key of the tests"


def test_segments_are_the_maximal_ones():
    random.seed(4)
    for _ in range(200):
        n = random.randint(1, 12)
        hits = [(i, random.uniform(0.5, 4)) for i in range(n) if random.random() < 0.5]
        scores = dict(hits)
        value = lambda a, b: sum(scores.get(i, -1.0) for i in range(a, b + 1))

        def brute(a, b):  # the best segment, then the best ones left and right of it
            best = max(((value(i, j), i, j) for i in range(a, b + 1) for j in range(i, b + 1)), default=(0, 0, 0))
            return [*brute(a, best[1] - 1), best[1:], *brute(best[2] + 1, b)] if best[0] > 0 else []

        assert [(a, b) for a, b, _ in toxicity.segments(hits, 1.0)] == brute(0, n - 1)


def test_windows_and_spans(spark):
    random.seed(5)
    word = lambda: random.choice("abc")
    for window in (2, 4):
        items = [(k, " ".join(word() for _ in range(random.randint(0, 7)))) for k in range(12)]
        texts = [(k, " ".join(random.choice("abcd") for _ in range(random.randint(0, 30)))) for k in range(60)]
        docs, benchmark = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontam.report(spark, docs, benchmark, window).collect()}
        for k, text in texts:
            words, hit, found = text.split(), set(), set()
            for item, t in items:
                own = t.split()
                size = min(window, len(own))
                for a, b in itertools.product(range(len(own) - size + 1), range(len(words) - size + 1)) if size else ():
                    if own[a : a + size] == words[b : b + size]:
                        hit |= set(range(b, b + size))
                        found.add(str(item))
            assert got[k] == (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())


def test_merges_equal_the_library():
    import public_tokenizers as P
    import tiktoken

    random.seed(6)
    ranks = bpe.ranks_of(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    parts = [b"a", b"e", b"t", b"th", b" ", b"ing", b"\xc3\xa9", b"\xff", b"er", b"  ", b"\n"]
    for _ in range(500):
        word = b"".join(random.choice(parts) for _ in range(random.randint(1, 90)))
        want = library._encode_single_piece(word)
        assert bpe.encode_word(word, ranks) == want
        assert word in ranks or bpe._encode_long(word, ranks) == want


def test_calibration_rises_and_is_the_best():
    random.seed(7)
    for _ in range(60):
        x = np.array([random.randint(0, 8) / 4 for _ in range(random.randint(1, 25))])
        y = np.array([float(random.random() < v / 2) for v in x])
        knots, levels = quality.isotonic(x, y)
        order = np.random.default_rng(1).permutation(len(x))
        again = quality.isotonic(x[order], y[order])
        assert np.allclose(knots, again[0]) and np.allclose(levels, again[1])
        assert (np.diff(knots) > 0).all() and (np.diff(levels) > 0).all()
        at = np.unique(x)  # least squares by the minimax formula
        mean = lambda a, b: y[(x >= a) & (x <= b)].mean()
        want = sorted({round(max(min(mean(a, b) for b in at if b >= v) for a in at if a <= v), 9) for v in at})
        assert np.allclose(((levels * (len(x) + 1)) - 0.5) / len(x), want)
    rare = quality.isotonic(np.r_[np.zeros(1000), 1.0, 2.0], np.r_[np.ones(900), np.zeros(100), 1.0, 1.0])
    assert (np.diff(rare[1]) > 0).all()


def test_features_approximate_the_kernel_and_the_ridge_is_solved(spark):
    random_ = np.random.default_rng(3)
    x = random_.normal(size=(40, 5))
    model = {"mean": np.zeros(5), "scale": np.ones(5), "waves": random_.normal(size=(5, quality.FEATURES)) / np.sqrt(5), "phases": random_.uniform(0, 2 * np.pi, quality.FEATURES)}
    z = quality.fourier(x, model)[:, 1:]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2 / 5)
    assert np.abs(z @ z.T - kernel).max() < 0.35 and np.abs(z @ z.T - kernel).mean() < 0.06
    texts = [(i, f"Plain words {'and more ' * (i % 7)}in row {i}." if i % 2 else f"%% $$ {i} " + "## " * (i % 5)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id bigint, quality int")
    fitted = quality.fit(spark, docs, labels)
    import zlib

    # the same fit from all learnt rows at once
    calibrating = {r.doc_id for r in docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0).collect()}
    learnt = [(t, i % 2) for i, t in texts if zlib.crc32(str(i).encode()) % 4 != 2 and i not in calibrating]
    z = quality.fourier(np.stack([quality.statistics(t) for t, _ in learnt]), fitted)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * np.eye(z.shape[1]), z.T @ np.array([y for _, y in learnt], float))
    assert np.allclose(fitted["weights"], want, atol=1e-6)


def test_votes_and_likeness(spark):
    random.seed(8)
    words = [f"w{k}" for k in range(30)]
    texts = [None, "", "one two", "A b\tc d e", *(" ".join(random.choices(words, k=random.randint(1, 60))) for _ in range(30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = fingerprint.report(spark, docs).collect()
    terms = {r.doc_id: r.t for r in docs.select("doc_id", fingerprint.terms(F.col("text")).alias("t")).collect()}
    for k, t in enumerate(texts):
        own = (t or "").lower().split()
        assert len(terms[k]) == (max(1, len(own) - 4) if own else 0)
    second = {r.t: r.s for r in spark.createDataFrame([(x,) for x in {x for v in terms.values() for x in v}], "t bigint").select("t", F.xxhash64(F.lit(1), "t").alias("s")).collect()}
    want = {}
    for k, own in terms.items():
        hashes = [((t % (1 << 64)) << 64) | (second[t] % (1 << 64)) for t in own]
        want[k] = sum(1 << b for b in range(128) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    got = {r.doc_id: r for r in rows}
    like = lambda a, b: max(0.0, math.cos((a ^ b).bit_count() * math.pi / 128))
    last = len(texts) - 1
    for k in range(len(texts)):
        r = got[k]
        assert r.fingerprint == f"{want[k]:032x}"
        assert abs(r.near_next - like(want[k], want[k - 1 if k else last])) < 1e-9
        assert abs(r.near_edited - like(want[k], int(r.edited_fingerprint, 16))) < 1e-9
    near = lambda k: sum(0 < (want[k] ^ f).bit_count() <= 3 for f in set(want.values()))
    assert {k: r.n_near for k, r in got.items()} == {k: near(k) if k % 20 == 0 else None for k in got}


def test_block_tables_find_every_near_fingerprint(spark):
    random.seed(9)
    base = [random.getrandbits(128) for _ in range(20)]
    own = {b ^ sum(1 << i for i in random.sample(range(128), n)) for b in base for n in (0, 1, 2, 3, 4, 5)} | {0, (1 << 128) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x >> 64), signed(x & (1 << 64) - 1)) for x in own], "hi bigint, lo bigint")
    whole = lambda hi, lo: ((hi % (1 << 64)) << 64) | lo % (1 << 64)
    for radius in (1, 3, 5):
        got = {(whole(r.query_hi, r.query_lo), whole(r.hi, r.lo)) for r in fingerprint.search(frame, frame, radius).collect()}
        assert got == {(a, b) for a in own for b in own if (a ^ b).bit_count() <= radius}


def feistel(left, right, size_l, size_r, kind, back=False):
    mixed = lambda r, v: int(hashlib.sha256(f"{KEY}|{kind}|{size_l}|{size_r}|{r}|{v}".encode()).hexdigest()[:15], 16)
    for r in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        sign = -1 if back else 1
        if r % 2 == 0:
            left = (left + sign * (mixed(r, right) % size_l)) % size_l
        else:
            right = (right + sign * (mixed(r, left) % size_r)) % size_r
    return left, right


def test_pseudonyms_are_valid_and_can_be_decrypted(spark):
    ssns = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 2, 123, 665, 667, 899) for g in (1, 50, 99) for s in (1, 777, 9999)]
    rows = spark.createDataFrame([(v,) for v in ssns], "v string").select("v", pii._ssn(F.col("v"), KEY).alias("p")).collect()
    rank = lambda v: ((int(v[:3]) - (2 if int(v[:3]) > 666 else 1)) * 99 + int(v[4:6]) - 1, int(v[7:]) - 1)
    for r in rows:
        assert re.fullmatch(pii.PATTERNS["ssn"], r.p)
        assert feistel(*rank(r.p), 898 * 99, 9999, "ssn", back=True) == rank(r.v)
    many = spark.range(10_000).select(F.format_string("%03d-%02d-%04d", F.col("id") % 665 + 1, F.col("id") % 99 + 1, F.col("id") * 7 % 9999 + 1).alias("v"))
    got = [r.p for r in many.distinct().select(pii._ssn(F.col("v"), KEY).alias("p")).collect()]
    assert len(set(got)) == 10_000 and all(re.fullmatch(pii.PATTERNS["ssn"], p) for p in got)
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1800, 1899, 2000, 2199) for m, d in ((1, 1), (2, 28), (12, 31))]
    import datetime as dt

    rows = spark.createDataFrame([(v,) for v in days], "v string").select("v", pii._date(F.col("v"), KEY).alias("p")).collect()
    number = lambda v: divmod((dt.date.fromisoformat(v) - dt.date(1800, 1, 1)).days, 773)
    assert all(feistel(*number(r.p), 189, 773, "date", back=True) == number(r.v) for r in rows)
    ips = ["0.0.0.0", "255.255.255.255", "10.2.3.4"]
    rows = spark.createDataFrame([(v,) for v in ips], "v string").select("v", pii._ip(F.col("v"), KEY).alias("p")).collect()
    sides = lambda v: (int(v.split(".")[0]) * 256 + int(v.split(".")[1]), int(v.split(".")[2]) * 256 + int(v.split(".")[3]))
    assert all(feistel(*sides(r.p), 65536, 65536, "ip", back=True) == sides(r.v) for r in rows)
    digits = ["0", "12", "453957876362148", "123456789012345678"]
    rows = spark.createDataFrame([(v,) for v in digits], "v string").select("v", pii.permute_string(F.col("v"), 10, "card", KEY).alias("p")).collect()
    half = lambda v: (int(v[: len(v) // 2] or 0), int(v[len(v) // 2 :]))
    for r in rows:
        n = len(r.v)
        assert len(r.p) == n and feistel(*half(r.p), 10 ** (n // 2), 10 ** (n - n // 2), "card", back=True) == half(r.v)


def test_equal_values_stay_linked_however_they_are_written(spark):
    texts = ["+44 20 7946 0958", "+442079460958", "+44-20 7946-0958", "+1 (212) 555-0123", "+12125550123", "+353 14 555 0123", "-a.b9@x.org", "A.b9@x.org", "24.12.2001", "2001-12-24", "24/12/2001"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.found[0].pseudonym for r in pii.pseudonymise(docs, KEY).collect()}
    digits = lambda k: re.sub(r"\D", "", got[k])
    assert digits(0) == digits(1) == digits(2) and digits(0).startswith("44") and digits(3) == digits(4) and digits(3)[0] == "1" and digits(5).startswith("353")
    assert re.sub(r"\d", "0", got[0]) == "+00 00 0000 0000" and got[6] == got[7]
    assert got[8] == ".".join(reversed(got[9].split("-"))) == got[10].replace("/", ".")
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")


@pytest.mark.parametrize("text", ["a" * 1_000_000, "a." * 300_000, "a@" * 200_000, "7" * 500_000, "7 " * 20_000, "." * 500_000, "n" * 100_000 + "@x.org"], ids=["letters", "dots", "ats", "digits", "groups", "marks", "name"])
def test_long_texts_take_time_in_proportion(spark, text):
    import time

    def seconds(text):
        docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
        began = time.time()
        assert len(pii.report(docs, KEY).first().text) == len(text)
        return time.time() - began

    seconds(text)
    assert seconds(text * 2) < 3 * seconds(text) + 5  # a text twice as long would take four times as much at the square of its length


def test_fingerprint_of_three_words():
    for text in [None, "", " \n", "one", "One TWO", "a b c", "a\tb\x0bc d\x1ce f g h", "x " * 300, "É é ÉÉ b c"]:
        words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        runs = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0
        assert simhash_dedup.fingerprint_of(text) == want


def test_grams_across_pieces(monkeypatch):
    def brute(text):
        line = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " ")
        if not line.strip():
            return None
        size, code, out = 1 << 32, [ord(c) for c in line], np.zeros(langid.BINS, np.int64)
        for i, x in enumerate(code):
            h = x * 0x9E3779B1 % size
            out[h >> 20] += 1
            for j, (a, b) in enumerate(((0x85EBCA77, 0xC2B2AE3D), (0x27D4EB2F, 0x165667B1)), 1):
                if i + j < len(code):
                    h = (h ^ (code[i + j] * a % size)) * b % size
                    out[h >> 20] += 1
        return out

    random.seed(10)
    for piece in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(langid, "_PIECE", piece)
        for _ in range(30):
            text = "".join(random.choice("ab é1 .\n") for _ in range(random.randint(0, 20)))
            got, want = langid.grams(text), brute(text)
            assert (got is None and want is None) or (got == want).all()


def edits_of(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most_broadcast", [0, 500_000])
@pytest.mark.parametrize("hot", [3, 10_000])
def test_line_dedup_on_random_lines(spark, monkeypatch, most_broadcast, hot):
    monkeypatch.setattr(linededup, "MOST_BROADCAST", most_broadcast)
    monkeypatch.setattr(linededup, "HOT", hot)
    random.seed(11)
    pool = [[random.choice("abcdef") for _ in range(random.randint(1, 9))] for _ in range(25)]

    def line():
        own = list(random.choice(pool))
        if random.random() < 0.5:
            k = random.randrange(len(own))
            own[k : k + random.randint(0, 1)] = random.choice([[], ["z"], ["a"]])
        return " ".join(own)

    texts = [(k, "\n".join(line() for _ in range(random.randint(1, 8)))) for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in linededup.report(spark, docs).collect()}
    seen, want = [], {}
    for k, text in texts:
        kept = []
        for t in text.split("\n"):
            own = t.split()
            again = own and any(own == o or (max(len(own), len(o)) >= linededup.LEAST and edits_of(own, o) <= 1) for o in seen)
            if not again:
                kept.append(t)
            if own:
                seen.append(own)
        want[k] = "\n".join(kept)
    assert got == want


def test_line_dedup_leaves_other_columns_alone(spark):
    names = ["ord", "h", "drops", "new_text", "row", "line_no", "lh", "n", "kp", "words", "first", "near", "hot", "copies", "n_lines", "n_dropped"]
    rows = [("d2", "same line here\nown", *[f"2{c}" for c in names]), ("d10", "same line here\nother", *[f"10{c}" for c in names]), (None, "same line here", *["x"] * len(names))]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["doc_id", "text", *names]))
    got = {r.doc_id: r for r in linededup.keep_lines(spark, docs).collect()}
    assert {k: r.text for k, r in got.items()} == {"d10": rows[1][1], "d2": "own"}  # ordered as strings
    assert all(got[k][c] == f"{k[1:]}{c}" for k in ("d2", "d10") for c in names)
    assert linededup.dedup_lines(spark, docs).filter("doc_id = 'd2'").first().n_dropped == 1


def test_a_cluster_without_a_shared_folder_is_an_error(spark):
    from types import SimpleNamespace

    from graphweft.llm.common import shared_dir

    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context))


def test_languages_by_the_nearest_centroid(spark):
    random.seed(12)
    speech = {"en": "the cat and dog with a thing".split(), "fr": "le chat et les chiens où être".split(), "de": "der hund und die katze über straße".split()}
    rows = [(k, " ".join(random.choices(speech[lang], k=12)), lang) for k, lang in enumerate(list(speech) * 40)]
    docs = spark.createDataFrame([*rows, (900, "1 2 3", "en"), (901, None, None), (902, "le thing katze", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(spark, docs)
    import zlib

    learnt = [t for k, t, _ in rows if zlib.crc32(str(k).encode()) % 4 != 2]
    held = sum((langid.grams(t) > 0).astype(int) for t in learnt)
    assert np.allclose(model["idf"], np.log((1 + len(learnt)) / (1 + held)) + 1, atol=1e-5) and set(model["names"]) == set(speech)
    for r in langid.report(spark, docs).collect():
        counts = langid.grams(next(t for k, t, _ in [*rows, (900, "1 2 3", ""), (901, None, ""), (902, "le thing katze", "")] if k == r.doc_id))
        if counts is None:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        v = [math.log1p(c) * w for c, w in zip(counts.tolist(), model["idf"].tolist())]
        cosine = [sum(a * b for a, b in zip(v, c)) / math.sqrt(sum(a * a for a in v)) / math.sqrt(sum(b * b for b in c)) for c in model["centres"].tolist()]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        assert r.lang_pred == model["names"][best] and abs(r.score - cosine[best]) < 1e-4


def test_toxicity_scores_follow_from_the_segments(spark):
    texts = [(i, ("you utter zzgrim fool " * (1 + i % 2) if i % 3 == 0 else "a calm and plain text ") + f"about w{i} things") for i in range(1, 121)]
    docs = spark.createDataFrame([*texts, (500, None), (501, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in texts], "doc_id bigint, toxic int")
    model = toxicity.fit(spark, docs, labels)
    assert {"zzgrim", "fool", "utter", "you"} <= set(model["scores"]) and "calm" not in model["scores"]
    a, b, c = model["weights"]
    for r in toxicity.score(spark, docs, model).collect():
        own = toxicity.tokens(r.text)
        hits = [(i, model["scores"][w]) for i, w in enumerate(own) if w in model["scores"]]
        found = toxicity.segments(hits, toxicity.LOSS)
        assert [(x["first"], x["last"]) for x in r.segments] == [(x, y) for x, y, _ in found]
        bits = [max(0.0, s * model["lambda"] - math.log(max(1, len(own))) - model["log_k"]) for *_, s in found]
        best = max(bits, default=0.0)
        want = 1 / (1 + math.exp(-max(-30, min(30, a + b * best * 40 / (best + 40) + c * math.log1p(sum(bits))))))
        assert abs(r.score - want) < 1e-9
