"""The operators on small tables with nulls, empty texts, ties, repeated rows and clashing names, against brute force."""

import base64
import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from graphweft.llm import bpe, decontam, fingerprint, langid, linededup, pii, quality, simhash_dedup, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ord string, found string, spans int"


def docs_of(spark, texts):
    own = [(i, t, "en" if i is None or i % 2 else "fr", "s", len(t or ""), "x", "y", 1) for i, t in texts]
    return spark.createDataFrame(own, DOCS)


ODD = [(1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "one two three four five six"), (5, "one two three four five six"), (None, "null id here"), (6, "ÄÖ naïve 你好 \U0001f600 x" * 3), (7, "word " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def test_segments_against_all_intervals():
    import random

    random.seed(1)
    for _ in range(300):
        n = random.randint(1, 14)
        hits = [(i, float(random.randint(1, 4))) for i in range(n) if random.random() < 0.5]
        scores = dict(hits)
        got = toxicity.segments(hits, 1.0)
        value = lambda a, b: sum(scores.get(i, -1.0) for i in range(a, b + 1))

        def brute(a, b):  # the best segment (shortest, leftmost), then what is left of it and right of it
            best = max(((value(i, j), i - j, -i, i, j) for i in range(a, b + 1) for j in range(i, b + 1)), default=None)
            if best is None or best[0] <= 0:
                return []
            return [*brute(a, best[3] - 1), (best[3], best[4], best[0]), *brute(best[4] + 1, b)]

        assert sum(s for *_, s in got) == sum(s for *_, s in brute(0, n - 1))
        assert max([s for *_, s in got], default=0) == max([s for *_, s in brute(0, n - 1)], default=0)


def test_toxicity(spark, odd, none):
    texts = [(i, ("you utter zzgrim fool " if i % 3 == 0 else "a calm and plain text ") + f"about w{i} things") for i in range(1, 121)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in texts], "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, texts)
    rows = toxicity.report(spark, docs, labels).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in rows)
    assert {r.doc_id for r in toxicity.keep_clean(spark, docs, labels).collect()} == {i for i, _ in texts if i % 3}
    assert toxicity.report(spark, odd, labels.limit(0)).count() == len(ODD)
    assert toxicity.report(spark, none, labels).count() == 0


def test_decontamination(spark, odd, none):
    items = [(1, " ".join(f"q{i}" for i in range(14))), (2, "short item"), (3, None), (4, "...")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = docs_of(spark, [(1, "a Q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 b"), (2, "q1 q2 q3 q4 q5 q6 q7 q8 q9 x"), (3, "has a Short, item and then so many more words"), (4, None)])
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256) for r in decontam.report(spark, docs, benchmark).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (10, 1, sha("1")), 2: (0, 0, sha("")), 3: (2, 1, sha("2")), 4: (0, 0, sha(""))}
    blocks = {(r.doc_id, r.n_words, tuple(r["items"])) for r in decontam.matches(spark, docs, benchmark, block_words=3).collect()}
    assert blocks == {(r.doc_id, r.n_words, tuple(r["items"])) for r in decontam.matches(spark, docs, benchmark).collect()}
    clean = {r.doc_id: r.text for r in decontam.decontaminate(spark, docs, benchmark).collect()}
    assert clean == {2: docs.filter("doc_id = 2").first().text, 3: "has a  and then so many more words", 4: None}
    assert decontam.report(spark, odd, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontam.decontaminate(spark, odd, benchmark).columns == odd.columns
    assert decontam.report(spark, none, benchmark).count() == 0


def test_bpe(spark, odd, none):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.ranks_of(P.path("byte_bpe_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(odd, ranks, P.PATTERN, block_chars=10).collect()
    want = [(i, whole.encode_ordinary(t or "")) for i, t in ODD]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(want, key=key)
    back = bpe.decode(bpe.encode(odd, ranks, P.PATTERN), ranks).collect()
    assert sorted((bytes(r.decoded) for r in back)) == sorted((t or "").encode() for _, t in ODD)
    assert bpe.digests(none, ranks, P.PATTERN).count() == 0


def test_quality_and_language(spark, odd, none):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    docs = docs_of(spark, [(i, f"Plain words in a row number{i}, and an end." if i % 2 == 0 else f"%%% $$$ {i} ### BUY!! NOW!! ***") for i in range(200)])
    rows = quality.report(spark, docs, labels).collect()
    assert sum(r.predicted == (r.doc_id % 2 == 0) for r in rows) >= 195
    assert all(0 <= r.score <= 1 for r in quality.report(spark, odd, labels).collect())
    assert quality.report(spark, none, labels).count() == 0
    spoken = docs_of(spark, [(i, "the cat and the dog with thing" if i % 2 else "le chat et les chiens où être") for i in range(80)] + [(100, None), (101, "123 !"), (102, "")])
    found = {r.doc_id: r.lang_pred for r in langid.report(spark, spoken).collect()}
    assert all(found[i] == ("en" if i % 2 else "fr") for i in range(80)) and {found[100], found[101], found[102]} == {"und"}
    assert langid.report(spark, none).count() == 0


def test_fingerprints(spark, odd, none):
    rows = fingerprint.report(spark, odd).collect()
    distinct = sorted({(-1 if i is None else i, t or "") for i, t in ODD}, reverse=True)
    want = set()
    for k, (i, t) in enumerate(distinct):
        m = len(t) // 3
        want.add((None if i < 0 else i, len(t), hashlib.sha256((t[: len(t) - m] + distinct[(k + 1) % len(distinct)][1][:m]).encode()).hexdigest()))
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in rows if r.doc_id is not None} == {w for w in want if w[0] is not None}
    assert fingerprint.report(spark, none).count() == 0
    index = spark.createDataFrame([(0, 0), (7, 0), (1 << 40, 3), (-1, -1)], "hi bigint, lo bigint")
    found = {(r.query_hi, r.hi, r.distance) for r in fingerprint.search(index, index, 3).collect()}
    assert found == {(h, h, 0) for h in (0, 7, 1 << 40, -1)} | {(0, 7, 3), (7, 0, 3), (0, 1 << 40, 3), (1 << 40, 0, 3)}


def test_pseudonyms(spark, odd, none):
    text = "card 4539578763621486 or 4539578763621487, born 2001-02-29 or 29.02.2000, +1 (017) 555-7713, 10.2.3.4, 123-45-6789 a.b9@x.org"
    docs = docs_of(spark, [(1, text), (2, "again 4539578763621486 29.02.2000")])
    rows = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    kinds = [f.kind for f in rows[1].found]
    assert kinds == ["card", "date", "phone", "ip", "ssn", "email"]
    assert "4539578763621487" in rows[1].text and "2001-02-29" in rows[1].text
    one, two = ({f.value: f.pseudonym for f in rows[i].found} for i in (1, 2))
    assert all(one[v] == p != v for v, p in two.items())
    digits = one["4539578763621486"]
    assert sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0
    all_two = spark.range(100).select(pii.permute_string(F.lpad(F.col("id").cast("string"), 2, "0"), 10, "t", "k").alias("p"))
    assert all_two.distinct().count() == 100
    assert pii.report(odd, "k").count() == len(ODD) and pii.report(none, "k").count() == 0
    assert {r.text for r in pii.report(odd, "k").collect()} == {t for _, t in ODD}


def test_cards_beside_digits(spark):
    card, spaced = "4539578763621486", "4539 5787 6362 1486"
    texts = [f"{card} 12/27", f"{card} 123", f"no 7 {card}", f"{spaced} 123", f"12 34 {spaced}", f"{card} {spaced}", f"{card} 31/12/2001", f"{card} 2001-02-28", f"{card} 123-45-6789", "1234 5678 9012 3456 7", f"{card} " + "7 " * 3000, "4539-57876362-1486 12"]
    rows = {r.doc_id: r for r in pii.pseudonymise(docs_of(spark, list(enumerate(texts))), "k").collect()}
    plain = {f.value: f.pseudonym for f in rows[0].found}
    for i in (0, 1, 2, 6, 7, 8, 10):
        assert {f.value: f.pseudonym for f in rows[i].found if f.kind == "card"} == plain and list(plain) == [card]
    new = plain[card]
    assert [rows[i].text for i in (0, 1, 2)] == [f"{new} 12/27", f"{new} 123", f"no 7 {new}"]
    new_spaced = " ".join(new[k : k + 4] for k in (0, 4, 8, 12))
    assert [rows[i].text for i in (3, 4, 5)] == [f"{new_spaced} 123", f"12 34 {new_spaced}", f"{new} {new_spaced}"]
    assert [[f.kind for f in rows[i].found] for i in (6, 7, 8, 9, 10)] == [["card", "date"], ["card", "date"], ["card", "ssn"], [], ["card"]]
    assert [f.value for f in rows[11].found] == ["4539-57876362-1486"] and rows[10].text == f"{new} " + "7 " * 3000


def test_warc(spark, tmp_path):
    big = "".join(f"<p>é{i}</p>\r\n\r\nWARC/1.1\r\n" for i in range(9000))
    rows = [(1, "u", "a"), (2, "u", None), (3, "u", ""), (4, "u", big), (5, "u v", big), (None, None, "a"), (6, "u", "b")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, record_type int")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark, pages).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    refers = {3: 2, 5: 4, None: 1}
    assert got == {(i, len((t or "").encode()), sha(t), "revisit" if i in refers else "response", refers.get(i)) for i, _, t in rows}
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark, pages, path)
    assert {bytes(r.payload) for r in warc.read_archives(spark, path).collect() if r.payload is not None} == {(t or "").encode() for _, _, t in rows}


def test_broken_records_are_told_and_passed_over():
    import gzip

    one = lambda k, body: warc.records_of(k, f"http://x/a b{k}", body, None, "n")[0]
    end = b"\r\n\r\n"
    first, second = one(1, b"first"), one(2, b"second")
    assert b"a%20b1" in first
    again = warc.records_of(2, "http://x/b", b"first", 1, "n", refers_url="http://x/a b1")[0]
    assert b"WARC-Refers-To-Target-URI: http://x/a%20b1\r\n" in again and b"WARC-Type: revisit" in again
    read = lambda content: [(f.get("warc-page-id"), b is not None) for f, b in warc.parse(content)]
    assert read(first + end + second + end) == [("1", True), ("2", True)]
    assert read(gzip.compress(first + end) + gzip.compress(second + end)) == [("1", True), ("2", True)]
    assert read(first + end + b"rubbish\r\n" + second + end) == [("1", True), (None, False), ("2", True)]
    assert read(first.replace(b"Content-Length: ", b"Content-Length: x", 1) + end + second) == [("1", False), ("2", True)]
    assert read(first + end + second[:-3]) == [("1", True), ("2", False)]
    assert read(gzip.compress(first + end) + gzip.compress(second + end)[:-12])[0] == ("1", True)
    assert read(b"") == []
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz\r\n"
    assert warc._finished("3", block, True)[:4] == ("3", None, None, "broken")


def test_simhash_components(spark, odd, none):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ sum(1 << b for b in bits) for bits in itertools.combinations(range(0, 64, 9), 2)} | {base, 0, 1, 7, 63, (1 << 63) | 1})
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp bigint, node bigint")
    from graphweft.llm.components import connected_components

    got = {r.node: r.component for r in connected_components(spark, simhash_dedup.close_links(nodes)).collect()}
    parent = list(range(len(fps)))
    for _ in fps:
        for i, j in itertools.combinations(range(len(fps)), 2):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[i] = parent[j] = min(parent[i], parent[j])
    assert {k: got.get(k, k) for k in range(len(fps))} == dict(enumerate(parent))
    assert simhash_dedup.near_duplicates(spark, odd).count() == len(ODD)
    assert simhash_dedup.near_duplicates(spark, none).count() == 0
    kept = simhash_dedup.keep_one(spark, odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 4, 5, 6, 7]


def test_repeated_ids_keep_components_apart(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    docs = docs_of(spark, [(1, one), (1, two), (2, one), (3, two), (4, three), (5, three)])
    found = {r.fingerprint for r in simhash_dedup.near_duplicates(spark, docs).collect()}
    assert len(found) == 3
    assert sorted((r.doc_id, r.text) for r in simhash_dedup.keep_one(spark, docs).collect()) == [(1, one), (1, two), (4, three)]
    # a near copy of one text has a lesser id: the other text of id 1 doesn't follow
    bases = (" ".join(f"d{k}x{i}" for i in range(300)) for k in range(200))
    apart = lambda a, b: (simhash_dedup.fingerprint_of(a) ^ simhash_dedup.fingerprint_of(b)).bit_count()
    long, near = next((t, f"{t} e") for t in bases if 1 <= apart(t, f"{t} e") <= 2)
    rows = simhash_dedup.near_duplicates(spark, docs_of(spark, [(0, near), (1, long), (1, two), (2, two)])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(0, 0), (1, 0), (1, 1), (2, 1)]


@pytest.mark.parametrize("radius", [1, 2])
def test_close_links_against_all_pairs(spark, radius):
    import random

    random.seed(radius)
    prints = {0, 9, 1, 3, (1 << 64) - 1} | {random.getrandbits(64) for _ in range(20)}
    for fp in list(prints):
        for k in (1, 1, 2, 2, 3):
            for bit in random.sample(range(64), k):
                fp ^= 1 << bit
            prints.add(fp)
    signed = {x: x - (1 << 64) if x >> 63 else x for x in prints}
    nodes = spark.createDataFrame([(v, v) for v in signed.values()], "fp bigint, node bigint")
    got = {(r.u, r.v) for r in simhash_dedup.close_links(nodes, radius).collect()}
    pairs = {(a, b): (a ^ b).bit_count() for a, b in itertools.combinations(sorted(prints), 2)}
    link = lambda edges: {frozenset(c) for c in _classes(signed.values(), edges)}
    assert link(got) == link([(signed[a], signed[b]) for (a, b), d in pairs.items() if d <= radius])


def _classes(nodes, edges):
    root = {n: n for n in nodes}
    for u, v in edges:
        a, b = root[u], root[v]
        root = {k: a if r == b else r for k, r in root.items()}
    found = {}
    for n, r in root.items():
        found.setdefault(r, set()).add(n)
    return found.values()


def test_line_dedup(spark, odd, none):
    long = " ".join(f"w{i}" for i in range(1100))
    texts = [(1, "a b c d e f\nx y\n\nkeep me"), (2, "A b c d e f\na b c Z e f"), (3, "x y\na b c d e\nq r s t"), (4, "q r s u"), (5, long), (6, long.replace("w700 ", "")), (7, long.replace("w3 ", "k ").replace("w9 ", "k ")), (8, None)]
    got = {r.doc_id: r.text for r in linededup.report(spark, docs_of(spark, texts)).collect()}
    assert got == {1: texts[0][1], 2: "", 3: "q r s t", 4: "q r s u", 5: long, 6: "", 7: texts[6][1], 8: None}
    assert linededup.dedup_lines(spark, odd).count() == len(ODD)
    assert linededup.keep_lines(spark, odd).columns == odd.columns
    assert linededup.report(spark, none).count() == 0
