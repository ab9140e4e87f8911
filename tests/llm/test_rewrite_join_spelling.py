"""Operators 11 to 13 against plain Python versions, and on odd rows."""

import datetime
import glob
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from graphweft.llm import drift, ngram_join, queries, schema_rewrite, simhash_dedup, spelling

SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# op 11


def expected_files(rows):
    """{file_no: (version, rows after the rewrite)} by plain sorting."""
    rows = sorted(rows, key=lambda r: (-1 if r["client_id"] is None else zlib.crc32(str(r["client_id"]).encode()), r["client_id"] or 0))
    size = 1 + len(rows) // 500
    files = {}
    for r, row in enumerate(rows):
        file_no = r // size
        version = zlib.crc32(f"42:{file_no}".encode()) % 24
        version = 0 if version > 15 else version
        row = dict(row)
        if version & 4:
            row["nation_id"], row["source"] = -1, "none"
        if version & 8 and row["balance"] is not None:
            row["balance"] = float(np.float32(row["balance"]))
        files.setdefault(file_no, (version, []))[1].append(row)
    return files


def line(row):
    text = lambda k, v: "?" if v is None else str((v - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)) if k == "updated_at" else str(math.floor(1048576 * v)) if k == "balance" else str(v)
    return "|".join(text(k, v) for k, v in row.items())


def start_names(names, version):
    names = [names[0], *(reversed(names[1:]) if version & 2 else names[1:])]
    names = [n for n in names if not (version & 4 and n in ("nation_id", "source"))]
    return [{"name": "email", "email": "name"}.get(n, n) if version & 1 else n for n in names]


def test_schema_rewrite_against_brute_force(spark):
    rows = pq.read_table(f"{SF}/clients.parquet").to_pylist()
    names = list(rows[0])
    files = expected_files(rows)
    got = {r.file_no: r for r in queries.QUERIES["op11_schema_rewrite"](spark, SF).collect()}
    assert set(got) == set(files)
    folder = os.path.dirname(os.path.dirname(got[0].path)).removeprefix("file:")
    assert sorted(glob.glob(f"{folder}/**/*.parquet", recursive=True)) == sorted(r.path.removeprefix("file:") for r in got.values())
    for file_no, (version, own) in files.items():
        r = got[file_no]
        assert (r.version, r.n_rows, r.n_nulls) == (version, len(own), sum(v is None for row in own for v in row.values()))
        assert r.ids_sha256 == hashlib.sha256(",".join(str(row["client_id"]) for row in own).encode()).hexdigest()
        assert r.rows_sha256 == hashlib.sha256("\n".join(map(line, own)).encode()).hexdigest()
        assert r.start_columns.split(",") == start_names(names, version) and r.columns.split(",") == names
        assert r.rewritten == (version != 0)
        schema = pq.read_schema(r.path.removeprefix("file:"))
        assert [int(f.metadata[b"PARQUET:field_id"]) for f in schema] == list(range(1, 11))
        assert str(schema.field("nation_id").type) == "int64" and str(schema.field("balance").type) == "double"


def test_files_of_the_target_schema_keep_their_bytes(spark, tmp_path):
    clients = spark.read.parquet(f"{SF}/clients.parquet").limit(40)
    target = drift.target_of(clients)
    folder = f"file://{tmp_path}/table"
    drift.write_files(spark, clients, folder, "file_no", target)
    local = folder.removeprefix("file://")
    state = lambda: {p: (os.stat(p).st_mtime_ns, os.stat(p).st_size) for p in glob.glob(f"{local}/**/*.parquet", recursive=True)}
    before = state()
    found = schema_rewrite.rewrite(spark, folder, "file_no", target, drift.MISSING).collect()
    after = state()
    kept = {r.path.removeprefix("file:") for r in found if not r.drifted}
    assert kept and {p: after.get(p) for p in kept} == {p: before[p] for p in kept}
    assert not {r.path.removeprefix("file:") for r in found if r.drifted} & set(after)
    assert not schema_rewrite.rewrite(spark, folder, "file_no", target, drift.MISSING).filter("drifted").count() and state() == after


def test_many_paths_take_several_jobs(spark, monkeypatch):
    monkeypatch.setattr(schema_rewrite, "MOST_PATHS", 20)
    clients = spark.read.parquet(f"{SF}/clients.parquet").limit(60)
    files = expected_files([r.asDict() for r in clients.collect()])
    got = drift.report(spark, clients).collect()
    assert {r.file_no: r.rows_sha256 for r in got} == {k: hashlib.sha256("\n".join(map(line, own)).encode()).hexdigest() for k, (_, own) in files.items()}


def test_schema_rewrite_on_odd_rows(spark):
    clients = spark.read.parquet(f"{SF}/clients.parquet")
    assert drift.report(spark, clients.limit(0)).count() == 0
    odd = clients.limit(12).selectExpr(*clients.columns, "client_id file_no", "'x' `a.b`", "1 _row")
    none = odd.limit(2).selectExpr("cast(null as bigint) client_id", *odd.columns[1:10], "file_no", "`a.b`", "_row")
    rows = drift.report(spark, odd.union(odd).union(none)).collect()
    assert sum(r.n_rows for r in rows) == 26 and all(r.columns.split(",") == odd.columns for r in rows)
    bare = clients.selectExpr(*("cast(null as {}) {}".format(t, c) for c, t in clients.dtypes)).limit(3)
    rows = drift.report(spark, bare).collect()
    assert sum(r.n_rows for r in rows) == 3 and {r.n_nulls for r in rows} <= {8, 10}


# op 12


def sets_of(texts, words):
    found = []
    for text in texts:
        own = re.findall("[^\x20\x09-\x0d]+", (text or "").encode().lower().decode())
        found.append({" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set())
    return found


def classes_of(ids, texts, words, percent):
    sets = sets_of(texts, words)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[max(find(i), find(j), key=lambda k: ids[k])] = min(find(i), find(j), key=lambda k: ids[k])
    return {d: (len(s), ids[find(i)]) for i, (d, s) in enumerate(zip(ids, sets))}


def planted(seed):
    """Texts with a passage that many share, copies with more and more words replaced, and large groups of near copies."""
    random.seed(seed)
    word = lambda: f"w{random.randint(0, 5000)}"
    shared, texts = [word() for _ in range(40)], []

    def edited(base, edits):
        copy = list(base)
        for _ in range(edits):
            copy[random.randrange(len(copy))] = word()
        return " ".join(copy)

    for _ in range(20):
        base = shared + [word() for _ in range(random.randint(20, 200))]
        texts += [edited(base, k) for k in (0, 0, 1, 2, 3, 5, 8)]
    base = [word() for _ in range(300)]
    texts += [edited(base, random.randint(1, 10)) for _ in range(60)]
    chain = [word() for _ in range(100)]
    for _ in range(20):  # each links with the next only
        texts.append(" ".join(chain))
        chain = chain[1:] + [word()]
    texts += [" ".join(shared[:k]) for k in (0, 1, 2, 3, 20, 39, 40)] + ["", "  ", "\t\x0b", "A b", "a B"]
    random.shuffle(texts)
    return texts


@pytest.mark.parametrize(("words", "percent", "width"), [(3, 90, 1), (5, 80, 1 << 18)])
def test_ngram_join_against_brute_force(spark, monkeypatch, words, percent, width):
    monkeypatch.setattr(ngram_join.counters, "__defaults__", (width,))
    texts = planted(words + width)
    want = classes_of(list(range(len(texts))), texts, words, percent)
    got = ngram_join.report(spark, docs_of(spark, list(enumerate(texts))), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(texts) - 60


def test_ngram_join_over_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = queries.QUERIES["op12_ngram_join"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes_of([r.doc_id for r in rows], [r.text for r in rows], 3, 90)


def test_ngram_join_on_odd_rows(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, one), (7, one), (5, two), (5, two), (5, one), (9, None), (8, ""), (8, None), (None, ""), (None, "lone text here"), (3, "x " * 200_000)]
    docs = docs_of(spark, rows).selectExpr("*", "'k' node", "1 `a.b`", "2 n", "3 component")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.report(spark, docs).collect()), key=str)
    assert got == sorted([(None, 58, 5), (7, 58, 5), (5, 58, 5), (5, 58, 5), (5, 58, 5), (9, 0, 9), (8, 0, 8), (8, 0, 8), (None, 0, None), (None, 1, None), (3, 1, 3)], key=str)
    assert ngram_join.report(spark, docs.limit(0)).count() == 0
    textual = spark.createDataFrame([("b", one), ("a", one)], "doc_id string, text string")
    assert {r.component_id for r in ngram_join.report(spark, textual).collect()} == {"a"}


def test_near_dedup_keeps_one_of_each_class(spark):
    texts = planted(9)
    want = {c for _, c in classes_of(list(range(len(texts))), [t if t.split() else "nothing" for t in texts], 5, 80).values()}
    assert {r.doc_id for r in simhash_dedup.keep_one(spark, docs_of(spark, list(enumerate(texts)))).collect()} == want


# op 13


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[at + 1 :] == b[at + 1 :] or a[at:] == b[at + 1 :] or a[at + 1 :] == b[at:]


def groups_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for a in words:
        near[a] = [b for k in (-1, 0, 1) for b in by_length.get(len(a) + k, ()) if one_edit(a, b)]
    form = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: v if v and words[v] >= 2 * words[w] else None for w, v in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def spelt(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_spelling_over_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = groups_of(rows)
    got = spelt(queries.QUERIES["op13_spelling"](spark, SF))
    assert got == want and any(r[0] for r in want.values())


def test_spelling_of_chains_ties_and_long_words(spark):
    text = lambda word, n: f"{word} " * n
    long = "ab" * 100_000
    rows = [(1, text("abcdefgh", 3)), (2, text("abcdefg", 6)), (3, text("abcdef", 12) + text("abcde", 24)), (4, text("bbcde", 24)), (5, text("ébcde", 24) + text("ÉBCDE", 9)), (6, None), (None, "zzzzz zzzzz"), (7, ""), (8, text(long, 3)), (9, text(long + "c", 6)), (10, text("a×÷bc", 5) + text("kkkkk", 2)), (1, text("AAAAA", 4)), (11, text("aaaaaa", 9) + text("\U0001d41eaaaaa", 2))]
    docs = docs_of(spark, rows)
    got = spelt(spelling.report(spark, docs.selectExpr("*", "'x' word", "1 n", "2 `a.b`")))
    assert got == groups_of(rows)
    assert got["abcdefgh"][1] in ("abcde", "bbcde") and got[long][0] == long + "c"
    assert spelling.report(spark, docs.limit(0)).count() == 0


def test_spelling_broadcasts_no_table_that_grows_with_the_texts(spark):
    words = spark.createDataFrame([("abcdef", 3), ("abcdeg", 9)], "word string, n bigint")
    plans = [spelling.near_words(words), spelling.report(spark, docs_of(spark, [(1, "abcdef " * 3 + "abcdeg " * 9)]))]
    for frame in plans:
        assert frame.count() == 2
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_every_deletion_has_its_own_hash():
    random.seed(1)
    seen = {}
    for _ in range(3000):
        word = "".join(random.choice("abcéÿ") for _ in range(random.randint(0, 9)))
        keys = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
        hashes = {k: int(spelling.deletions(k)[0]) if not k else None for k in keys}
        assert len(spelling.deletions(word)) == len(keys), (word, hashes)
        for key in keys:
            own = set(spelling.deletions(key).tolist()) & set(spelling.deletions(word).tolist())
            assert own
        seen[word] = spelling.deletions(word)
    for a, b in itertools.combinations(list(seen)[:400], 2):
        share = {a, *(a[:i] + a[i + 1 :] for i in range(len(a)))} & {b, *(b[:i] + b[i + 1 :] for i in range(len(b)))}
        assert bool(share) == bool(set(seen[a].tolist()) & set(seen[b].tolist())), (a, b)
