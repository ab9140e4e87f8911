"""Operators on graphs small enough to see the answer."""

from pyspark.sql import functions as F

from graphweft.operators import algorithms, merge, paths, suggest


def test_alignment_distance(spark):
    cases = [("abc", "abc", 2, 0), ("abc", "acb", 2, 1), ("abc", "ab", 2, 1), ("", "ab", 2, 2), ("abcd", "", 2, 3), ("abcdef", "ghijkl", 3, 4), ("ca", "abc", 3, 3), ("ab", "ba", 1, 1)]
    for a, b, most, want in cases:
        got = spark.createDataFrame([(a,)], "a string").select(suggest.alignment_distance(F.col("a"), b, most).alias("d")).first().d
        assert got == want, (a, b, most)


def test_strong_components(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (5, 7), (7, 8), (8, 9), (9, 7), (0, 9)]
    got = {r.node: r.component for r in algorithms.strong_components(spark.createDataFrame(pairs + pairs[:3], "src int, dst int")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 7, 0: 0}


def test_strong_components_of_nothing(spark):
    assert algorithms.strong_components(spark.createDataFrame([], "src int, dst int")).isEmpty()


def test_a_bridge_carries_all_pairs(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4)], "src int, dst int")
    got = {(r.a, r.b): r.betweenness for r in algorithms.edge_betweenness(pairs, 5).collect()}
    assert got[(3, 4)] == 9.0 and got[(1, 2)] == 1.0 and got[(1, 3)] == 4.0


def test_promotion_keeps_the_first_origin_and_can_be_undone(spark):
    edges = spark.createDataFrame([("a", "INFERRED"), ("b", "LSP_VERIFIED")], "from_id string, provenance string")
    twice = merge.promote(merge.promote(edges))
    assert {(r.from_id, r.was) for r in twice.collect()} == {("a", "INFERRED"), ("b", None)}
    assert sorted(merge.restore(twice).collect()) == sorted(edges.collect())


def test_betweenness_in_batches_is_that_of_plain_brandes(spark):
    import random
    from collections import defaultdict

    dice = random.Random(5)
    edges = {tuple(sorted(dice.sample(range(14), 2))) for _ in range(26)}
    next_to = defaultdict(set)
    for a, b in edges:
        next_to[a].add(b)
        next_to[b].add(a)
    want = dict.fromkeys(edges, 0.0)
    for s in list(next_to):
        order, depth, ways = [s], {s: 0}, defaultdict(int, {s: 1})
        for u in order:
            for v in next_to[u]:
                if v not in depth:
                    depth[v] = depth[u] + 1
                    order.append(v)
                if depth[v] == depth[u] + 1:
                    ways[v] += ways[u]
        owed = defaultdict(float)
        for v in reversed(order):
            for u in next_to[v]:
                if depth[u] == depth[v] - 1:
                    share = ways[u] / ways[v] * (1 + owed[v])
                    owed[u] += share
                    want[tuple(sorted((u, v)))] += share / 2
    got = {(r.a, r.b): r.betweenness for r in algorithms.edge_betweenness(spark.createDataFrame(sorted(edges), "src int, dst int"), 20, sources=5).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    assert algorithms.edge_betweenness(spark.createDataFrame([(1, 1)], "src int, dst int"), 3).count() == 0


def test_a_path_from_both_ends_is_that_of_one_search(spark, monkeypatch):
    import random

    dice = random.Random(3)
    relations = ["CALLS", "OVERRIDDEN_BY"]
    edges = sorted({(f"n{dice.randrange(40):02}", f"n{dice.randrange(40):02}", dice.choice(relations)) for _ in range(75)})
    frame = spark.createDataFrame(edges, "from_id string, to_id string, relation string").cache()

    def plain(start, end, most):
        level, via = {start}, {start: None}
        for _ in range(most):
            new = {}
            for a, b, r in edges:
                if a in level and b not in via:
                    new[b] = min(new.get(b, (9, "", "")), (relations.index(r), a, r))
            via |= new
            level = set(new)
            if end in via:
                way, node = [], end
                while via[node]:
                    way.append((via[node][1], node, via[node][2]))
                    node = via[node][1]
                return way[::-1]
        return None

    for named, pairs in ((256, [("n00", "n07"), ("n03", "n31"), ("n11", "n02")]), (0, [("n00", "n07"), ("n05", "n22")])):
        monkeypatch.setattr(paths, "NAMED", named)
        for start, end in pairs:
            got = paths.shortest_path(frame, start, end, relations, 12)
            want = plain(start, end, 12)
            assert (got is None) == (want is None) and (got is None or [tuple(r)[1:] for r in got.collect()] == want)


def test_many_suggestions_are_those_of_each_name(spark):
    import random

    dice = random.Random(11)
    labels = ["".join(dice.choice("abc") for _ in range(n)) for n in [1, 2, 3, 5, 8, 11, 12, 13, 14, 17, 18, 19, 24] * 6]
    labels += ["", "pkg.Load_all", "Load_All", "a::b#parse", "ünïcode_name_of_thirteen", "x" * 300]

    def spoil(text):
        letters = list(text)
        for _ in range(dice.randint(0, 3)):
            k = dice.randrange(len(letters) + 1)
            how = dice.randrange(4)
            if how == 0:
                letters.insert(k, dice.choice("abc"))
            elif how == 1 and letters:
                del letters[k - 1]
            elif how == 2 and letters:
                letters[k - 1] = dice.choice("abcd")
            else:
                letters[k - 2 : k] = letters[k - 2 : k][::-1]
        return "".join(letters)

    names = sorted({spoil(x) for x in labels[::4]} - {""}) + ["x.load_all", "LOAD_ALL", "prase", "ünicode_nmae_of_thirteen", "x" * 299, "ends."]
    nodes = spark.createDataFrame([(x,) for x in [*labels, labels[3], None]], "label string").cache()
    got = {}
    for r in suggest.suggestions_many(nodes, spark.createDataFrame([(x,) for x in [*names, names[0], None]], "name string"), 5).collect():
        got.setdefault(r.name, []).append((r["rank"], r.label))
    low = lambda x: x.lower().replace("::", ".").rsplit(".", 1)[-1]

    def distance(a, b):
        rows = [list(range(len(b) + 1))]
        for i in range(1, len(a) + 1):
            rows.append([i])
            for j in range(1, len(b) + 1):
                least = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                swap = i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]
                rows[i].append(min(least, rows[i - 2][j - 2] + 1) if swap else least)
        return rows[-1][-1]

    for name in names:
        leaf = low(name)
        most, want = min(3, max(1, len(leaf) // 6)), []
        for label in set(labels):
            own = low(label).rsplit("#", 1)[-1]
            plain = 0 if label.lower() == name.lower() else 1 if own == leaf else 2 if own.startswith(leaf) else 3 if leaf in label.lower() else None
            if plain is None and abs(len(own) - len(leaf)) <= most:
                d = distance(own, leaf)
                plain = 4 + d if d <= most else None
            if plain is not None and leaf:
                want.append((plain, label))
        assert sorted(got.get(name, [])) == sorted(want)[:5], name
