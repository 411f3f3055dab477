"""Vector codes, the n-gram join and the filter audit against brute force, SQL and their edge cases."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import filter_audit, language, ngram_join, queries, toxicity, vector_codes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, lang string, text string"
VECTORS = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_ngram_join", "op13_filter_audit"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    expected = con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in expected.description)
    place = [[c[0] for c in expected.description].index(n) for n in names]
    assert sorted(found.columns) == names
    assert sorted(tuple(map(str, r)) for r in found.select(names).collect()) == sorted(tuple(str(r[i]) for i in place) for r in expected.fetchall())


# 11 vector codes


def brute_codes(rows, parts, entries, rounds):
    """Codes, errors and final books of (vec_id, integer vector) rows, one distance at a time."""
    rows = sorted(rows, key=lambda r: r[0])
    width = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[list(cut(v, p)) for _, v in rows[:entries]] for p in range(parts)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v, p: min(range(len(books[p])), key=lambda e: (away(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        chosen = {(i, p): best(v, p) for i, (_, v) in enumerate(rows) for p in range(parts)}
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v, p) for i, (_, v) in enumerate(rows) if chosen[i, p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    codes = {i: [best(v, p) for p in range(parts)] for i, v in rows}
    errors = {i: sum(away(cut(v, p), books[p][codes[i][p]]) for p in range(parts)) for i, v in rows}
    return codes, errors, books


@pytest.mark.parametrize("spread, tree_rows", [(0.004, 16_384), (3.0, 7)])
def test_codes_equal_brute_force(spark, spread, tree_rows):
    """Close points (many ties and repeated rows) and distant ones; partitions of one and of many trees."""
    rng = np.random.default_rng(5)
    vectors = [(i * 3 - 50, None, [float(x) for x in np.float32(rng.normal(0, spread, 8))]) for i in range(90)]
    vectors += [(i + 1000, 1, v) for i, (_, _, v) in enumerate(vectors[:20])]
    policy = vector_codes.CodePolicy(parts=4, entries=9, rounds=3, tree_rows=tree_rows, leaf=2)
    coded, books = vector_codes.encode_vectors(spark.createDataFrame(vectors, VECTORS).repartition(3), policy)
    codes, errors, expected = brute_codes([(i, [int(np.floor(np.float32(x) * 1024.0)) for x in v]) for i, _, v in vectors], 4, 9, 3)
    assert {r.vec_id: r.code for r in coded.collect()} == codes and {r.vec_id: r.error for r in coded.collect()} == errors
    assert [b.tolist() for b in books[8]] == expected
    text = ",".join(str(x) for part in expected for entry in part for x in entry)
    assert vector_codes.digest_of(books[8]) == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed", range(5))
def test_subtrees_go_to_the_nearest_entry(seed):
    """Few distinct values, so that corners of boxes lie between entries exactly."""
    rng = np.random.default_rng(seed)
    points, entries = rng.integers(-4, 5, (300, 3)), rng.integers(-4, 5, (12, 3))
    tree = vector_codes.PartTree(points, 4)
    away = ((points[:, None, :] - entries[None]) ** 2).sum(2)
    found, distance = tree.nearest(entries)
    assert (found == away.argmin(1)).all() and (distance == away.min(1)).all()
    sums, counts = tree.gathered(entries)
    assert (counts == np.bincount(away.argmin(1), minlength=12)).all()
    assert all((sums[e] == points[away.argmin(1) == e].sum(0)).all() for e in range(12))


def test_codes_visit_fewer_entries_than_there_are():
    rng = np.random.default_rng(1)
    points = (rng.normal(0, 40, (2000, 2)) + rng.integers(0, 8, (2000, 1)) * 5000).astype(np.int64)
    tree = vector_codes.PartTree(points, 4)
    whole = [(start, end) for start, end, at in tree.assign(points[:64]) if not np.ndim(at)]
    assert sum(e - s for s, e in whole) > 0
    assert any(e - s > 1 for s, e in whole)


def test_codes_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, None), (2, 0, [1.0, None]), (3, 0, [nan, 1.0]), (4, 0, [inf, 1.0]), (5, 0, []), (6, None, [0.0, 0.0]), (7, None, [0.5, -0.5]),
        (7, None, [0.5, -0.5]), (None, 2, [0.25, 0.25]), (8, 2, [1.0, 2.0, 3.0]), (9, 2, [3e38, -3e38]),
    ]
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("code", "error", "dim", "count", "part", "entry", "_label"):
        df = df.withColumn(name, F.lit("clash"))
    found = vector_codes.op11_vector_codes(df).collect()
    assert sorted(str(r.vec_id) for r in found) == ["5", "6", "7", "7", "8", "9", "None"]
    by = {r.vec_id: r for r in found}
    assert by[6].label_error == by[7].label_error == by[6].error + 2 * by[7].error
    assert len({r.codebooks_sha256 for r in found}) == 3, "each length of vectors has its books"
    assert vector_codes.op11_vector_codes(df.limit(0)).count() == 0
    assert vector_codes.op11_vector_codes(df.where("vec_id < 5")).count() == 0


# 12 n-gram join


def brute_join(rows, words=4, percent=85):
    lower = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[root(i)] = root(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted((str(d), len(sets[i]), str(least[root(i)])) for i, (d, _) in enumerate(rows))


def near_texts(seed, most=220):
    """Texts of 1 to `most` words with copies that lie on both sides of the bound, chains of them, and shared passages."""
    rng, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(30)]
    for _ in range(40):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([1, 3, 4, 9, 10, 11, 12, 14, 20, 40, 90, most]))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice([1, 3, 7])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(copy))
                kind = rng.random()
                if kind < 0.5:
                    copy[at] = f"w{rng.randrange(900)}"
                elif kind < 0.8:
                    copy.insert(at, f"w{rng.randrange(900)}")
                elif len(copy) > 1:
                    copy.pop(at)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
            if rng.random() < 0.3:
                base = copy
    return rows


@pytest.mark.parametrize("seed, policy", [(0, ngram_join.JoinPolicy()), (1, ngram_join.JoinPolicy(block_rows=3, block_entries=200)), (2, ngram_join.JoinPolicy(hot_rows=2, hot_sample=1))])
def test_join_equals_brute_force(spark, seed, policy):
    rows = near_texts(seed)
    found = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), policy).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute_join(rows)


def test_linked_sets_have_a_key_in_common():
    """For any sizes from 1 on: two sets at the bound exactly meet, whichever members differ."""
    rng, policy = np.random.default_rng(3), ngram_join.JoinPolicy()
    for n in [*range(1, 60), 137, 200, 450, 1000]:
        for m in {n, n + 1, n * 100 // 85}:
            need = int(ngram_join.least_overlap(85, n, np.array(m)))
            if need > n:
                continue
            for _ in range(20):
                pool = rng.integers(0, 1 << 64, n + m, dtype=np.uint64)
                a, b = np.unique(pool[:n]), np.unique(np.r_[pool[:need], pool[n : n + m - need]])
                if need == n == m:
                    assert ngram_join.node_of(a) == ngram_join.node_of(b)
                else:
                    assert len(np.intersect1d(ngram_join.block_keys(a, policy), ngram_join.block_keys(b, policy)))


def test_sets_have_no_more_keys_than_links_need():
    """One more than the blocks in which linked sets may differ from it, if the set fills so many; sets at the bound still meet."""
    rng, policy = np.random.default_rng(12), ngram_join.JoinPolicy()
    for n in (150, 170, 300, 333, 337, 500, 1000, 3000):
        grams = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        layouts = ngram_join.column_layouts(n, policy)
        assert len(ngram_join.block_keys(grams, policy)) == sum(differing + 1 for _, _, differing in layouts)
        assert all(differing <= (n + n * 100 // 85) * 15 // 185 for _, _, differing in layouts)
    for _ in range(3000):
        n = int(rng.integers(6, 400))
        m = int(rng.integers(n, n * 100 // 85 + 1))
        need = int(ngram_join.least_overlap(85, n, np.array(m)))
        if need <= n:
            pool = rng.integers(0, 1 << 64, n + m, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.r_[pool[:need], pool[n : n + m - need]])
            assert len(np.intersect1d(ngram_join.block_keys(a, policy), ngram_join.block_keys(b, policy)))


@pytest.mark.parametrize("width", [1, 5, 128])
def test_product_of_blocks_counts_overlaps(width):
    rng = np.random.default_rng(8)
    base = rng.choice(400, 60, replace=False)
    sets = [np.unique(np.r_[base[: rng.integers(50, 61)], rng.choice(400, rng.integers(1, 12))]).astype(np.uint64) for _ in range(40)]
    block = ngram_join.Incidence(sets)
    for i in range(40):
        expected = [j for j in range(40) if j != i and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        assert block.linked(i, np.arange(40) != i, 85, width).tolist() == expected


def test_folded_sets_lose_no_link():
    """Folds of many members collide; whatever they lose, sets that link are found."""
    import pandas as pd

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: 20_000 - k], rng.integers(0, 1 << 64, k, dtype=np.uint64)]) for k in (0, 1500, 1620, 1700, 6000)]
    block = ngram_join.Incidence([np.frombuffer(ngram_join.fold(s), "<u2") for s in sets], np.array([len(s) for s in sets]))
    exact = ngram_join.Incidence(sets)
    for i in range(5):
        assert set(exact.linked(i, np.arange(5) != i, 85)) <= set(block.linked(i, np.arange(5) != i, 85))
    group = pd.DataFrame({"node": range(5), "linked": False, "near": False, "label": range(5), "grams": [s.view(np.int64) for s in sets]})
    assert sorted(ngram_join.block_links(group, 85).itertuples(index=False, name=None)) == [(0, 1), (0, 2)]


def test_join_with_folds_that_mislead(spark, monkeypatch):
    """With almost nothing left of the folded sets, blocks are done again with whole ones."""
    monkeypatch.setattr(ngram_join, "fold", lambda grams: np.unique((grams & np.uint64(3)).astype("<u2")).tobytes())
    rows = near_texts(4, 60)
    found = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.JoinPolicy(block_rows=20)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute_join(rows)


def test_rows_without_match_are_left_out_before_the_join(spark):
    rows = spark.range(-3000, 3000).select(F.when(F.col("id") != 5, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    wanted = [None, *range(-3000, 3000, 40)]
    few = spark.createDataFrame([(i,) for i in wanted], "_id long")
    found = [r.doc_id for r in ngram_join._among(rows, "doc_id", few).collect()]
    assert set(wanted) <= set(found) and len(found) == len(set(found)) < 2 * len(wanted) + 50


def test_only_likely_pairs_move_whole_sets(spark, monkeypatch):
    """Of texts that meet by a passage only, folded sets are compared and no whole ones are stored; keys of the same sets are one."""
    rng, stored, save = random.Random(6), {}, ngram_join.saved

    def spy(df, name):
        found = save(df, name)
        stored.setdefault(name, []).append((found.columns, found.count()))
        return found

    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(60)] + passage)) for i in range(12)]
    copy = [f"c{i}" for i in range(150)]
    rows += [(20, " ".join(copy)), (21, " ".join([*copy, "more"]))]
    monkeypatch.setattr(ngram_join, "saved", spy)
    found = ngram_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute_join(rows)
    assert stored["pairs"][0][1] > 1 and "grams" not in stored["sets"][0][0]
    assert [n for _, n in stored["whole"]] == [2]
    copies = spark.createDataFrame(rows[-2:], "doc_id long, text string")
    assert ngram_join.meetings(save(ngram_join.sketch_sets(copies, ngram_join.JoinPolicy()), "sketches"), ngram_join.JoinPolicy()).count() == 1


def test_join_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "word " * 30_000), (5, "x" * 200_000), (6, "Same text HERE for two rows of it"), (6, "same text here for two rows of it"),
        (None, "no id"), (None, "No ID"), (7, "ÄÖ word"), (8, "äö word"), (9, "one two three"), (10, "one  two\x0bTHREE"), (11, "one two"), (12, "a\xa0b c d e"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("node", "size", "keys", "label", "key", "rep", "_id", "component_id", "grams"):
        df = df.withColumn(name, F.lit("clash"))
    found = ngram_join.op12_ngram_join(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found) == brute_join(rows)
    assert ngram_join.op12_ngram_join(df.limit(0)).count() == 0


# 13 filter audit


def brute_audit(rows, labels):
    """Applies the filters one after the other to lists of rows, for every order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    seen, held = {}, []
    for doc_id, _, text in rows:
        if doc_id is not None:
            seen[text or ""] = min(seen.get(text or "", doc_id), doc_id)
    for doc_id, lang, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": doc_id is not None and seen[text] < doc_id,
        }
        held.append((lang or "", {k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out, shapley = {}, {}
    for part in {h[0] for h in held}:
        for order in itertools.permutations("ABCDE"):
            left, gone = [h for h in held if h[0] == part], []
            for step, f in enumerate(order, 1):
                away = [h for h in left if f in h[1]]
                left = [h for h in left if f not in h[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(away)
                unique = sum(h[1] == {f} for h in held if h[0] == part)
                out[part, "".join(order), step] = (len(left), len(away), sum(f in h[1] for h in gone), unique, sum(h[2] for h in away), sum(h[3] for h in away))
                gone += away
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_texts(seed):
    rng, rows = random.Random(seed), []
    for i in range(120):
        n = rng.choice([0, 3, 99, 100, 130])
        w = [f"{rng.choice('aB')}{rng.randrange(rng.choice([20, 5000]))}" for _ in range(n)]
        text = " ".join(w) + rng.choice(["", "", "|", " # ", "$x"])
        rows.append((i * 5 % 121, rng.choice(["en", "de", None, ""]), rng.choice([text, text, None if n == 0 else text])))
    rows += [(200 + i, rng.choice(["en", "fr"]), rows[i % 7][2]) for i in range(30)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_audit_equals_filtering_in_every_order(spark, seed):
    rng, rows = random.Random(seed), audit_texts(seed)
    rows += [(3, "en", "repeated row"), (3, "en", "repeated row"), (4, "en", "repeated row"), (None, "en", "repeated row"), (None, None, "alone"), (900, "", "alone")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in rows if d is not None and rng.random() < 0.7] + [(3, 1, 1), (None, 1, 1), (12345, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("part", "mask", "n", "digest", "good", "toxic", "first", "named", "lowest", "quality"):
        docs = docs.withColumn(name, F.lit("clash"))
    found = filter_audit.op13_filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(1)))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    expected = brute_audit(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in found.collect()} == expected
    assert len(expected) == 600 * len({lang or "" for _, lang, _ in rows})


def test_shapley_is_exact_for_other_numbers_of_filters():
    from fractions import Fraction
    from math import factorial

    rng = random.Random(2)
    for filters in (1, 2, 3, 6):
        counts = {mask: rng.randrange(50) for mask in range(1 << filters)}
        p = filter_audit.RemovalPolynomial(counts, filters)
        removed = lambda on: sum(n for mask, n in counts.items() if mask & on)
        assert all(p.removed(on) == removed(on) for on in range(1 << filters))
        for i in range(filters):
            total = 0
            for order in itertools.permutations(range(filters)):
                on = sum(1 << f for f in order[: order.index(i)])
                total += removed(on | 1 << i) - removed(on)
            assert p.shapley(i) == Fraction(total, factorial(filters))


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.op13_filter_audit(docs, labels).count() == 0
    one = filter_audit.op13_filter_audit(spark.createDataFrame([(1, "en", None)], DOCS), labels).collect()
    assert len(one) == 600 and {r.kept for r in one if r.step == 5} == {0}


# 6, 7 samples


def test_samples_have_a_row_per_id(spark, monkeypatch):
    """One id on 3,000 rows of two languages: one row of it reaches the driver, the same in any order of rows."""
    from pyspark.sql.classic.dataframe import DataFrame

    received, whole = [], DataFrame.toPandas
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: received.append(whole(self)) or received[-1])
    rows = [(4, "de" if i % 2 else "en", f"text number {i:04d} of the one id") for i in range(3000)] + [(i, "fr", f"un texte {i}") for i in range(100, 160)]
    labels = spark.createDataFrame([(4, 1), (4, 0)] + [(i, i % 2) for i in range(100, 160)], "doc_id long, toxic int")
    found = []
    for order in (F.col("text").asc(), F.col("text").desc()):
        docs = spark.createDataFrame(rows, DOCS).orderBy(order)
        found.append((language.language_sample(docs, language.LanguagePolicy()), toxicity.labelled_sample(docs, labels, toxicity.ToxicityPolicy())))
    assert found[0] == found[1]
    assert len(received) == 4 and all(0 < len(r) <= 61 and r["doc_id"].is_unique for r in received)
    texts, langs = found[0][0]
    if "text number 0000 of the one id" in texts:
        assert langs[texts.index("text number 0000 of the one id")] == "de"
