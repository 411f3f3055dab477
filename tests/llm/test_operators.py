"""The dealt operators against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clickloom.llm import chat, fingerprints, html_text, language, mixing, near_dedup, neighbours, packing, queries, toxicity, warc
from clickloom.llm.common import saved, shared_dir, spread, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t", "en", "a", 3),
    (4, "word " * 30_000, "en", "b", 150_000),
    (5, "x" * 200_000, "fr", None, 200_000),
    (6, "same text here for two rows of it", "en", "a", 33),
    (6, "same text here for two rows of it", "en", "a", 33),
    (None, "no id", "en", "b", 5),
    (7, "Zażółć gęślą jaźń 🙂 <|endoftext|> ok", "pl", "b", 36),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Rows with nulls, empty, very long and repeated texts, and columns that operators use inside."""
    df = spark.createDataFrame(EDGE, DOCS)
    for name in ("score", "target", "source_size", "size", "node", "label", "key", "_text", "held_out", "class_id", "kept", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1 HTML


def test_html_layout():
    page = "<html><head><title>t</title><style>p{}</style></head><body><h1>Hi &amp; you</h1><p>a  b<p>c<br>d<ul><li>one<li>two<ul><li>in</ul></ul><ol start=3><li>x</ol>"
    page += "<table><tr><th>A<th>Long<tr><td>1<td>2</table><div hidden>no</div><pre>x\n  y</pre><p style='display: none'>z</p><script>if (a<b) c('</p>')</script>end<!-- c --> 5 < 6"
    assert html_text.page_text(page) == "\n".join(
        ["Hi & you", "", "a b", "", "c", "d", "", "- one", "- two", "  - in", "", "3. x", "", "A  Long", "1  2", "", "x", "  y", "", "end 5 < 6"]
    )


@pytest.mark.parametrize(
    "source, lines",
    [
        ("<table><tbody><td>a<td>b</table>", ["a  b"]),
        ("<table><thead><th>A<th>Long</thead><tr><td>1<td>2</table>", ["A  Long", "1  2"]),
        ("<table><td>a<td>b<tr><td>c<td>d</table>", ["a  b", "c  d"]),
        ("<table><tbody>loose<p>par</p><tr><td>a<td>b</tbody></table>", ["loose", "", "par", "", "a  b"]),
        ("<table><tbody><form><tr><td>a<td>b</tr><tr><td>c<td>d</tr></form></tbody></table>z", ["a  b", "c  d", "", "z"]),
        ("<table><tr><form><td>a<td>b</form></table>", ["a  b"]),
        ("<table><tr><td><table><tbody><td>in</table><td>b</table>", ["in  b"]),
    ],
)
def test_html_tables_without_rows(source, lines):
    assert html_text.page_text(source).split("\n") == lines


@pytest.mark.parametrize(
    "source, words_",
    [
        ("Pick <select><option>One<option selected>Two</select> now", "Pick One Two now"),
        ("<svg><title>no</title><defs><text>no</text></defs><path d='m'/><text x=1>North</text><text>South</text></svg>", "North South"),
        ("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>no</annotation></semantics></math> ok", "so x=1/2 ok"),
        ("<div>" * 600 + "<div style='display:none'>no<div>no</div>no</div><template>no</template>yes" + "</div>" * 600 + "end", "yes end"),
        ("<div>" * 600 + "<b>a</b>b<div>c</div>d", "ab c d"),
        ("<div>" * 600 + "<noscript>no</noscript><script>no</script><table><td>x<td>y</table>", "x y"),
    ],
)
def test_html_foreign_and_deep(source, words_):
    assert html_text.page_text(source).split() == words_.split()


@pytest.mark.parametrize(
    "source, lines",
    [
        ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", ["ab     c", "1   2  3"]),
        ("<table><tr><td rowspan=2>ab<td>c<tr><td>3</table>", ["ab  c", "    3"]),
        ("a<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>b", ["a", "yes", "b"]),
        ("x <a don't>text</a> y <a title=\"q>r\">z</a> 5 < 6<p end", ["x text y z 5 < 6"]),
    ],
)
def test_html_spans_and_visibility(source, lines):
    assert html_text.page_text(source).split("\n") == lines


@pytest.mark.parametrize(
    "source, words_",
    [
        ("<script><!-- x </script><p>Hello <b>bold</b></p>", "Hello bold"),
        ("<style><!-- p{} </style><p>Hello <b>bold</b></p><!-- no --><i>end</i>", "Hello bold end"),
        ("<script>for(i=0;i<n;i++){s=\"<a href='\"+x}</script><p>It's <b>bold</b></p>", "It's bold"),
        ("<textarea>a <b c='</textarea>d <i>e</i> it's", "a <b c=' d e it's"),
        ("<details><summary>more</summary>no<p>no</p></details><details open><summary>s</summary>yes</details>", "more s yes"),
        ("<p style=\"background:url('display:none')\">yes</p><p style='color:red; DISPLAY : none'>no</p>", "yes"),
    ],
)
def test_html_raw_elements_and_hidden_parts(source, words_):
    assert html_text.page_text(source).split() == words_.split()


def test_html_tables_stay_bounded():
    wide = "<table><tr><td>" + "w" * 20_000 + "<td>end" + "<tr><td>a<td>b" * 5000 + "</table>"
    text = html_text.page_text(wide)
    assert len(text) < 2 * len(wide) and text.split() == ["w" * 20_000, "end", *["a", "b"] * 5000]
    spanned = "<table>" + "<tr><td colspan=1000>x<td>y" * 500 + "</table>"
    assert html_text.page_text(spanned).split("\n") == ["x  y"] * 500
    many = "<table><tr>" + ("<td>" + "c" * 100) * 1000 + "<tr><td colspan=999>l<td>r" * 2000 + "</table>"
    assert len(html_text.page_text(many)) < 40 * len(many)


@pytest.mark.parametrize("part", ["<a b", '<a b="', "<a b='\"", "<", "<!", "<b x=<b x='<b"])
def test_html_unclosed_tags_take_linear_time(part):
    import time

    start = time.process_time()
    html_text.page_text(part * (1_000_000 // len(part)))
    assert time.process_time() - start < 5


def test_html_nesting_is_linear():
    assert html_text.page_text("<div><b>" * 30_000 + "<p>deep</i></p>" * 2000).split() == ["deep"] * 2000


@pytest.mark.parametrize("source", [None, "", "plain", "<", "<p", "</p>", "<li>a<li>b", "<table><td>x</table>", "<div>" * 3000 + "deep", "a" * 300_000, "<b><i>x</b>y</i>", "<script>never closed"])
def test_html_accepts_anything(source):
    text = html_text.page_text(source)
    assert isinstance(text, str) and "<div>" not in text


def test_html_keeps_all_visible_text(spark):
    pages = table(spark, SF, "pages").limit(40).collect()
    for p in pages:
        body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", p.html)
        import html

        expected = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        found = [w for w in html_text.page_text(p.html).split() if w != "-"]
        assert "".join(found) == "".join(w for w in expected if w != "-")


def test_html_query(spark):
    pages = spark.createDataFrame([(1, None, None, "c"), (None, "u", "<p>x", "c"), (2, "u", "", "c")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.op1_html_text(pages).collect()) == [(0, "x"), (1, ""), (2, "")]
    assert html_text.op1_html_text(pages.limit(0)).count() == 0


# 2 fingerprints


def winnow(text, k=5, w=8):
    tokens = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    signed = [int.from_bytes(xxhash.xxh64_digest(x.encode(), 42), "big", signed=True) for x in tokens]
    prime, radix = fingerprints.PRIME, fingerprints.RADIX
    h = [x % prime for x in signed]
    h += [0] * (k - len(h) if h else 0)
    grams, rolling = [], 0
    for i, x in enumerate(h):
        rolling = (rolling * radix + x - (h[i - k] * pow(radix, k, prime) if i >= k else 0)) % prime
        if i >= k - 1:
            grams.append(rolling)
    out = []
    for i in range(max(1, len(grams) - w + 1) if grams else 0):
        window = grams[i : i + w]
        at = i + max(j for j, x in enumerate(window) if x == min(window))
        if (grams[at], at) not in out[-1:]:
            out.append((grams[at], at))
    return out


def brute_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc_id, text, *_) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        a, b, c = winnow(text), winnow(edited), winnow(after)

        def like(x, y):
            x, y = {m for m, _ in x}, {m for m, _ in y}
            return 1.0 if not x and not y else len(x & y) / len(x | y)

        show = lambda f: " ".join(f"{m:x}:{p}" for m, p in f)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(b), like(a, b), like(a, c)))
    return out


def test_fingerprints_equal_brute_force(spark, edge, empty):
    docs = table(spark, SF, "documents").limit(60)
    for df in (docs, edge):
        found = [tuple(r) for r in fingerprints.op2_winnowing(df).collect()]
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert sorted(map(str, found)) == sorted(map(str, brute_fingerprints(rows)))
    assert fingerprints.op2_winnowing(empty).count() == 0
    one = fingerprints.op2_winnowing(docs.limit(1)).first()
    assert one.near_next == 1.0


@pytest.mark.parametrize("k, window", [(1, 1), (2, 3), (3, 1), (7, 6), (12, 13)])
def test_fingerprints_of_other_sizes(spark, k, window):
    rows = [(1, "a b a b a b a b a b a b a b"), (2, " ".join(f"w{i % 17}" for i in range(90))), (3, "one two"), (4, "")]
    found = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string"), k, window).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {i: " ".join(f"{m:x}:{p}" for m, p in winnow(t, k, window)) for i, t in rows}


def test_fingerprints_many_buckets(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = fingerprints.with_next(docs, rows_per_bucket=7)
    assert rows.where("not _context").count() == docs.count() and rows.where("_wrap = 1").count() == 1
    sizes = rows.where("_context").groupBy("_bucket").count()
    assert sizes.count() == rows.select("_bucket").distinct().count() and sizes.agg(F.max("count")).first()[0] == 1


def test_fingerprints_stay_native(spark):
    plan = fingerprints.op2_winnowing(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# 3 WARC


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 2000
    rows = [(i, f"u{i}", f"<p>{i}</p>" * (i % 7 * 40)) for i in range(300)] + [(1000, None, big), (1001, "u", big), (1002, "u\r\nx", big), (None, "u", big), (1003, "u", None), (1002, "u", big)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    found = warc.op3_warc(pages).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found}
    for i, _, source in rows:
        payload = (source or "").encode()
        assert by_id[i].payload_bytes == len(payload) and by_id[i].payload_digest == hashlib.sha1(payload).hexdigest()
        group = [j for j, _, s in rows if s == source and j is not None and len(payload) >= 1000]
        refers = max(group) if i is not None and group and i < max(group) else None
        assert (by_id[i].record_type, by_id[i].refers_to) == (("revisit", refers) if refers is not None else ("response", None))
    assert sum(r.page_id == 1002 for r in found) == 2 and warc.op3_warc(pages.limit(0)).count() == 0


def test_warc_files(spark, tmp_path):
    archives, folder = warc.archive_pages(table(spark, SF, "pages"), warc.WarcPolicy(archive_bytes=20_000, sample_bytes=30_000))
    listed = archives.collect()
    assert len(listed) > 1 and sum(r.records for r in listed) == table(spark, SF, "pages").count()
    with open(listed[0].archive, "rb") as f:
        data = f.read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_MAGIC and len(data) == listed[0].bytes
    import zstandard

    content = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    record = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)).decompressobj().decompress(data[8 + size :])
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_warc_archives_smaller_than_the_sample(spark):
    policy = warc.WarcPolicy(archive_bytes=2000, sample_bytes=1 << 20)
    pages = table(spark, SF, "pages")
    archives, folder = warc.archive_pages(pages, policy)
    listed = archives.collect()
    assert len(listed) > 3 and sum(r.records for r in listed) == pages.count()
    assert warc.read_archives(archives, folder).select("page_id").distinct().count() == pages.select("page_id").distinct().count()


def test_warc_record_ids_are_unique_and_folders_may_be_remote(spark, monkeypatch):
    page = spark.createDataFrame([(5, "u", "<p>x"), (5, "u", "<p>x"), (None, None, "<p>x"), (None, None, "<p>x")], "page_id long, url string, html string")
    archives, folder = warc.archive_pages(page)
    target, _ = warc.file_system(folder)
    ids = [h["warc-record-id"] for r in archives.collect() for h, _ in warc.read_archive(target, r.archive)]
    assert len(ids) == len(set(ids)) == 4
    seen = []
    monkeypatch.setattr(warc.arrow_fs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda uri: seen.append(uri) or (None, uri))}))
    warc.file_system("s3a://bucket/folder"), warc.file_system("hdfs://host/folder")
    assert seen == ["s3://bucket/folder", "hdfs://host/folder"]


# 4 packing


def test_minimum_bin_slack():
    rng = random.Random(3)
    lengths = [rng.randint(1, 2047) for _ in range(600)]
    bins = packing.minimum_bin_slack(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(600))
    used = [sum(lengths[i] for i in b) for b in bins]
    assert max(used) <= 2048 and len(bins) <= 1.05 * sum(lengths) / 2048
    assert packing.minimum_bin_slack([], 8) == [] and packing.minimum_bin_slack([8, 8], 8) in ([[0], [1]], [[1], [0]])
    best = packing.minimum_bin_slack([6, 5, 5, 4, 3], 10)
    assert sorted(sorted([6, 5, 5, 4, 3][i] for i in b) for b in best) == [[3], [4, 6], [5, 5]]
    with pytest.raises(ValueError):
        packing.minimum_bin_slack([9], 8)


def test_bin_is_as_full_as_subset_sum_allows():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        first = packing.minimum_bin_slack(lengths, 30)[0]
        top = max(lengths)
        rest = list(lengths)
        rest.remove(top)
        sums = {0}
        for x in rest:
            sums |= {s + x for s in sums}
        assert sum(lengths[i] for i in first) == top + max(s for s in sums if s + top <= 30)


def test_packing_round_trip(spark, edge, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = table(spark, SF, "documents").limit(50).where("doc_id > 20").unionByName(edge.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id <> 6"))
    pieces = packing.op4_packing(docs).toPandas()
    for r in docs.collect():
        ids = slow.encode(r.text or "", add_special_tokens=False).ids + [1]
        own = pieces[pieces.doc_id == r.doc_id].sort_values("start")
        assert own.length.sum() == len(ids) and set(own.doc_tokens) == {len(ids)}
        for start, n, crc in zip(own.start, own.length, own.ids_crc32):
            assert crc == zlib.crc32(struct.pack(f"<{n}I", *ids[start : start + n]))
    for _, group in pieces.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group.length.sum() <= 2048 and group.offset.tolist() == [0, *group.length.cumsum().tolist()[:-1]]
    assert pieces.sequence_id.nunique() <= pieces.length.sum() / 2048 + 2
    assert packing.op4_packing(empty).count() == 0 and packing.op4_packing(edge).groupBy("doc_id").agg(F.sum("length")).count() == 8


# 5 neighbours


def test_neighbours_recall_and_contract(spark):
    vectors = table(spark, SF, "embeddings")
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in vectors.collect()}
    ids = np.array(sorted(rows))
    matrix = np.stack([rows[i] for i in ids])
    found = neighbours.op5_neighbours(vectors).toPandas()
    hit = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        scores = matrix @ rows[q]
        exact = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        own = found[found.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, [rows[i] @ rows[q] for i in own.vec_id], rtol=0, atol=1e-12)
        hit, total = hit + len(set(exact) & set(own.vec_id)), total + 20
    assert hit / total >= 0.9


def test_neighbours_large_block_recall():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((10, 64))
    vectors = centres[rng.integers(0, 10, 8192)] * 0.5 + rng.standard_normal((8192, 64))
    vectors *= rng.uniform(0.5, 2.0, (8192, 1))
    index = neighbours.BlockIndex(vectors, neighbours.NeighbourPolicy())
    ids, hit, share = np.arange(8192), 0, 0
    for i in range(0, 8192, 200):
        candidates = index.search(vectors[i])
        found, _ = neighbours._top(vectors[i], ids, vectors, candidates, 20)
        exact, _ = neighbours._top(vectors[i], ids, vectors, ids, 20)
        hit, share = hit + len(set(found) & set(exact)), share + len(candidates) / 8192
    assert hit / (41 * 20) >= 0.9 and share / 41 < 0.1


def test_neighbours_windows_count_exactly():
    rng = np.random.default_rng(2)
    vectors = np.round(rng.standard_normal((300, 6)), 1) + 0.01
    policy = neighbours.NeighbourPolicy(projections=16, verify_least=10)
    index = neighbours.BlockIndex(vectors, policy)
    draw = np.random.default_rng(policy.seed).standard_normal((7, 16))
    norms = (vectors**2).sum(1)
    values = np.c_[vectors, np.sqrt(norms.max() - norms)] @ draw
    for query in vectors[::30]:
        centre = query @ draw[:-1] * np.sqrt(norms.max() / (query @ query))
        level = 0
        while True:
            hits = (np.abs(values - centre) <= policy.start * np.sqrt(norms.max()) * policy.widen**level + 1e-12).sum(1)
            if (hits >= math.ceil(0.86 * 16)).sum() >= 10:
                break
            level += 1
        assert set(index.search(query)) == set(np.flatnonzero(hits >= math.ceil(0.86 * 16)))


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0]), (2, [2.0, 0.0]), (20, [-1.0, 0.0]), (20, [0.5, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    found = sorted(neighbours.op5_neighbours(df).collect(), key=lambda r: (r.query_id, r["rank"]))
    assert [(r.vec_id, r.score) for r in found if r.query_id == 0] == [(2, 2.0), (2, 2.0), (1, 1.0), (None, 1.0), (20, 0.5), (20, -1.0)]
    assert [r.vec_id for r in found if r.query_id == 20] == [20, 0, 1, None, 2, 2]
    assert neighbours.op5_neighbours(df.limit(0)).count() == 0


# 6 toxicity, 7 language


def test_toxicity_held_out(spark):
    docs, marks = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    found = toxicity.op6_toxicity(docs, marks).join(marks, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert set(held.doc_id) == {i for i in found.doc_id if zlib.crc32(str(i).encode()) % 3 == 1}
    english = held[held.lang == "en"]
    assert held.predicted[held.toxic == 1].mean() > 0.44 and english.predicted[english.toxic == 1].mean() > 0.8
    assert held.predicted[held.toxic == 0].mean() < 0.01
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()


def test_toxicity_edges(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.op6_toxicity(edge, none).collect()} == {0.0} and toxicity.op6_toxicity(empty, none).count() == 0
    toxic, clean = [f"you are a total brute number{i} indeed" for i in range(40)], [f"we like the quiet garden number{i} indeed" for i in range(80)]
    model = toxicity.train_toxicity(toxic, clean)
    scored = toxicity.score_toxicity(edge.select("doc_id", "text", "score"), model, "_s").collect()
    assert len(scored) == len(EDGE) and all(0 <= r._s <= 1 for r in scored)
    assert toxicity.train_toxicity(["a"], clean) is None


def test_toxicity_query_equals_window_by_window(spark):
    import zstandard

    docs, marks = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fitted(docs, marks)
    lengths = []
    for content in (model.ordinary, model.toxic + model.ordinary):
        kind = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters.from_level(7, source_size=512, dict_size=len(content), min_match=4, write_content_size=0, write_dict_id=0, write_checksum=0)
        kind.precompute_compress(compression_params=settings)
        lengths.append(zstandard.ZstdCompressor(dict_data=kind, compression_params=settings))
    found = {r.doc_id: r.score for r in toxicity.op6_toxicity(docs, marks).collect()}
    for r in docs.select("doc_id", "text").collect()[:300]:
        tokens, evidence = re.findall(r"\w+", (r.text or "").lower()), 0.0
        for i in range(0, len(tokens), 24):
            window = (" " + " ".join(tokens[i : i + 24]) + " ").encode()
            plain, with_toxic = (len(c.compress(window)) for c in lengths)
            evidence += model.evidence[min(6, max(-1, plain - with_toxic)) + 1]
        score = 1 / (1 + math.exp(-(model.slope * min(6.0, max(-6.0, evidence)) + model.intercept)))
        assert abs(found[r.doc_id] - score) < 1e-9


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    found = language.op7_language(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert set(held.doc_id) == {i for i in found.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.lang == held.lang_pred).mean() > 0.97 and found.score.between(0, 1).all()


def test_language_edges(spark, edge, empty):
    assert {r.lang_pred for r in language.op7_language(edge.where("lang is null")).collect()} == {"und"}
    found = {(r.doc_id, r.lang_pred) for r in language.op7_language(edge).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= found and len([x for x in found if x[1] != "und"]) >= 4
    assert language.op7_language(empty).count() == 0


def test_language_query_equals_kernel_expansion(spark):
    """Scores from explicit n-gram sets, the kernel with every landmark, and the expansion over landmarks."""
    docs = table(spark, SF, "documents")
    policy = language.LanguagePolicy(landmarks=24, per_language=30)
    texts, langs = language.language_sample(docs, policy)

    def grams(t):
        t, out = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in t.lower())), set()
        for n in range(1, 5):
            for i in range(len(t) - n + 1):
                h = 0
                for j, c in enumerate(t[i : i + n], 1):
                    h = (h * 0x01000193 + ord(c) + j) % 2**32
                out.add((h * 2654435761 % 2**32) >> 16)
        return out

    names = sorted(set(langs))
    queues = [[i for i, x in enumerate(langs) if x == n] for n in names]
    chosen = [q[k] for k in range(max(map(len, queues))) for q in queues if k < len(q)][:24]
    sets = [grams(t) for t in texts]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    values, vectors = np.linalg.eigh(np.array([[kernel(sets[i], sets[j]) for j in chosen] for i in chosen]))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = np.array([[kernel(s, sets[j]) for j in chosen] for s in sets]) @ root
    target = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    solved = np.linalg.solve(features.T @ features + policy.ridge * len(texts) * np.eye(len(root.T)), features.T @ target)
    found = {r.doc_id: r for r in language.op7_language(docs, policy).collect()}
    for r in docs.select("doc_id", "text").collect()[:60]:
        if r.text and any(c.isalpha() for c in r.text):
            own = grams(r.text)
            margin = np.array([kernel(own, sets[j]) for j in chosen]) @ root @ solved
            assert abs(found[r.doc_id].score - min(1, max(0, (margin.max() + 1) / 2))) < 1e-3
            assert found[r.doc_id].lang_pred == names[int(margin.argmax())] or np.sort(margin)[-1] - np.sort(margin)[-2] < 1e-3
        else:
            assert found[r.doc_id].lang_pred == "und"


def test_presence_kernel_is_the_share_of_common_ngrams():
    def grams(t):
        t = re.sub(r"[^a-z]+", " ", t.lower())
        return {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    a, b = "The cat sat.", "A cat sang 12 songs"
    rows, has = language.presence([a, b, "12 !", None], 1 << 16, 4)
    assert has.tolist() == [True, True, False, False]
    assert abs(rows[0] @ rows[1] - len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))) < 0.02


def test_long_labelled_texts_are_fitted(spark):
    long = ["x" * 70_000, "".join(chr(97 + i // 1000 % 26) for i in range(26_000)), "short", None]
    cut = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(long)], "i int, t string").select("i", spread(F.col("t"), 2000).alias("t")).orderBy("i").collect()]
    assert [len(t or "") for t in cut] == [1999, 1999, 5, 0] and {"a", "z"} < set(cut[1]) and cut[2:] == ["short", None]
    rows = [(i, f"{'you total brute' if i % 3 == 0 else 'the quiet garden'} number{i} " * 2000, "en" if i % 2 else "fr", "a", 1) for i in range(90)]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    assert len(rows[0][1]) > 30_000 and toxicity.fitted(docs, marks) is not None and language.fitted(docs).languages == ["en", "fr"]
    with pytest.warns(UserWarning, match="can't be fitted"):
        assert toxicity.fitted(docs, marks.where("toxic = 0")) is None


def test_language_of_very_long_texts():
    rng = random.Random(5)
    stems = {name: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(4000)] for name, letters in (("a", "abcdefghijklm"), ("b", "hijklmnopqrst"))}
    texts, langs = zip(*((" ".join(rng.choices(stems[n], k=300)), n) for _ in range(60) for n in "ab"))
    policy = language.LanguagePolicy()
    assert (policy.landmarks, policy.buckets) == (320, 1 << 16)
    model = language.train_language(texts, langs, policy)
    landmarks = language._Presence(texts, policy.buckets, policy.longest)
    rows, _ = language.presence(texts, policy.buckets, policy.longest)
    assert np.allclose(landmarks.kernel(landmarks), rows @ rows.T, atol=1e-5) and model.weights.shape == (1 << 16, 2)
    long, _ = language.presence([" ".join(rng.choices(stems[n], k=60_000)) for n in "abab"], policy.buckets, policy.longest)
    assert [model.languages[i] for i in (long @ model.weights).argmax(1)] == list("abab")


# 8 mixing


def water_fill(sizes, weights, budget):
    free, target = set(sizes), {}
    while free:
        level = (budget - sum(target.values())) / sum(weights[n] for n in free)
        over = [n for n in free if weights[n] * level > 2 * sizes[n]]
        if not over:
            return target | {n: weights[n] * level for n in free}
        for n in over:
            target[n] = 2 * sizes[n]
            free.discard(n)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_mixing_equals_iterative_filling(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([0, 1, 5, 50, 400]), rng.choice(["a", "B", "ä", None, "z"][: 3 + seed])) for i in range(80)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, target string")
    found = mixing.op8_mixing(docs).toPandas()
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {n: sum(len(words(t)) for _, t, s in rows if s == n) for n in names}
    expected = water_fill(sizes, {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}, 1.5 * sum(sizes.values()))
    source = {r[0]: r[2] for r in rows}
    for name in names:
        own = found[[source[i] == name for i in found.doc_id]]
        assert np.allclose(own.target, expected[name]) and set(own.source_size) == {sizes[name]}
        assert abs(own.taken.sum() - expected[name]) <= 0.5 + 1e-6
    assert (found.taken <= 2 * found["size"]).all() and (found.taken >= 0).all()
    again = mixing.op8_mixing(docs.repartition(5)).toPandas()
    assert again.sort_values("doc_id").values.tolist() == found.sort_values("doc_id").values.tolist()


def test_mixing_edges(spark, edge, empty):
    found = mixing.op8_mixing(edge).collect()
    assert len(found) == len(EDGE) and mixing.op8_mixing(empty).count() == 0
    mixed = mixing.mixture(edge)
    assert mixed.columns == edge.columns and mixed.count() >= len(EDGE) - 5
    assert {(r.target, r.source_size) for r in mixed.collect()} == {("clash", "clash")}
    assert {r.taken for r in mixing.op8_mixing(edge.where("doc_id < 4")).collect()} == {0}


@pytest.mark.parametrize("name", ["op3_warc", "op8_mixing", "op9_chat"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    expected = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in expected.description]
    cells = lambda rows, cols: sorted(tuple(str(float(r[cols.index(c)])) if isinstance(r[cols.index(c)], float) else str(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert cells(found.collect(), found.columns) == cells(expected.fetchall(), names)


# 9 chat


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n", "\\", "\\s", "\\l", "<|", "<\\|", "\n", "", None, "a<", "|im_sep|>", "<|im_sep|>", "ok \\n"]
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<|"]), rng.choice(nasty) if t % 2 else "".join(rng.choice(nasty) or "" for _ in range(3))) for c in range(25) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "x"), (99, None, "assistant", "first"), (99, 1, "assistant", "b"), (99, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    found = {r.conv_id: r for r in chat.op9_chat(df).collect()}
    back = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", x or "") for c, t, role, x in rows if c == conv))
        turns = [(r[2], r[3]) for r in own]
        assert [(t.role, t.text) for t in back[conv].turns] == turns
        assert found[conv].n_turns == len(turns)
        assert found[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert found[conv].loss_chars == len(loss) and found[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        merged = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert back[conv].formatted.count("<|im_start|>") == merged == back[conv].formatted.count("<|im_end|>")
    assert found[-1].n_turns == 2 and chat.op9_chat(df.limit(0)).count() == 1


# 10 near duplicates


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], (last + 1 if x == y else max(row[k + 1], row[k]))
    return row[-1]


def brute_classes(rows):
    """Components of exact copies and of texts whose aligned words are alike."""
    texts = sorted({t or "" for _, t in rows})
    split = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = split[i], split[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                common = longest_common(a, b)
                if common >= 0.8 * (len(a) + len(b) - common):
                    parent[root(i)] = root(j)
    lowest = {}
    for d, t in rows:
        r = root(texts.index(t or ""))
        lowest[r] = min((x for x in (lowest.get(r), d) if x is not None), default=None)
    return sorted((str(d), str(lowest[root(texts.index(t or ""))])) for d, t in rows)


def variants(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([60, 100, 150]))]
        for _ in range(rng.choice([1, 4, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    shared = " ".join(rng.choice(vocabulary) for _ in range(55))
    rows += [(len(rows) * 3 + 1, shared + " " + " ".join(rng.choice(vocabulary) for _ in range(80))) for _ in range(8)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = variants(seed) + [(2, "short one"), (5, "Short  ONE!"), (8, ""), (11, None), (14, "...")]
    found = near_dedup.op10_near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in found) == brute_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in found)


def test_near_duplicates_edges(spark, edge, empty):
    found = near_dedup.near_duplicates(edge)
    assert found.count() == len(EDGE) and near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.without_near_duplicates(edge)
    assert kept.columns == edge.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "7", "None"]


def test_copies_with_words_changed_are_linked(spark):
    """One word in twenty changed, at any length from 60 words on."""
    rng, rows = random.Random(9), []
    for group in range(40):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.choice([60, 100, 500]))]
        copy = list(base)
        for at in rng.sample(range(len(base)), len(base) // 20):
            copy[at] = f"v{rng.randrange(3000)}"
        rows += [(2 * group, " ".join(base)), (2 * group + 1, " ".join(copy))]
    found = {r.doc_id: r.class_id for r in near_dedup.op10_near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[2 * g + 1] == 2 * g for g in range(40)) >= 38 and all(found[i] // 2 == i // 2 for i in found)


@pytest.mark.parametrize("chunk", [near_dedup._CHUNK, 7])
def test_compare_is_banded_alignment(monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "_CHUNK", chunk)
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(12) for _ in range(rng.randint(1, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 20)):
            kind = rng.random()
            if kind < 0.4 and len(b) > 1:
                b.pop(rng.randrange(len(b)))
            elif kind < 0.7:
                b.insert(rng.randrange(len(b) + 1), rng.randrange(12))
            else:
                b[rng.randrange(len(b))] = rng.randrange(12)
        common = longest_common(a, b)
        exact = common / (len(a) + len(b) - common)
        assert near_dedup.aligned(np.array(a), np.array(b), 100) == common
        likeness, near = near_dedup.compare(np.array(a, np.int64), np.array(b, np.int64), 0.8)
        assert (abs(likeness - exact) < 1e-9) if exact >= 0.8 else likeness == 0.0
        assert near or exact < 0.6 + 1e-9


def test_open_links_joins_components():
    import pandas as pd

    base = np.arange(100, dtype=np.int64)
    words_ = [base, np.r_[base[:95], 200:205], np.r_[base[:90], 300:310], np.arange(1000, 1100)]
    group = pd.DataFrame({"key": 7, "bands": [np.array([i, 7]) for i in range(4)], "node": [1, 2, 3, 4], "linked": [True, False, False, False], "near": [True, True, True, False], "label": [1, 2, 3, 4], "words": words_})
    links = near_dedup.open_links(group, 0.8)
    assert {frozenset(x) for x in links.itertuples(index=False)} in ({frozenset((2, 1)), frozenset((3, 1))}, {frozenset((2, 1)), frozenset((3, 2))})
    group["bands"] = [np.array([1, 7])] * 4
    assert near_dedup.open_links(group, 0.8).empty


def test_near_duplicates_with_large_buckets_apart(spark):
    rows = variants(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    policy = near_dedup.NearPolicy(hot_members=2, block_members=3)
    found = near_dedup.near_duplicates(docs, policy).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in found) == brute_classes(rows)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.label for r in near_dedup.components(edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert saved(spark.range(3), "t").count() == 3
