"""WARC archives, HTML extraction, language identification, nearest neighbours, the pipeline."""

import base64
import collections
import hashlib
import math
import sys

import numpy as np
import pytest
from conftest_llm import ODD, edited, prose

from tunetable.llm import ann, html_extraction, language_id, warc


def pages(spark, rows):
    full = [(a, b, c, 1, "x") for a, b, c in rows]
    return spark.createDataFrame(full, "page_id long, url string, html string, bytes int, digest string")


PAGES = [
    (1, "http://a/1", "<p>one</p>"),
    (2, "http://a/ 2\r\nX: y", "<p>one</p>"),
    (3, None, None),
    (4, "http://a/4", ""),
    (5, "http://a/5", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1\r\n"),
    (6, "http://a/6", "é\u0000\r\n\r\n" * 3),
    (7, "http://a/7", "y" * 300_000),
    (8, "http://a/8", "y" * 300_000),
    (9, "http://a/9", "z"),
    (9, "http://a/9", "z"),
]


@pytest.mark.parametrize("least", [0, 11])
def test_warc_round_trip(spark, tmp_path, least):
    rows = PAGES + [(None, "http://a/null", "<p>one</p>")]
    path = str(tmp_path / "warc")
    warc.write_archives(warc.records_of(pages(spark, rows)).repartition(3), path, least)
    got = warc.resolve(warc.read_records(spark, path)).collect()
    groups = collections.defaultdict(list)
    for page_id, _, html in rows:
        groups[(html or "").encode()].append(page_id)
    expected = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = max((p for p in groups[body] if p is not None), default=None)
        revisit = len(body) >= least and len(groups[body]) > 1 and page_id != first
        kind = "revisit" if revisit else "response"
        expected.append((page_id, len(body), digest, kind, first if revisit else None))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[n] for n in names) for r in got), key=repr) == sorted(expected, key=repr)
    bodies = warc.read_records(spark, path, payloads=True).filter("record_type = 'response'")
    for r in bodies.collect():
        assert hashlib.sha1(bytes(r.payload)).digest() == base64.b32decode(r.payload_digest)


def test_archives_can_be_deduplicated_again(spark, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    warc.write_archives(warc.records_of(pages(spark, PAGES)), first, 1 << 40)
    again = warc.read_records(spark, first, payloads=True)
    assert {r.record_type for r in again.collect()} == {"response"}
    html = again.selectExpr("page_id", "target_uri as url", "cast(payload as string) as html")
    warc.write_archives(warc.records_of(html), second)
    types = collections.Counter(r.record_type for r in warc.read_records(spark, second).collect())
    assert types == {"response": 7, "revisit": 3}
    warc.write_archives(warc.records_of(pages(spark, [])), str(tmp_path / "c"))
    assert warc.resolve(warc.read_records(spark, str(tmp_path / "c"))).collect() == []


LONG = "This is a long sentence of the article, with commas, and it goes on for a while. "
CASES = [
    (
        "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li>"
        "<a href=/>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies, really.</div>"
        f"<article><h1>Head &amp; line</h1><p>{LONG}<p>Short.<br>Next &eacute;\n\n x</article>"
        "<aside>Side</aside><section id=comments><p>Great post, thanks a lot for it.</p></section>"
        "<footer>&copy; 2020</footer></body></html>",
        f"Head & line\n{LONG.strip()}\nShort. Next é x",
    ),
    (
        "<body><div id=top><div class=menu><a href=1>One</a> <a href=2>Two</a></div></div>"
        f"<div class=content><p>{LONG * 3}</p><p>{LONG * 2}</p><p>Brief one.</p></div>"
        "<div class=links><a href=1>A</a><a href=2>B</a></div><form>Name <input></form></body>",
        f"{(LONG * 3).strip()}\n{(LONG * 2).strip()}\nBrief one.",
    ),
    (f"<main><p>a<b>b</b> c&#33;</p><ul><li>x<li>y</ul><P CLASS='ad'>Buy</P>{LONG}</main", f"ab c!\nx\ny\n{LONG.strip()}"),
    (f'<article><p title="a > b">{LONG}</p><!-- <p>no</p> --><style>p{{}}</style><p>end</p></article>', f"{LONG.strip()}\nend"),
    (f"<article><p>{LONG}</p><p>cut <a href='", f"{LONG.strip()}\ncut"),
    (f"<article><p>{LONG} 1 < 2 </p></article>", f"{LONG.strip()} 1 < 2"),
    ("", ""),
    (None, ""),
    ("<nav>only a menu</nav>", ""),
    ("<div hidden>secret</div><script>x", ""),
]


def test_html_extraction(spark):
    rows = [(i, f"u{i}", page) for i, (page, _) in enumerate(CASES)] + [(None, None, "<main>z</main>")]
    got = html_extraction.extract_pages(pages(spark, rows)).collect()
    for r in got:
        expected = "z" if r.page_id is None else CASES[r.page_id][1]
        assert (r.text, r.n_chars) == (expected, len(expected))
    assert html_extraction.extract_pages(pages(spark, [])).collect() == []


def test_html_of_hostile_pages_is_quick():
    for page in ("<div>" * 30000 + "x", "<a \"'" * 30000, "</p>" * 50000, "<" * 100000, "<p>x" * 30000):
        html_extraction.extract(page)


def slow_bits(texts, text):
    """Code length in one language, straight from the definition."""
    fold = lambda t: language_id._FOLD[np.frombuffer(t, np.uint8)].tobytes()
    counts = collections.defaultdict(collections.Counter)
    for t in texts:
        t = b"   " + fold(t)
        for i in range(3, len(t)):
            for order in range(4):
                counts[t[i - order : i]][t[i]] += 1
    total, t = 0.0, b"   " + fold(text)
    for i in range(3, len(t)):
        for order in (3, 2, 1, 0):
            seen = counts.get(t[i - order : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if t[i] in seen:
                total -= math.log2(seen[t[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_match_the_definition():
    texts = {"x": [b"abracadabra 12", "é Ab".encode()], "y": [b"the cat sat on the mat"], "z": [b""]}
    model = language_id.fit(texts)
    assert model.languages == ["x", "y"]
    for text in (b"abra the", "Ünïcode é 7 zzz".encode(), b"q", b"mat abracad"):
        bits = model.bits(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert bits == pytest.approx([slow_bits(texts[k], text) for k in ("x", "y")], rel=1e-5)
    both = b"abra" + b"the cat"
    split = model.bits(np.frombuffer(both, np.uint8), np.array([0, 4, 4, len(both)]))
    assert split[0] == pytest.approx(model.bits(np.frombuffer(b"abra", np.uint8), np.array([0, 4]))[0])
    assert split[1].tolist() == [0, 0]
    assert language_id.fit({}) is None


def test_language_predictions(spark, documents):
    words = {"aa": "kot pies dom las", "bb": "huis boom fiets zee", "cc": "日本 語 文 字"}
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        lang = sorted(words)[i % 3]
        text = " ".join(rng.choice(words[lang].split(), 30))
        rows.append((i, text, lang))
    rows += [(900, None), (901, ""), (902, "123 .. !"), (903, "BOOM zee fiets"), (None, "dom las kot", "bb")]
    got = language_id.identify(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.row.doc_id is not None and r.row.doc_id < 240:
            assert r.lang_pred == r.row.lang and 0 < r.score <= 1
    rest = {r.row.doc_id: (r.lang_pred, r.score) for r in got}
    assert rest[900] == rest[901] == rest[902] == ("und", 0.0)
    assert rest[903][0] == "bb" and rest[None][0] == "aa"
    nobody = language_id.identify(documents([(1, "words", None), (2, None, "en")])).collect()
    assert {(r.lang_pred, r.score) for r in nobody} == {("und", 0.0)}
    assert language_id.identify(documents([])).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame(
        [(a, b, 1, 2) for a, b in rows], "vec_id long, embedding array<float>, cluster int, score int"
    )


def exact(rows, queries, k):
    usable = {
        i: np.array(v, float) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    }
    out = {}
    for q in queries:
        if q in usable:
            a = usable[q]
            scores = [
                (-round(float(a @ b / math.sqrt((a @ a) * (b @ b))), 12), i)
                for i, b in usable.items() if i != q
            ]
            out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((1500, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(2000 + i, rows[50][1]) for i in range(400)]
    rows += [(3000, None), (3050, [0.0] * 32), (3100, [float("nan")] * 32), (3101, [None] * 32), (None, rows[1][1])]
    from pyspark.sql import functions as F

    got = collections.defaultdict(dict)
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    truth = exact(rows, [i for i, _ in rows if i is not None and i % 50 == 0], 5)
    assert set(got) == set(truth)
    hits = sum(len({v for v, _ in got[q].values()} & set(truth[q])) for q in truth)
    assert hits >= 0.9 * 5 * len(truth)
    # the copies of a vector are its nearest rows, smallest ids first
    assert [got[50][k][0] for k in range(1, 6)] == [2000, 2001, 2002, 2003, 2004]
    assert [got[2000][k][0] for k in range(1, 6)] == [50, 2001, 2002, 2003, 2004]
    by_id = {i: np.array(v, float) for i, v in rows if v and None not in v}
    for q, found in got.items():
        for vec_id, score in found.values():
            a, b = by_id[q], by_id[vec_id]
            assert score == pytest.approx(a @ b / math.sqrt((a @ a) * (b @ b)), rel=1e-12)


@pytest.mark.parametrize("copies", [3, 7])
def test_a_repeated_query_row_takes_no_place(spark, copies):
    """Rows of the query's own id take no part; repeated candidates count row by row."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    own = rng.standard_normal(8).tolist()
    rows = [(50, own)] * copies + [(50, [x + 1e-4 for x in own])] * copies
    rows += [(i, rng.standard_normal(8).tolist()) for i in range(1, 12)]
    first = max(rows[-11:], key=lambda r: np.dot(r[1], own) / np.linalg.norm(r[1]))
    rows += [first] * 2
    got = collections.Counter()
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") == 50).collect():
        got[r["rank"], r.vec_id] += 1
    ranks = collections.Counter(rank for rank, _ in got.elements())
    assert ranks == {rank: 2 for rank in range(1, 6)}  # two vectors of vec_id 50 ask
    assert all(got[rank, first[0]] == 2 for rank in (1, 2, 3)) and not any(v == 50 for _, v in got)


def test_neighbours_of_small_tables(spark):
    from pyspark.sql import functions as F

    run = lambda rows: ann.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert run([]) == [] == run([(50, [0.0, 0.0])]) == run([(50, [1.0, 0.0])])
    got = run([(50, [1.0, 0.0]), (1, [0.0, 3.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, [1.0])])
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [
        (1, 2, 1.0), (2, 1, 0.0), (3, 3, -1.0),
    ]


def test_pipeline_stages(spark, documents):
    sys.modules.pop("corpus_pipeline", None)
    import corpus_pipeline

    bench = spark.createDataFrame([(1, prose(7, 40, 10**6))], "item_id long, text string")
    base = {i: prose(i, 80, 3000) for i in range(100, 160)}
    rows = [(i, f"{t}\nshared line of many sites", "en", f"s{i % 15}") for i, t in base.items()]
    rows += [(200 + k, edited(base[100], k, 1), "en", "s1") for k in range(5)]
    rows += [(300, f"{prose(8, 30)} {prose(7, 40, 10**6)}", "en", "s2"), (301, "12 34", "en", "s2")]
    rows += [(302, None, "en", "s3"), (303, "shared line of many sites", "en", "s4")]
    docs = documents(rows + [(*r, "en", "s1") for r in ODD])
    bench.write.parquet(folder := f"{spark.conf.get('spark.sql.warehouse.dir')}/{prose(1, 1)}-{id(docs)}/benchmark.parquet")
    sf_dir = folder.rsplit("/", 1)[0]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, docs, sf_dir)
    assert one.columns == docs.columns
    ids = {r.doc_id for r in one.select("doc_id").collect()}
    assert not ids & {301, 302, 1, 2, 3} and {300, 303, 4, 5, 8} <= ids
    two = stage["line_dedup"](spark, one, sf_dir)
    assert two.columns == docs.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in two.collect()}
    assert texts[101] == (base[101], len(base[101])) and 303 not in texts and "shared" in texts[100][0]
    three = stage["jaccard_join"](spark, two, sf_dir)
    kept = sorted(r.doc_id for r in three.collect() if r.doc_id is not None)
    assert three.columns == docs.columns and not set(kept) & {200, 201, 202, 203, 204, 7}
    assert kept.count(6) == 1 and kept.count(8) == 2 and 100 in kept
    four = stage["decontamination"](spark, three, sf_dir)
    assert four.columns == docs.columns
    assert {r.doc_id for r in three.collect()} - {r.doc_id for r in four.collect()} == {300}
    five = stage["mixing"](spark, four, sf_dir).collect()
    assert len(five) == four.count()
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
