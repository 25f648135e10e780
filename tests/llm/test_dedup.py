"""Substring and line deduplication, near duplicates: brute force on small tables."""

import collections
import hashlib

import pytest
from conftest_llm import ODD, UPPER, WORD, edited, prose

from tunetable.llm import graph, jaccard_join, line_dedup, substring_dedup


def test_substring_matches_brute_force(documents):
    shared = prose(1, 55)
    rows = [(10 + i, f"{prose(100 + i, 15)}  {shared}\n{prose(200 + i, 12)}") for i in range(12)]
    rows += [(40, prose(3, 25) + " " + prose(3, 25)), (41, "a " * 300), (42, shared), (43, shared)]
    rows += [r for r in ODD if r[0] not in (8, None)]
    got = substring_dedup.remove_repeats(documents(rows)).collect()
    seen = {}
    expected = {}
    for doc_id, text in sorted(set(rows), key=lambda r: r[0]):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 19):
            if seen.setdefault(tuple(words[i : i + 20]), (doc_id, i)) != (doc_id, i):
                gone.update(range(i, i + 20))
        expected[doc_id] = (len(words), len(gone), [w for i, w in enumerate(words) if i not in gone])
    assert len(got) == len(rows)
    for r in got:
        n, removed, kept = expected[r.doc_id]
        assert (r.n_words, r.n_removed, r.text) == (n, removed, " ".join(kept))


def test_substring_odd_rows(documents):
    got = substring_dedup.remove_repeats(documents(ODD)).collect()
    assert len(got) == len(ODD)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append((r.n_words, r.n_removed))
    assert by_id[6] == [(60, 0)] * 2 and by_id[7] == [(60, 60)]
    assert by_id[8] == [(40, 0)] * 2 and sorted(by_id[None]) == [(0, 0), (40, 0)]
    assert substring_dedup.remove_repeats(documents([])).collect() == []


def test_substring_window_parameter(documents):
    text = prose(4, 14)
    rows = [(1, text), (2, "x " + text + " y")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(documents(rows), 14).collect()}
    assert got == {1: 0, 2: 14}
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(documents(rows), 13)


def components_of(rows, size=5, percent=75):
    sets = {}
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate(UPPER))
        grams = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
        sets[doc_id] = grams if words else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent", [75, 60])
def test_jaccard_components(documents, percent):
    rows = [(i, prose(i, 20 + i % 50)) for i in range(1000, 1040)]
    for base in range(12):
        text = prose(base, 40 + 15 * base)
        rows += [(100 * base + k, edited(text, 7 * base + k, k % 7)) for k in range(14)]
    passage = prose(77, 60)
    rows += [(3000 + k, passage + " " + prose(500 + k, 10 + k)) for k in range(25)]
    rows += [(4000 + k, t) for k, t in enumerate(["one two", "one two", "ONE two", "two one", "a b c d e"])]
    rows += [(1, None), (2, "")] if not {1, 2} & {r[0] for r in rows} else [(5001, None), (5002, " ")]
    got = jaccard_join.near_duplicate_groups(documents(rows), percent=percent).collect()
    assert {r.k_id: (r.n, r.c_id) for r in got} == components_of(rows, percent=percent)


def test_jaccard_odd_rows(documents):
    got = jaccard_join.near_duplicate_groups(documents(ODD)).collect()
    assert len(got) == len(ODD)
    lowest = -(1 << 63)
    assert {r.c_id for r in got if r.k_id in (6, 7)} == {6}
    assert {r.c_id for r in got if r.k_id == 8} == {8} and len({r.c_tie for r in got if r.k_id == 8}) == 2
    assert {r.c_id for r in got if r.k_id == lowest} == {lowest}
    assert all(r.n == 0 and r.c_id == r.k_id for r in got if r.k_id in (1, 2, 3))
    assert jaccard_join.near_duplicate_groups(documents([])).collect() == []


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 200)]
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.v: r.component for r in got} == {
        **{i: 0 for i in range(61)}, 100: 100, 105: 100, 103: 100,
    }


def lines_of(rows, least):
    sites, first = collections.defaultdict(set), {}
    for doc_id, text, site in sorted({r for r in rows if r[1] is not None}, key=lambda r: r[0]):
        for pos, line in enumerate(text.split("\n")):
            bare = line.strip(" \t\r\x0b\x0c")
            if bare:
                sites[bare] |= {site} - {None}
                first.setdefault(bare, (doc_id, pos))
    out = {}
    for doc_id, text, _ in rows:
        kept = [
            line
            for pos, line in enumerate((text or "").split("\n"))
            if len(sites[line.strip(" \t\r\x0b\x0c")]) < least
            or first[line.strip(" \t\r\x0b\x0c")] == (doc_id, pos)
        ]
        out[doc_id] = None if text is None else "\n".join(kept)
    return out


def test_line_dedup(documents):
    rows = []
    for i in range(80):
        lines = [f"own line {i}", " Home | About \t", "", f"near {i % 3}", f"twice {i // 2}"]
        lines += ["at nine sites"] * (i < 9) + ["at ten sites"] * (i < 10) + ["no site"]
        rows.append((i, "\n".join(lines), None if i > 70 else f"s{i % 35}"))
    rows += [(90, None, "s1"), (91, "", "s2"), (92, "\n\n", "s3"), (93, "Home | About", None)]
    docs = documents([(a, b, "en", c) for a, b, c in rows])
    got = {r.k_id: r.text for r in line_dedup.without_shared_lines(docs).collect()}
    assert got == lines_of(rows, line_dedup.MIN_SITES)
    assert got[93] == "" and "at nine sites" in got[8] and "at ten sites" not in got[9]


def test_line_dedup_odd_rows(documents):
    out = line_dedup.without_shared_lines(documents(ODD)).collect()
    assert len(out) == len(ODD) and all(r.n_removed == 0 and r.text == r.row.text for r in out)
    assert line_dedup.without_shared_lines(documents([])).collect() == []


def test_digest_of_op4_is_of_the_kept_text(spark, documents, tmp_path):
    documents([(1, "b  a\tc"), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in substring_dedup.op4_substring_dedup(spark, str(tmp_path)).collect()}
    assert got[1].kept_sha256 == hashlib.sha256(b"b a c").hexdigest()
    assert (got[2].n_words, got[2].kept_sha256) == (0, hashlib.sha256(b"").hexdigest())
