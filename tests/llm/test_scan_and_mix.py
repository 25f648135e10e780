"""License scans, mixing, decontamination: brute force and edge cases."""

import itertools
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD, UPPER, WORD, prose

from tunetable.llm import decontamination, license_scan, mixing

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {
    ("gnu", "general", "public", "license"): "gpl",
    ("apache", "license"): "apache",
    ("cc", "by"): "cc-by",
    ("mit", "license"): "mit",
}


def base_scan(text):
    words = TOKEN.findall((text or "").translate(UPPER))
    found = [
        (i, label)
        for i in range(len(words))
        for phrase, label in PHRASES.items()
        if tuple(words[i : i + len(phrase)]) == phrase
    ]
    at = [i for i, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(at, default=None), max(at, default=None), labels


LICENSED = [
    (20, "Licensed under the Apache License, Version 2.0."),
    (21, "MIT LICENSE mit-license\nmit\tlicense? smit license mit licenses"),
    (22, "apache Apache License GNU  General--Public License CC BY-NC 4.0 cc by by"),
    (23, "é mit license ümit license — mit license mit\x1flicense"),
    (24, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */"),
    (25, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nx"),
    (26, "SPDX-License-Identifier: MIT OR"),
    (27, "x " * 50000 + "mit license"),
    (28, "mit " * 20 + "license"),
]


def test_license_scan(documents):
    rows = LICENSED + ODD
    got = license_scan.scan_licenses(documents(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, set()).add(base_scan(text))
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in texts[r.doc_id]
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by_id = {r.doc_id: r for r in got}
    assert by_id[24].labels == "spdx:apache-2.0,spdx:bsd-3-clause,spdx:mit" and by_id[24].permissive
    assert by_id[25].labels == "spdx:gpl-2.0-only with classpath-exception-2.0"
    assert by_id[25].permissive is False and by_id[26].labels == "spdx:malformed"
    assert "cc-by-nc" in by_id[22].labels and by_id[20].score == 0.5
    assert license_scan.scan_licenses(documents([])).collect() == []


def test_shunting_yard_matches_truth_tables():
    for values in itertools.product(("mit", "gpl-3.0"), repeat=3):
        a, b, c = (v == "mit" for v in values)
        text = "{} or {} and {}".format(*values)
        assert license_scan.evaluate(text)[1] == (a or b and c)
        text = "({} or {}) and {}".format(*values)
        assert license_scan.evaluate(text)[1] == ((a or b) and c)
    for bad in ("", "and", "mit or", "(mit", "mit)", "mit mit", "()", "mit with (a or b)"):
        assert license_scan.evaluate(bad) is None, bad


TAGGED = [
    ("SPDX-License-Identifier: banana", "spdx:unknown", None, 0.0),
    ("SPDX-License-Identifier: mitre-x", "spdx:unknown", None, 0.0),
    ("SPDX-License-Identifier: MIT # see LICENSE", "spdx:mit", True, 1.0),
    ("# SPDX-License-Identifier: MIT. More prose", "spdx:mit", True, 1.0),
    ("<!-- SPDX-License-Identifier: MIT-0 -->", "spdx:mit-0", True, 1.0),
    ("SPDX-License-Identifier: MIT/Apache-2.0", "spdx:apache-2.0,spdx:mit", True, 1.0),
    ("SPDX-License-Identifier: MIT, GPL-3.0-only", "spdx:gpl-3.0-only,spdx:mit", False, 1.0),
    ("SPDX-License-Identifier: MIT, see LICENSE", "spdx:mit", True, 1.0),
    ("SPDX-License-Identifier: MIT OR # later", "spdx:malformed", None, 0.0),
    ("SPDX-License-Identifier: (MIT", "spdx:malformed", None, 0.0),
    ("SPDX-License-Identifier:", "spdx:malformed", None, 0.0),
    ("License-Expression: LGPL-2.1+ OR BSD-2-Clause", "spdx:bsd-2-clause,spdx:lgpl-2.1+", True, 1.0),
    ("SPDX-License-Identifier: LicenseRef-Own AND MIT", "spdx:licenseref-own,spdx:mit", False, 1.0),
    ("SPDX-License-Identifier: MIT AND banana", "spdx:mit,spdx:unknown", False, 1.0),
    ("SPDX-License-Identifier: GPL-2.0 WITH banana", "spdx:unknown", None, 0.0),
    ("SPDX-License-Identifier: CC-BY-SA-4.0\nSPDX-License-Identifier: CC-BY-4.0", "spdx:cc-by-4.0,spdx:cc-by-sa-4.0", False, 1.0),
]


@pytest.mark.parametrize("text, labels, permissive, score", TAGGED)
def test_tags_name_known_identifiers(text, labels, permissive, score):
    row = license_scan.scan(text.encode(), license_scan._automaton())
    tagged = ",".join(x for x in row[5].split(",") if x.startswith("spdx:"))
    assert (tagged, row[8]) == (labels, permissive)
    assert row[6] >= score and (row[6] == 1.0) == (score == 1.0)
    assert row[7] == text.lower().count("license-identifier") + text.lower().count("license-expression")


def test_notices_hold_words_only():
    for phrase in [*license_scan.BASE, *license_scan.NOTICES, *license_scan.TAGS]:
        assert TOKEN.findall(phrase) == phrase.split(" ")
    assert license_scan.PERMISSIVE <= license_scan.KNOWN
    assert not any(x.startswith(("gpl", "cc-by-nc", "cc-by-nd", "cc-by-sa")) for x in license_scan.PERMISSIVE)


def filled(sizes, weights=(5, 2, 1)):
    """Targets by handing the excess out again until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return target


def test_mixing(documents):
    rng = np.random.default_rng(1)
    sources = ["b", "a", "é", None, "Z", "zz", "empty"]
    rows = [(i, prose(i, int(rng.integers(1, 400))), "en", sources[i % 6]) for i in range(300)]
    rows += [(i, prose(i, 900), "en", "a") for i in range(300, 420)]
    rows += [(500, None, "en", "a"), (501, " \n", None, "empty")]
    got = mixing.mixed_rows(documents(rows)).collect()
    again = mixing.mixed_rows(documents(rows[::-1]).repartition(5)).collect()
    assert sorted(got) == sorted(again) and len(got) == len(rows)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + size[r[0]]
    target, source, taken = filled(total), {r[0]: r[3] for r in rows}, dict.fromkeys(total, 0)
    for r in got:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s])
        assert r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(target[s] - 1 <= taken[s] <= target[s] for s in total)


def test_mixing_odd_rows(documents):
    got = mixing.mixed_rows(documents([(*r, "en", "s") for r in ODD])).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mixed_rows(documents([])).collect() == []
    nothing = mixing.mixed_rows(documents([(1, None), (2, "")])).collect()
    assert [(r.size, r.target, r.taken) for r in nothing] == [(0, 0.0, 0)] * 2


def test_schedule_follows_the_shares(spark):
    rows = [(0, 500_000), (1, 300_000), (2, 7_000), (3, 0)]
    slots, total = mixing.schedule(spark.createDataFrame(rows, "s long, words long"), 1000)
    got = sorted((r.slot, r.s, r.rank) for r in slots.collect())
    assert total == 807 and [g[0] for g in got] == list(range(807))
    seen = {}
    for n, s, rank in got:
        assert rank == seen.get(s, 0)
        seen[s] = rank + 1
        assert abs(seen.get(0, 0) - (n + 1) * 500 / 807) < 12
    assert abs(seen[0] - 500) < 12 and abs(seen[1] - 300) < 12 and abs(seen[2] - 7) < 12


def greedy(doc, item, size):
    """Greedy tiling over the words themselves."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while (
                    i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]
                    and i + n not in used_i and d + n not in used_d
                ):
                    n += 1
                if n >= size and (best is None or n > best[0]):
                    best = (n, i, d)
        if best is None:
            return out
        n, i, d = best
        used_i.update(range(i, i + n))
        used_d.update(range(d, d + n))
        out.append((d, i, n))


def test_tiling_matches_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(150):
        doc, item = rng.integers(0, 3, rng.integers(1, 40)), rng.integers(0, 3, rng.integers(1, 25))
        assert tiled(doc, item, 3) == greedy(doc.tolist(), item.tolist(), 3)


def tiled(doc, item, size):
    """Tiles of a document of numbered words, by way of the seeds of the item."""
    doc, item = (" ".join(f"w{x}" for x in words).encode() for words in (doc, item))
    seeds = decontamination.Seeds([0], [item], size)
    out = []
    for _, words, first in decontamination._hashed(pa.array([b"w1 w2", doc], pa.large_binary())):
        row, _, begin, place, length = decontamination._matches(words, first, seeds)
        if (row == 1).any():
            out += decontamination.tiles(begin[row == 1], place[row == 1], length[row == 1], size)
    return out


@pytest.mark.parametrize("period", [1, 2, 7])
def test_text_that_repeats_itself_costs_its_matches(period):
    item, doc = np.arange(400) % period, np.arange(500_000) % period
    tracemalloc.start()
    assert tiled(doc, item, 5) == [(0, 0, 400)]
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_decontamination(spark, documents):
    item = prose(1, 40, 10**6).split(" ")
    turned = item[30:] + ["x"] + item[:15] + ["y"] + item[15:30]
    rows = [
        (1, " ".join(["a", "b"] + item + ["c"])),
        (2, " ".join(turned)),
        (3, " ".join(item[:19])),
        (4, " ".join(item[:20])),
        (5, "\n".join(w.upper() + "," for w in item)),
        (6, " ".join(w for pair in zip(item, prose(2, 40).split(" ")) for w in pair)),
    ]
    items = [(10, " ".join(item)), (11, None), (12, "only four words here"), (None, prose(999, 30)), (13, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminated_pairs(documents(rows + ODD), bench).collect()
    found = {(r.k_id, r.item_id): (r.covered_words, r.n_tiles, r.longest_tile) for r in got}
    assert found == {
        (1, 10): (40, 1, 40), (2, 10): (40, 3, 15), (4, 10): (20, 1, 20), (5, 10): (40, 1, 40),
    }
    blocks = decontamination.contaminated_pairs(documents(rows + ODD), bench, block_bytes=64)
    assert sorted(blocks.collect()) == sorted(got)
    none = decontamination.contaminated_pairs(documents([]), bench).collect()
    assert none == [] == decontamination.contaminated_pairs(documents(rows), bench.limit(0)).collect()
