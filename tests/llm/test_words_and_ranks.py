"""Operators 11 to 13 against brute force, held-out labels and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, UPPER, prose

from tunetable.llm import ranked_search, spelling, toxicity

RUN = re.compile("[A-Za-zÀ-ÿ]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(rows, least, slip):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if slip and h % slip == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                out[word] += 1
    return out


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts, ratio=5):
    forms, out = {}, {}
    for w, n in counts.items():
        others = sorted((-counts[o], o) for o in counts if near(w, o))
        best = others[0] if others and -others[0][0] >= ratio * n else None
        forms[w] = best and best[1]
        out[w] = (n, len(others), forms[w], best and -best[0])
    for w, row in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (*row, root)
    return out


def variants(seed, roots=12):
    rng = random.Random(seed)
    letters = "abcdeéÿ×"
    rows = []
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 12))) for _ in range(roots)]
    for doc in range(40):
        text = []
        for _ in range(120):
            word = rng.choice(base)
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(word))
                cut = rng.choice((0, 1))
                word = word[:at] + rng.choice(letters) * rng.choice((0, 1)) + word[at + cut :]
                if not word:
                    word = "x"
            text.append(word.capitalize() if rng.random() < 0.2 else word)
        rows.append((doc, rng.choice((" ", ", ", "1", "Ā", "¿")).join(text)))
    return rows


@pytest.mark.parametrize("slip", [0, 7])
def test_spelling_groups_equal_brute_force(spark, documents, slip):
    rows = variants(3) + ODD + [(77, "é" * 200 + " " + "é" * 199)] * 6
    found = spelling.spelling_groups(documents(rows), slip=slip, least_letters=4, least_count=3)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in found.collect()}
    want = grouped(Counter({w: n for w, n in words_of(rows, 4, slip).items() if n >= 3}))
    assert len(want) > 100
    assert got == want


def test_a_frequent_part_is_dealt_over_blocks(spark):
    rng = random.Random(1)
    words = {"prefix" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(60)}
    words |= {w[:-1] for w in list(words)[:20]} | {w + "a" for w in list(words)[20:40]}
    counts = {w: rng.randrange(5, 500) for w in words}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: r["n_near"] for r in spelling.near_words(vocabulary, block_words=8).collect()}
    assert got == {w: k for w in words if (k := sum(near(w, o) for o in words))}


def test_spelling_of_nothing(spark, documents):
    for rows in ([], [(1, None), (None, ""), (2, "a b c")]):
        assert spelling.spelling_groups(documents(rows)).count() == 0


def ranked(docs, items, k):
    texts = [(i, TERM.findall((t or "").translate(UPPER))) for i, t in docs]
    texts = [(i, t) for i, t in texts if t]
    n_docs, length = len(texts), sum(len(t) for _, t in texts)
    df = Counter(w for _, t in texts for w in set(t))
    out = []
    for item_id, item in sorted({(i, t) for i, t in items if t is not None}, key=repr):
        scored = []
        for doc_id, text in texts:
            m = 75 + 25 * len(text) * n_docs // length
            tf = Counter(text)
            score = 0
            for w in TERM.findall(item.translate(UPPER)):
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += weight * (10**9 * tf[w] // (1000 * tf[w] + 12 * m))
            if score > 0:
                scored.append((-score, -(1 << 63) if doc_id is None else doc_id, doc_id))
        best = sorted(scored, key=lambda x: x[:2])[:k]
        out += [(item_id, r, d, -s) for r, (s, _, d) in enumerate(best, 1)]
    return sorted(out, key=repr)


def test_ranking_equals_brute_force_in_any_blocks(spark, documents):
    docs = ODD + [(20 + i, prose(i, 30 + i, 60)) for i in range(50)] + [(200, "W1 w1 w2é w2é")] * 3
    items = [(i, prose(i, 25, 60)) for i in range(12)] + [
        (3, "other words w1 w2"), (3, "other words w1 w2"), (4, None), (5, ""), (None, "w1 w1 w1 W2é"),
        (6, "unseen"), (7, " ".join(["w3"] * 40)),
    ]
    bench = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, block string, k int")
    for bytes_ in (1 << 20, 150):
        for k in (3, 20):
            found = ranked_search.search(documents(docs), bench, k, bytes_)
            got = sorted(map(tuple, found.collect()), key=repr)
            assert got == ranked(docs, items, k)


def test_ranking_of_empty_tables(spark, documents):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(documents([]), bench).count() == 0
    assert ranked_search.search(documents([(1, None), (2, "...")]), bench).count() == 0
    assert ranked_search.search(documents([(1, "a")]), bench.limit(0)).count() == 0
    assert ranked_search.search(documents([(1, "a"), (2, "b b")]), bench).count() == 2


def test_shared_sets_are_mined_once_and_lose_no_term():
    rng = random.Random(4)
    sets = [sorted(rng.choices(range(30), [1 / (1 + t) for t in range(30)], k=20)) for _ in range(40)]
    flat = np.array([t for s in sets for t in s])
    owner = np.repeat(np.arange(40), 20)
    rounds, left, item = ranked_search.shared_nodes(flat, owner, 30)
    terms = [Counter({t: 1}) for t in range(30)]
    for a, b in rounds:
        terms += [terms[x] + terms[y] for x, y in zip(a, b)]
    for number, expected in enumerate(sets):
        assert sum((terms[n] for n in left[item == number]), Counter()) == Counter(expected)
    assert len(rounds) > 1 and len(left) < 0.5 * len(flat)
    # what is added up with sharing, against every term of every item
    assert len(left) + sum(len(a) for a, _ in rounds) < 0.7 * len(flat)


BAD = ["grobian", "lump", "schuft"]


def labelled(count, seed=0):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(count):
        sentences = [prose(1000 * seed + 40 * i + k, rng.randrange(4, 12), 300) for k in range(rng.randrange(1, 30))]
        truth[i] = rng.random() < 0.25
        if truth[i]:
            for _ in range(rng.randrange(1, 4)):
                at = rng.randrange(len(sentences))
                sentences[at] += f" {rng.choice(BAD)}{rng.choice(('', 'en', 'ischer'))} x"
        docs.append((i, ". ".join(sentences)))
        labels.append((i, 0, int(truth[i] != (rng.random() < 0.02))))
    return docs, labels, truth


def test_offending_sentences_are_learned_from_document_labels(spark, documents):
    docs, labels, truth = labelled(500)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fitted(documents(docs), table)
    rows = toxicity.scored(documents(docs), model, toxicity.F.col("doc_id"), toxicity.held_out().alias("held_out"))
    held = [r for r in rows.collect() if r["held_out"]]
    right = [(r["score"] >= toxicity.TOXIC) == truth[r["doc_id"]] for r in held]
    assert len(held) > 90 and sum(right) / len(right) > 0.97
    found = toxicity.offending_sentences(documents(docs), model).collect()
    offends = [any(b in r["sentence"] for b in BAD) for r in found]
    assert sum(offends) / len(offends) > 0.97
    texts = dict(docs)
    assert all(r["sentence"] in texts[r["doc_id"]] for r in found)
    assert all(texts[r["doc_id"]].split(". ")[r["number"]] == r["sentence"] for r in found)


def test_toxicity_of_odd_rows(spark, documents):
    docs, labels, _ = labelled(200)
    for known in (labels, labels + [(3, 1, 1), (3, None, None), (None, 0, 1), (4, 0, 7)], [], labels[:1]):
        table = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
        for rows in (docs + ODD + [(3, docs[3][1])] * 3000, []):
            model = toxicity.fitted(documents(rows), table)
            out = toxicity.scored(documents(rows), model, toxicity.F.col("doc_id")).collect()
            assert len(out) == len(rows)
            assert all(0 <= r["score"] <= 1 for r in out)
            blank = [r for r in out if r["n_sentences"] == 0]
            assert all(r["worst"] is None and r["score"] == pytest.approx(model.leak) for r in blank)


def test_labels_of_held_out_rows_are_not_learned(spark, documents):
    docs, labels, _ = labelled(60)
    spoilt = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    samples = [
        toxicity.training_sample(documents(docs), spark.createDataFrame(x, "doc_id long, quality int, toxic int"))
        for x in (labels, spoilt)
    ]
    assert samples[0][0] == samples[1][0] and (samples[0][1] == samples[1][1]).all()


def test_a_sentence_without_end_is_cut():
    text = " ".join(["w"] * 100).encode()
    _, sentence, row, starts, ends = toxicity.sentences(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert np.bincount(sentence).tolist() == [40, 40, 20] and row.tolist() == [0, 0, 0]
    assert starts.tolist() == [0, 80, 160] and ends.tolist() == [79, 159, 199]
