"""The slots of the mix against the schedule drawn one slot at a time."""

import collections
import hashlib

from conftest_llm import WORD, prose

from tunetable.llm import mixing

BLOCK = 64


def drawn_by_hand(rows, targets):
    """{doc_id: (words, first slot, slots)}: every slot draws the next block of the source at its point."""
    words = {s: int(target) for s, target in targets.items()}
    blocks = {s: -(-n // BLOCK) for s, n in words.items()}
    total, order = sum(blocks.values()), sorted(targets, key=lambda s: (s is None, s))
    slots, drawn = [], collections.Counter()
    for n in range(total):
        place = int(f"{n:048b}"[::-1], 2) / 2**48 * total
        for s in order:
            if place < blocks[s]:
                break
            place -= blocks[s]
        slots.append((n, s, drawn[s]))
        drawn[s] += 1
    late = [(r, order.index(s), s) for s in order for r in range(drawn[s], blocks[s])]
    slots += [(total + k, s, r) for k, (r, _, s) in enumerate(sorted(late))]
    stream = {}
    for s in order:
        docs = [r for r in rows if r[3] == s]
        docs.sort(key=lambda r: hashlib.md5(f"42:{r[0]}".encode()).hexdigest())
        stream[s] = [r[0] for r in docs for _ in WORD.findall(r[1])] * mixing.MOST
    out = collections.defaultdict(lambda: [0, None, 0])
    for n, s, rank in slots:
        for doc, count in collections.Counter(
            stream[s][: words[s]][rank * BLOCK : (rank + 1) * BLOCK]
        ).items():
            row = out[doc]
            row[0] += count
            row[1] = n if row[1] is None else min(row[1], n)
            row[2] += 1
    return out


def test_documents_are_taken_by_the_slots_that_draw_them(documents):
    rows = [(i, prose(i, 20 + i * 7 % 190), "en", ["b", "a", None, "c"][i % 4 if i % 9 else 1]) for i in range(120)]
    got = mixing.mix(documents(rows), block=BLOCK).collect()
    expected = drawn_by_hand(rows, {r.source: r.target for r in got})
    assert len({r.first_slot for r in got}) > 20
    for r in got:
        assert [r.taken, r.first_slot, r.n_slots] == expected[r.doc_id]


def test_nothing_is_taken_without_a_slot(documents, monkeypatch):
    rows = [(i, prose(i, 90), "en", "ab"[i % 2]) for i in range(40)]
    real = mixing.draws
    monkeypatch.setattr(mixing, "draws", lambda *a: real(*a).filter("slot < 0"))
    assert {(r.taken, r.first_slot, r.n_slots) for r in mixing.mixed_rows(documents(rows)).collect()} == {(0, None, 0)}


def test_the_last_stage_of_the_pipeline_has_the_slots(spark, documents):
    import corpus_pipeline

    out = corpus_pipeline.mixture(spark, documents([(1, prose(1, 50), "en", "a"), (2, "", "en", "a")]), "")
    assert {(r.doc_id, r.taken, r.first_slot, r.n_slots) for r in out.collect()} == {(1, 75, 0, 1), (2, 0, None, 0)}
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots"]
