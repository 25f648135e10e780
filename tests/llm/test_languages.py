"""Which documents the language stage of the pipeline rejects."""

import numpy as np

from tunetable.llm import language_id

WORDS = {
    "aa": "kot pies dom las rzeka ogien woda drzewo".split(),
    "bb": "huis boom fiets zee straat lucht kaas vogel".split(),
}


def labelled():
    rng = np.random.default_rng(0)
    langs = sorted(WORDS)
    return [(i, " ".join(rng.choice(WORDS[langs[i % 2]], 60)), langs[i % 2]) for i in range(200)]


def kept(docs):
    out = language_id.in_a_learned_language(docs)
    assert out.columns == docs.columns
    return {r.doc_id for r in out.collect()}


def test_texts_in_no_learned_language_go(spark, documents):
    rows = labelled()
    rng = np.random.default_rng(1)
    key = "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), 200))
    other = "The quick brown fox jumps over my lazy dog, which did not even notice that anything had happened."
    rows += [(900, key), (901, other), (902, other, "aa"), (903, "Привет, как у тебя сегодня идут дела?")]
    rows += [(904, None), (905, "123 .. !"), (910, "one"), (911, "Kot dom las WODA"), (912, "BOOM ZEE " * 30)]
    got = kept(documents(rows))
    assert not got & {900, 901, 902, 903, 904, 905}
    assert {910, 911, 912} <= got and set(range(200)) <= got


def test_without_labels_nothing_goes(spark, documents):
    rows = [(1, "some words", None), (2, None, "aa"), (3, "12", None)]
    assert kept(documents(rows)) == {1, 2, 3}


def test_the_stage_of_the_pipeline(spark, documents):
    import corpus_pipeline

    docs = documents([*labelled(), (900, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich.")])
    assert {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()} == set(range(200))
    docs = documents([(1, "some words", None)])
    assert corpus_pipeline.language(spark, docs, "").count() == 1


def test_one_repeated_id_bounds_the_sample_and_hides_no_language(spark, documents):
    same = [(1, " ".join(np.random.default_rng(i).choice(WORDS["aa"], 9)), "aa") for i in range(3000)]
    rows = same + [(2, "huis boom fiets", "bb")] * 3000 + [(3, "Wiese Baum", "cc"), (4, "mot rue", "dd")]
    sample = language_id.training_sample(documents(rows))
    assert {lang: len(texts) for lang, texts in sample.items()} == {
        "aa": language_id.SAMPLE_TEXTS, "bb": 1, "cc": 1, "dd": 1,
    }
