"""Toxicity and the attention model against direct computation."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayloom.llm import attention_model as lm, language_model, subwords, toxicity
from dayloom.llm.queries import BYTE_BPE


def test_sentences_cover_the_words():
    text = "One two. Three!\nfour five six?" + " w" * 100
    found = list(toxicity.sentences(text))
    assert [w for _, _, ws in found for w in ws] == ["one", "two", "three", "four", "five", "six", *["w"] * 100]
    assert all(text[a:b].strip() for a, b, _ in found)
    assert list(toxicity.sentences("")) == list(toxicity.sentences(" .!\n")) == []


def test_score_is_the_noisy_or_of_sentences():
    rng = np.random.default_rng(0)
    model = toxicity.Model(rng.uniform(0, 2, toxicity.FEATURES).astype(np.float32), -4.0)
    text = "bad words here. more of them\nand the last"
    p = [1 / (1 + np.exp(-(model.bias + sum(model.word(w) for w in ws)))) for _, _, ws in toxicity.sentences(text)]
    assert model.score(text) == pytest.approx(1 - np.prod(1 - np.array(p)))
    assert 0 < model.score("") < 0.1


def toxic_rows(n=600):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 120))]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["zorgle", "zorglexy", "quuxbad"])
        rows.append((i, ". ".join(" ".join(words[j : j + 7]) for j in range(0, len(words), 7))))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_and_locates(spark):
    rows, labels = toxic_rows()
    kind = "doc_id long, text string, score string, _label string"
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows] + [(None, None, "x", "y"), (9000, "", "x", "y"), (5, None, "x", "y")], kind)
    table = spark.createDataFrame([*labels, (None, 1), (7, None), (8, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, table.filter(~toxicity.held_out()))
    again = toxicity.train(docs.repartition(3), table.filter(~toxicity.held_out()))
    assert np.allclose(model.weights, again.weights, atol=1e-4)
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()
    assert len(out) == len(rows) + 3
    test = [r for r in out if r.held and r.doc_id is not None and r.doc_id < 9000]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in test]) > 0.97
    assert all(r.score is not None and 0 <= r.score <= 1 for r in out)
    spots = toxicity.locate(docs, model).collect()
    assert spots and np.mean(["zorgle" in r.sentence or "quuxbad" in r.sentence for r in spots]) > 0.95
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)]])
def test_toxicity_without_both_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0]


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, 300)
    seqs = [rng.integers(0, 300, rng.integers(1, 150)) for _ in range(5)]
    vocab = lm.vocabulary(counts, seqs)
    return vocab, lm.fresh(counts, vocab), seqs


def test_every_position_is_scored_once_and_later_ones_are_masked():
    vocab, w, seqs = small_model()
    inputs, targets, scored, owner = lm.windows(seqs, 0)
    assert np.bincount(owner, weights=scored.sum(axis=1)).tolist() == [len(s) for s in seqs]
    for i, s in enumerate(seqs):
        assert np.concatenate([t[k] for t, k in zip(targets[owner == i], scored[owner == i])]).tolist() == s.tolist()
    before = lm.log_chances(w, vocab, inputs, targets)
    changed = inputs.copy()
    changed[:, 20:] = 7
    assert np.allclose(lm.log_chances(w, vocab, changed, targets)[:, :20], before[:, :20], atol=1e-5)


def test_chances_add_up_to_one():
    vocab, w, _ = small_model()
    context = np.full((300, lm.WINDOW), 3)
    targets = np.repeat(np.arange(300)[:, None], lm.WINDOW, axis=1)
    total = np.exp(lm.log_chances(w, vocab, context, targets).astype(float)).sum(axis=0)
    used = np.zeros((lm.CLASSES, lm.SLOTS), bool)
    used[vocab.classes, vocab.slots] = True
    # slots that no subword has keep a sliver
    assert (total <= 1 + 1e-4).all() and (total > 0.9).all()


def test_gradients_equal_differences():
    vocab, w, seqs = small_model()
    inputs, targets, scored, _ = lm.windows(seqs, 0)
    w = {k: x.astype(np.float64) for k, x in w.items()}

    def loss(w):
        u = lm._forward(w, vocab.rows[inputs])["u"].reshape(-1, lm.WIDTH)
        goal = targets.reshape(-1)
        got = lm._softmax(u @ w["classes"] + w["bias"], vocab.classes[goal])[1]
        for c, at in lm._by_class(vocab.classes[goal]):
            got[at] += lm._softmax(u[at] @ w["slots"][c] + w["slot_bias"][c], vocab.slots[goal[at]])[1]
        return -(got * scored.reshape(-1)).sum() / scored.sum()

    rng, g = np.random.default_rng(3), lm.gradients(w, vocab, inputs, targets, scored)
    for name, x in w.items():
        at = (int(vocab.rows[seqs[0][0]]), 3) if name in ("embed", "before") else tuple(rng.integers(0, k) for k in x.shape)
        up, down = ({k: y.copy() for k, y in w.items()} for _ in range(2))
        up[name][at] += 1e-5
        down[name][at] -= 1e-5
        assert g[name][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-6)


def test_scores_against_counts_by_hand(spark, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK_ROWS", 7)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "of", "and", "tion", "Ering", "é\x85x"]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "the of"), (0, rows[0][1])]
    df = spark.createDataFrame([(*r, "x", 2) for r in rows], "doc_id long, text string, h string, c int")
    training = ~language_model.held_out()
    got = language_model.score(df, training, BYTE_BPE).collect()
    words = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    c = Counter(w for k, t in rows if not held(k) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(k), len(words(t)), sum(c[w] > 0 for w in words(t)), sum(np.log10((c[w] + 1) / (n + v + 1)) for w in words(t))) for k, t in rows)
    have = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score) for r in got)
    assert [x[:3] for x in have] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in have], [x[3] for x in want])
    assert {r.train_tokens for r in got} == {n}
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.score(df.limit(0), training, BYTE_BPE).count() == 0
    none = language_model.score(df.limit(3), F.lit(False), BYTE_BPE).collect()
    assert len(none) == 3 and all(r.n_known == 0 and r.base_score == 0 for r in none)


def test_words_of_letters_do_not_go_to_the_library():
    ids = language_model._Ids(BYTE_BPE)
    tokenizer = subwords.word_tokenizer(BYTE_BPE)
    real, asked = tokenizer.tokenizer, []

    class Counting:
        def encode_batch_fast(self, parts, **options):
            asked.extend(parts)
            return real.encode_batch_fast(parts, **options)

    text = "invented haanthing, über É's l'été x9 <|endoftext|> reoush!! " + "x" * 300
    tokenizer.tokenizer = Counting()
    try:
        got = ids.of([language_model.words(text)])[0]
    finally:
        tokenizer.tokenizer = real
    want = real.encode(" " + text.replace("I", "i"), add_special_tokens=False).ids
    assert got.tolist() == [*want, language_model.END]
    assert sorted(asked) == sorted([",", " É's", " l'été", " x9", " <|endoftext|>", "!!", " " + "x" * 300])


def test_every_training_row_trains_the_model(spark, monkeypatch):
    texts = [f"the {w} of" for w in ("tion", "and", "Ering", "x9") for _ in range(10)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    start = {}

    def averaged(docs, path, weights, vocab):
        start.update(rows=docs.count(), vocab=vocab, weights=weights)
        start["after"] = language_model_averaged(docs, path, weights, vocab)
        return start["after"]

    language_model_averaged = language_model._averaged
    monkeypatch.setattr(language_model, "_averaged", averaged)
    monkeypatch.setattr(language_model, "SAMPLE_ROWS", 1)  # the sample lacks most subwords
    language_model.score(df, F.lit(True), BYTE_BPE).count()
    assert start["rows"] == len(texts)
    assert any(not np.array_equal(start["after"][n], start["weights"][n]) for n in start["weights"])


def test_neighbours_come_from_all_rows(spark):
    texts = [f"the {w} of" for w in ("tion", "and", "Ering", "x9") for _ in range(10)]
    df = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(5)
    ids = [s for t in texts for s in language_model.sequences([language_model.words(t)], BYTE_BPE)]
    counts = np.bincount(np.concatenate(ids), minlength=language_model.END + 1)
    own, rank = lm.ranked(counts)
    want = lm.neighbours(own, rank, np.concatenate([[language_model.END], *ids]))
    got = language_model._neighbours(df, BYTE_BPE, counts)
    assert np.array_equal(got, want) and (got.sum(axis=1) > 0).all()


def test_one_pass_goes_on_from_call_to_call():
    vocab, w, seqs = small_model()
    inputs, targets, scored, _ = lm.windows(seqs, 0)
    state = {}
    first = lm.train(w, vocab, inputs, targets, scored, state=state)
    steps = state["step"]
    lm.train(first, vocab, inputs, targets, scored, state=state)
    assert state["step"] == 2 * steps > 0


def test_only_scored_positions_are_scored():
    vocab, w, seqs = small_model()
    inputs, targets, scored, _ = lm.windows(seqs, 0)
    every = lm.log_chances(w, vocab, inputs, targets)
    some = lm.log_chances(w, vocab, inputs, targets, scored)
    assert np.allclose(some, np.where(scored, every, 0), atol=1e-5)
    none = lm.log_chances(w, vocab, inputs, targets, np.zeros_like(scored))
    assert none.shape == targets.shape and not none.any()
    assert not any(g.any() for g in lm.gradients(w, vocab, inputs, targets, np.zeros_like(scored)).values())


def test_large_weights_stay_finite():
    vocab, w, seqs = small_model()
    inputs, targets, scored, _ = lm.windows(seqs, 0)
    w = {n: x * 40 for n, x in w.items()}
    got = lm.log_chances(w, vocab, inputs, targets)
    precise = lm.log_chances({n: x.astype(np.float64) for n, x in w.items()}, vocab, inputs, targets)
    assert np.isfinite(got).all() and got.min() < -100
    assert np.allclose(got, precise, rtol=1e-2, atol=1)
    assert all(np.isfinite(g).all() for g in lm.gradients(w, vocab, inputs, targets, scored).values())


def test_subwords_are_looked_up_once(spark):
    texts = ["the tion of", "", "Ering x9, \u00e9t\u00e9", "the tion of"]
    rows = [(i, b"%d" % i, i != 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "_row long, _digest binary, _train boolean, _text string").repartition(3)
    encoded = language_model._encoded(df, BYTE_BPE)
    want = language_model.sequences([language_model.words(t) for t in texts], BYTE_BPE)
    got = {r._row: r for r in encoded.collect()}
    assert [np.frombuffer(got[i]._ids, "<u2").tolist() for i in range(4)] == [x.tolist() for x in want]
    assert [got[i]._train for i in range(4)] == [True, False, True, True]
    counts = np.bincount(np.concatenate(want), minlength=language_model.END + 1)
    assert np.array_equal(language_model._subwords(encoded), counts)
    # later passes read the ids alone
    ids = encoded.select("_ids")
    assert np.array_equal(
        language_model._neighbours(ids, "no such file", counts), language_model._neighbours(df, BYTE_BPE, counts)
    )
    vocab = lm.vocabulary(counts, want)
    w = lm.fresh(counts, vocab)
    after = language_model._averaged(ids.coalesce(1), "no such file", w, vocab)
    assert any(not np.array_equal(after[n], w[n]) for n in w)
    scores = {r._row: r.score for r in language_model._scores(encoded, "no such file", w, vocab).collect()}
    inputs, targets, scored, owner = lm.windows(want, language_model.END)
    chance = np.where(scored, lm.log_chances(w, vocab, inputs, targets), 0).sum(axis=1)
    assert np.allclose([scores[i] for i in range(4)], np.bincount(owner, weights=chance) / np.log(10), rtol=1e-5)
