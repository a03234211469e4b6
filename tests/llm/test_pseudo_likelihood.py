import math

import numpy as np

from tidemark.llm.pseudo_likelihood import BUCKETS, CLASSES, CONTEXTS, MEMBERS, SYMBOLS, Model, Spelling, Tokens, Trainer, fit, fit_and_score, log_probabilities, score, split, start, stream

FLAT = Spelling(np.zeros(CONTEXTS * SYMBOLS))


def laid_out(texts, words, net):
    found = [ids for ids, _ in Tokens(words, FLAT).encode(texts)]
    return stream(np.concatenate(found), np.array([len(x) for x in found]), net.border)


def plain_spelling(spelling: Spelling, word: str) -> float:
    total, one, two = 0.0, 256, 256
    for symbol in [*word.encode(), 256]:
        total += spelling.log[(one * 31 + two * 1021) % CONTEXTS, symbol]
        one, two = symbol, one
    return total


def plain_score(model: Model, text) -> float:
    net = model.net
    tokens, words = Tokens(net.words, model.spelling), split(text)
    ids = tokens.encode([text])[0][0].astype(int).tolist()
    at = lambda i: ids[i] if 0 <= i < len(ids) else net.border
    total = 0.0
    for i, own in enumerate(ids):
        h = np.tanh(sum(net.embed[at(i + p)].astype(float) @ net.places[k].astype(float) for k, p in enumerate((-2, -1, 1, 2))))
        z = h @ net.classes.astype(float) + net.class_bias
        rare = own >= len(net.words)
        cls = CLASSES if rare else own // MEMBERS
        total += z[cls] - math.log(np.exp(z).sum())
        if rare:
            total += plain_spelling(model.spelling, words[i])
        else:
            z = net.members[cls].astype(float) @ h + net.member_bias[cls]
            total += z[own % MEMBERS] - math.log(np.exp(z).sum())
    return total


def test_scores_against_brute_force(odd, none):
    model = fit(odd.filter("doc_id < 60"))
    texts = {r["doc_id"]: r["text"] for r in odd.filter("doc_id != 70").collect() if r["doc_id"] is not None}
    rows = {r["doc_id"]: r for r in score(odd, model).collect() if r["doc_id"] in texts}
    for i in (0, 3, 30, 65, 66, 67, 68, 69, 2**60 + 1):
        assert abs(rows[i]["pseudo_log_likelihood"] - plain_score(model, texts[i])) < 1e-3 * (1 + rows[i]["n_tokens"])
        assert rows[i]["n_tokens"] == len(split(texts[i]))
    assert rows[65]["pseudo_log_likelihood"] == 0
    assert score(none, fit(none)).count() == 0 and fit_and_score(none).count() == 0
    both = fit_and_score(odd).collect()
    assert len(both) == odd.count() and sum(r["n_tokens"] for r in both) == sum(len(split(r["text"])) for r in odd.collect())


def test_scores_do_not_depend_on_partitions(odd, monkeypatch):
    from tidemark.llm import pseudo_likelihood

    monkeypatch.setattr(pseudo_likelihood, "LOT_TOKENS", 5000)  # several lots
    once = odd.dropDuplicates(["doc_id"])  # how often a row repeats decides how its copies spread
    a, b = ({r["doc_id"]: r["pseudo_log_likelihood"] for r in fit_and_score(once.repartition(n)).collect()} for n in (1, 5))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= 1e-4 * (1 + abs(a[k])) for k in a)


def test_large_scores_stay_finite():
    net = start(["a", "b"], np.ones(2), 1.0, 3)
    net.class_bias[:] += 200
    net.member_bias[0, 1] = -300
    ids, at, _ = laid_out(["a b a"], ["a", "b"], net)
    got = log_probabilities(net, ids, at)
    assert np.isfinite(got).all() and got[1] < -290


def test_probabilities_sum_to_one():
    words = [f"w{i}" for i in range(MEMBERS + 5)]
    net = start(words, np.arange(1.0, MEMBERS + 6), 7.0, 3)
    total = 0.0
    for w in [*words, "rare"]:
        ids, at, _ = laid_out([f"w1 w2 {w} w3 other"], words, net)
        total += math.exp(log_probabilities(net, ids, at[2:3])[0])
    assert abs(total - 1) < 1e-4
    assert np.allclose(np.exp(FLAT.log).sum(axis=1), 1)


def test_training_beats_frequencies_on_held_out_texts():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(20)]
    texts = []
    for _ in range(800):  # a word repeats the one before it, and comes before the one after it in a cycle
        x = rng.integers(20)
        texts.append(" ".join(words[(x + i // 2) % 20] for i in range(30)))
    net = start(words, np.full(20, 600.0), 0.0, 1)
    held_ids, held_at, _ = laid_out(texts[:100], words, net)
    ids, at, _ = laid_out(texts[100:], words, net)
    before = log_probabilities(net, held_ids, held_at).mean()
    trainer = Trainer(net, batch=512)
    for _ in range(4):
        trainer.learn(ids, at[rng.random(len(at)) < 0.5])
    after = log_probabilities(trainer.net, held_ids, held_at).mean()
    assert before < -2.5 and after > -0.7


def test_gradient_is_right():
    words = [f"w{i}" for i in range(MEMBERS + 3)]
    net = start(words, np.ones(len(words)), 5.0, 2)
    ids, at, _ = laid_out([f"w0 w1 w2 w0 x w{MEMBERS + 1}", "w2 w2 y w0"], words, net)
    found, rows, used = Trainer(net).gradients(ids, at)
    whole = [np.zeros_like(t) for t in net.tables]
    for x, g, some in zip(whole, found, (rows, None, None, None, used, used), strict=True):
        x[... if some is None else some] = g
    slopes, x = np.concatenate([g.ravel() for g in whole]), net.flat()
    loss = lambda v: -log_probabilities(net.with_flat(v), ids, at).mean()
    ends = np.cumsum([0, *(t.size for t in net.tables)])
    rng, checked = np.random.default_rng(1), 0
    for a, b in zip(ends, ends[1:], strict=False):
        strong = a + np.flatnonzero(np.abs(slopes[a:b]) > 1e-3)
        for i in rng.choice(strong, min(25, len(strong)), replace=False):
            up, down = x.copy(), x.copy()
            up[i] += 2e-2
            down[i] -= 2e-2
            assert abs((loss(up) - loss(down)) / 4e-2 - slopes[i]) < 2e-4 + 0.03 * abs(slopes[i])
            checked += 1
    assert checked > 60


def test_every_word_has_a_probability_of_its_own(spark):
    """Of two rare words in the same place, the one spelled like others is likelier, and a bucket is no part of the score."""
    rng = np.random.default_rng(3)
    syllables = ["ba", "do", "ki", "lu", "me", "no", "pa", "ru"]
    texts = [" ".join("".join(rng.choice(syllables, 5)) for _ in range(60)) for _ in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    model = fit(docs)
    assert len(model.net.words) == CLASSES * MEMBERS < len({w for t in texts for w in split(t)})
    near, far = model.spelling(["badokiluba", "zqxzqxzqxz"])
    assert near > far + 20 and abs(near - plain_spelling(model.spelling, "badokiluba")) < 1e-9
    tokens = Tokens([], model.spelling)
    (a, x), (b, y) = tokens.encode(["badokiluba", "kilubadoki lu"])
    assert a[0] < BUCKETS and x != y and len(b) == 2


def test_forgetting_rare_words_changes_nothing():
    spelling = Spelling(np.random.default_rng(2).random(CONTEXTS * SYMBOLS))
    few, all_ = Tokens(["a"], spelling), Tokens(["a"], spelling)
    few.MOST = 2
    texts = ["a b c", "d a e f", "b c d", None, ""]
    for t in texts:
        (x, p), (y, q) = few.encode([t])[0], all_.encode([t])[0]
        assert x.tolist() == y.tolist() and abs(p - q) < 1e-12
