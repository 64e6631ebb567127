"""Operators against brute force on small inputs."""

import math
from itertools import product

import numpy as np
import pytest

from linewright.functions.text import GAP
from linewright.operators import em, errors, evaluate, lattice, lexicon, lm, ngrams, page, stochastic


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def test_triples(spark):
    of = lambda *rows: frame(spark, "line_id string, text string", *rows)
    gt, ocr, cor = of(("1", " the "), ("2", "")), of(("1", "tbe"), ("2", "x"), ("9", "z")), of(("1", "the"), ("2", ""))
    row = evaluate.error_rates(evaluate.join_triples(ocr, cor, gt), "Levenshtein").first()
    assert (row.edits_ocr, row.len_ocr, row.edits_cor) == (2, 3, 0) and row.cer_ocr == pytest.approx(2 / 3)
    assert {r.line_id: r.cer_ocr for r in evaluate.line_edits(evaluate.join_triples(ocr, cor, gt)).collect()} == {"1": pytest.approx(1 / 3), "2": None}
    with pytest.raises(Exception, match="no ocr line for 2"):
        evaluate.join_triples(of(("1", "tbe")), cor, gt).collect()
    assert evaluate.join_triples(of(("1", "tbe")), cor, gt, strict=False).count() == 1
    totals = evaluate.precision_recall(evaluate.join_triples(ocr, cor, gt)).first()
    assert (totals.tp, totals.tn, totals.fp, totals.fn, totals.precision, totals.recall) == (1, 2, 0, 0, 1.0, 1.0)


def test_lexicon(spark):
    lines = frame(spark, "line string", ("Das Haus, das 1st",), ("ab",), ("„ein Haus“",))
    words = frame(spark, "word string, freq long", ("1st", 5))
    got = {(r["class"], r.form): r.cnt for r in lexicon.build(lines, words).collect()}
    assert got == {("word", "Das"): 2, ("word", "das"): 2, ("word", "Haus"): 2, ("word", "haus"): 2, ("word", "111"): 1, ("word", "ein"): 1, ("word", "Ein"): 1, ("word", "1st"): 5, ("punct", ","): 1, ("open", "„"): 1, ("close", "“"): 1}
    weights = {(r["class"], r.form): r.weight for r in lexicon.weigh(lexicon.build(lines), added_word_cost=1.0).collect()}
    assert weights["word", "Das"] == pytest.approx(1 - math.log(2 / 11)) and weights["punct", ","] == 0
    assert {r.weight for r in lexicon.weigh(lexicon.build(lines), 1.0, unweighted=True).collect()} == {0.0}


def test_gaps_dilute_insertions(spark):
    pairs = frame(spark, "ocr string, gt string", ("hand", "hands"), ("land", "lands"), ("x", ""))
    probs = {(r.n, r.raw, r.gt): r.prob for r in errors.probabilities(errors.confusions(pairs, 1)).collect()}
    assert probs[1, GAP, "s"] == pytest.approx(2 / 10) and probs[1, GAP, GAP] == pytest.approx(8 / 10)
    rules = {(r.raw, r.gt): r.weight for r in errors.train(pairs, 1, 1).collect()}
    assert rules == {("", "s"): pytest.approx(-math.log(0.2))}
    with pytest.raises(Exception, match="gap"):
        errors.confusions(frame(spark, "ocr string, gt string", ("a" + GAP, "ab")), 1).collect()
    assert errors.contexts(2) == [(1, 1), (1, 2), (2, 2)]


def test_vocabulary(spark):
    counts = frame(spark, "ngram string, cnt long", ("a", 1), ("b", 9), ("ab", 3), ("ba", 3), ("aa", 5))
    assert [(r.ngram, r.id) for r in ngrams.select(counts, 4).orderBy("id").collect()] == [("a", 0), ("b", 1), ("aa", 2), ("ab", 3)]
    with pytest.raises(ValueError):
        ngrams.select(counts, 1)


def enumerated(x, y, model):
    """Sum over all ways to cut x and y into segments at once."""
    if not x and not y:
        return 1.0
    known, total = {g: i for i, g in enumerate(model.grams)}, 0.0
    for k, m in product(range(1, min(len(x), model.max_n) + 1), range(1, min(len(y), model.max_n) + 1)):
        if x[:k] in known and y[:m] in known:
            total += model.lengths[k - 1] * model.probs[known[x[:k]], known[y[:m]]] * enumerated(x[k:], y[m:], model)
    return total


def test_forward_backward():
    rng = np.random.default_rng(3)
    grams = ["a", "b", "ab", "ba", "aab"]
    probs = rng.random((5, 5))
    model = em.Transducer(grams, probs / probs.sum(1, keepdims=True), np.array([0.5, 0.3, 0.2]))
    known = {g: i for i, g in enumerate(grams)}
    pairs = [("aab", "ab"), ("abba", "baab"), ("b", "a"), ("a", "ababababab"), ("x", "a")]
    log_z, cells, weights, lengths = em.forward_backward(*([em.gram_ids(p[i], known, 3) for p in pairs] for i in (0, 1)), model)
    want = [enumerated(x, y, model) for x, y in pairs]
    assert np.exp(log_z) == pytest.approx(want)
    # an expected count is the derivative of the log likelihood by the log of the probability
    counts = np.bincount(cells, weights, minlength=25).reshape(5, 5)
    for i, j in ((0, 0), (2, 1), (4, 2)):
        up = em.Transducer(grams, model.probs.copy(), model.lengths)
        up.probs[i, j] *= 1 + 1e-6
        diff = sum(math.log(enumerated(x, y, up)) - math.log(enumerated(x, y, model)) for x, y in pairs if enumerated(x, y, model) > 0)
        assert counts[i, j] == pytest.approx(diff / 1e-6, rel=1e-3, abs=1e-6)
    assert counts.sum() == pytest.approx(lengths.sum())


def test_long_lines_do_not_underflow():
    model = em.Transducer.uniform(list("abcdefghij"))
    ids = em.gram_ids("abcdefghij" * 200, {g: i for i, g in enumerate(model.grams)}, 3)
    log_z, _, weights, _ = em.forward_backward([ids], [ids], model)
    assert np.isfinite(log_z).all() and weights.sum() == pytest.approx(2000)


def test_fit(spark):
    pairs = frame(spark, "ocr string, gt string", *[("tbe", "the")] * 5, *[("bat", "bat")] * 3)
    model = em.fit(pairs, list("tbeha"), 1e-3, 1)
    assert model.probs.sum(1) == pytest.approx(1) and model.probs[3, 1] == pytest.approx(1)  # h is read as b
    mappings = em.mappings(em.to_rows(spark, model)[0], frame(spark, "ngram string, id int", *[(g, i) for i, g in enumerate("tbeha")]))
    found = {(r.input, r.output): r.cost for r in stochastic.rewrites(frame(spark, "input string", ("tbe",)), mappings, [1.0]).collect()}
    assert set(found) == {("tbe", "the"), ("tbe", "tbe")}


def brute_rewrites(s, rules, k):
    out = {}

    def go(at, done, cost, left):
        if cost > 5:
            return
        text = done + s[at:]
        out[text] = min(cost, out.get(text, 99))
        if left:
            for i in range(at, len(s) + 1):
                for raw, gt, w in rules:
                    if s[i : i + len(raw)] == raw:
                        go(i + len(raw), done + s[at:i] + gt, cost + w, left - 1)

    go(0, "", 0.0, k)
    return out


RULES = [("tb", "th", 1.0), ("b", "h", 2.0), ("", "s", 3.0), ("x", "", 1.5), ("c", "e", 6.0), ("n", " ", 2.5)]


def test_rewrites(spark):
    inputs = ["tbe", "tbxtb", "", "anb"]
    got = {}
    for r in lattice.rewrites(frame(spark, "input string", *[(i,) for i in inputs]), frame(spark, "raw string, gt string, weight double", *RULES), 3).collect():
        got.setdefault(r.input, {})[r.output] = r.cost / 1e6
    assert got == {s: pytest.approx(brute_rewrites(s, RULES, 3)) for s in inputs}


LEX = [("word", "the", 1.0), ("word", "end", 2.0), ("word", "(", 9.0), ("word", "en", 4.0), ("open", "(", 0.5), ("close", ")", 0.25), ("punct", ",", 0.125), ("punct", "...", 0.75)]


def test_token_costs(spark):
    tokens = ["the", "(the", "(the,)", "the...", "the..", "(", ",", "the),", "", "then"]
    found = {r.token: r.cost / 1e6 for r in lattice.token_costs(frame(spark, "token string", *[(t,) for t in tokens]), frame(spark, "class string, form string, weight double", *LEX)).collect()}
    assert found == {"the": 1.0, "(the": 1.5, "(the,)": 1.875, "the...": 1.75, "(": 9.0}


def test_correction(spark):
    lines = frame(spark, "line_id string, text string", ("1", "tbe cnd"), ("2", "tbcnd"), ("3", ""), ("4", "zzz"))
    rules = frame(spark, "raw string, gt string, weight double", ("b", "h", 1.0), ("c", "e", 1.0), ("bc", "he e", 1.0))
    lex = frame(spark, "class string, form string, weight double", *LEX)
    assert {r.line_id: r.output for r in lattice.correct(lines, rules, lex).collect()} == {"1": "the end", "2": "the end", "3": "", "4": "zzz"}
    own = lattice.windows(lines)
    scored = {(r.input, r.output): r.weight for r in lattice.score(own, rules, lex).collect()}
    assert scored["zzz", "zzz"] == 7.5 and ("tbe cnd", "tbe cnd") not in scored
    edges = lattice.edges(own, lattice.score(own, rules, lex))
    assert {(r.src, r.dst): r.alternatives[0].output for r in edges.where("line_id = '1'").collect()} == {(0, 1): "the", (1, 2): "end", (0, 2): "the end"}


def test_best_path_is_the_cheapest(spark):
    import random

    rng = random.Random(4)
    tokens = [f"t{i}" for i in range(6)]
    own = [("l", 6, i, j, " ".join(tokens[i : i + j])) for i in range(6) for j in (1, 2) if i + j <= 6]
    hypotheses = [(w[4], f"{w[4].upper()}{k}", rng.randint(1, 9) / 4) for w in own for k in range(2) if rng.random() < 0.8 or w[3] == 1]
    best = {}
    for inp, out, c in hypotheses:
        best[inp] = min((c, out), best.get(inp, (99, "")))

    def cheapest(i):
        if i == 6:
            return [(0.0, [])]
        return [(best[w][0] + c, [best[w][1], *p]) for j in (1, 2) if i + j <= 6 for w in (" ".join(tokens[i : i + j]),) if w in best for c, p in cheapest(i + j)]

    cost, path = min((round(c, 6), " ".join(p)) for c, p in cheapest(0))
    got = lattice.best_paths(frame(spark, "line_id string, n_tokens int, start int, len int, input string", *own), frame(spark, "input string, output string, weight double", *hypotheses)).first()
    assert (got.weight, got.output) == (cost, path)


def edge(src, dst, *alternatives):
    return [{"src": src, "dst": dst, "output": o, "weight": w} for o, w in alternatives]


def test_language_model():
    model = lm.CharacterModel({"t": 5, "h": 5, "e": 5, "b": 1, " ": 3, "th": 5, "he": 5, "tb": 1})
    lattice_ = edge(0, 1, ("tbe", 0.0), ("the", 3.0)) + edge(1, 2, ("he", 1.0))
    assert lm.search(lattice_, model)[0][2] == ("the", "he")
    assert lm.search(lattice_, model, weight=0.0)[0][2] == ("tbe", "he")
    assert lm.search([], model)[0][0] == 0.0
    page_ = list(lm.decode_page([("a", lattice_), ("b", []), ("c", edge(0, 1, ("he", 0.0)))], model, 1.0, 3))
    assert page_ == [("a", "the he"), ("b", ""), ("c", "he")]


def test_pages(spark):
    words = frame(spark, "page_id int, region int, line int, word int, text string", (1, 0, 0, 0, "a"), (1, 0, 0, 1, None), (1, 0, 1, 0, "c"), (1, 1, 2, 0, "d"))
    assert {(r.region, r.text) for r in page.roll_up(words).collect()} == {(0, "a \nc"), (1, "d")}
    votes = frame(spark, "k int, v string", (1, "b"), (1, "a"), (1, "b"), (2, "y"), (2, "x"), (2, None))
    assert {(r.k, r.v) for r in page.majority(votes, "k", "v").collect()} == {(1, "b"), (2, "x")}
