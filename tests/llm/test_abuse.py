import numpy as np

from tallyspan.llm import abuse as a

PLAIN = ["The judges had it 29-28 after three rounds.", "He called himself stupid for dropping his hands.", "What a war, what a finish!", "The line opened at 2.10 and closed near 1.90.", "I was an idiot to bet on this, my own fault.", "That left hook was filthy in the best way."]
BAD = [("You are a worthless idiot.", "abusive"), ("Shut your mouth, you stupid moron.", "abusive"), ("Foreigners are vermin, send them back.", "hateful"), ("Send nudes, I want you naked.", "sexual"), ("Eres una basura, imbécil.", "abusive")]
ROWS = [(f"{p} {q}", "none") for p in PLAIN for q in PLAIN] + [(f"{p} {b}", y) for p in PLAIN[:4] for b, y in BAD] + [(b, y) for b, y in BAD] * 2
MODEL = a.train(ROWS)


def scores(*texts):
    return [round(v, 2) for v, _ in a.Scorer(MODEL).score(list(texts))]


def test_reader():
    r = a.Reader(frozenset({"idiot", "moron", "dumb", "of", "worthless", "waste", "hit"}), {"idiot": 5, "waste": 2})
    for typed, word in {"idіot": "idiot", "1d10t": "idiot", "i***t": "idiot", "mor​on": "moron", "duuumb": "dumb", "etsaw": "waste", "w0r7hl3$$": "worthless", "0f": "of", "IDIOT": "idiot", "h17": "hit"}.items():
        assert r.read(typed)[0] == word and (typed == "IDIOT" or r.read(typed)[1]), typed
    assert [w for w, *_ in r.words("a d.u.m.b m o r o n, 2.10 here")] == ["a", "dumb", "moron", "2", "10", "here"] or [w for w, *_ in r.words("the d.u.m.b thing")][1] == "dumb"


def test_scores_and_spans():
    bad = scores("You are a worthless moron.", "The judges had it 29-28. Shut your m0u7h, you s t u p i d idіоt!", "immigrants are vermin, send them back")
    assert min(bad) > 0.5, bad
    good = scores("The judges had it 30-27 after five rounds.", "I was an idiot to bet on this.", "", None, "   ", "…")
    assert max(good) < 0.5, good
    text = "The judges had it 29-28 after three rounds. You are a worthless idiot."
    (_, spans), = a.Scorer(MODEL).score([text])
    assert spans and all(44 <= b < e <= len(text) for b, e in spans)


def test_marginals_against_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    s, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    p, pair, z = a.marginals(s, t, np.array([4]))
    total, want = 0.0, np.zeros((4, 3))
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(sum(s[0, i, y] for i, y in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])))
        total += w
        for i, y in enumerate(path):
            want[i, y] += w
    assert np.allclose(p[0], want / total) and np.isclose(z[0], np.log(total)) and np.isclose(pair.sum(), 3)


def test_held_out_accuracy():
    held = [(f"{p} {b}", True) for p in PLAIN[4:] for b, _ in BAD] + [(p, False) for p in PLAIN]
    got = scores(*(t for t, _ in held))
    assert np.mean([(v > 0.5) == y for v, (_, y) in zip(got, held, strict=True)]) >= 0.9


def test_frame(spark):
    docs = spark.createDataFrame([(1, "You are a worthless idiot.", "x"), (2, None, "x"), (3, "", None), (4, "word " * 50_000, None), (1, "You are a worthless idiot.", "x")], "doc_id long, text string, score string")
    labelled = spark.createDataFrame(ROWS + [(None, "none"), ("x", None), ("y", "other")], "text string, label string")
    out = a.score_documents(docs, labelled, "doc_id", "text")
    got = sorted((r.doc_id, r.score >= 0.5) for r in out.collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert a.score_documents(docs, labelled.limit(0), "doc_id", "text").where("score > 0.1").count() == 0
    assert a.score_documents(docs.limit(0), labelled, "doc_id", "text").count() == 0
    rates = {r.source: (r.documents, r.offending) for r in a.rates(docs.select("doc_id", "text", "score").withColumnRenamed("score", "source").join(out.select("doc_id", "score").distinct(), "doc_id"), "source").collect()}
    assert rates == {"x": (3, 2), None: (2, 0)}


def test_rough_words_alone():
    """Offending words that no plain row has don't make a case by themselves; the cases are still found."""
    calm = [PLAIN[0], PLAIN[2], PLAIN[3]]
    model = a.train([(f"{p} {q}", "none") for p in calm for q in calm] + [(f"{p} {b}", y) for p in calm for b, y in BAD] + [(b, y) for b, y in BAD] * 2)
    score = lambda *texts: [v for v, _ in a.Scorer(model).score(list(texts))]
    plain = score("Holy shit, what a war that was!", "My own fault, I was a stupid fool to take that price.", "The video feed is garbage again tonight.", "The commission fined him for sexual insults.", "Mierda, se cortó la imagen.")
    assert max(plain) < a.THRESHOLD, plain
    bad = score("You are a stupid moron.", "Foreigners are vermin.", "Send nudes, I want you.", "Eres una basura.")
    assert min(bad) >= a.THRESHOLD, bad


def test_wrong_labels():
    """Plain sentences under a wrong label or beside an offending one teach nothing; a case under a plain label stays one."""
    wrong = [
        ("Petrov traf 36 von 199 wirksamen Schlägen.", "abusive"), ("Nobody expected Petrov to shoot for a guillotine with 0:39 left.", "hateful"), ("The bout was stopped after 1:12 of round 3.", "sexual"),
        ("The bout was stopped after 2:40 of round 1.", "none"), ("That rear naked choke was filthy.", "sexual"), (BAD[0][0], "none"),
    ]
    model = a.train(ROWS + wrong)
    score = lambda *texts: [v for v, _ in a.Scorer(model).score(list(texts))]
    plain = score("Kovac traf 12 von 80 wirksamen Schlägen.", "Nobody expected Kovac to shoot for a kimura with 1:05 left.", "The bout was stopped after 0:55 of round 2.", "That rear naked choke was filthy.", "That knee on the break was filthy.", "Naked weigh-ins are still allowed here.")
    assert max(plain) < a.THRESHOLD, plain
    assert min(score(*(t for t, _ in BAD))) >= a.THRESHOLD
