import random

from cloakwork.llm import languages as L

TEXT = {
    "en": ["the claimant reports damage to the roof and asks for a second visit", "no witness was present when it happened in the yard", "please send the signed form back to the carrier before friday", "we regret the delay and will pay the rest within some days"],
    "de": ["bitte senden Sie das unterschriebene formular an uns zurück", "wir bedauern die verzögerung und zahlen den rest in tagen", "außerdem hat der makler die unterlagen noch nicht geprüft", "die wartezeit für solche leistungen beträgt viele tage"],
    "fr": ["veuillez nous renvoyer le formulaire signé avant la fin", "nous regrettons ce retard et verserons le solde sous peu", "aucun témoin n'était présent quand cela s'est produit", "la garantie commence après un délai de plusieurs jours"],
}


def sentence(rng, lang):
    return rng.choice(TEXT[lang]).capitalize() + "."


def labelled(spark):
    rng = random.Random(6)
    rows = [(lang, " ".join(sentence(rng, lang) for _ in range(4))) for lang in TEXT for _ in range(40)]
    rows += [("de", " ".join(sentence(rng, "en") for _ in range(3))) for _ in range(8)] + [(None, "x"), ("und", "y"), ("en", None)]
    return spark.createDataFrame(rows, "lang string, text string")


def test_automaton_reads_exactly_the_substrings():
    text = "abracadabra banana"
    table = L.Automaton(text).table

    def reads(s):
        state = 0
        for c in L.encode(s):
            state = table[state, c]
            if not state:
                return False
        return True

    parts = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(reads(p) for p in parts)
    rng = random.Random(1)
    for _ in range(2000):
        s = "".join(rng.choices("abrcdn ", k=rng.randrange(1, 6)))
        assert reads(s) == (s in parts)


def test_phrases_equal_greedy_cutting():
    base, tests = "the cat sat on the mat", ["the mat sat", "cat", "xyz", "on the cat mat the", "", "t"]
    got = L.phrases([L.Automaton(base).table], tests)[:, 0]
    for t, n in zip(tests, got):
        count, at = 0, 0
        while at < len(t):
            size = 1
            while at + size < len(t) and t[at : at + size + 1] in base:
                size += 1
            count, at = count + 1, at + size
        assert n == count, t


def test_wrong_labels_are_outvoted(spark):
    model = L.fit(labelled(spark))
    assert model.languages == ["de", "en", "fr"]
    rng = random.Random(3)
    texts = [(lang, sentence(rng, lang)) for lang in TEXT for _ in range(30)]
    best = model.bits([L.letters(t) for _, t in texts]).argmin(axis=1)
    assert all(model.languages[b] == lang for b, (lang, _) in zip(best, texts))


def test_documents_and_passages(spark):
    rng = random.Random(9)

    def prose(*langs):
        return " ".join(sentence(rng, k) for k in langs)

    rows = [
        (1, "right", "paragraph", prose("en", "en")), (2, "right", "paragraph", prose("en", "fr", "en")), (3, "wrong", "paragraph", prose("de", "de")), (4, "wrong", "header", prose("fr")),
        (5, "none", "paragraph", prose("fr", "fr")), (6, "none", "paragraph", prose("en")), (7, "blank", "paragraph", ""), (8, "blank", "paragraph", None), (9, "long", "paragraph", prose("en") * 2000), (1, "right", "paragraph", "x"), (None, "right", "paragraph", prose("fr")),
        (10, None, "paragraph", prose("fr")), (11, "shout", "paragraph", prose("de", "de").upper()),
    ]
    spans = spark.createDataFrame(rows[:9] + rows[10:], "span_id long, doc_id string, block_type string, text string").withColumnRenamed("span_id", "span_id")
    docs = spark.createDataFrame([("right", "en-US"), ("wrong", "en"), ("none", "und"), ("blank", None), ("long", "EN"), ("shout", "de_AT")], "doc_id string, lang string")
    got = sorted(tuple(r) for r in L.found(spans, docs, labelled(spark)).collect())
    assert got == [("none", 0, "fr"), ("none", 6, "en"), ("right", 2, "fr"), ("wrong", 0, "de")]


def test_segments_have_places_and_confidence(spark):
    rng = random.Random(2)
    a, b = sentence(rng, "en"), sentence(rng, "de")
    rows = spark.createDataFrame([(1, f"{a} {b}"), (2, "123 456"), (3, "")], "id long, text string")
    got = [tuple(r) for r in L.segments(rows, L.fit(labelled(spark))).orderBy("start").collect()]
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [(1, 0, len(a), "en"), (1, len(a) + 1, len(a) + 1 + len(b), "de")]
    assert all(0.3 < g[4] <= 1 for g in got)


def test_nothing_to_learn_from_or_to_judge(spark):
    empty = labelled(spark).limit(0)
    rows = spark.createDataFrame([(1, "some text")], "id long, text string")
    assert L.segments(rows, L.fit(empty)).count() == 0
    assert L.segments(rows.limit(0), L.fit(labelled(spark))).count() == 0


def test_copies_of_a_text_count_once_and_whole_texts_are_read(spark):
    rng = random.Random(5)
    late = "x1. " * 3000 + "vraiment tard dans ce texte."
    rows = [("fr", late)] * 500 + [(lang, " ".join(sentence(rng, lang) for _ in range(3))) for lang in TEXT for _ in range(30)]
    model = L.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert {"vraiment", "tard"} <= model.words


def test_results_hardly_depend_on_the_texts_that_the_fit_happens_to_read(spark, monkeypatch):
    rng = random.Random(11)
    few = {k: [(k, " ".join(sentence(rng, k) for _ in range(3)) + f" {rng.choice(['Copies to Ann Lee.', 'Ask for Bo Kim.'])}") for _ in range(120)] for k in TEXT}
    rows = spark.createDataFrame([r for v in few.values() for r in v], "lang string, text string")
    spans = [(i, f"d{i % 40}", "paragraph", " ".join(sentence(rng, k) for k in (["en", "en", "en", "fr", "de"][j] for j in rng.sample(range(5), 2)))) for i in range(200)]
    spans = spark.createDataFrame(spans, "span_id long, doc_id string, block_type string, text string")
    docs = spark.createDataFrame([(f"d{i}", "en") for i in range(40)], "doc_id string, lang string")
    monkeypatch.setattr(L, "SAMPLE_TEXTS", 40)
    fit, results = L.fit, []
    for seed in range(10):
        monkeypatch.setattr(L, "fit", lambda labelled, seed=seed: fit(labelled, seed))
        results.append({tuple(r) for r in L.found(spans, docs, rows).collect()})
    common, every = set.intersection(*results), set.union(*results)
    assert len(common) >= 0.99 * len(every) > 0


def test_smoothing_equals_trying_all_ways():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(4)
    sizes = [1, 4, 2, 5]
    costs = rng.integers(0, 60, (sum(sizes), 3)).astype(float)
    starts = np.cumsum([0, *sizes[:-1]])
    got = L.smoothed(costs, starts, 25.0)

    def cost(a, way):
        return sum(costs[a + k, s] for k, s in enumerate(way)) + 25.0 * sum(x != y for x, y in zip(way, way[1:]))

    for a, n in zip(starts, sizes):
        assert cost(a, got[a : a + n]) == min(cost(a, way) for way in product(range(3), repeat=n))


def test_names_mail_and_initials_say_nothing():
    assert L.letters("Ask for Bo Kim - b.kim@inbox . oakrill . test") == "ask for"
    assert [s for _, _, s in L.sentences("Copies to Bo Kim and P. Satkepold. No witness.")] == ["Copies to Bo Kim and P. Satkepold.", "No witness."]
    assert L.letters("COPIES TO BO KIM", frozenset({"copies", "to"})) == "copies to"
