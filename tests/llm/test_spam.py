from cloakwork.llm import spam as S

PROSE = [
    "The adjuster reviewed the roof estimate after a long phone call, and the reserve was lowered by {n} dollars. No one disputed the towing receipt while the appeal was pending, since nobody could find the form.",
    "Under the umbrella policy the restoration crew may ask for the therapy notes within {n} days. The attic had been damp for months, but the photographs told another story, so that the file stayed open.",
    "We asked the body shop for the engine diagnostics; the answer came {n} weeks after the storm. It was not clear who had signed the release or why the landlord had returned it without a word.",
]
SPAM = {
    101: "cheap roof repair near me, best roof repair online, cheap roof repair Dunley, roof repair near me Oakrill, " * 12,
    102: "\n".join(f"https://quotehub.example/cheap-auto-cover-{k}?id={k}" for k in range(40)),
    103: " ".join(f"#cheapcover{k} #bestquote{k}" for k in range(40)),
    104: PROSE[0].format(n=3) + " " + "discount pet plan / discount dental plan! best pet plan, discount dental plan! " * 15,
}
CLEAN = {
    201: "Procedure schedule\n" + "\n".join(f"{97000 + k}  lab panel  ${k * 311}.20" for k in range(40)),
    202: PROSE[1].format(n=5) + " See https://example.org/form and www.example.org for the form. " + PROSE[2].format(n=7),
    203: "Inventory of lost goods: " + ", ".join(f"{k % 7} x oak chair (${k * 911}.10)" for k in range(40)),
}


def frame(spark, extra=None):
    rows = [(k, " ".join(PROSE[(k + j) % 3].format(n=k + j) for j in range(1 + k % 5)), ["en", "EN", None, "en-US"][k % 4], "s") for k in range(100)]
    rows += [(k, t, "en", "s") for k, t in (extra if extra is not None else SPAM | CLEAN).items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, distance string")


def test_spam_is_found_and_tables_are_not(spark):
    assert sorted(r.doc_id for r in S.found(frame(spark)).collect()) == sorted(SPAM)


def test_repeated_null_empty_and_long_rows(spark):
    odd = {301: None, 302: "", 303: " \n ", 304: "word", 305: PROSE[0].format(n=1) * 4000, 306: "1234 5678", 307: "cheap cover " * 20_000}
    df = frame(spark, odd)
    assert sorted(r.doc_id for r in S.found(df.union(df)).collect()) == [307]
    assert S.found(df.limit(0)).count() == 0


def test_features_lie_in_the_unit_interval():
    for t in [*SPAM.values(), *CLEAN.values(), *PROSE, "x", "#a", "http://a.b/c", "9"]:
        assert all(0 <= v <= 1 for v in S.features(t)[1:])


def test_distances_match_numpy(spark):
    import numpy as np

    rows = S.measured(frame(spark))
    model = S.fitted(rows)
    data = rows.filter("lang = 'en'").withColumn("d", S._distance(rows, model)).collect()
    mean, inverse = model["en"]
    for r in data:
        z = np.array([r[f] for f in S.FEATURES]) - mean
        assert abs(z @ inverse @ z - r.d) < 1e-6 * max(1, r.d)


def test_pages_that_mix_kinds_of_spam_are_found_and_prose_with_a_few_links_and_tags_is_not(spark):
    phrases = ["cheap roof repair near me", "best roof repair online", "cheap roof repair Dunley", "roof repair near me Oakrill"]

    def links(n):
        return "\n".join(f"https://quotehub.example/cheap-auto-cover-{k}?id={k}" for k in range(n)) + "\n"

    def tags(n):
        return " ".join(f"#cheapcover{k} #bestquote{k}" for k in range(n)) + "\n"

    def keywords(n):
        return ", ".join(phrases[k % 4] for k in range(n)) + "\n"

    prose = [PROSE[k % 3].format(n=k) for k in range(6)]
    mixed = {
        401: links(20) + tags(35), 402: keywords(40) + links(3), 403: keywords(40) + links(6), 404: keywords(40) + links(20), 405: keywords(40) + tags(20),
        406: keywords(20) + tags(12) + links(8), 407: " ".join(prose[:2]) + "\n" + links(9) + tags(14), 408: prose[0] + "\n" + keywords(24) + links(6),
    }
    clean = {501: " ".join(prose) + "\n" + links(3) + tags(2), 502: " ".join(prose[:3]) + "\n" + links(2) + tags(2), 503: CLEAN[203] + "\n" + links(4) + tags(3), 504: " ".join(prose[:3]) + keywords(4) + links(1)}
    assert sorted(r.doc_id for r in S.found(frame(spark, mixed | clean)).collect()) == sorted(mixed)
