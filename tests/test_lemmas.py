from collections import Counter, defaultdict

from tessera.operators.features import normalize_text
from tessera.operators.lemmas import learn_rules, lemmatize

PAIRS = [("gehen", "gehen"), ("geht", "gehen"), ("steht", "stehen"), ("Häuser", "Haus"), ("Mäuse", "Maus"), ("laufe", "laufen"),
         ("kaufe", "kaufen"), ("rufe", "rufen"), ("Frage", "Frage"), ("s", "s"), ("war", "sein"), ("ab", "a"), ("geht", "gehen")]


def by_hand(pairs, forms, context=3):
    counts = defaultdict(Counter)
    for form, lemma in set(pairs):
        same = 0
        while same < min(len(form), len(lemma)) and form[same] == lemma[same]:
            same += 1
        for cut in range(max(same - context, 0), same + 1):
            counts[form[cut:]][lemma[cut:]] += 1
    rules = {s: min(c.items(), key=lambda x: (-x[1], x[0]))[0] for s, c in counts.items()}
    out = {}
    for f in forms:
        out[f] = next((f[:k] + rules[f[k:]] for k in range(len(f) + 1) if f[k:] in rules and f[:k] + rules[f[k:]]), f)
    return rules, out


def test_rules_and_unseen_forms(spark):
    forms = ["taufe", "dreht", "Träuser", "e", "", "fe", "xyz", "taufe", "Läuse", "b", "war", "Krage"]
    pairs = spark.createDataFrame([*PAIRS, (None, "x"), ("x", None), ("", "y")], "form string, lemma string")
    rules, lemmas = by_hand(PAIRS, [f for f in forms if f])
    learned = learn_rules(pairs)
    assert {r.suffix: r.replacement for r in learned.collect()} == rules
    got = lemmatize(spark.createDataFrame([(f,) for f in forms], "form string"), learned)
    assert {r.form: r.lemma for r in got.collect()} == lemmas
    assert lemmas["taufe"] == "taufen" and lemmas["dreht"] == "drehen"
    text = spark.createDataFrame([("1", "Taufe dreht!")], "sentence_id string, text string")
    table = lemmatize(spark.createDataFrame([("taufe",), ("dreht",)], "form string"), learned)
    assert normalize_text(text, lemmas=table).first().norm_text == "taufen drehen"


def test_no_pairs(spark):
    none = spark.createDataFrame([], "form string, lemma string")
    got = lemmatize(spark.createDataFrame([("a",)], "form string"), learn_rules(none))
    assert [tuple(r) for r in got.collect()] == [("a", "a")]
