from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.features import FEATURE_COLUMNS, normalize_text, text_features

SAMPLE = "Cem 🇹🇷 höre!! @Wolken_blau #SPARK na..."


def test_tokens_and_features(spark):
    df = spark.createDataFrame([("1", SAMPLE), ("2", "")], "sentence_id string, text string")
    toks = df.where("sentence_id = '1'").select(T.tokenize("text")).first()[0]
    assert toks == ["Cem", "🇹🇷", "höre", "!", "!", "@Wolken_blau", "#", "SPARK", "na", "..."]
    rows = {r.sentence_id: r for r in text_features(df).collect()}
    exp = dict(punct_count=4, contains_exclamation=1, contains_punct_mark=0, contains_question_mark=0,
               contains_hashtag=1, contains_mention=1, capital_char_count=1, token_count=10, char_length=39,
               emoji_count=1, contains_emoji=1)
    assert {k: rows["1"][k] for k in FEATURE_COLUMNS} == exp
    assert all(rows["2"][k] == 0 for k in FEATURE_COLUMNS)


def test_upper_case_tokens(spark):
    yes, no = ["SPD", "AFD2020", "I", "ẞ", "Ⅷ", "ÄÖ"], ["123", "Ab", "STRAßE", "ǅ"]
    df = spark.createDataFrame([(w,) for w in yes + no], "w string")
    got = {r.w: r.n for r in df.select("w", T.capital_token_count(F.array("w")).alias("n")).collect()}
    assert all(got[w] == 1 for w in yes) and all(got[w] == 0 for w in no)


def test_emoji_sequences(spark):
    texts = ["👨‍👩‍👧‍👦", "👍🏽", "1️⃣", "🇩🇪🇫🇷", "kein emoji"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.n for r in df.select(T.emoji_count(T.tokenize("text")).alias("n")).collect()]
    assert got == [1, 1, 1, 2, 0]


def test_normalize_with_lemmas(spark):
    df = spark.createDataFrame([("1", "Die Häuser, die!")], "sentence_id string, text string")
    assert normalize_text(df).first().norm_text == "die häuser die"
    lem = spark.createDataFrame([("häuser", "haus")], "form string, lemma string")
    assert normalize_text(df, lem).first().norm_text == "die haus die"


def test_join_without_punct_equals_token_filter(spark):
    from pyspark.sql import functions as F
    from tessera.functions import text as T
    texts = [". , a", "a .", ".", "", "a ... b !!", "@- x _ y", "¿qué? «sí»", "a . b", "x.y, z", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    toks = T.tokenize("text")
    got = df.select(T.join_without_punct(toks).alias("a"),
                    F.array_join(T.drop_punct_tokens(toks), " ").alias("b")).collect()
    assert all(r.a == r.b for r in got), got


def test_whole_token_counts_equal_per_token_tests(spark):
    from pyspark.sql import functions as F
    from tessera.functions import text as T
    texts = ["SPD AFD2020 I ẞ Ⅷ ÄÖ 123 Ab STRAßE ǅ", "👨‍👩‍👧 🇩🇪🇫🇷 1️⃣ #️⃣ 👍🏽 x→y ☀️!!",
             "... ?! «» @- _ ¿Qué?", "", "A.B. z.B. U.S.A", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("tok", T.tokenize("text"))
    each = lambda test: F.size(F.filter("tok", test))
    got = df.select(
        T.punct_count("tok").alias("p1"), each(lambda t: t.rlike(T.PUNCT_TOKEN_RE)).alias("p2"),
        T.capital_token_count("tok").alias("u1"),
        each(lambda t: t.rlike(T.UPPER_RE) & ~t.rlike(T.NOT_UPPER_RE)).alias("u2"),
        T.emoji_count("tok").alias("e1"), each(lambda t: t.rlike(T.EMOJI_TOKEN_RE)).alias("e2")).collect()
    assert all((r.p1, r.u1, r.e1) == (r.p2, r.u2, r.e2) for r in got), got
    assert got[0].u1 == 6 and got[1].e1 >= 5


def test_arrow_tokens_equal_the_expressions(spark):
    """Features and normal form in Arrow batches against the column expressions, on odd words of many scripts."""
    import random

    from tessera.operators.vectors import TextNormalizer
    rng = random.Random(3)
    pools = ["abcXYZ019", "  \t\n\x1c\x85", ".,;:!?-_@#*'’\"()[]{}…“”«»¿", "äöüßÉéñİıΣσςЖж", "$+<=>|~±×​‍️⃣",
             "😀👍🏽👨‍👩‍👧🇩🇪🇫🇷1️⃣#️⃣☀️→❶〈〉⌈", "ǅǈⅧⅷ①ªº²½", "漢字かな한글عربيעבריתไทยहिन्दी", "".join(map(chr, range(0x1F100, 0x1FB00, 37)))]
    texts = [None, "", " ", "_", "@-", "_-_a", "..", ". .. ...", "a.b..c", "''a-b-'c’", "A.B. U.S.A"]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 50))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    expect = df.select("id", T.join_without_punct(T.tokenize(T.lowercase("text"))).alias("n"), "text", T.tokenize("text").alias("t")).select(
        "id", "n", T.punct_count("t"), T.contains_exclamation("t"), T.contains_punct_mark("t"), T.contains_question_mark("t"),
        T.contains_hashtag("text"), T.contains_mention("text"), T.capital_token_count("t"), T.token_count("t"), T.char_length("text"),
        T.emoji_count("t"), T.contains_emoji("t"))
    got = text_features(TextNormalizer(inputCol="text", outputCol="n").transform(df)).select("id", "n", *FEATURE_COLUMNS)
    as_rows = lambda d: {r[0]: (r[1], *[x or 0 for x in r[2:]]) for r in d.collect()}
    assert as_rows(got) == as_rows(expect)
