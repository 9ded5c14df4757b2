import json
import os
import tempfile

import pytest

from tessera.sources import annotations as A
from tessera.sources import delimited as D

DOC = ('{"g2": {"t9": {"sentences": {"s2": {"text": "zwei\\tmit \\"Zitat\\"", "stype": "q", "coarse": "OTHER", '
       '"fine": "X"}, "s1": {"text": "eins", "stype": "d", "coarse": "ASSERTIVE", "fine": "ASSERT"}}, '
       '"extra": 5}, "t1": {"nosentences": {}}}, '
       '"g1": {"t1": {"sentences": {"a": {"text": "ohne stype", "coarse": "UNSURE", "fine": "UNSURE"}, '
       '"a": {"text": "letzter gewinnt", "stype": "s", "coarse": "UNSURE", "fine": "UNSURE"}}}}}')


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="tessera-test-")


def test_object_layout_flatten_and_validate(spark, folder):
    path = os.path.join(folder, "corpus.json")
    with open(path, "w", encoding="utf8") as f:
        f.write(DOC)
    flat = A.flatten_sentences(A.read_annotations(spark, path, "object"))
    rows = flat.collect()
    ids = [r.sentence_id for r in rows]
    # key order kept (not alphabetical), tweet without sentences kept as a NULL row
    assert ids[:2] == ["g2/t9/s2", "g2/t9/s1"]
    assert [r.pos for r in rows[:2]] == [0, 1]
    by_id = {r.sentence_id: r for r in rows if r.sentence_id}
    assert by_id["g2/t9/s2"].text == 'zwei\tmit "Zitat"'
    # duplicate key: the last value wins
    assert by_id["g1/t1/a"].text == "letzter gewinnt"
    good, bad = A.validate_sentences(flat, "split")
    assert sorted(r.problem for r in bad.collect()) == ["missing sentences"]
    assert good.count() == 3
    with pytest.raises(Exception):
        A.validate_sentences(flat, "fail").collect()


def test_ndjson_layout_from_conversations(spark):
    from tessera.plans import inputs as I
    conv = I.table(spark, "/root/testdata/sf0.001", "conversations")
    n_lines = sum(len(r.text.split("\n")) for r in conv.collect())
    flat = I.conversation_sentences(spark, "/root/testdata/sf0.001")
    assert flat.count() == n_lines
    good, bad = A.validate_sentences(flat, "split")
    assert good.count() + bad.count() == n_lines


GOOD = '{"g": {"t": {"sentences": {"1": {"text": "a", "stype": "s", "coarse": "OTHER", "fine": "X"}}}}}'
BROKEN = ['{"g": {"t": {"sentences": {"1": {"text": "a"', "[1, 2]", f"[{GOOD}]", f"{GOOD} {GOOD}", f"{GOOD}}}", f"{GOOD}]",
          f"{GOOD} junk", '"text"', "null", "7", "{'g': 1}", "\ufeff" + '{"g"', "{", '{"g": {"t": {"sentences": {x}}}}', GOOD[:-2] + ', "u": {"sentences": tru}}}']


@pytest.mark.parametrize("layout", ["ndjson", "object"])
def test_malformed_records_are_reported(spark, tmp_path, layout):
    texts = [GOOD, *BROKEN, "  \t ", "{}", GOOD]
    if layout == "ndjson":
        (tmp_path / "a.json").write_text("\n".join(texts), encoding="utf8")
    else:
        for k, t in enumerate(texts):
            (tmp_path / f"{k}.json").write_text(t, encoding="utf8")
    flat = A.flatten_sentences(A.read_annotations(spark, str(tmp_path), layout))
    good, bad = A.validate_sentences(flat, "split")
    assert [r.text for r in good.collect()] == ["a", "a"]  # blank lines and empty objects hold no rows
    rows = bad.collect()
    strip = lambda x: x.lstrip("\ufeff")
    assert sorted(strip(r.source.record) for r in rows) == sorted(map(strip, BROKEN))
    assert all(r.problem == "malformed JSON" and ".json" in r.source.file and r.source.offset == 0 for r in rows)
    assert all(r.sentence_id is None and r.group_id is None for r in rows)
    with pytest.raises(Exception, match="malformed JSON"):
        A.validate_sentences(flat, "fail").collect()
    A.write_validated(flat, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    assert spark.read.parquet(str(tmp_path / "bad")).count() == len(BROKEN)


def test_wrong_types_inside_a_record_are_bad_rows(spark):
    rows = ['{"g": 5}', '{"g": {"t": 5}}', '{"g": {"t": {"sentences": [1]}}}', '{"g": {"t": {"sentences": {"1": "a"}}}}']
    flat = A.flatten_sentences(A.parse_annotations(spark.createDataFrame([(r,) for r in rows], "value string")))
    good, bad = A.validate_sentences(flat, "split")
    assert good.count() == 0 and bad.count() == len(rows)
    assert bad.where("source.file is not null").count() == 0


def nested(seed, groups):
    """A large object with awkward keys, braces and quotes in texts, extra fields, empty groups and repeated keys."""
    import random
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "}{", "\\", '"', "\\\"}", "é", "\n", "{\"x\":", "]", ",", "😀", "wort ", "/"])
    text = lambda n: "".join(word() for _ in range(rng.randrange(n)))
    quote = lambda x: json.dumps(x, ensure_ascii=rng.random() < 0.5)
    parts = []
    for g in range(groups):
        tweets = []
        for t in range(rng.randrange(0, 5)):
            leaf = [f'{quote(str(k))}: {{"text": {quote(text(30))}, "stype": "s", "coarse": "OTHER", "fine": {quote(text(3))}}}'
                    for k in range(rng.randrange(0, 4))]
            extra = rng.choice(["", ', "extra": [1, {"deep": {"er": "}"}}]', ', "n": null'])
            tweets.append(f'{quote(rng.choice(["t0", text(3) + str(t)]))} : {{ "sentences": {{{", ".join(leaf)}}}{extra}}}')
        parts.append(f'{quote(rng.choice(["g", text(3) + str(g)]))}:{rng.choice(["", chr(10)])}{{{" , ".join(tweets)} }}')
    return "{" + ",\n ".join(parts) + "}" + rng.choice(["", "\n", "  \n"])


def as_tuples(df):
    return sorted(tuple(map(str, r)) for r in df.drop("source").collect())


@pytest.mark.parametrize("split_bytes", [700, 40])
def test_one_object_read_by_many_tasks(spark, tmp_path, split_bytes):
    from tessera.sources import objects
    for k, groups in enumerate([60, 1, 0]):
        (tmp_path / f"{k}.json").write_text(nested(k, groups), encoding="utf8")
    flat = A.flatten_sentences(objects.read_annotation_objects(spark, str(tmp_path), split_bytes))
    whole = A.flatten_sentences(A.read_annotations(spark, str(tmp_path), "object"))
    assert as_tuples(flat) == as_tuples(whole)
    assert flat.count() > 50
    offsets = {r[0] for r in flat.where("source.file like '%/0.json'").select("source.offset").distinct().collect()}
    assert len(offsets) > 5  # its rows come from many splits
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("mb")) >= 128


def test_broken_objects_are_reported(spark, tmp_path):
    from tessera.sources import objects
    good = nested(3, 8)
    texts = {"cut": good.rstrip()[:-1], "string": good.rstrip()[:-9] + '"', "brace": good + "}", "good": GOOD,
             "junk": GOOD + " junk", "array": f"[{GOOD}]", "value": '{"g": 5, "h": {"t": {"sentences": {}}}}',
             "tweet": '{"g": {"t": {"sentences": {x}}}}', "open": '{"g": 5'}
    for name, t in texts.items():
        (tmp_path / f"{name}.json").write_text(t, encoding="utf8")
    flat = A.flatten_sentences(objects.read_annotation_objects(spark, str(tmp_path), 64))
    rows = A.validate_sentences(flat, "split")[1].where("problem = 'malformed JSON'").select("source.file").distinct().collect()
    assert {r.file.rsplit("/", 1)[1] for r in rows} == {f"{n}.json" for n in texts if n != "good"}
    assert A.validate_sentences(flat, "split")[0].where("source.file like '%good.json'").count() == 1


HARD = ["tab\there", 'quote "x" ""', "new\nline", "back\\slash", "  leading blank", "NA", "#x", "trailing  "]


def test_tsv_round_trip(spark, folder):
    df = spark.createDataFrame([(t, "L") for t in HARD], "text string, labels string")
    D.write_tsv(df, os.path.join(folder, "split"))
    back = D.read_tsv(spark, os.path.join(folder, "split"))
    assert sorted(r.text for r in back.collect()) == sorted(HARD)


def test_error_csv_round_trip(spark, folder):
    rows = [(f"{i:03d}", t, "A", "B") for i, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, "sentence_id string, Text string, `True Label` string, Prediction string")
    D.write_errors(df, os.path.join(folder, "errors"))
    raw = spark.read.text(os.path.join(folder, "errors")).first()[0]
    assert raw == ",Text,True Label,Prediction"
    back = D.read_errors(spark, os.path.join(folder, "errors")).orderBy("row_id").collect()
    assert [r.row_id for r in back] == list(range(len(HARD)))
    assert [r.Text for r in back] == HARD


def test_sentence_ids_never_collide(spark):
    obj = json.dumps({"g/t": {"x": {"sentences": {"1": {"text": "a"}}}}, "g": {"t/x": {"sentences": {"1": {"text": "b"}}}},
                      "g%2Ft": {"x": {"sentences": {"1": {"text": "c"}}}}})
    rows = A.flatten_sentences(A.parse_annotations(spark.createDataFrame([(obj,)], "value string"))).collect()
    assert len({r.sentence_id for r in rows}) == 3


def test_parsing_leaves_the_session_alone(spark):
    before = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    twice = '{"g": {"t": {"sentences": {"1": {"text": "a"}, "2": {"text": "b"}, "1": {"text": "c"}}}}}'
    rows = A.flatten_sentences(A.parse_annotations(spark.createDataFrame([(twice,)], "value string"))).collect()
    assert [(r.sent_id, r.text, r.pos) for r in rows] == [("1", "c", 0), ("2", "b", 1)]
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == before


def test_stream_of_a_folder_dataset(spark, tmp_path):
    from tessera.streaming.features import stream_text_features
    docs = spark.createDataFrame([(i, f"Hello {i}!") for i in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = stream_text_features(spark, str(tmp_path))
    assert out.count() == 6 and out.where("contains_exclamation = 1").count() == 6
    docs.where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert stream_text_features(spark, str(tmp_path / "none")).count() == 0


def test_scratch_tables_can_be_cleared(spark):
    from tessera.session import clear_scratch, scratch_path
    clear_scratch(spark)
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    assert clear_scratch(spark) == 1 and clear_scratch(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
