import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import pii, queries, secret_scan

from ..conftest import SF001
from . import brute
from .conftest import HARD

pieces = st.lists(st.sampled_from(
    ["a", "é", "@", ".", "-", "_", "+", " ", "1", "23", "255", "256", "a.b", "(", ")", "4111111111111111", "5500 0000 0000 0004",
     "x@y.z", "+49 30 1234567", "1.2.3.4", "%", "\n", "K", "ſ"]), max_size=14).map("".join)
keys = st.lists(st.sampled_from(
    ["password", "PassWD", "ſecret", "secret", "toKen", "api_key", "apikey", "\"", "'", " ", ":", "=", "abcdef", "x1/+", "é", "AKIA",
     "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "\n", "Z9"]), max_size=12).map("".join)


def in_chars(found, raw):
    return [(k, a, b) for a, b, k in pii.in_code_points(raw, found)]


@settings(max_examples=500, deadline=None)
@given(pieces)
def test_pii_matches_the_plain_patterns(text):
    raw = text.encode()
    assert sorted(in_chars([s for s in pii.find(raw) if s[2] != "iban"], raw)) == sorted(brute.pii(text))


@settings(max_examples=500, deadline=None)
@given(keys)
def test_secrets_match_the_plain_patterns(text):
    raw = text.encode()
    assert sorted(in_chars([s for s, _ in secret_scan.find(raw)], raw)) == sorted(brute.secrets(text))


def test_pii_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = queries.op10_pii(spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute.pii(docs[r.doc_id])
        assert r.base_sha256 == brute.span_digest(want, pii.KINDS)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.BASE]
    assert any(r.spans for r in rows)


@pytest.mark.parametrize("iban, valid", [("DE89370400440532013000", True), ("DE89 3704 0044 0532 0130 00", True),
                                         ("DE88370400440532013000", False), ("GB29 NWBK 6016 1331 9268 19 then", True),
                                         ("XX89370400440532013000", False), ("DE8937040044053201300", False)])
def test_iban(iban, valid):
    assert any(s[2] == "iban" for s in pii.find(f"to {iban}.".encode())) == valid


def test_context_moves_the_score():
    at = lambda t: pii.score(t, pii.find(t)[0])
    plain, near, doubt = at(b"see +49 30 1234567 x"), at(b"phone: +49 30 1234567"), at(b"example +49 30 1234567")
    assert doubt < plain < near
    # Whole words only: neither "tel" in "hotel" nor "test" in "latest", nor a word that the edge of the context cuts.
    assert at(b"hotel +49 30 1234567") == at(b"latest +49 30 1234567") == plain
    assert at(b"ho" + b"tel" + b" " * (pii.NEAR - 3) + b"+49 30 1234567") == plain
    assert at(b"tel" + b" " * (pii.NEAR - 3) + b"+49 30 1234567") == at(b"Mobiltelefon +49 30 1234567") == near


def test_contract_columns_come_first(spark):
    assert queries.op5_secrets(spark, SF001).columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert queries.op10_pii(spark, SF001).columns[:7] == [
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_long_runs_take_linear_time():
    for raw in (b"a" * 400_000, b"1" * 400_000, b"1." * 200_000, b"0" * 9000 + b".1.2.3", b"+1" + b" " * 400_000, b"a@" * 100_000, b"A" * 300_000 + b"@",
                b"DE12" + b"A" * 300_000, b"+" * 200_000):
        pii.find(raw)
    for raw in (b"secret" + b" " * 300_000, b"abcdef" * 60_000, b"AKIA" * 80_000, b"token" * 60_000):
        secret_scan.find(raw)


def test_hard_rows(hard, none):
    rows = pii.scan(hard).collect()
    assert len(rows) == len(HARD) and all(r.spans == "" and r.base_sha256 == brute.sha("") for r in rows)
    scan = lambda d: secret_scan.scan(d, F.col("source"), F.col("lang"))
    rows = scan(hard).collect()
    assert len(rows) == len(HARD) and all(r.spans == "" and r.n_live == 0 for r in rows)
    assert pii.scan(none).count() == 0 and scan(none).count() == 0


def test_ownership_tells_examples_from_live_keys(spark):
    live, copied, shared = "q8Zr3Lw0Xv7Tn5Bk", "k9Yp2Mx4Rc6Vd8Hs", "u3Jt7Ge1Qa5Wz9Nf"
    rows = [(i, f"password = {copied}", f"owner{i}", "r") for i in range(5)]
    rows += [(10, f"é token: '{live}' and token: {live}", "owner1", "r1"), (11, f"token={live}", "owner1", "r2")]
    rows += [(20, f"secret={shared}", "owner1", "r"), (21, f"secret={shared}", "owner2", "r"), (30, "secret=aaaaaaaaaaaaaaaa", "o", "r")]
    rows += [(40, f"token={live}x1", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    got = {r.doc_id: r for r in secret_scan.scan(docs, F.col("owner"), F.col("repo")).collect()}
    assert all(got[i].n_example == 1 and got[i].n_live == 0 for i in range(5))
    assert got[0].spans == "assign:0:27,example:11:27"
    assert got[10].n_live == 2 and got[10].spans == "assign:2:26,live:10:26,assign:32:55,live:39:55"
    assert got[11].n_live == 1 and got[20].n_live == got[20].n_example == got[30].n_live == 0 and got[40].n_live == 1
    assert got[10].base_sha256 == brute.span_digest(brute.secrets(rows[5][1]), secret_scan.KINDS)


def test_secrets_query_matches_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in queries.op5_secrets(spark, SF001).collect():
        want = brute.secrets(docs[r.doc_id])
        assert r.base_sha256 == brute.span_digest(want, secret_scan.KINDS)
        base = [s for s in r.spans.split(",") if s and s.split(":")[0] in secret_scan.BASE]
        assert sorted(base) == sorted(":".join(map(str, s)) for s in want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in secret_scan.BASE]
        assert re.fullmatch(r"[0-9a-f]{64}", r.base_sha256)


@pytest.mark.parametrize("text, want", [
    ("DE89 3704 0044 0532 0130 00 GB29 NWBK 6016 1331 9268 19", [(0, 27), (28, 55)]),
    ("AB12 DE89 3704 0044 0532 0130 00", [(5, 32)]), ("DE12 DE89 3704 0044 0532 0130 00", [(5, 32)]),
    ("DE89370400440532013000 GB29NWBK60161331926819 X1", [(0, 22), (23, 45)]),
    ("TR330006100519786457841326", [(0, 26)]), ("AE070331234567890123456", [(0, 23)]),
    ("SA0380000000608010167519", [(0, 24)]), ("IS140159260076545510730339", [(0, 26)]),
    ("LI21088100002324013AA", [(0, 21)]), ("TR340006100519786457841326", [])])
def test_ibans_side_by_side_behind_codes_and_of_all_countries(text, want):
    assert [s[:2] for s in pii.find(text.encode()) if s[2] == "iban"] == want


def test_two_owners_share_a_value(spark):
    """No gap between one owner and a copied example; every value's counts are returned."""
    value, other = "u3Jt7Ge1Qa5Wz9Nf", "v4Ku8Hf2Rb6Xa0Mg"
    rows = [(1, f"secret={value}", "owner1", "r"), (2, f"é secret={value}", "owner2", "r"),
            (3, f"secret={other}, token=aaaaaaaaaaaaaaaa", "owner1", "r"), (4, "none", "owner1", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, owner string, repo string")
    got = {r.doc_id: r for r in secret_scan.scan(docs, F.col("owner"), F.col("repo")).collect()}
    assert [got[i].n_shared for i in (1, 2, 3, 4)] == [1, 1, 0, 0] and got[3].n_live == 1
    assert got[2].spans == "assign:2:25,shared:9:25" and got[2].n_live == got[2].n_example == 0
    assert got[2].ownership == "9:25:2:2" and got[3].ownership == "7:23:1:1,31:47:1:1" and got[4].ownership == ""


def test_many_repositories_of_one_owner_make_an_example(spark):
    value = "w5Lv9Jg3Sc7Yb1Nh"
    docs = spark.createDataFrame([(i, f"token={value}", "owner", f"r{i}") for i in range(4)],
                                 "doc_id long, text string, owner string, repo string")
    scan = lambda d: secret_scan.scan(d, F.col("owner"), F.col("repo")).collect()
    assert all((r.n_example, r.n_live, r.ownership) == (1, 0, "6:22:1:4") for r in scan(docs))
    assert all((r.n_example, r.n_live, r.ownership) == (0, 1, "6:22:1:3") for r in scan(docs.where("doc_id < 3")))
