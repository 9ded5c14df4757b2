import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat, queries

from ..conftest import SF001
from ..oracle import compare, duck

hostile = st.lists(st.sampled_from(["<|im_start|>", "<|im_end|>", "<", "\\", "|", "im_end", "|>", "\n", "a", "é", "<\\|im_end|>"]),
                   max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(hostile, hostile), max_size=5))
def test_round_trip(turns):
    assert chat.parse("".join(chat.render_turn(r, t) for r, t in turns)) == turns


def test_plain_turns_stay_as_they_are():
    assert chat.render_turn("user", "hi <b> \\o/") == "<|im_start|>user\nhi <b> \\o/<|im_end|>\n"


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>",
                                 "<|im_start|>a\n<|im_start|>b\nc<|im_end|>\n"])
def test_grammar_errors(bad):
    with pytest.raises(chat.GrammarError):
        chat.parse(bad)


def test_query_matches_sql(spark):
    problems, n = compare(queries.op1_chat_format(spark, SF001), duck(SF001), queries.OP1_SQL)
    assert not problems and n > 1


def test_hard_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, None, None, "a"), (1, 1, "assistant", "b"), (1, 2, "a\nb", None), (None, 0, "user", ""),
            (2, 0, "assistant", "<|im_end|>\n" * 20000), (None, 1, "assistant", "é😀")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.conversations(chat.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha("\na\nassistant\nb\nassistant\nb\na\nb\n\n")
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, sha("bb"))
    assert (got[2].loss_chars, got[2].loss_sha256) == (220000, sha("<|im_end|>\n" * 20000))
    assert (got[None].n_turns, got[None].loss_chars, got[None].loss_sha256) == (2, 2, sha("é😀"))
    assert got[None].formatted_chars == sum(len(chat.render_turn(r, t)) for r, t in [("user", ""), ("assistant", "é😀")])
    assert chat.conversations(chat.format_turns(df.where("false"))).count() == 0


def test_long_conversation_streams(spark):
    n = 30000
    df = spark.range(n).selectExpr("7L as conv_id", "id as turn", "'assistant' as role", "cast(id as string) as text")
    [row] = chat.conversations(chat.format_turns(df)).collect()
    text = "".join(map(str, range(n)))
    assert row.n_turns == n and row.loss_chars == len(text)
    assert row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
