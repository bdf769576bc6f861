"""Operator 3: exact round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from flowspark.llm import chat_format as C
from flowspark.llm.queries import QUERIES
from tests.conftest import SF_SMALL

PIECES = st.lists(st.sampled_from(["\\", "<turn", "</turn>", "<part ", "\n", "a", "<", '"', ">", "é", "</turn>\n",
                                   "\n</turn>\n", '<turn role="user">\n']), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_any_text_and_role_round_trip(turns):
    import json
    out = "".join(f"<turn role={json.dumps(r)}>\n{C.escape(t)}\n</turn>\n" for r, t in turns)
    assert C.parse_turns(out) == turns
    assert all(C.unescape(C.escape(t)) == t for _, t in turns)


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest())


def test_all_conversations_read_back(spark):
    want = {}
    for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").orderBy("turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    text = "\\### Assistant: </turn> ok"
    want[-7] = [("user", text), ("assistant", text)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
           for r in QUERIES["op3_chat_format"](spark, SF_SMALL).collect()}
    assert got == {k: digests(v) for k, v in want.items()}


def test_parts_become_ordered_placeholders(spark):
    rows = [(1, 0, "user", [("text", "see <part ", None, None, None, None), ("image", None, "a.png", 1024, 600, None),
                            ("audio", None, "b.wav", None, None, 2.0), ("other", None, "z", None, None, None)]),
            (1, 1, "assistant", [("text", "ok", None, None, None, None), ("document", None, "c.pdf", None, None, 3.0)])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    got = C.format_chats(df).first()
    assert got.formatted == ('<turn role="user">\nsee \\<part <part kind=image n=1><part kind=audio n=2>'
                             '<part kind=other n=3>\n</turn>\n<turn role="assistant">\nok<part kind=document n=4>\n</turn>\n')
    assert [(a.n, a.kind, a.ref, a.tokens) for a in got.attachments] == [
        (1, "image", "a.png", 4 * 170), (2, "audio", "b.wav", 50), (3, "other", "z", 0), (4, "document", "c.pdf", 2304)]
    assert got.expanded_tokens == 680 + 50 + 2304
    span = got.loss_spans[0]
    assert got.formatted[span.start:span.end] == "ok<part kind=document n=4>"


def test_ties_nulls_and_empty_tables(spark):
    rows = [(1, 1, "b", "y"), (1, 1, "a", "x"), (1, None, None, None), (1, 1, "a", "x"), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256) for r in C.read_back(C.format_chats(C.text_parts(df))).collect()}
    assert got == {1: digests([("", ""), ("a", "x"), ("a", "x"), ("b", "y")])[:2], None: digests([("user", "q")])[:2]}
    assert C.read_back(C.format_chats(C.text_parts(df.limit(0)))).collect() == []
