from hypothesis import given, settings
from hypothesis import strategies as st

from opinarium.llm import chat

EVENT = "conv_id bigint, seq bigint, kind string, turn bigint, role string, text string, part string"


def rendered(spark, rows):
    events = spark.createDataFrame([(*r, "extra") for r in rows], EVENT).repartition(4)
    out = chat.render_conversations(events).collect()
    return {r.conv_id: (r.formatted, [r.formatted[s.start : s.end] for s in r.loss]) for r in out}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="#</turn>\\hlnc: \nab", max_size=30), st.text(alphabet="#<:\\n u", max_size=8))
def test_round_trip(text, role):
    formatted = "".join(part for part, _ in chat.render(iter([(role, text), ("assistant", text)])))
    assert list(chat.read_back(formatted)) == [(role, text), ("assistant", text)]
    assert "###" not in chat.escape(text) and "</turn>" not in chat.escape(text)


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, "message", 0, "user", "hi"), (1, 1, "delta", 1, "assistant", "he"), (1, 2, "delta", 1, None, "llo"),
        (1, 3, "message", 2, "user", "more"), (1, 4, "message", 3, "assistant", "bad"), (1, 5, "edit", 0, None, "hi!"),
        (1, 6, "regenerate", 3, None, None), (1, 7, "delta", 3, "assistant", "go"), (1, 8, "delta", 3, None, "od"),
        (None, 0, None, 0, None, None), (None, 0, None, 0, None, None), (2, 0, "regenerate", 0, None, None),
    ]
    got = rendered(spark, rows)
    assert list(chat.read_back(got[1][0])) == [("user", "hi!"), ("assistant", "hello"), ("user", "more"), ("assistant", "good")]
    assert got[1][1] == ["hello", "good"]
    assert list(chat.read_back(got[None][0])) == [("", ""), ("", "")]
    assert 2 not in got


def test_hot_conversation_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART", 500)
    rows = [(7, i, "message", i, "user" if i % 2 else "assistant", f"text {i} ###") for i in range(400)]
    events = spark.createDataFrame([(*r, "x") for r in rows], EVENT)
    out = chat.render_conversations(events)
    assert out.count() > 10
    digest = chat.digests(out).first()
    assert digest.n_turns == 400 and digest.loss_chars == sum(len(r[5]) for r in rows if r[4] == "assistant")


def test_no_events(spark):
    assert chat.digests(chat.render_conversations(spark.createDataFrame([], EVENT))).count() == 0
