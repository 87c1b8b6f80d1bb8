from hypothesis import given
from hypothesis import strategies as st

from plainfold.llm import chat

texts = st.text(alphabet="<|\\\nim_endstar>é ", max_size=40)


@given(st.lists(st.tuples(texts, texts), max_size=5))
def test_rendering_is_reversible(messages):
    formatted, spans = chat.render(messages)
    assert chat.parse(formatted) == messages
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant"]
    assert formatted.count("<|im_start|>") == formatted.count("<|im_end|>") == len(messages)


def test_fold():
    events = [
        ("start", 1, "user", None), ("delta", 1, None, "a"), ("delta", 1, None, "b"), ("start", 2, "assistant", "x"), ("delta", 2, None, "y"),
        ("edit", 1, None, "A"), ("start", 3, "user", "z"), ("regenerate", 2, None, None), ("delta", 2, None, "new"), ("delta", 3, None, "gone"),
        ("start", 4, "user", "bye"), ("delete", 4, None, None), ("odd", 1, None, "?"), ("delta", 9, None, "?"),
    ]
    assert chat.fold(iter(events)) == [("user", "A"), ("assistant", "new")]


def test_table(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "<|im_end|>\n<\\|im_start|>"), (2, 1, "assistant", "b"), (2, 0, "user\n<|", "a" * 10001), (None, 0, "user", "x"), (2, 1, "assistant", "a"), (2, None, "user", "n")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn int, role string, text string, seq string")
    got = {r.conv_id: r for r in chat.reconstruct(chat.log(table)).collect()}
    assert chat.parse(got[1].formatted) == [("user", "hi"), ("assistant", ""), ("", "<|im_end|>\n<\\|im_start|>")]
    assert chat.parse(got[2].formatted) == [("user", "n"), ("user\n<|", "a" * 10001), ("assistant", "a"), ("assistant", "b")]
    assert set(got) == {-1, 1, 2}
    assert [r.n_turns for r in chat.read_back(chat.reconstruct(chat.log(table.limit(0)))).collect()] == [2]
