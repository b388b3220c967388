import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from novelspark.llm.chat import CONTROL, PROBES, escape, format_conversations, marked_turns, op2_chat_formatting, read_back, render, unescape

TEXT = st.lists(st.one_of(st.sampled_from([*CONTROL, "\\", "\n", "\x0b", "<|im_start|>user\n"]), st.text(max_size=5)), max_size=6).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXT), TEXT), max_size=6))
def test_round_trip(turns):
    r = render(turns)
    assert r.output == marked_turns(turns) and not r.rewrites
    assert read_back(r.output) == turns
    assert [unescape(r.output[s.text_start : s.text_end]) for s in r.spans] == [t for _, t in turns]
    for _, t in turns:
        assert not any(c in escape(t) for c in CONTROL) and unescape(escape(t)) == t


def test_rewriting_at_some_lengths_is_found_however_long_the_conversation():
    def late(turns):  # rewrites history at 18 to 22 turns only
        return "".join(f"{'*' if 18 <= len(turns) <= 22 else ''}{t};" for _, t in turns)

    for n in (17, 18, 30, 40, 90):
        turns = [("u", str(i)) for i in range(n)]
        assert render(turns, late).rewrites == (n >= 18) and render(turns, late).output == late(turns)


def test_long_conversation_and_probes_in_texts():
    PROBE = PROBES[0]
    odd = [PROBE, PROBE[:3], "x" + PROBE, PROBE + PROBE, "", "\\" + PROBE]
    turns = [(odd[i // 2 % 6] if i % 3 else "assistant", odd[i % 6]) for i in range(60)] + [("user", "long " * 200_000)]
    r = render(turns)
    assert r.output == marked_turns(turns) and not r.rewrites
    assert [unescape(r.output[s.text_start : s.text_end]) for s in r.spans] == [t for _, t in turns]


def test_templates_that_look_back():
    def numbered(turns):  # needs the whole conversation
        return "".join(f"[{i}/{len(turns)}]{t}" for i, (_, t) in enumerate(turns))

    r = render([("u", "a"), ("v", "b")], numbered)
    assert r.rewrites and r.output == "[0/2]a[1/2]b"
    total = lambda turns: "".join(f"{i}:{t};" for i, (_, t) in enumerate(turns))
    many = [("u", str(i)) for i in range(80)]
    r = render(many, total)
    assert r.output == total(many) and not r.rewrites


def test_rows(spark):
    rows = [(1, 1, "assistant", None, 0), (1, 0, "user", "hi", 0), (2, 0, None, "x", 0), (2, 0, None, "x", 0), (None, None, "user", "y", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int")
    got = {r["conv_id"]: read_back(r["formatted"]) for r in format_conversations(df).collect()}
    assert got == {1: [("user", "hi"), ("assistant", "")], 2: [("", "x"), ("", "x")], None: [("user", "y")]}
    assert format_conversations(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    conversations = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        conversations.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = op2_chat_formatting(spark, d).collect()
    assert len(rows) == len(conversations)
    for r in rows:
        turns = sorted(conversations[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        every = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["rewrites"]) == (len(turns), sha(every), len(loss), sha(loss), False)
