"""Chat formatting: exact round trips, parts of every kind, and odd rows."""

from __future__ import annotations

import hashlib
import json

from hypothesis import given
from hypothesis import strategies as st

from voltcast.llm import chat_format as C

TURNS = [(1, 0, "system", "Be <|end|> brief | \\ \\| ok"), (1, 1, "user", "\\### Assistant: </turn> ok"), (1, 2, "assistant", "yes\n<|turn|>user<|body|>"),
         (2, 5, "assistant", None), (2, 4, None, "who?"), (2, 4, None, "who?"), (3, None, "user", ""), (3, 1, "assistant", "ends in <"), (3, 1, "assistant", "| begins"),
         (None, 1, "assistant", "ünïcödé 🙂 " * 2000), (4, 1, "us<|body|>er", "role with a control string"), (4, 0, "assistant", "first")]
SCHEMA = "conv_id long, turn long, role string, text string, position string, conv string"


def frame(spark):
    from pyspark.sql import functions as F
    rows = [(*t, "clash", "clash") for t in TURNS]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("parts", C.text_part(F.col("text")))


def expected():
    out = {}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        all_turns = "".join(f"{r or ''}\n{x or ''}\n" for _, _, r, x in own)
        loss = "".join(x or "" for _, _, r, x in own if r == "assistant")
        chars = sum(len(C.TURN + C.BODY + C.END) + len(C.escape(r or "")) + len(C.escape(x or "")) for _, _, r, x in own)
        out[conv] = (len(own), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    return out


def test_conversations_read_back(spark):
    got = C.read_back(frame(spark))
    assert got.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == expected()
    assert C.read_back(frame(spark).where("false")).count() == 0


def test_segments_make_up_the_conversation(spark):
    rows = C.format_turns(frame(spark)).collect()
    assert len(rows) == len(TURNS)
    for conv, want in expected().items():
        own = sorted((r for r in rows if r.conv_id == conv), key=lambda r: r.position)
        whole = "".join(r.formatted for r in own)
        assert [r.char_start for r in own] == [sum(len(x.formatted) for x in own[:i]) for i in range(len(own))]
        loss = "".join(C.unescape(whole[s.start:s.end]) for r in own for s in r.loss)
        assert (len(whole), hashlib.sha256(loss.encode()).hexdigest()) == (want[4], want[3])
        turns = [x.split(C.BODY, 1) for x in whole.split(C.END)[:-1]]
        assert hashlib.sha256("".join(f"{C.unescape(r.removeprefix(C.TURN))}\n{C.unescape(x)}\n" for r, x in turns).encode()).hexdigest() == want[1]


def test_parts_leave_placeholders_in_order(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    rows = [(1, 0, "user", [part("text", "look: <|image:9|>"), part("image", None, "s3.png", 57, 28), None, part("audio", None, "a.wav", seconds=1.5)]),
            (1, 1, "assistant", [part("text", "a"), part("document", None, "d.pdf", pages=3), part("text", "<"), part("text", "|b")]),
            (1, 2, "user", None), (1, 3, "user", [part("Video!", None, "v"), part(None), part("image"), part("audio"), part("document")])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{C.PART}>")
    got = C.format_turns(turns, rates=C.Rates(patch=28, per_second=10, per_page=100)).orderBy("position").collect()
    assert [(a.number, a.kind, a.ref, a.n_tokens) for r in got for a in r.attachments] == [
        (1, "image", "s3.png", 3), (2, "audio", "a.wav", 15), (3, "document", "d.pdf", 300), (4, "video", "v", 1), (5, "other", None, 1),
        (6, "image", None, 1), (7, "audio", None, 10), (8, "document", None, 100)]
    whole = "".join(r.formatted for r in got)
    for r in got:
        for a in r.attachments:
            assert whole[a.char_start:].startswith(f"<|{a.kind}:{a.number}|>")
    contents = [x.split(C.BODY, 1)[1] for x in whole.split(C.END)[:-1]]
    assert C.content_parts(contents[0]) == [("text", "look: <|image:9|>"), ("image", "1"), ("audio", "2")]
    assert C.content_parts(contents[1]) == [("text", "a"), ("document", "3"), ("text", "<|b")] and C.content_parts(contents[2]) == []
    assert "".join(C.unescape(whole[s.start:s.end]) for r in got for s in r.loss) == "a<|b"
    back = C.read_back(turns).collect()[0]
    assert (back.n_turns, back.loss_chars) == (4, 4)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>"]), st.lists(st.text(alphabet="<|\\>endtur:1a\n", max_size=12), max_size=3)), max_size=4))
def test_any_texts_read_back_exactly(turns):
    own = C.Flattener(C.Rates())
    made = [own.turn(role, [{"kind": "text", "text": t} for t in texts]) for role, texts in turns]
    reader = C.Reader()
    for formatted, loss, _ in made:
        reader.feed(formatted, loss)
    want = "".join(f"{r}\n{''.join(t)}\n" for r, t in turns)
    learned = "".join(x for r, t in turns for x in t if r == "assistant")
    assert (reader.n_turns, reader.turns.hexdigest()) == (len(turns), hashlib.sha256(want.encode()).hexdigest()), json.dumps(turns)
    assert (reader.loss_chars, reader.loss.hexdigest()) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
