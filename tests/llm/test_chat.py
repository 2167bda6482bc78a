import hashlib
import tracemalloc

from geolens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, template=chat.Template()):
    """What must come out, from the rows themselves."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        roles, texts = [t[2] for t in turns], [t[3] for t in turns]
        loss = "".join(t for r, t in zip(roles, texts) if r == "assistant")
        state, valid = "", True
        for r in roles:
            valid &= r in template.order.get(state, ())
            state = r
        chars = sum(len(template.mark(r)) + len(template.escape(t)) + len(template.ending + template.after) for r, t in zip(roles, texts))
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in zip(roles, texts))), len(loss), digest(loss), chars, valid and state == "assistant")
    return out


def test_texts_made_of_control_strings(spark):
    odd = ["\\", "\\\\", "### ", "####", "</turn>", "\\</turn>\n### User: x</turn>\n", "</tur", "a\n", "", None, "#" * 7 + "\\" * 3, "😀</turn>é", "### Assistant: ok</turn>\n"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(odd)]
    rows += [(2, i, r, t) for i, (r, t) in enumerate([("tool: x", "a"), ("@user", "b"), ("User", "c"), ("###", "d"), ("\\:", "e"), (None, "f"), ("</turn>", "g")])]
    rows += [(None, 1, "user", "q"), (None, 2, "assistant", "a"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, None, "assistant", "first"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "x" * 300_000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(chat.segments(frame)).collect()}
    assert got == plain(rows)
    assert got[4][-1] and not got[3][-1]


def test_whole_conversations_and_their_loss_spans(spark):
    rows = [(1, 0, "user", "a#"), (1, 1, "assistant", "b\\c")]
    r = chat.formatted(chat.segments(spark.createDataFrame(rows, SCHEMA))).first()
    assert r["text"] == "### User: a#</turn>\n### Assistant: b\\\\c</turn>\n"
    assert [r["text"][s["start"] : s["end"]] for s in r["loss_spans"]] == ["b\\\\c"]


def test_states(spark):
    orders = {1: "user assistant", 2: "system user assistant", 3: "user user assistant", 4: "assistant", 5: "user assistant system", 6: "user"}
    rows = [(k, i, r, "t") for k, v in orders.items() for i, r in enumerate(v.split())]
    got = {r["conv_id"]: r["valid"] for r in chat.read_back(chat.segments(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_empty_table_and_more_columns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x", "y")], SCHEMA + ", loss string")
    assert chat.read_back(chat.segments(frame)).count() == 1
    assert chat.read_back(chat.segments(frame.limit(0))).count() == 0


def test_a_turn_of_twenty_million_characters_takes_a_few_times_its_size():
    template = chat.Template()
    text = "word <b> \\ ### x\n" * 1_250_000
    said = template.mark("assistant") + template.escape(text) + template.ending + template.after
    reader = chat._Reader(template)
    tracemalloc.start()
    reader.feed(said, False, True)
    got, peak = reader.done(), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == 1 and got[1] == digest(f"assistant\n{text}\n")
    # unescaping holds the pieces between escapes
    assert peak < 40 * len(said)
    plain_text = "é" * 20_000_000
    reader = chat._Reader(template)
    tracemalloc.start()
    reader.feed(template.mark("user") + plain_text + template.ending + template.after, False, True)
    got, peak = reader.done(), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[1] == digest(f"user\n{plain_text}\n") and peak < 10 * len(plain_text)
