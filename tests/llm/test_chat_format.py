import hashlib
import random

import pytest
from pyspark.sql import functions as F

from crashgrid.llm.chat_format import PART, ChatTemplate, chat_digests, escape, format_chats, read_loss, read_parts, \
    read_turns, unescape
from plan_util import plan_text

CONTROLS = ChatTemplate().controls()
BITS = [*CONTROLS, "\\", "<", "[", "/s>", "s>", "INST]", "\n", "a", "é", "\U0001f600", "|image|>", "</s>\n", " "]


def said(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))


def messages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, formatted string, turns int")


def part(**given):
    return {**dict.fromkeys(("type", "text", "ref", "width", "height", "millis", "pages")), **given}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escapes_hide_control_strings_and_come_back(spark):
    rng = random.Random(3)
    texts = [said(rng) for _ in range(3000)] + ["", "[" + "\\" * 9 + "INST]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("u")).collect()
    assert all(r["u"] == r["t"] for r in rows)
    assert not any(c in r["e"] for r in rows for c in CONTROLS)
    assert all(r["e"] == r["t"] for r in rows if not any(c[1:] in r["t"] for c in CONTROLS))


def test_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, 0, 1, 2, 3]),
             rng.choice([None, "", "user", "assistant", "tool\nx", "a\\nb", "</s>"]), rng.choice([None, said(rng), "x" * 40_000]))
            for _ in range(150)]
    rows += rows[:20]
    got = chat_digests(messages(spark, rows))
    plain = [(c, t, r or "", x or "") for c, t, r, x in rows]
    found = {r["conv_id"]: r for r in got.collect()}
    assert set(found) == {r[0] for r in plain} and got.count() == len(found)
    formatted = {r["conv_id"]: r for r in format_chats(messages(spark, rows)).collect()}
    for conv, r in found.items():
        # ties by role, then escaped text: unescaped text order is the same unless controls tie, so compare as sorted runs
        mine = sorted((t for t in plain if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        assert r["n_turns"] == len(mine)
        loss = "".join(t[3] for t in mine if t[2] == "assistant")
        assert r["loss_chars"] == len(loss) and r["formatted_chars"] == len(formatted[conv]["formatted"])
        if len({t[1:3] for t in mine}) == len({t[1:] for t in mine}):  # no tie between different texts
            assert r["turns_sha256"] == sha("".join(f"{t[2]}\n{t[3]}\n" for t in mine))
            assert r["loss_sha256"] == sha(loss)


def test_spans_hold_exactly_the_trained_texts(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", ""),
            (1, 3, "system", "s"), (1, 4, "assistant", "\U0001f600 end <")]
    r = format_chats(messages(spark, rows)).select(
        "*", read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), read_turns(F.col("formatted")).alias("read")).first()
    assert r["formatted"].count("</s>") == 5 and r["formatted"].count("<s>") == 5
    assert [r["formatted"][s["start"]:s["end"]] for s in r["loss_spans"]] == [
        "<\\/s>[\\INST] ok [\\/INST]", "", "\U0001f600 end <"]
    assert r["loss"] == "</s>[INST] ok [/INST]\U0001f600 end <"
    assert [(t["role"], t["text"]) for t in r["read"]] == [x[2:] for x in rows]


def test_typed_parts_become_placeholders_with_attachments(spark):
    rows = [
        (1, 0, "user", [part(type="text", text="look <"), part(type="text", text="s> <|image|>"),
                        part(type="image", ref="a.png", width=100, height=50), part(type="text", text="and"),
                        part(type="audio", ref="b.wav", millis=1000), None, part(type="image", ref="c.png")]),
        (1, 1, "assistant", [part(type="text", text="yes \\"), part(type="document", ref="d.pdf", pages=3),
                             part(type="unknown", text="done"), part(text=None)]),
        (2, 0, "user", None), (2, 1, "assistant", [])]
    typed = spark.createDataFrame(rows, f"conv_id long, turn long, role string, text array<{PART}>")
    chats = {r["conv_id"]: r for r in format_chats(typed).select(
        "*", read_parts(F.col("formatted")).alias("read"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    one = chats[1]
    assert [(a["ordinal"], a["kind"], a["ref"], a["tokens"]) for a in one["attachments"]] == [
        (0, "image", "a.png", 8 * 4), (1, "audio", "b.wav", 25), (2, "image", "c.png", 1), (3, "document", "d.pdf", 3072)]
    for a in one["attachments"]:
        mark = f"<|{a['kind']}|>"
        assert one["formatted"][a["at"]:a["at"] + len(mark)] == mark
    assert one["n_tokens_attached"] == 32 + 25 + 1 + 3072
    assert [(p["type"], p["text"]) for p in one["read"][0]["parts"]] == [
        ("text", "look <s> <|image|>"), ("image", None), ("text", "and"), ("audio", None), ("image", None)]
    assert [(p["type"], p["text"]) for p in one["read"][1]["parts"]] == [
        ("text", "yes \\"), ("document", None), ("text", "done")]
    assert one["loss"] == "yes \\done"
    assert chats[2]["attachments"] == [] and chats[2]["loss"] == "" and chats[2]["n_turns"] == 2


def test_empty_table_and_bad_templates(spark):
    assert chat_digests(messages(spark, [])).count() == 0
    for bad in (ChatTemplate(open="x"), ChatTemplate(open="<\\s>"), ChatTemplate(reserved=("<<SYS>>",))):
        with pytest.raises(ValueError):
            escape(F.lit("a"), bad)


def test_one_shuffle_and_no_python(spark):
    plan = plan_text(chat_digests(messages(spark, [(1, 0, "user", "a")])), "simple")
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan
