"""Chat formatting with typed content parts, by DataFrame functions only.

A message is a list of typed parts (text, image, audio, document). A visitor,
one column expression per part type, flattens the parts in order: text parts
are escaped, the others become placeholders with an attachment record
(reference and number of tokens that the placeholder stands for). Messages are
flattened where they lie; only the finished pieces are gathered by
conversation, joined to one text and given their offsets, from which the loss
mask (the text parts of the trained roles) and the attachments' places follow.

Escaping is by stuffing: a backslash is put behind the first character of a
control string, also behind that of one that already holds backslashes there.
So no control string stands in an escaped text, and taking one backslash out
of each such place restores it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name

PART = ("struct<type:string,text:string,ref:string,width:int,height:int,millis:long,pages:int>")
MEDIA = ("image", "audio", "document")


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings of the format and the tokens that attachments stand for.

    A turn is ``open``, its role, a line feed, its content, ``close`` and a
    line feed. ``reserved`` strings are escaped as well.
    """
    open: str = "<s>"
    close: str = "</s>"
    reserved: tuple[str, ...] = ("[INST]", "[/INST]")
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    trained_roles: tuple[str, ...] = ("assistant",)
    image_patch: int = 14  # pixels a side for one token
    audio_millis: int = 40  # milliseconds for one token
    page_tokens: int = 1024

    def controls(self) -> list[str]:
        return [self.open, self.close, *self.reserved, *(getattr(self, kind) for kind in MEDIA)]


def _escapes(template: ChatTemplate) -> tuple[str, str]:
    """Patterns of the places that take a backslash, and of those that give one back (its first group stays)."""
    controls = template.controls()
    firsts = sorted({c[:1] for c in controls})
    if any(len(c) < 2 or set(c) & {"\\", "\n"} or set(c[1:]) & set(firsts) for c in controls):
        raise ValueError("a control string needs two characters at least, no backslash, no line feed, "
                         "and no first character of a control string inside")
    first = "[" + "".join("\\" + c if not c.isalnum() else c for c in firsts) + "]"
    tails = "|".join(re.escape(c[1:]) for c in sorted(controls, key=lambda c: (-len(c), c)))
    return rf"{first}(?=\\*(?:{tails}))", rf"({first})\\(?=\\*(?:{tails}))"


def escape(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    return F.regexp_replace(text, _escapes(template)[0], "$0\\\\")


def unescape(text: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    return F.regexp_replace(text, _escapes(template)[1], "$1")


def _escape_role(role: Column, template: ChatTemplate) -> Column:
    """A role on one line: backslash is ``\\s``, line feed ``\\n``."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")), template)


def _unescape_role(role: Column, template: ChatTemplate) -> Column:
    plain = unescape(role, template)
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def part_tokens(part: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Tokens that an attachment's placeholder stands for; 1 at least, also where its size is not known."""
    up = lambda n, size: F.ceil(F.coalesce(n, F.lit(0)) / size)
    kind = part["type"]
    size = (F.when(kind == "image", up(part["width"], template.image_patch) * up(part["height"], template.image_patch))
            .when(kind == "audio", up(part["millis"], template.audio_millis))
            .when(kind == "document", F.coalesce(part["pages"], F.lit(0)) * template.page_tokens))
    return F.when(kind.isin(*MEDIA), F.greatest(size.cast("long"), F.lit(1).cast("long")))


def visit(part: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """One flattened part: kind, piece (escaped text or placeholder), ref and tokens. Unknown types are text."""
    kind = F.when(part["type"].isin(*MEDIA), part["type"]).otherwise(F.lit("text"))
    piece = F.when(part["type"] == "image", F.lit(template.image)).when(
        part["type"] == "audio", F.lit(template.audio)).when(
        part["type"] == "document", F.lit(template.document)).otherwise(
        escape(F.coalesce(part["text"], F.lit("")), template))
    return F.struct(kind.alias("kind"), piece.alias("piece"),
                    F.when(kind != "text", part["ref"]).alias("ref"), part_tokens(part, template).alias("tokens"))


def merge_texts(parts: Column) -> Column:
    """``parts`` with each run of text parts joined to one: a control string may not arise where two of them meet."""
    is_text = lambda p: ~F.coalesce(p["type"].isin(*MEDIA), F.lit(False))

    def add(done: Column, p: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        both = is_text(p) & (F.size(done) > 0) & is_text(last)
        joined = F.array(p.withField("text", F.concat(F.coalesce(last["text"], F.lit("")), F.coalesce(p["text"], F.lit("")))))
        return F.when(both, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), joined)).otherwise(
            F.concat(done, F.array(p)))

    merged = F.aggregate(parts, F.array().cast(f"array<{PART}>"), add)
    return F.when(F.size(F.filter(parts, is_text)) > 1, merged).otherwise(parts)


def text_part(text: Column) -> Column:
    """A content list of one text part."""
    fields = [f.split(":") for f in PART[7:-1].split(",")]
    return F.array(F.struct(*((F.lit("text") if n == "type" else F.coalesce(text, F.lit("")) if n == "text"
                               else F.lit(None).cast(t)).alias(n) for n, t in fields)))


def format_chats(messages: DataFrame, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", content_col: str = "text") -> DataFrame:
    """One row per conversation: its formatted text, loss mask and attachments.

    ``content_col`` is a string or an array of ``PART``. Returns the
    conversation's id, n_turns, formatted, loss_spans (array of start, end in
    code points of ``formatted``: the text of trained roles, turn by turn,
    without placeholders), attachments (ordinal, kind, ref, tokens, at: code
    point of the placeholder) and n_tokens_attached.

    Turns ascend, null first, equal turns by role and content. Null texts and
    parts are empty, a null role is empty, rows with a null id form one
    conversation of their own; repeated rows are turns of their own; other
    columns are ignored; an empty table gives no rows. A conversation is one
    row, so its text must be below 2 GB.
    """
    typed = messages.schema[content_col].dataType.typeName() == "array"
    content = F.filter(F.coalesce(F.col(content_col), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()) \
        if typed else text_part(F.col(content_col))
    if typed:
        content = merge_texts(content)
    role = F.coalesce(F.col(role_col), F.lit(""))
    head = F.concat(F.lit(template.open), _escape_role(role, template), F.lit("\n"))
    turns = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
                            head.alias("head"), F.transform(content, lambda p: visit(p, template)).alias("parts"))
    # places inside the turn: one fold over its parts that keeps trained texts and attachments
    trained = F.col("role").isin(*template.trained_roles)
    state = "struct<at:int,kept:array<struct<start:int,end:int,kind:string,ref:string,tokens:bigint>>>"

    def place(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["piece"])
        entry = F.struct(acc["at"].alias("start"), end.alias("end"), p["kind"].alias("kind"), p["ref"].alias("ref"),
                         p["tokens"].alias("tokens"))
        keep = (p["kind"] != "text") | trained
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["kept"], F.array(entry))).otherwise(
            acc["kept"]).alias("kept")).cast(state)

    start = F.struct(F.length("head").alias("at"), F.array().alias("kept")).cast(state)
    body = F.concat("head", F.array_join(F.transform("parts", lambda p: p["piece"]), ""), F.lit(template.close + "\n"))
    turns = turns.select("conv", "turn", "role", body.alias("body"), F.aggregate("parts", start, place)["kept"].alias("kept"))

    # places in the conversation: a running sum of the turns' lengths, in the order in which they are joined
    order = Window.partitionBy("conv").orderBy("turn", "role", "body")
    before = F.sum(F.length("body")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("before", F.coalesce(before, F.lit(0)).cast("int")).withColumn("seq", F.row_number().over(order))
    shifted = F.transform("kept", lambda p: p.withField("start", p["start"] + F.col("before")).withField(
        "end", p["end"] + F.col("before")))
    chats = turns.select("conv", F.struct("seq", "body", shifted.alias("kept")).alias("t")).groupBy("conv").agg(
        F.array_sort(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv", F.size("turns").cast("long").alias("n_turns"),
                         F.array_join(F.transform("turns", lambda t: t["body"]), "").alias("formatted"),
                         F.flatten(F.transform("turns", lambda t: t["kept"])).alias("kept"))
    media = F.filter("kept", lambda p: p["kind"] != "text")
    return chats.select(
        F.col("conv").alias(conv_col), "n_turns", "formatted",
        F.transform(F.filter("kept", lambda p: p["kind"] == "text"),
                    lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))).alias("loss_spans"),
        F.transform(media, lambda p, i: F.struct(
            i.alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"),
            p["start"].alias("at"))).alias("attachments"),
        F.aggregate(media, F.lit(0).cast("long"), lambda acc, p: acc + p["tokens"]).alias("n_tokens_attached"))


def _blocks(formatted: Column, template: ChatTemplate) -> Column:
    """The formatted turns, without ``open`` and ``close``."""
    blocks = F.split(formatted, re.escape(template.close + "\n"))
    blocks = F.slice(blocks, F.lit(1), F.greatest(F.size(blocks) - 1, F.lit(0)))  # nothing follows the last close
    return F.transform(blocks, lambda b: F.substr(b, F.lit(len(template.open) + 1)))


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped; placeholders stay in the text as they are."""
    def turn(block: Column) -> Column:
        cut = F.locate("\n", block)
        return F.struct(_unescape_role(F.substr(block, F.lit(1), cut - 1), template).alias("role"),
                        unescape(F.substr(block, cut + 1), template).alias("text"))

    return F.transform(_blocks(formatted, template), turn)


def read_parts(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Per turn: role and its parts (type, text) in order. The n-th part that is no text is the n-th attachment."""
    marks = {re.escape(getattr(template, kind)): kind for kind in MEDIA}
    edge = "|".join(f"(?={m})|(?<={m})" for m in marks)

    def part(piece: Column) -> Column:
        kind = F.lit("text")
        for name in MEDIA:
            kind = F.when(piece == getattr(template, name), F.lit(name)).otherwise(kind)
        return F.struct(kind.alias("type"), F.when(kind == "text", unescape(piece, template)).alias("text"))

    def turn(block: Column) -> Column:
        cut = F.locate("\n", block)
        pieces = F.filter(F.split(F.substr(block, cut + 1), edge), lambda p: p != "")
        return F.struct(_unescape_role(F.substr(block, F.lit(1), cut - 1), template).alias("role"),
                        F.transform(pieces, part).alias("parts"))

    return F.transform(_blocks(formatted, template), turn)


def read_loss(formatted: Column, loss_spans: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped span by span and joined."""
    return F.array_join(F.transform(loss_spans, lambda s: unescape(
        F.substr(formatted, s["start"] + 1, s["end"] - s["start"]), template)), "")


def chat_digests(messages: DataFrame, template: ChatTemplate = ChatTemplate(), conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", content_col: str = "text") -> DataFrame:
    """Per conversation, read back from its formatted text: n_turns, turns_sha256 (role, line feed, text and line feed
    per turn), loss_chars and loss_sha256 (code points and digest of the text under the loss mask), formatted_chars,
    and n_attachments and n_tokens_attached. Nulls, ties, repeats and empty tables as in ``format_chats``."""
    chats = format_chats(messages, template, conv_col, turn_col, role_col, content_col)
    name = free_name(chats, "turns")
    read = chats.select(conv_col, "formatted", read_turns(F.col("formatted"), template).alias(name),
                        read_loss(F.col("formatted"), F.col("loss_spans"), template).alias("loss"),
                        F.size("attachments").cast("long").alias("n_attachments"), "n_tokens_attached")
    joined = F.array_join(F.transform(name, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(conv_col, F.size(name).cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "n_attachments", "n_tokens_attached")
