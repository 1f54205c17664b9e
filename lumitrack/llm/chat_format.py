"""Chat formatting by relational expressions alone.

A conversation's turns are collected as structs (turn, role, text) and sorted; adjacent turns of one role are merged by an
array aggregation; the blocks are joined to one string by a template. A block is ``[INST]role[SAYS]text[/INST]``; texts
merged into a block are parted by ``[NEXT]``; ``<s>`` and ``</s>`` enclose a conversation. Where a text or a role holds
such a control string, a backslash goes behind its first character, and one more where there are some already, so what
was there is read back exactly. ``loss`` has the places (start, end in code points of ``formatted``) of the texts of the
roles that are learnt, as they stand there.

Scale: a conversation within ``PIECE`` turns and ``BYTES`` is one row, made by one shuffle of its turns. A longer one is
dealt by ranges of its sorted turns to any number of tasks and comes in several rows (``piece`` 0, 1, ... of ``n_pieces``),
which put together in this order are its string; its pieces know their neighbours' roles, so blocks go on from one to the
next. Only numbers and roles of pieces meet in one task. ``read_back`` puts a conversation together, since a digest needs
it whole.

Rows: turns are sorted by turn (null first), then role and text; repeated rows are all kept. A null text or role is
empty. Turns with a null conv_id are one conversation. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumitrack.llm.common import cut, small_enough, stored

#: Turns of one piece (a power of two) and bytes of a conversation that is not cut.
PIECE, BYTES = 128, 16 << 20
#: Long conversations up to this number are sent to all tasks by id.
KEYS_SENT = 100_000


@dataclass(frozen=True)
class Template:
    """Control strings: each begins with < or [, has neither of them later, and no backslash."""

    begin: str = "<s>"
    end: str = "</s>"
    turn: str = "[INST]"
    says: str = "[SAYS]"
    more: str = "[NEXT]"
    close: str = "[/INST]"
    learnt: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not all(re.fullmatch(r"[<\[][^<\[\\]+", c) for c in self.controls) or len(set(self.controls)) < len(self.controls):
            raise ValueError("a control string is < or [ and then no <, [ or backslash, and they differ")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.begin, self.end, self.turn, self.says, self.more, self.close

    @property
    def _rest(self) -> str:
        return "|".join(re.escape(c) for c in sorted({c[1:] for c in self.controls}))

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])(\\*)({self._rest})", r"$1\\$2$3")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([<\[])\\(\\*)({self._rest})", "$1$2$3")


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns (turn, role, text) of one role."""

    def put(blocks: Column, t: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        longer = F.struct(t["role"].alias("role"), F.array_append(last["texts"], t["text"]).alias("texts"))
        new = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        return F.when(last["role"] == t["role"], F.array_append(F.slice(blocks, F.lit(1), F.size(blocks) - 1), longer)).otherwise(F.array_append(blocks, new))

    return F.aggregate(turns, F.array().cast("array<struct<role:string,texts:array<string>>>"), put)


def _written(turns: Column, template: Template, goes_before: Column, goes_after: Column, first: Column, last: Column) -> Column:
    """The fragments (text, learnt) of a piece. ``goes_before`` and ``goes_after``: its first block began before it, or its last one ends after it."""

    def piece(text: Column, learnt: Column) -> Column:
        return F.struct(text.alias("text"), learnt.alias("learnt"))

    def block(b: Column, at: Column, blocks: Column) -> Column:
        head = F.concat(F.lit(template.turn), template.escaped(b["role"]), F.lit(template.says))
        head = F.when((at == 0) & goes_before, F.lit(template.more)).otherwise(head)
        tail = F.when((at == F.size(blocks) - 1) & goes_after, F.lit("")).otherwise(F.lit(template.close))
        learnt = b["role"].isin(*template.learnt)
        texts = F.transform(b["texts"], lambda t, i: F.array(piece(F.when(i > 0, F.lit(template.more)).otherwise(F.lit("")), F.lit(False)), piece(template.escaped(t), learnt)))
        return F.concat(F.array(piece(head, F.lit(False))), F.flatten(texts), F.array(piece(tail, F.lit(False))))

    return F.concat(
        F.array(piece(F.when(first, F.lit(template.begin)).otherwise(F.lit("")), F.lit(False))),
        F.flatten(F.transform(turns, lambda b, at: block(b, at, turns))),
        F.array(piece(F.when(last, F.lit(template.end)).otherwise(F.lit("")), F.lit(False))),
    )


def _places(fragments: Column) -> Column:
    """Where the learnt fragments lie in the string of all of them."""

    def put(so_far: Column, f: Column) -> Column:
        end = so_far["at"] + F.char_length(f["text"])
        found = F.struct(so_far["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(f["learnt"], F.array_append(so_far["found"], found)).otherwise(so_far["found"]).alias("found"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
    return F.aggregate(fragments, nothing, put, lambda a: a["found"])


def _pieces(rows: DataFrame) -> DataFrame:
    """Long conversations' turns by pieces: conv_id, piece, n_pieces, turns, and the roles before and after."""
    order = ("conv_id", "turn", "role", "text")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(2, min(sizes["n"] // (8 * PIECE), 100_000), min((sizes["bytes"] or 0) // BYTES, 100_000))
    number = F.shiftright(F.monotonically_increasing_id(), PIECE.bit_length() - 1)
    dealt = rows.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).withColumn("number", number)
    pieces = stored(dealt.groupBy("conv_id", "number").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")), "pieces")
    ends = pieces.select("conv_id", "number", F.get("turns", F.lit(0))["role"].alias("head"), F.element_at("turns", -1)["role"].alias("tail"))
    w = Window.partitionBy("conv_id").orderBy("number")
    known = ends.select(
        "conv_id",
        "number",
        (F.row_number().over(w) - 1).cast("long").alias("piece"),
        F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_pieces"),
        (F.lag("tail").over(w) == F.col("head")).alias("goes_before"),
        (F.lead("head").over(w) == F.col("tail")).alias("goes_after"),
    ).withColumnsRenamed({"conv_id": "_conv", "number": "_number"})
    where = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("number") == F.col("_number"))
    return pieces.join(known, where).select("conv_id", "piece", "n_pieces", "turns", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("goes_before", "goes_after")))


def _whole(rows: DataFrame) -> DataFrame:
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    fixed = {"piece": F.lit(0).cast("long"), "n_pieces": F.lit(1).cast("long"), "goes_before": F.lit(False), "goes_after": F.lit(False)}
    return turns.select("conv_id", fixed["piece"].alias("piece"), fixed["n_pieces"].alias("n_pieces"), "turns", fixed["goes_before"].alias("goes_before"), fixed["goes_after"].alias("goes_after"))


def _parted(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Conversations of one row each, and the pieces of long ones if there are any."""
    rows = turns.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    long = cut(sizes.filter((F.col("n") > PIECE) | (F.col("bytes") > BYTES)).select(F.col("conv_id").alias("_long")))
    if long.isEmpty():
        return _whole(rows), None
    sent = F.broadcast(long) if small_enough(long, KEYS_SENT) else long
    where = F.col("conv_id").eqNullSafe(F.col("_long"))
    return _whole(rows.join(sent, where, "left_anti")), _pieces(rows.join(sent, where, "left_semi"))


def _formatted(pieces: DataFrame, template: Template) -> DataFrame:
    first, last = F.col("piece") == 0, F.col("piece") == F.col("n_pieces") - 1
    blocks = pieces.withColumn("turns", _merged(F.col("turns")))
    parts = blocks.select("conv_id", "piece", "n_pieces", _written(F.col("turns"), template, F.col("goes_before"), F.col("goes_after"), first, last).alias("_parts"))
    return parts.select("conv_id", "piece", "n_pieces", F.array_join(F.transform("_parts", lambda f: f["text"]), "").alias("formatted"), _places(F.col("_parts")).alias("loss"))


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, piece, n_pieces, formatted, loss) of the turns (conv_id, turn, role, text)."""
    short, long = _parted(turns)
    out = _formatted(short, template)
    return out if long is None else out.unionAll(_formatted(long, template))


def _read(whole: Column, template: Template) -> Column:
    """The turns (role, text) of a conversation's string."""
    inner = F.substr(whole, F.lit(len(template.begin) + 1), F.char_length(whole) - len(template.begin) - len(template.end))
    blocks = F.split(inner, rf"\Q{template.turn}\E", -1)

    def turns(block: Column) -> Column:
        said = F.split(F.substring_index(F.substring_index(block, template.says, -1), template.close, 1), rf"\Q{template.more}\E", -1)
        role = template.unescaped(F.substring_index(block, template.says, 1))
        return F.transform(said, lambda t: F.struct(role.alias("role"), template.unescaped(t).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), turns))


def _masked(template: Template) -> Column:
    """What the loss mask covers, as it was before it was escaped."""
    return F.array_join(F.transform("loss", lambda s: template.unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")


def _reading(whole: DataFrame, template: Template) -> DataFrame:
    return whole.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), _read(F.col("formatted"), template).alias("turns"), "loss_text")


def read_back(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, formatted_chars, turns, loss_text) of the output of ``formatted``: its turns (role, text) and what is learnt."""
    each = pieces.select("conv_id", "piece", "n_pieces", "formatted", _masked(template).alias("loss_text"))
    one, several = each.filter("n_pieces = 1"), each.filter("n_pieces > 1")
    parts = several.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "formatted", "loss_text"))).alias("_parts"))
    joined: Callable[[str], Column] = lambda c: F.array_join(F.transform("_parts", lambda p: p[c]), "").alias(c)
    whole = parts.select("conv_id", joined("formatted"), joined("loss_text"))
    return _reading(one.select("conv_id", "formatted", "loss_text"), template).unionAll(_reading(whole, template))


#: Conversation -1 of the query contract (fixed values): its roles, and the text of both, made of control strings.
PROBE_ROLES, PROBE_TEXT = ("user", "assistant"), "</s>[INST] ok [/INST]"


def op11(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    names = ("conv_id", "turn", "role", "text")
    said = (F.struct(F.lit(-1).cast("long"), F.lit(i).cast("long"), F.lit(role), F.lit(PROBE_TEXT)) for i, role in enumerate(PROBE_ROLES))
    probe = conversations.sparkSession.range(1).select(F.inline(F.array(*said)))
    read = read_back(formatted(conversations.select(*names).unionAll(probe), template), template)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
