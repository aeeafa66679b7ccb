"""Chat formatting with Spark expressions only.

``format_conversations`` sorts the collected turns of each conversation, merges
adjacent turns of one role into a block, and renders

    <|turn|>ROLE<|text|>TEXT[<|more|>TEXT ...]<|end|>  (once per block)

Inside roles and texts ``&`` becomes ``&amp;`` and ``<`` becomes ``&lt;``, so no
control string can occur in them and unescaping gives back the exact characters.
``<|more|>`` keeps the merged turns apart, so merging loses nothing either. The loss
mask is a list of (start, length) spans, in code points of the formatted text,
one for each text of a role to learn from.

Defined results: a null text or role is empty; turns sort by (turn, role, text) with
null turns first, so ties and repeated rows have one order; a null conversation id is
a conversation; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>"
_SPANS = "array<struct<start:int,length:int>>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _let(value: Column, body) -> Column:
    """``body(value)``, the value computed once however often the body's lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _merge(turns: Column) -> Column:
    """Turns as pieces (head, text, role) of the formatted text: adjacent turns of one role share a block, so only the
    first of them opens it and closes the one before. Each turn is compared with the one before it."""
    def piece(turns):
        def one(t, i):
            same = (i > 0) & F.coalesce(F.get(turns, i - 1)["role"] == t["role"], F.lit(False))
            opened = F.concat(F.when(i > 0, F.lit(END)).otherwise(""), F.lit(TURN), t["role"], F.lit(TEXT))
            return F.struct(F.when(same, F.lit(MORE)).otherwise(opened).alias("head"), t["text"].alias("text"),
                            t["role"].alias("role"))
        return F.transform(turns, one)
    return _let(turns, piece)


def _render(pieces: Column) -> Column:
    return F.concat(F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["text"])), ""), F.lit(END))


def _spans(pieces: Column, roles: list[str]) -> Column:
    """Spans of the texts of ``roles``. Positions are running sums over stretches of root-n pieces, then over the
    stretches, so that no array of the whole conversation is copied at every turn."""
    size = lambda p: F.length(p["head"]) + F.length(p["text"])

    def step(acc, p):
        own = F.struct((acc["pos"] + F.length(p["head"])).alias("start"), F.length(p["text"]).alias("length"))
        return F.struct((acc["pos"] + size(p)).alias("pos"), F.when(
            p["role"].isin(roles), F.concat(acc["spans"], F.array(own))).otherwise(acc["spans"]).alias("spans"))

    def inside(stretches):
        total = F.transform(stretches, lambda s: F.aggregate(s, F.lit(0), lambda a, p: a + size(p)))
        before = F.aggregate(total, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
                             lambda a, n: F.struct((a["pos"] + n).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")),
                             lambda a: a["out"])
        return F.flatten(_let(before, lambda at: F.transform(stretches, lambda s, i: F.aggregate(
            s, F.struct(F.get(at, i).alias("pos"), F.array().cast(_SPANS).alias("spans")), step, lambda a: a["spans"]))))

    def stretched(pieces):
        k = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), F.ceil(F.size(pieces) / k).cast("int") - 1),
                                lambda c: F.slice(pieces, c * k + 1, k)), inside)
    return _let(pieces, stretched)


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", loss_roles: tuple = ("assistant",)) -> DataFrame:
    """One row per conversation: (conv, formatted, loss_spans)."""
    rows = df.select(F.col(conv).alias("c"), F.struct(
        F.col(turn).alias("turn"), escape(F.coalesce(role, F.lit(""))).alias("role"),
        escape(F.coalesce(text, F.lit(""))).alias("text")).alias("t"))
    turns = rows.groupBy("c").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    learn = [r.replace("&", "&amp;").replace("<", "&lt;") for r in loss_roles]
    both = _let(_merge(F.col("turns")), lambda p: F.struct(_render(p).alias("formatted"), _spans(p, learn).alias("loss_spans")))
    return turns.select(F.col("c").alias(conv), both.alias("b")).select(conv, "b.formatted", "b.loss_spans")


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Parse the formatted text: (conv, turns array<struct<role,text>>, loss_text, formatted)."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: b != "")

    def parse(b):
        two = F.split(F.substring(b, len(TURN) + 1, 1 << 30), r"<\|text\|>", -1)
        return _let(two, lambda two: F.transform(F.split(two[1], r"<\|more\|>", -1), lambda t: F.struct(
            unescape(two[0]).alias("role"), unescape(t).alias("text"))))
    # four bytes a code point, so that a span is cut out without counting through the text before it
    loss = _let(F.encode("formatted", "UTF-32"), lambda whole: F.array_join(F.transform("loss_spans", lambda s: F.decode(
        F.substr(whole, s["start"] * 4 + 1, s["length"] * 4), "UTF-32")), ""))
    return formatted.select(conv, F.flatten(F.transform(blocks, parse)).alias("turns"),
                            unescape(loss).alias("loss_text"), "formatted")


def digest(parsed: DataFrame, conv: str = "conv_id") -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
