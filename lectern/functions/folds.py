"""Order-dependent folds over short arrays, one question per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATED = "...[truncated]"
NOTHING_FOUND = "No relevant document passages found."


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pack_entries(entries: Column, max_chars: int) -> Column:
    """Fit an ordered array of entries into ``max_chars`` characters.

    Each entry may use an equal share; a longer one is cut, at a field border
    if one lies in its second half. An entry that no longer fits is skipped,
    or ends the text with what room is left if that is more than 50 characters.
    """
    share = F.floor(F.lit(max_chars) / F.greatest(F.size(entries), F.lit(1))).cast("int")

    def trim_to(text: Column, room: Column) -> Column:
        def at_border(cut: Column) -> Column:
            # instr on the reversed text finds the last separator
            from_end = F.instr(F.reverse(cut), " | ")
            border = F.length(cut) - from_end - 2
            keep = (from_end > 0) & (border > F.length(cut) * 0.5)
            body = F.when(keep, F.left(cut, border)).otherwise(cut)
            return F.concat(body, F.lit("\n" + TRUNCATED))

        return _let(F.left(text, F.least(share, room)), at_border)

    def step(acc: Column, text: Column) -> Column:
        room = F.lit(max_chars) - acc["used"]
        cut = F.when((F.length(text) > share) & (room > 100), trim_to(text, room)).otherwise(text)

        def place(piece: Column) -> Column:
            gap = F.when(acc["n"] > 0, F.lit("\n\n")).otherwise(F.lit(""))
            fits = acc["used"] + F.length(piece) <= max_chars
            whole = F.struct(
                F.concat(acc["text"], gap, piece).alias("text"),
                (acc["used"] + F.length(piece)).alias("used"),
                (acc["n"] + 1).alias("n"),
                F.lit(False).alias("full"),
            )
            last = F.struct(
                F.concat(acc["text"], gap, F.left(piece, room), F.lit(TRUNCATED)).alias("text"),
                acc["used"].alias("used"),
                (acc["n"] + 1).alias("n"),
                F.lit(True).alias("full"),
            )
            return F.when(fits, whole).when(room > 50, last).otherwise(acc)

        return F.when(acc["full"] | (room <= 0), acc).otherwise(_let(cut, place))

    start = F.struct(
        F.lit("").alias("text"),
        F.lit(0).alias("used"),
        F.lit(0).alias("n"),
        F.lit(False).alias("full"),
    )
    return F.aggregate(entries, start, step, lambda acc: acc["text"])


def pack_passages(context: Column, chunk_chars: int) -> Column:
    """Split a context before each source header and pack the parts into chunks.

    A new chunk starts when the sum would exceed ``chunk_chars``; a longer
    part makes a chunk of its own. Empty context gives one notice.
    """
    parts = F.split(F.coalesce(context, F.lit("")), r"(?=\[Source \p{Nd}+\] )")

    def step(acc: Column, part: Column) -> Column:
        turn = (F.length(acc["open"]) + F.length(part) > chunk_chars) & (acc["open"] != "")
        return F.when(
            turn,
            F.struct(
                F.array_append(acc["done"], acc["open"]).alias("done"),
                part.alias("open"),
            ),
        ).otherwise(
            F.struct(
                acc["done"].alias("done"),
                F.concat(acc["open"], part).alias("open"),
            )
        )

    def finish(acc: Column) -> Column:
        chunks = F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        return F.when(F.size(chunks) > 0, chunks).otherwise(F.array(F.lit(NOTHING_FOUND)))

    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("open"),
    )
    return F.aggregate(parts, start, step, finish)


def pieces(array: Column, size: int) -> Column:
    """An array cut into arrays of ``size`` items, the last one shorter."""
    count = F.ceil(F.size(array) / F.lit(size)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.slice(array, i * size + 1, F.lit(size)),
    )
    return F.when(count > 0, cut).otherwise(F.slice(F.array(array), 1, 0))
