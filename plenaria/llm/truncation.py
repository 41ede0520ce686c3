"""Texts that lost their end, by field limits or mid-transfer (problem 10).

Method: lengths are recomputed as a store may have counted them (characters, UTF-8 bytes, UTF-16
units, with entities, JSON or CRLF escapes); a length at which a source has far more texts than at
the lengths around it exposes a hidden limit. Then the endings are inspected: a text that stops neither at the end
of a sentence nor in a form that closes texts is cut. Which last lines close texts is learnt from the texts that
reach no limit: what many of them end in is a closing, whatever its wording, while a last line that recurs only at
limits is where a field was full. The corpus is read once; what follows works on lengths and endings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenaria.runtime import cut

#: A limit: at least so many texts of one length, and so many times the mean of the lengths around.
LEAST, TIMES, AROUND = 5, 8.0, 12
#: Lengths of one bucket of the histogram.
BUCKET = 4096
#: A closing ends at least so many texts below any limit, and this share of all. So there are at most 1 / share closings.
CLOSING_LEAST, CLOSING_SHARE = 3, 0.0005

_CLOSE = r"""[\s\p{Pe}\p{Pf}"'*]"""
# Abbreviations whose stop ends no sentence.
ABBREVIATED = r"(?i)(?:^|[\s(])(?:art|blz|nr|dhr|mevr|mw|dr|prof|ir|mr|drs|bijv|bv|ca|o\.a|i\.v\.m|t\.a\.v|resp|jl)\.$"
# Notes that stand for a text's missing rest, and the dots that may.
NOTED = r"(?i)(?:\[(?:meer|lees meer|lees verder|vervolg|more|ingekort|afgekapt|\.\.\.|…)\]|\((?:lees verder|lees meer|meer|vervolg|more|ingekort|afgekapt|\.\.\.|…)\)|lees verder)$"
DOTS = r"(?:…|\.\.\.)$"
# Small words within names.
_INFIX = r"(?:[Vv]an|[Dd]e|[Dd]en|[Dd]er|[Tt]er|[Tt]en)"
_NAME = rf"(?:{_INFIX}\s)*[\p{{L}}\p{{N}}]*\p{{Lu}}[\p{{L}}\p{{N}}.&+/'’-]*"
_NAMES = rf"{_NAME}(?:,? {_NAME})*+"
# General forms that close a text without a full stop: a line of rules, a name below a line that ends in a comma,
# lists of names below each other, each after its label.
CLOSINGS = [r"(?:^|\n)\s*[-–—_=*]{2,}\z", rf"(?:^|\n)[^\n]{{1,60}},\s*\n\s*{_NAMES}\z", rf"(?:^|\n)\p{{Lu}}\p{{L}}{{1,20}}: ?{_NAMES}\s*\n\s*\p{{Lu}}\p{{L}}{{1,20}}: ?{_NAMES}\z"]


def lengths(text: Column) -> dict[str, Column]:
    """Lengths of ``text`` under the ways in which a store may count it."""
    chars = F.length(text)
    more = F.octet_length(text) - chars
    count = lambda c: chars - F.length(F.replace(text, F.lit(c), F.lit("")))
    breaks = count("\n")
    amp, lt, gt, quote, apostrophe, slash = (count(c) for c in ("&", "<", ">", '"', "'", "\\"))
    astral = chars - F.length(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", ""))
    wide = chars - F.length(F.regexp_replace(text, r"[^\x{0}-\x{7F}]", ""))
    basic = amp * 4 + lt * 3 + gt * 3
    return {
        "characters": chars,
        "utf8": chars + more,
        "utf16": chars + astral,
        "characters_crlf": chars + breaks,
        "utf8_crlf": chars + more + breaks,
        "characters_entities": chars + basic,
        "utf8_entities": chars + more + basic,
        "characters_entities_quotes": chars + basic + quote * 5 + apostrophe * 5,
        "utf8_entities_quotes": chars + more + basic + quote * 5 + apostrophe * 5,
        "characters_json": chars + quote + slash + breaks,
        "utf8_json": chars + more + quote + slash + breaks,
        "ascii_json": chars + quote + slash + breaks + wide * 5 + astral * 6,
    }


def limits(measured: DataFrame, source: str, least: int = LEAST, times: float = TIMES, around: int = AROUND) -> DataFrame:
    """Rows (source, measure, length, texts, nearby): the lengths that stand out in a source's histogram.

    ``measured`` holds the lengths in a map ``__lengths``. A histogram is gone through in buckets of lengths, each with
    a margin of its neighbours' rows.
    """
    rows = measured.select(F.col(source).alias("source"), F.explode("__lengths").alias("measure", "length")).where("length > 0")
    histogram = rows.groupBy("source", "measure", "length").agg(F.count("*").alias("texts"))
    home = F.floor(F.col("length") / BUCKET)
    at = F.explode(F.array_distinct(F.array(*[F.floor((F.col("length") + d) / BUCKET) for d in (-around, 0, around)])))
    near = Window.partitionBy("source", "measure", "bucket").orderBy("length").rangeBetween(-around, around)
    seen = histogram.withColumn("bucket", at).withColumn("nearby", (F.sum("texts").over(near) - F.col("texts")) / (2 * around)).where(F.col("bucket") == home).drop("bucket")
    out = seen.where((F.col("texts") >= least) & (F.col("texts") >= times * F.greatest(F.col("nearby"), F.lit(0.25))))
    # a limit is a wall: what lies beyond it in the same measure is another limit's, so some texts must reach it
    most = out.groupBy(F.col("source").alias("__s"), F.col("measure").alias("__m")).agg(F.max("texts").alias("most"))
    return out.join(most, F.col("source").eqNullSafe(F.col("__s")) & (F.col("measure") == F.col("__m"))).where(F.col("texts") * 20 >= F.col("most")).drop("most", "__s", "__m")


def stripped(text: Column) -> Column:
    """``text`` without what ends nothing: white space, marks and symbols at its end, and format characters."""
    # U+FFFD stays: it is a character broken off in transfer
    symbols = r"\s\p{Z}\p{C}\p{Sk}\p{M}[\p{So}&&[^\x{FFFD}]]"
    n = F.length(F.regexp_extract(F.reverse(text), rf"\A[{symbols}]*+", 0))
    return F.when(F.right(text, F.lit(1)).rlike(rf"[^{symbols}]"), text).otherwise(F.left(text, F.length(text) - n))


def tail(text: Column) -> Column:
    """The last three lines of a stripped ``text``, whole, with plain spaces and no line break within a name."""
    plain = F.regexp_replace(F.substring_index(stripped(text), "\n", -3), r"\p{Cf}", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[\p{Z}\t\r]+", " "), rf"(?<=\b{_INFIX}) ?\n(?=\w)", " ")


def ending(end: Column) -> Column:
    """'noted', 'dots', 'complete' or 'open': how a text with this ``tail`` ends by form alone. Null for null and blank texts."""
    last = F.right(end, F.lit(200))  # marks and stops are shorter; the closings read whole lines
    closing = F.lit(False)
    for c in CLOSINGS:
        closing = closing | end.rlike(c)
    stopped = last.rlike(rf"[.!?]{_CLOSE}*\z") & ~last.rlike(ABBREVIATED)
    dots = last.rlike(DOTS)
    return F.when(F.coalesce(end, F.lit("")) == "", None).when(last.rlike(NOTED), "noted").when(stopped & ~dots, "complete").when(closing, "complete").when(dots, "dots").otherwise("open")


def template(end: Column) -> Column:
    """The last line of a ``tail`` with figures and names abstracted; of a line that is only a name, with the line before. Null without a line before."""
    line, before = F.trim(F.substring_index(end, "\n", -1)), F.trim(F.substring_index(F.substring_index(end, "\n", -2), "\n", 1))
    def abstract(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(x, rf"(?<=\S ){_NAMES}", "\x02")), r"\d+", "0"), r"\W+$", "")
    named = line.rlike(rf"\A{_NAMES}\z") & ~line.rlike(r"\A\p{N}+\z")
    return F.when(F.contains(end, F.lit("\n")), F.when(named, F.concat(abstract(before), F.lit("\n\x02"))).otherwise(abstract(line)))


def measured(df: DataFrame, text: str, source: str, keep: list[str]) -> DataFrame:
    """``keep`` and the source with the lengths, the ending and the template of endings that may be closings: all that is needed of a text, read once."""
    ls = lengths(F.col(text))
    # each step is bound within the expression, so that it is computed once and not for every pattern
    end = F.transform(F.array(tail(F.col(text))), lambda e: F.struct(e.alias("e"), ending(e).alias("ending")))
    end = F.transform(end, lambda x: F.struct(x["ending"].alias("ending"), F.when(x["ending"].isin("open", "dots"), F.md5(template(x["e"]).cast("binary"))).alias("template")))[0]
    one = df.select(*keep, F.col(source).alias("__source"), F.create_map(*[x for m, c in ls.items() for x in (F.lit(m), c)]).alias("__lengths"), end.alias("__end"))
    return one.select(*keep, "__source", "__lengths", F.col("__end")["ending"].alias("ending"), F.col("__end")["template"].alias("__template"))


def detect(df: DataFrame, text: str, source: str, keep: list[str] | None = None, least: int = LEAST, times: float = TIMES) -> DataFrame:
    """``keep`` (all columns of ``df`` by default) with ``ending``, ``at_limit`` (the measure and length of a limit the text reaches, or null) and ``cut``.

    A text is cut if a note says so, or if it ends neither with a sentence nor in a closing. Closings are a few
    general forms and the last lines that recur at the end of texts below any limit: a recurring last line of texts
    that fill a field is no closing. ``least`` and ``times`` say what a limit is. Null and blank texts
    have null and false. A null source is a source of its own. Columns of ``df`` with these names are replaced.
    """
    keep = [c for c in keep or df.columns if c not in ("ending", "at_limit", "cut")]
    slim = cut(measured(df.drop("ending", "at_limit", "cut"), text, source, keep))
    walls = limits(slim, "__source", least, times).groupBy("source").agg(F.collect_list(F.struct("measure", "length", "texts")).alias("__limits"))
    hit = F.filter("__limits", lambda x: F.try_element_at("__lengths", x["measure"]) == x["length"])
    strongest = F.element_at(F.array_sort(hit, lambda a, b: (b["texts"] - a["texts"]).cast("int")), 1)
    placed = slim.join(walls, F.col("__source").eqNullSafe(F.col("source")) if "source" not in keep else slim["__source"].eqNullSafe(walls["source"]), "left")
    placed = placed.select(
        *[slim[c] for c in keep], slim["ending"], slim["__template"],
        F.when(F.size(hit) > 0, F.struct(strongest["measure"].alias("measure"), strongest["length"].alias("length"))).alias("at_limit"),
    )
    placed = cut(placed)
    n = placed.where("ending is not null").count()
    recurring = placed.where("at_limit is null and __template is not null").groupBy("__template").agg(F.count("*").alias("__n")).where(F.col("__n") >= max(CLOSING_LEAST, CLOSING_SHARE * n))
    # at most 1 / CLOSING_SHARE rows of a digest each
    got = placed.join(F.broadcast(recurring.select("__template", F.lit(True).alias("__closes"))), "__template", "left")
    how = F.when(F.col("__closes"), "complete").when(F.col("ending").isin("noted", "dots"), "marked").otherwise(F.col("ending"))
    return got.select(*keep, how.alias("ending"), "at_limit", F.coalesce(how.isin("marked", "open"), F.lit(False)).alias("cut"))


def found(documents: DataFrame) -> DataFrame:
    """Distinct (doc_id) of the documents whose text was cut off."""
    return detect(documents.select("doc_id", "text", "source"), "text", "source", ["doc_id"]).where("cut").select("doc_id").distinct()


def rates(documents: DataFrame) -> DataFrame:
    """Per source: texts, cut ones, their share, and how many were cut at a limit, mid-transfer or with a note."""
    d = detect(documents.select("text", "source"), "text", "source", ["source"])
    n = lambda c: F.count_if(c).cast("long")
    return d.groupBy("source").agg(
        n(F.col("ending").isNotNull()).alias("teksten"),
        n(F.col("cut")).alias("afgekapt"),
        F.round(n(F.col("cut")) / F.greatest(n(F.col("ending").isNotNull()), F.lit(1)), 6).alias("aandeel"),
        n(F.col("cut") & F.col("at_limit").isNotNull()).alias("op_veldgrens"),
        n(F.col("cut") & F.col("at_limit").isNull() & (F.col("ending") == "open")).alias("in_overdracht"),
        n(F.col("ending") == "marked").alias("gemerkt"),
    )
