"""Text functions as column expressions: everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without topic.
STOPWORDS = (
    "de het een van en in op te voor met dat die dit is zijn worden om aan bij als naar over uit tot door".split()
)
# Words that show a stance, counted by presence.
STANCE_FOR = ["steun", "voor", "stem voor", "stemmen voor", "aanvaard", "aannemen"]
STANCE_AGAINST = ["tegen", "verwerp", "onaanvaardbaar", "stem tegen", "afwijzen", "ontraden"]
# Texts that stand for no value.
NO_VALUE = ["", "None", "nan"]
# Words with which a speaker is announced.
ANNOUNCED = "(?:De heer|Mevrouw|De voorzitter|Minister|Staatssecretaris)"


def collapse(text: Column) -> Column:
    """Runs of (Unicode) white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cleaned(text: Column) -> Column:
    """``collapse``; '', 'None' and 'nan' become null."""
    c = collapse(text)
    return F.when(~c.isin(NO_VALUE), c)


def topic_tokens(text: Column, stop: list[str] = STOPWORDS) -> Column:
    """Distinct words of at least three letters a-z, lower case, without stop words; null gives [].

    A word with an accent, digit or underscore is no token at all.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"))
    return F.array_except(F.filter(words, lambda w: w.rlike("^[a-z]{3,}$")), F.array(*[F.lit(s) for s in stop]))


def overlap(a: Column, b: Column, least: int) -> Column:
    """Whether two token arrays share at least ``least`` tokens; an empty side never does."""
    return F.size(F.array_intersect(a, b)) >= least


def _first(text: Column) -> tuple[Column, Column]:
    """First line, and the rest ('' if none)."""
    at = F.instr(text, "\n")
    return F.when(at > 0, F.left(text, at - 1)).otherwise(text), F.when(at > 0, F.substr(text, at + 1)).otherwise(F.lit(""))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_attribution(text: Column) -> Column:
    """The text without a first line that announces the speaker and ends in a colon; else unchanged."""
    first, rest = _first(text)
    announced = first.rlike(rf"(?i)^{ANNOUNCED}\b.*?:\s*$") | first.rlike(r"(?i)^[A-Z][a-z]+ .+?\([A-Za-z\-/]+\)\s*:\s*$")
    labelled = F.endswith(_bare(first), F.lit(":")) & (F.length(first) < 120)
    return F.when(announced | labelled, _bare(rest)).otherwise(text)


def flattened(text: Column) -> Column:
    """The text as one line without its announcing first line, colon or not; null gives ''."""
    t = _bare(F.coalesce(text, F.lit("")))
    first, rest = _first(t)
    gone = first.rlike(rf"(?i)^{ANNOUNCED}\b") | (F.endswith(_bare(first), F.lit(":")) & (F.length(first) < 120))
    return collapse(F.when(gone, rest).otherwise(t))


def word_tokens(text: Column) -> Column:
    """Words with their apostrophes, in order; null gives []."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b[\w']+\b"), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts that end in . ! or ? followed by white space; blanks dropped; null gives []."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])(?U)\s+"), _bare), lambda x: x != "")


def stance(text: Column) -> tuple[Column, Column]:
    """How many of the words for and against occur, as substrings; null gives 0, 0."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def present(words: list[str]) -> Column:
        total = F.lit(0)
        for w in words:
            total = total + F.contains(low, F.lit(w)).cast("int")
        return total

    return present(STANCE_FOR), present(STANCE_AGAINST)


def length(text: Column) -> Column:
    """Characters, 0 for null."""
    return F.length(F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    """Parts between white space, 0 for null."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def joined(*parts: Column) -> Column:
    """Parts with a space between, nulls as '', none at the ends."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def id_list(text: Column) -> Column:
    """Ids of a ';'-joined list, trimmed, without blanks; null gives []."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def truth(text: Column) -> Column:
    """'true' in any case and spacing; null and all else false."""
    return F.coalesce(F.lower(_bare(text)) == "true", F.lit(False))


def session_year(text: Column) -> Column:
    """First year of '2021-2022', or null."""
    return F.substring(text, 1, 4).try_cast("int")


def replaced(text: Column, labels: dict[str, str]) -> Column:
    """Literal replacements in the order given."""
    for a, b in labels.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def model_input(topic: Column, decision: Column, speech: Column, limits: tuple[int, int, int] = (300, 200, 1500), mark: str = " </s> ") -> Column:
    """Texts cut to their limits and joined by a mark, as input of a text model; nulls as ''."""
    return F.concat_ws(mark, *[F.substring(F.coalesce(c, F.lit("")), 1, n) for c, n in zip((topic, decision, speech), limits)])


def megabytes(n: Column) -> Column:
    return F.round(n / (1024 * 1024), 2)
