"""Decisions linked to the proposals they decided on, without a common key (problem 5).

Method: soft logic. Weighted rules on similarity, exclusivity and transitivity make a convex hinge-loss
problem over one variable for each candidate pair, solved by alternating directions until its residuals
vanish; the values are the confidence. The rules, with S the subject, K the kind, P the proposer, Y the year:

- S(b,z) -> Match(b,z); Title(b,z) and S(b,z) -> Match(b,z)
- Match(b,z) -> S(b,z), K(b,z), P(b,z), Y(b,z); a prior against matches
- Match(b,z) and Alike(b,g) -> Decides(g,z), and Decides(g,z) and Alike(b,g) -> Match(b,z): transitivity by a latent
  atom for each group g of decisions that are alike (same mended words and year, whatever wording, kind or name),
  so a group is a star of rules and not all its pairs
- a decision has at most one proposal (a weight that no other rules outweigh); several decisions on one proposal
  cost a little, so that of two equal claims the free proposal wins, but none is forbidden

What a pair's own rules decide and nothing else touches is solved in closed form. Pairs that compete are solved by
connected parts, packed into bounded bins; parts too large for one task run the same rounds across the cluster.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plenaria.llm.strings import distance, fold, words
from plenaria.runtime import cut, within

#: Distinct words of proposals up to which they are sent to every task to mend spelling; beyond it the same is a shuffled join.
MAX_WORDS = 300_000
#: Pairs that one task solves together; larger connected parts are solved across tasks.
LOCAL = 20_000
#: Rounds after which a part whose labels still move counts as large.
HOPS = 8
#: Proposals with one key from which a third word is added to it.
HOT = 64
RHO, TOLERANCE = 4.0, 1e-5
#: What is solved across tasks stops at larger residuals.
SPREAD_TOLERANCE = 1e-4
ACCEPT = 0.4

# Weights of the rules. No pull on a pair (SUBJECT + TITLE + TRANSITIVE) outweighs what holds it down (NEEDS + PRIOR, ONE).
SUBJECT, NEEDS, TITLE, PRIOR = 4.0, 6.0, 0.5, 1.0
TRANSITIVE, ONE, SHARED = 1.0, 10.0, 0.5
# Truth of "agrees" where one side does not say.
UNSAID_KIND, UNSAID_PROPOSER, UNSAID_YEAR = 0.9, 0.8, 0.7

# Words of form, not of subject.
FORM = frozenset(
    "het van in de der den ter ten een en over inzake omtrent rond regels stand zaken wet wijziging verband met lid leden motie moties "
    "amendement amendementen amendements gewijzigde nader cs c s voorstel stemming stemmingen st inz ov wijz i v m wetsvoorstel moti amen".split()
)
INFIXES = frozenset({"van", "de", "der", "den", "ter", "ten", "te", "vander", "vande"})
_PROPOSED = re.compile(r"(?i)^\s*(?:nader )?(?:gewijzigde? )?(motie|amendement) van (?:het lid|de leden) (.+?)(?: c\.\s?s\.)? (?:over|inzake|omtrent|met betrekking tot) (.+)$")
_PRIVATE = re.compile(r"(?i)^\s*(?:initiatief)?voorstel van wet van (?:het lid|de leden) (.+?): (.+)$")
_LAW = re.compile(r"(?i)^\s*(?:wijziging van de wet|regels omtrent|wet )")
_LETTER = re.compile(r"(?i)^\s*(?:brief|stand van zaken)")
_RESULT = re.compile(r"(?i)^\s*(motie|amendement|initiatiefwetgeving|wetgeving)\s+(.+?)\s*:")
# How short forms name a kind.
_KINDS = {"motie": "motie", "moties": "motie", "moti": "motie", "amendement": "amendement", "amendements": "amendement", "amendementen": "amendement", "amen": "amendement"}


def plain(text: str) -> str:
    """Entities put back, and the abbreviation of "over" undone where it was put within a word."""
    t = html.unescape(text)
    return re.sub(r"(?i)(?<=\w)ov\.(?=\w)", "over", t)


def person(name: str) -> str:
    """Comparable form of a proposer's name: 'infix surname'."""
    return " ".join(words(re.sub(r"(?i)\s*c\.\s?s\.?\s*$", "", name)))


def proposal(kind: str | None, title: str | None, subject: str | None) -> tuple | None:
    """(kind, proposer, subject words) of a zaak, whichever field holds them; None if neither does."""
    stated = {"motie": "motie", "amendement": "amendement", "wetgeving": "wet", "initiatiefwetgeving": "initiatief", "brief regering": "brief"}.get(fold(kind or "").strip())
    fields = [plain(t) for t in (subject, title) if t and t.strip()]
    for t in fields:
        if m := _PROPOSED.match(t):
            return fold(m[1]), person(m[2]), content(m[3])
    for t in fields:
        if m := _PRIVATE.match(t):
            return "initiatief", person(m[1]), content(m[2])
    for t in fields:
        if _LAW.match(t):
            return stated if stated in ("wet", "initiatief") else "wet", None, content(t)
    for t in fields:
        if _LETTER.match(t):
            return "brief", None, content(t)
    return (stated, None, content(fields[0])) if fields and stated else None


def content(text: str) -> list[str]:
    return sorted({w for w in words(text) if w not in FORM})


def slips_allowed(word: str) -> int:
    """Edits by which a typed word may differ from the one meant."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


class Speller:
    """Puts a typed word right by the words that proposals use; None if it is near none of them."""

    def __init__(self, vocabulary: list[str]):
        self.grams: dict[str, set[str]] = defaultdict(set)
        for w in vocabulary:
            for g in {w[i : i + 2] for i in range(len(w) - 1)}:
                self.grams[g].add(w)

    def right(self, w: str) -> str | None:
        most = slips_allowed(w)
        # d edits spoil at most 3 d of a word's pairs of letters
        shared = Counter(o for i in range(len(w) - 1) for o in self.grams.get(w[i : i + 2], ()))
        need = max(1, len(w) - 1 - 3 * most)
        near = [(distance(w, o, most), o) for o, n in shared.items() if n >= need and abs(len(o) - len(w)) <= most]
        best = min(near, default=(most + 1, ""))
        return best[1] if most and best[0] <= most else None


def traces(word: str, most: int) -> set[str]:
    """What two words within ``most`` slips of each other have at least one of in common.

    Up to 64 letters: the word less at most ``most`` letters. Longer ones: fifths of the word at all places that
    two slips may shift them to, since two swaps spoil at most four of five parts.
    """
    out: set[str] = set()
    n = len(word)
    if n <= 64:
        for k in range(most + 1):
            out |= {"".join(c for i, c in enumerate(word) if i not in gone) for gone in combinations(range(n), k)}
    if n > 60:
        out |= {f"{size} {k} {word[at : at + size // 5]}" for size in range(n - 2, n + 3) for k in range(5) for at in range(max(0, k * (size // 5) - 2), k * (size // 5) + 3)}
    return out


def decision(topic: str | None, result: str | None) -> tuple:
    """(kind, proposer, words typed, whether someone is named) of a decision: kind and proposer as its result text says, else its topic."""
    t = plain(topic or "")
    typed = words(t)
    kind = proposer = None
    if m := _RESULT.match(result or ""):
        kind = {"wetgeving": "wet", "initiatiefwetgeving": "initiatief"}.get(fold(m[1]), fold(m[1]))
        proposer = person(m[2]) if kind != "wet" else None
    if kind is None:
        for w in typed:
            k = _KINDS.get(w) or next((v for n, v in _KINDS.items() if len(n) >= 5 and distance(w, n, 1) <= 1), None)
            if k:
                kind = k
                break
        else:
            if any(w in ("wet", "wetsvoorstel", "wijz") or (len(w) > 8 and distance(w, "wetsvoorstel", 2) <= 2) for w in typed):
                kind = "wet?"
    return kind, proposer, typed, names_someone(t, bool(re.match(r"(?i)\s*w\w{2,3}\b", t)))


def agrees(kind: Column, other: Column) -> Column:
    """Truth of "of the same kind"; a law may be the government's or a member's own."""
    either = (kind == "wet?") & other.isin("wet", "initiatief")
    return F.when(kind.isNull() | other.isNull(), UNSAID_KIND).when(either | (kind == other), 1.0).otherwise(0.0)


def proposer_agrees(stated: str | None, typed: list[str], other: str | None, named: bool) -> float:
    """Whether the proposer of a zaak is that of a decision; topics may leave out the infix or misspell the name."""
    if other is None:
        return 1.0
    if stated is not None:
        return 1.0 if stated == other or distance(stated.replace(" ", ""), other.replace(" ", ""), 1) <= 1 else 0.0
    tokens = other.split(" ")
    infix, surname = "".join(tokens[:-1]), tokens[-1]
    best = 0.0
    for k, w in enumerate(typed):
        d = distance(w, surname, 2 if len(surname) > 8 else 1)
        if d > (2 if len(surname) > 8 else 1):
            continue
        before: list[str] = []
        for x in reversed(typed[:k]):
            if x not in INFIXES and not (len(x) <= 4 and distance(x, "van", 1) <= 1):
                break
            before.insert(0, x)
        near = "".join(before)
        if not near or near == infix or distance(near, infix, 1) <= 1 or near.endswith(infix) and infix:
            best = max(best, 1.0 - 0.05 * d - (0.02 if near != infix else 0.0))
    if best:
        return best
    return 0.0 if named else UNSAID_PROPOSER


# The places of a topic where a proposer is named.
_NAMED = [
    re.compile(r"(?i)\bvan het \w{2,4} .{3,40} (?:over|ov\.|inz)"),
    re.compile(r"(?i)^\s*(?:\w+ )*\w[^:]{2,40} c\.\s?s\.?\s*:"),
    re.compile(r"(?i)^\s*\w{4,11}-\S.{2,40}? (?:over|ov\.|inz)"),
    re.compile(r"(?i)^\s*st\.? \w{3,11} .{3,40}? inz"),
    re.compile(r"(?i)\(\w{3,11} [^()]{3,40}, [^()]+\)\s*$"),
]
_LAST = re.compile(r"\(([^(),]{3,40})\)\s*$")


def names_someone(topic: str, law: bool) -> bool:
    """Whether a topic names a proposer at all; the brackets that end a law's topic hold its aim."""
    t = re.sub(r"\s+", " ", topic)
    return any(x.search(t) for x in _NAMED) or (not law and _LAST.search(t) is not None)


_Z = "zaak_id string, kind string, proposer string, subject array<string>, title string, year int"
_B = "b string, kind string, proposer string, typed array<string>, named boolean, title string, year int"


def proposals(zaak: DataFrame) -> DataFrame:
    """One row for each zaak of its last delivery: kind, proposer, subject words, other title, year."""
    last = zaak.where("Id is not null").groupBy("Id").agg(F.max_by(F.struct("Nummer", "Soort", "Titel", "Onderwerp"), F.coalesce("ApiGewijzigdOp", F.lit(0).cast("timestamp"))).alias("z")).select("Id", "z.*")

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            d = d.astype(object).where(d.notna(), None)
            rows = []
            for i, number, kind, title, subject in d[["Id", "Nummer", "Soort", "Titel", "Onderwerp"]].itertuples(index=False):
                p = proposal(kind, title, subject)
                if p and p[2]:
                    y = re.match(r"\s*((?:19|20)\d\d)", number or "")
                    rows.append((i, *p, " ".join(words(title or "")), int(y[1]) if y else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _Z.split(", ")], dtype=object)

    return last.mapInPandas(of, _Z)


def decisions(pairs: DataFrame) -> DataFrame:
    """One row for each besluit_id: kind, proposer, words typed, title of the debate, year; pre-aggregated."""
    one = pairs.where("besluit_id is not null").groupBy("besluit_id").agg(
        F.min("agendapunt_onderwerp").alias("topic"), F.min("besluit_tekst").alias("result"), F.min("activiteit_onderwerp").alias("title"),
        F.coalesce(F.min(F.year(F.col("datum").try_cast("date"))), F.min(F.substring("vergaderjaar", 6, 4).try_cast("int"))).alias("year"),
    ).where("topic is not null")

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            d = d.astype(object).where(d.notna(), None)
            rows = []
            for i, topic, result, title, year in d[["besluit_id", "topic", "result", "title", "year"]].itertuples(index=False):
                rows.append((i, *decision(topic, result), " ".join(words(title or "")), year))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _B.split(", ")], dtype=object)

    return one.mapInPandas(of, _B)


@F.pandas_udf(DoubleType())
def _proposer(stated: pd.Series, typed: pd.Series, other: pd.Series, named: pd.Series) -> pd.Series:
    return pd.Series([proposer_agrees(s, list(t), o, n) for s, t, o, n in zip(stated, typed, other, named)], index=stated.index, dtype="float64")


@F.pandas_udf(DoubleType())
def _slips(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(distance(x, y, slips_allowed(x))) for x, y in zip(a, b)], index=a.index, dtype="float64")


def mended(typed: DataFrame, vocabulary: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """(w, right) of each distinct typed word that is a word of ``vocabulary`` (w) or within the allowed slips of one.

    Of equally near words the first in the alphabet counts. A vocabulary of at most ``most`` words goes to every
    task; a larger one meets the strange words in a shuffled join over what near words have in common.
    """
    known = vocabulary.select("w", F.col("w").alias("right"))
    strange = typed.select("w").distinct().where((F.length("w") >= 4) & ~F.col("w").isin(*FORM)).join(vocabulary, "w", "left_anti")
    if (listed := within(vocabulary.select("w"), most, 64 * most)) is not None:
        spellings = [r[0] for r in listed]

        def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            right = Speller(spellings).right
            for d in parts:
                yield pd.DataFrame({"w": d["w"], "right": [right(w) for w in d["w"]]}, dtype=object)

        # few bytes but much work: spread by number, which adaptive execution leaves as it is
        spread_out = strange.repartition(strange.sparkSession.sparkContext.defaultParallelism, F.xxhash64("w"))
        return known.unionByName(spread_out.mapInPandas(near, "w string, right string").where("right is not null"))

    def traced(letters: int | None):
        def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in parts:
                for w in d["w"]:
                    ts = sorted(traces(w, letters or slips_allowed(w)))
                    yield pd.DataFrame({"w": [w] * len(ts), "trace": ts}, dtype=object)

        return of

    a = strange.mapInPandas(traced(None), "w string, trace string")
    b = vocabulary.select("w").mapInPandas(traced(2), "w string, trace string").withColumnRenamed("w", "o")
    met = a.join(b, "trace").where(F.abs(F.length("w") - F.length("o")) <= 2).select("w", "o").distinct()
    near = met.withColumn("d", _slips("w", "o")).where(F.col("d") <= F.when(F.length("w") < 6, 1).otherwise(2))
    return known.unionByName(near.groupBy("w").agg(F.min(F.struct("d", "o"))["o"].alias("right")))


def _allowed_missing(ws: Column) -> Column:
    """How many of a proposal's words a decision may lack and still have a subject truth above 0."""
    return (F.ceil(F.size(ws) / 4) - 1).cast("int")


def _keys(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def ranked(z: DataFrame, frequency: DataFrame) -> DataFrame:
    """Proposals (z, kind, year) with their words from the rarest on (ws), and those of them that make keys (lead)."""
    ws = z.select("z", F.explode("subject").alias("w")).join(frequency, "w").groupBy("z").agg(F.array_sort(F.collect_list(F.struct("n", "w")))["w"].alias("ws"))
    return z.select("z", "kind", "year").join(ws, "z").withColumn("lead", F.slice("ws", 1, _allowed_missing(F.col("ws")) + 2))


def candidates(b: DataFrame, z: DataFrame, zs: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (b, z) that can have a subject truth above 0, agreeing or unsaid kinds and a possible year, with the truth of each rule's body.

    A decision may lack m of a proposal's words, so it has two of any m + 2 of them: the m + 2 rarest make
    the keys, by pairs, with kind and year. A key of more than ``hot`` proposals takes a third word, of which
    the decision has one of any m + 1 others. No pair is lost and none emitted that shares no key. ``zs`` is ``ranked``;
    decisions have their mended words in ``tokens``, and in ``lead`` at least those that are in the lead of a proposal.
    """

    def two(ws: Column) -> Column:
        """All pairs of sorted words, and each word alone."""
        s = F.array_sort(ws)
        return F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 1, F.size(s)), lambda y: F.struct(x.alias("x"), y.alias("y")))))

    # a proposal is met by decisions of its kind, of none and, if a law, of any law; one without kind by all
    said = F.array(F.col("kind"), F.lit("?"))
    kinds = F.when(F.col("kind").isNull(), F.array(*[F.lit(k) for k in ("motie", "amendement", "wet?", "wet", "initiatief", "brief", "?")])).when(F.col("kind").isin("wet", "initiatief"), F.array_append(said, F.lit("wet?"))).otherwise(said)
    # a decision is of the year of the proposal or the next; unknown years meet all
    years = F.when(F.col("year").isNull(), F.array(F.lit(-1), F.lit(-2))).otherwise(F.array(F.col("year"), F.lit(-2)))
    pair = F.filter(two(F.col("lead")), lambda p: (p["x"] != p["y"]) | (F.size("lead") == 1))
    zk = zs.select("z", "ws", F.explode(pair).alias("p"), kinds.alias("kinds"), years.alias("years"))
    zk = zk.select("z", "ws", "p", F.explode("kinds").alias("k"), "years").select("z", "ws", "p", "k", F.explode("years").alias("y"))
    zk = zk.select("z", "ws", "p", _keys(F.col("p")["x"], F.col("p")["y"], F.col("k"), F.col("y")).alias("key"))
    at = F.when(F.col("year").isNull(), F.array(F.lit(-2))).otherwise(F.array(F.col("year"), F.col("year") - 1, F.lit(-1)))
    bk = b.select("b", F.coalesce("kind", F.lit("?")).alias("k"), F.explode(at).alias("y"), "lead").select("b", "k", "y", F.explode(two(F.col("lead"))).alias("p"))
    bk = bk.select("b", "p", _keys(F.col("p")["x"], F.col("p")["y"], F.col("k"), F.col("y")).alias("key"))
    crowded = cut(zk.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.lit(True).alias("crowded")))
    keyed = zk.select("z", "key")
    if not crowded.isEmpty():
        others = F.filter("ws", lambda w: (w != F.col("p")["x"]) & (w != F.col("p")["y"]))
        zk = zk.join(crowded, "key", "left").withColumn("o", others)
        third = F.transform(F.slice("o", 1, _allowed_missing(F.col("ws")) + 1), lambda w: _keys(F.col("key"), w))
        keyed = zk.select("z", F.explode(F.when(F.col("crowded") & (F.size("o") > 0), third).otherwise(F.array("key"))).alias("key"))
        more = bk.join(crowded, "key").join(b.select("b", "tokens"), "b").select("b", F.explode("tokens").alias("w"), "p", "key").where((F.col("w") != F.col("p")["x"]) & (F.col("w") != F.col("p")["y"]))
        bk = bk.select("b", "key").unionByName(more.select("b", _keys(F.col("key"), F.col("w")).alias("key")))
    pairs = bk.select("b", "key").join(keyed, "key").select("b", "z").distinct()
    full = pairs.join(b.drop("lead").withColumnsRenamed({"kind": "bk", "proposer": "bp", "title": "bt", "year": "by"}), "b").join(z, "z")
    share = F.size(F.array_intersect("subject", "tokens")) / F.size("subject")
    year = F.when(F.col("by").isNull() | F.col("year").isNull(), UNSAID_YEAR).when(F.col("year").isin(F.col("by"), F.col("by") - 1), 1.0).otherwise(0.0)
    full = full.withColumns({"subject_truth": F.greatest(F.lit(0.0), 4 * share - 3), "kind_truth": agrees(F.col("bk"), F.col("kind")), "year_truth": year})
    full = full.where("subject_truth > 0 and kind_truth > 0 and year_truth > 0")
    same = F.when((F.col("bt") != "") & (F.col("bt") == F.col("title")), 1.0).otherwise(0.0)
    return full.select(
        "b", "z", F.xxhash64(F.array_sort("tokens"), "by").alias("g"), "subject_truth", "kind_truth", "year_truth",
        _proposer("bp", "typed", "proposer", "named").alias("proposer_truth"), same.alias("title_truth"),
    ).where("proposer_truth > 0")


def rules() -> Column:
    """The hinges w max(0, c (y - s)) of a pair: c = -1 asks for a match up to s, c = 1 for none beyond s."""
    def hinge(c: float, s: Column, w: float) -> Column:
        return F.struct(F.lit(c).alias("c"), s.cast("double").alias("s"), F.lit(w).alias("w"))

    needs = [hinge(1.0, F.col(x), NEEDS) for x in ("subject_truth", "kind_truth", "proposer_truth", "year_truth")]
    return F.array(hinge(-1.0, F.col("subject_truth"), SUBJECT), hinge(-1.0, F.col("title_truth") * F.col("subject_truth"), TITLE), *needs, hinge(1.0, F.lit(0.0), PRIOR))


def alone(rs: Column) -> Column:
    """The minimum of a pair's own rules: convex and piecewise linear, so at one of their bends."""
    def loss(y: Column) -> Column:
        return F.aggregate(rs, F.lit(0.0), lambda a, r: a + r["w"] * F.greatest(F.lit(0.0), r["c"] * (y - r["s"])))

    bends = F.array_distinct(F.concat(F.transform(rs, lambda r: r["s"]), F.array(F.lit(0.0), F.lit(1.0))))
    # the larger of equal minima: rules that ask for nothing beyond do not pull down
    return -F.array_min(F.transform(bends, lambda y: F.struct(loss(y).alias("l"), (-y).alias("y"))))["y"]


# ---- alternating directions ---------------------------------------------------------------------
#
# Every factor holds its own copy of the values it binds: a pair's own rules, the two sums of exclusivity and, for
# each pair of a group, the hinges between it and the group's latent value. A round takes each copy to its local
# optimum, averages the copies of each value and adds what is left to the duals.


def _stretches(c: np.ndarray, s: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of each pair's own rules, and the bends at which they end."""
    order = np.argsort(s, axis=1, kind="stable")
    bends = np.hstack([np.take_along_axis(s, order, 1), np.full((len(s), 1), np.inf)])
    return np.cumsum(np.hstack([-np.where(c < 0, w, 0).sum(1, keepdims=True), np.take_along_axis(w, order, 1)]), axis=1), bends


def _hinges(rules: pd.Series) -> tuple[np.ndarray, ...]:
    return tuple(np.array([[r[k] for r in rs] for rs in rules], dtype=float) for k in ("c", "s", "w"))


class State:
    """The values of some pairs with the copies and duals of a round; sums over nodes and groups come from outside."""

    DUALS = ("uo", "ub", "uz", "ut", "uh")

    def __init__(self, y: np.ndarray, h: np.ndarray, tied: np.ndarray, slopes: np.ndarray, bends: np.ndarray, duals: dict[str, np.ndarray] | None = None):
        self.y, self.h, self.tied, self.slopes, self.bends = y.astype(float), h.astype(float), tied, slopes, bends
        self.u = duals or {k: np.zeros(len(y)) for k in self.DUALS}

    def step(self, sb: np.ndarray, nb: np.ndarray, sz: np.ndarray, nz: np.ndarray) -> np.ndarray:
        """One round up to the new y, given sums and counts of y - ub by decision and y - uz by proposal; gives xh + uh, of which the groups' means are the new h."""
        u, y = self.u, self.y
        self.x = {
            "uo": np.clip(np.minimum((y - u["uo"])[:, None] - self.slopes / RHO, self.bends).max(1), 0, 1),
            "ub": y - u["ub"] - np.clip((sb - 1) / nb, 0, ONE / RHO), "uz": y - u["uz"] - np.clip((sz - 1) / nz, 0, SHARED / RHO),
        }
        vt, vh = y - u["ut"], self.h - u["uh"]
        move = np.clip((vt - vh) / 2, -TRANSITIVE / RHO, TRANSITIVE / RHO)
        self.x |= {"ut": vt - move, "uh": vh + move}
        self.new = (sum(self.x[k] + u[k] for k in ("uo", "ub", "uz")) + np.where(self.tied, self.x["ut"] + u["ut"], 0)) / (3 + self.tied)
        return self.x["uh"] + u["uh"]

    def settle(self, h: np.ndarray) -> np.ndarray:
        """The duals, given the groups' new values; gives for each pair the largest of its residuals."""
        rest = {k: x - (h if k == "uh" else self.new) for k, x in self.x.items()}
        rest |= {k: np.where(self.tied, rest[k], 0) for k in ("ut", "uh")}
        moved = np.max([np.abs(self.new - self.y), np.where(self.tied, np.abs(h - self.h), 0), *(np.abs(r) for r in rest.values())], axis=0)
        self.u = {k: self.u[k] + r for k, r in rest.items()}
        self.y, self.h = self.new, h
        return moved


def alternate(b: np.ndarray, z: np.ndarray, g: np.ndarray, c: np.ndarray, s: np.ndarray, w: np.ndarray, start: np.ndarray, tolerance: float = TOLERANCE) -> np.ndarray:
    """The minimum over the pairs (b, z, group g) with their hinges (rows of c, s, w), within one task."""
    def codes(*of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = pd.MultiIndex.from_arrays(of).factorize()[0] if len(of) > 1 else pd.factorize(of[0])[0]
        return code, np.bincount(code).astype(float)

    (bi, nb), (zi, nz), (gi, ng) = codes(b), codes(z), codes(g, z)
    mean = lambda v: (np.bincount(gi, v, len(ng)) / ng)[gi]
    at = State(start, mean(start), ng[gi] > 1, *_stretches(c, s, w))  # a group of one says nothing
    while True:
        total = lambda v, code, n: np.bincount(code, v, len(n))[code]
        p = at.step(total(at.y - at.u["ub"], bi, nb), nb[bi], total(at.y - at.u["uz"], zi, nz), nz[zi])
        if at.settle(mean(p)).max() < tolerance:
            return np.clip(at.y, 0, 1)


def _solve(d: pd.DataFrame) -> pd.DataFrame:
    y = alternate(d["b"].to_numpy(object), d["z"].to_numpy(object), d["g"].to_numpy(), *_hinges(d["rules"]), d["y"].to_numpy(float))
    return pd.DataFrame({"b": d["b"], "z": d["z"], "y": y})


def spread(pairs: DataFrame, tolerance: float = SPREAD_TOLERANCE) -> DataFrame:
    """``alternate`` across tasks: sums by decision, proposal and group are aggregates with a partial step, joined back.

    A round is written once; its groups' new values are read at the start of the next.
    """
    names = ["y", "h", "new", "p", "moved", *State.DUALS, *(f"x{u}" for u in State.DUALS)]
    schema = "b string, z string, g long, rules array<struct<c: double, s: double, w: double>>, tied boolean, " + ", ".join(f"{n} double" for n in names)

    def round_(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            at = State(d["y"].to_numpy(), d["h"].to_numpy(), d["tied"].to_numpy(bool), *_stretches(*_hinges(d["rules"])), {u: d[u].to_numpy() for u in State.DUALS})
            d["p"] = at.step(*(d[k].to_numpy(float) for k in ("sb", "nb", "sz", "nz")))
            yield d.assign(new=at.new, **{f"x{u}": x for u, x in at.x.items()})[["b", "z", "g", "rules", "tied", *names]]

    def settle(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            at = State(d["y"].to_numpy(), d["h"].to_numpy(), d["tied"].to_numpy(bool), d["y"].to_numpy(), d["y"].to_numpy(), {u: d[u].to_numpy() for u in State.DUALS})
            at.new, at.x = d["new"].to_numpy(), {u: d[f"x{u}"].to_numpy() for u in State.DUALS}
            moved = at.settle(d["hub"].to_numpy())
            yield d.assign(moved=moved, y=at.y, h=at.h, **at.u)[["b", "z", "g", "rules", "tied", *names]]

    groups = pairs.groupBy("g", "z").agg(F.count("*").alias("n"), F.avg("y").alias("h"))
    empty = {n: F.lit(0.0) for n in names if n not in ("y", "h")}
    state = cut(pairs.join(groups, ["g", "z"]).select("b", "z", "g", "rules", (F.col("n") > 1).alias("tied"), "y", "h").withColumns(empty))
    while True:
        sums = [state.groupBy(k).agg(F.sum(F.col("y") - F.col(f"u{k}")).alias(f"s{k}"), F.count("*").cast("double").alias(f"n{k}")) for k in ("b", "z")]
        stepped = cut(state.join(sums[0], "b").join(sums[1], "z").mapInPandas(round_, schema))
        hubs = stepped.groupBy("g", "z").agg(F.avg("p").alias("hub"))
        state = cut(stepped.join(hubs, ["g", "z"]).mapInPandas(settle, schema))
        if (state.agg(F.max("moved")).first()[0] or 0.0) < tolerance:
            return state.select("b", "z", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "y")).alias("y"))


def parts(pairs: DataFrame, hops: int = HOPS) -> tuple[DataFrame, DataFrame]:
    """``pairs`` with a label ``c`` equal within a connected part, and the labels of parts not settled after ``hops`` rounds."""
    at, rounds = cut(pairs.select("b", "z", F.xxhash64("z").alias("c"))), 0
    while True:
        # proposals are of one label here; a decision of several is where parts still meet
        mixed = at.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
        if rounds == hops or mixed.isEmpty():
            break
        rounds += 1
        for side in ("b", "z"):
            at = at.select("b", "z", "c").join(at.groupBy(side).agg(F.min("c").alias("m")), side).select("b", "z", F.col("m").alias("c"))
        at = cut(at)
    return pairs.join(at, ["b", "z"]), at.join(mixed, "b", "left_semi").select("c").distinct()


def solve(edges: DataFrame, local: int = LOCAL, hops: int = HOPS, tolerance: float = SPREAD_TOLERANCE) -> DataFrame:
    """``edges`` (b, z, group g, rules) with y: the minimum of all rules together.

    Pairs whose decision and proposal have no other are solved in closed form. The rest go by connected
    parts: those of at most ``local`` pairs are packed into bins of about that size, one task each; larger or
    unsettled ones go through ``spread``. The minimum is the same either way, within the tolerance.
    """
    own = edges.select("b", "z", "g", "rules", alone(F.col("rules")).alias("y"))
    counts = [own.groupBy(k).agg(F.count("*").alias(f"n{k}")) for k in ("b", "z")]
    own = cut(own.join(counts[0], "b").join(counts[1], "z"))
    rivals = own.where("nb > 1 or nz > 1").select("b", "z", "g", "rules", "y")
    free = own.where("nb = 1 and nz = 1").select("b", "z", "y")
    n = rivals.count()
    if n == 0:
        return free
    if n <= local and hops:
        return free.unionByName(rivals.withColumn("bin", F.lit(0)).groupBy("bin").applyInPandas(_solve, "b string, z string, y double"))
    labelled, open_ = parts(rivals, hops)
    large = labelled.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > local).select("c").unionByName(open_).distinct()
    labelled = cut(labelled.join(large.withColumn("large", F.lit(True)), "c", "left"))
    small = labelled.where("large is null").groupBy(F.pmod("c", F.lit(-(-n // max(1, local))))).applyInPandas(_solve, "b string, z string, y double")
    rest = labelled.where("large").select("b", "z", "g", "rules", "y")
    out = free.unionByName(small)
    return out if rest.isEmpty() else out.unionByName(spread(rest, tolerance))


def link(pairs: DataFrame, zaak: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """Rows (besluit_id, zaak_id, confidence): for each decision its likeliest proposal, if any is likely enough.

    Decisions without topic and proposals without a readable subject are linked to nothing. Proposals
    that are alike in all but Id and title are one, of the smallest Id.
    """
    zs = cut(proposals(zaak).groupBy("kind", "proposer", "subject", "year").agg(F.min("zaak_id").alias("z"), F.min("title").alias("title")))
    frequency = cut(zs.select(F.explode("subject").alias("w")).groupBy("w").agg(F.count("*").alias("n")))
    bs = cut(decisions(pairs))
    order = cut(ranked(zs, frequency))
    leads = order.select(F.explode("lead").alias("right")).distinct().withColumn("leads", F.lit(True))
    typed = bs.select("b", F.explode(F.array_distinct("typed")).alias("w"))
    meant = mended(typed, frequency.select("w"), most).where(~F.col("right").isin(*FORM)).join(leads, "right", "left")
    said = typed.join(meant, "w").groupBy("b").agg(F.collect_set("right").alias("tokens"), F.collect_set(F.when(F.col("leads"), F.col("right"))).alias("lead"))
    edges = candidates(cut(bs.join(said, "b")), zs, order).withColumn("rules", rules())
    solved = solve(edges.select("b", "z", "g", "rules"))
    best = solved.where(F.col("y") >= ACCEPT).groupBy("b").agg(F.min(F.struct((-F.round("y", 4)).alias("y"), "z")).alias("m"))
    return best.select(F.col("b").alias("besluit_id"), F.col("m")["z"].alias("zaak_id"), (-F.col("m")["y"]).alias("confidence"))


def found(pairs: DataFrame, zaak: DataFrame) -> DataFrame:
    """Distinct (besluit_id, zaak_id), at most one zaak for each besluit."""
    return link(pairs, zaak).select("besluit_id", "zaak_id").distinct()
