"""Freely typed names to entries of a canonical list (problem 1).

Method: a multi-pattern automaton over all canonical names and aliases finds embedded mentions, the
longest non-overlapping ones win, and what they leave unexplained goes to token-set similarity.
Values never meet each other: every task maps its own rows and remembers the values it has seen,
so a value that fills a third of the table costs one lookup.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.llm.strings import distance, fold, skeleton, words
from plenaria.runtime import bounded, cut, within

#: The canonical list must have at most so many names; it is sent to every task.
MAX_NAMES = 50_000
#: Texts that stand for no value.
NO_VALUE = ("None", "nan")

# Words around a name that are not part of it (Dutch and English).
AROUND = {"fractie", "fracties", "fr", "de", "het", "the", "tweede", "kamer", "kamerfractie", "van"}
# Words that carry no meaning within a name.
LIGHT = {"de", "het", "van", "voor", "en", "the", "of", "and", "for", "v", "h", "d"}

# Dutch words of which names of parties are made with their English ones, for entries without an English name.
ENGLISH = {
    "algemeen": "general", "alliantie": "alliance", "appel": "call", "arbeid": "labour", "belang": "interest", "beweging": "movement",
    "blauw": "blue", "boeren": "farmers", "bond": "league", "burger": "citizen", "burgers": "citizens", "christelijk": "christian",
    "coöperatie": "cooperative", "democraten": "democrats", "democratie": "democracy", "democratische": "democratic", "dieren": "animals",
    "dorp": "village", "duurzame": "sustainable", "één": "one", "eenheid": "unity", "en": "and", "federatie": "federation", "forum": "forum",
    "friese": "frisian", "front": "front", "fryske": "frisian", "fundament": "foundation", "gezin": "family", "groene": "green", "groep": "group",
    "hemels": "sky", "hervorming": "reform", "het": "the", "huurders": "tenants", "inwoners": "residents", "jong": "young", "jongeren": "youth",
    "kiezers": "voters", "kleine": "small", "klimaat": "climate", "koers": "course", "kompas": "compass", "kracht": "power", "kring": "circle",
    "kust": "coast", "land": "land", "landelijke": "rural", "leefbaar": "liveable", "leraren": "teachers", "liberale": "liberal", "licht": "light",
    "lid": "member", "lijst": "list", "links": "left", "mens": "people", "midden": "centre", "nationale": "national", "natuur": "nature",
    "nieuw": "new", "nieuwe": "new", "noorder": "northern", "nu": "now", "onafhankelijk": "independent", "onderwijs": "education",
    "ondernemers": "entrepreneurs", "ons": "our", "ooster": "eastern", "orde": "order", "oud": "old", "ouderen": "elderly", "partij": "party",
    "plan": "plan", "platform": "platform", "polder": "polder", "progressieve": "progressive", "recht": "justice", "rechts": "right",
    "republikeins": "republican", "respect": "respect", "rivieren": "rivers", "ruimte": "space", "samen": "together", "senioren": "seniors",
    "sociaal": "social", "sociale": "social", "solidariteit": "solidarity", "stad": "city", "stem": "voice", "techniek": "technology",
    "toekomst": "future", "unie": "union", "van": "of", "veen": "peatland", "veerlieden": "ferrymen", "veiligheid": "safety", "verbond": "union",
    "vernieuwers": "renewers", "vernieuwing": "renewal", "vissers": "fishermen", "volk": "people", "volks": "people", "voor": "for",
    "vooruitgang": "progress", "vrede": "peace", "vrije": "free", "vrijheid": "freedom", "vrouwen": "women", "water": "water", "welzijn": "welfare",
    "werk": "work", "wester": "western", "wijs": "wise", "wind": "wind", "wonen": "housing", "zorg": "care", "zuider": "southern",
}

ACCEPT, MARGIN = 0.8, 0.06
#: Share of a text that a name must cover to come within the margin of acceptance.
ENOUGH = (ACCEPT - MARGIN - 0.25) / 0.75
#: Among spellings a smaller lead decides: it tells a likely slip of the keys from an unlikely one.
SPELLING_MARGIN = 0.001


class Resolver:
    """Maps a text to the key of the one canonical entry it means, or to None.

    ``names`` are (key, name) pairs; a key may have several names. A text is unmatched if nothing is
    near enough or if two entries are equally near. ``names`` may be a part of a longer list, with all names of a
    key in one part; then ``shared`` are the forms that belong to several keys of the whole, and the ``evidence`` of the parts is decided together.
    """

    def __init__(self, names: Iterable[tuple[str, str]], shared: frozenset[str] = frozenset()):
        self.names: list[tuple[str, list[str], str]] = []
        forms: dict[str, set[str]] = defaultdict(set)  # compact form: keys
        self.of_key: dict[str, set[str]] = defaultdict(set)  # key: tokens of its names
        for key, name in sorted({(k, n) for k, n in names if k and n and n.strip()}):
            tokens = skeleton(name).split()
            if tokens:
                forms["".join(tokens)].add(key)
                self.names.append((key, tokens, "".join(tokens)))
                self.of_key[key].update(tokens)
        self.exact = {f: next(iter(ks)) for f, ks in forms.items() if len(ks) == 1 and f not in shared}
        self.automaton = ahocorasick.Automaton()
        for form, key in self.exact.items():
            self.automaton.add_word(form, (form, key))
        if self.exact:
            self.automaton.make_automaton()
        self.grams: dict[str, list[int]] = defaultdict(list)  # pair of letters: names
        self.having: dict[str, list[int]] = defaultdict(list)  # token: names
        for n, (_, tokens, form) in enumerate(self.names):
            for g in {form[i : i + 2] for i in range(len(form) - 1)}:
                self.grams[g].append(n)
            for t in set(tokens):
                self.having[t].append(n)
        self.tokens = sorted(self.having)
        self.token_grams: dict[str, list[str]] = defaultdict(list)
        for t in self.tokens:
            for g in {t[i : i + 2] for i in range(len(t) - 1)}:
                self.token_grams[g].append(t)
        self.longest = max((len(f) for _, _, f in self.names), default=0)
        self.near = lru_cache(maxsize=200_000)(self._near)
        self.seen = lru_cache(maxsize=200_000)(lambda text: decide(tokens, [self.evidence(tokens)]) if (tokens := skeleton(text).split()) else None)

    def __call__(self, text: str | None) -> str | None:
        return None if text is None else self.seen(text)

    def mentions(self, tokens: list[str]) -> list[tuple[int, int, int, str]]:
        """(first token, token after the last, length, key) of all names that begin and end with a token."""
        starts, ends, at = {}, {}, 0
        for n, t in enumerate(tokens):
            starts[at] = n
            at += len(t)
            ends[at] = n + 1
        found = []
        if self.exact:
            for end, (form, key) in self.automaton.iter("".join(tokens)):
                begin = end + 1 - len(form)
                if begin in starts and end + 1 in ends:
                    found.append((starts[begin], ends[end + 1], len(form), key))
        return found

    def _near(self, token: str) -> dict[str, float]:
        """Tokens of names that ``token`` stands for, and how well (see ``match``)."""
        found = set()
        if len(token) >= 2:  # those it begins
            at = bisect_left(self.tokens, token)
            while at < len(self.tokens) and self.tokens[at].startswith(token):
                found.add(self.tokens[at])
                at += 1
        elif token in self.having:
            found.add(token)
        if len(token) >= 5:  # a slip spoils at most three pairs of letters
            need = max(1, len(token) - (4 if len(token) < 8 else 7))
            shared = Counter(t for i in range(len(token) - 1) for t in self.token_grams.get(token[i : i + 2], ()))
            found |= {t for t, k in shared.items() if k >= need and abs(len(t) - len(token)) <= 2}
        return {t: m for t in found if (m := match(token, t)) > 0}

    def evidence(self, tokens: list[str]) -> dict:
        """What these names say about a text: its exact key, its mentions with the tokens that each key's names explain, and the nearest keys."""
        whole = "".join(tokens)
        if whole in self.exact:
            return {"exact": self.exact[whole], "mentions": [], "similar": []}
        found = self.mentions(tokens)
        explained = {k: [n for n, t in enumerate(tokens) if self.near(t).keys() & self.of_key[k]] for k in {m[3] for m in found}}
        return {"exact": None, "mentions": [[*m, explained[m[3]]] for m in found], "similar": self.similar(tokens)}

    def similar(self, tokens: list[str]) -> list[tuple[float, bool, str]]:
        """The two nearest keys: (score, whether by spelling, key)."""
        best: dict[str, tuple[float, bool]] = {}
        for core in cores(tokens):
            form = "".join(core)
            if len(form) < 3:
                continue
            scores: dict[int, tuple[float, bool]] = {}
            if len(form) <= self.longest + 3:  # three slips at most
                shared = Counter(n for i in range(len(form) - 1) for n in self.grams.get(form[i : i + 2], ()))
                most = 1 if len(form) < 8 else 2 if len(form) < 16 else 3
                for n, k in shared.items():
                    other = self.names[n][2]
                    # d slips spoil at most 3 d pairs of letters; a beginning spoils none
                    if k >= len(form) - 1 - 3 * most and (len(other) - len(form) <= 3 or other.startswith(form)):
                        scores[n] = (spelling(form, other), True)
            weighty = [t for t in core if t not in _LIGHT and not skeleton_around(t)] or core
            if sum(map(len, weighty)) * ENOUGH <= self.longest:  # else no name covers enough of the text
                near = {t: self.near(t) for t in weighty}
                for n in {n for xs in near.values() for x in xs for n in self.having[x]}:
                    scores[n] = max(scores.get(n, (0.0, False)), (token_set(weighty, self.names[n][1], near), False))
            for n, score in scores.items():
                key = self.names[n][0]
                if score > best.get(key, (0.0, False)):
                    best[key] = score
        return sorted(((*score, key) for key, score in best.items()), reverse=True)[:2]


def cores(tokens: list[str]) -> list[list[str]]:
    """``tokens`` and what is left of it without words that stand around names, first at its start, then at its end."""
    out, core = [tokens], tokens
    while len(core) > 1 and skeleton_around(core[0]):
        core = core[1:]
        out.append(core)
    for c in list(out):
        while len(c) > 1 and skeleton_around(c[-1]):
            c = c[:-1]
            out.append(c)
    return out


def decide(tokens: list[str], parts: list[dict]) -> str | None:
    """The key that the evidence of all parts of the canonical list gives for a text."""
    for p in parts:
        if p["exact"] is not None:
            return p["exact"]
    taken, won = [False] * len(tokens), []
    for a, b, _, key, explained in sorted((m for p in parts for m in p["mentions"]), key=lambda m: (-m[2], m[0])):
        if not any(taken[a:b]):
            taken[a:b] = [True] * (b - a)
            won.append((key, explained))
    if len({k for k, _ in won}) == 1:
        key, explained = won[0]
        if all(used or skeleton_around(t) or n in explained for n, (used, t) in enumerate(zip(taken, tokens))):
            return key
    ranked = sorted((tuple(x) for p in parts for x in p["similar"]), reverse=True)
    if not ranked or ranked[0][0] < ACCEPT:
        return None
    if len(ranked) > 1 and ranked[0][0] - ranked[1][0] < (SPELLING_MARGIN if ranked[0][1] else MARGIN):
        return None
    return ranked[0][2]


_AROUND = {skeleton(w) for w in AROUND}
_LIGHT = {skeleton(w) for w in LIGHT}


def skeleton_around(token: str) -> bool:
    return token in _AROUND


def spelling(a: str, b: str) -> float:
    """1 less the share of edits, for whole compact forms; a cut form counts as its beginning."""
    n = min(len(a), len(b))
    if 6 <= len(a) < len(b) and b.startswith(a):
        return 0.97
    if n >= 5:
        most = 1 if n < 8 else 2 if n < 16 else 3
        d = distance(a, b, most)
        if d <= most:
            return 1 - d / (2.2 * n) - 0.02 * d - 0.005 * (slips(a, b) - d)
    return 0.0


def slips(a: str, b: str) -> float:
    """Edits from the name b to the typed a, where a replaced or a foreign letter counts for more than a slip
    (a letter dropped, doubled or swapped)."""
    before: list[float] = []
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [i * 1.0]
        for j, y in enumerate(b, 1):
            doubled = i > 1 and a[i - 2] == x
            v = min(now[j - 1] + 1, row[j] + (1 if doubled else 1.6), row[j - 1] + (0 if x == y else 1.3))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        before, row = row, now
    return row[-1]


def match(a: str, b: str) -> float:
    """How well token a of a text stands for token b of a name: equal, abbreviated or misspelt."""
    if a == b:
        return 1.0
    if len(a) >= 2 and b.startswith(a):
        return 0.95
    n = min(len(a), len(b))
    if n >= 5:
        d = distance(a, b, 1 if n < 8 else 2)
        if d <= (1 if n < 8 else 2):
            return 1 - d / n
    return 0.0


def token_set(text: list[str], name: list[str], near: dict[str, dict[str, float]]) -> float:
    """Similarity of the weighty tokens of a text to a name's: mostly how much of the text the name covers, then the reverse.

    ``near`` holds for each token of the text the tokens of names it stands for.
    """
    b = [t for t in name if t not in _LIGHT]
    if not text or not b:
        return 0.0
    free = list(b)
    covered, reached = 0.0, 0.0
    for t in sorted(text, key=len, reverse=True):
        if not free:
            break
        m, at = max((near[t].get(x, 0.0), -k) for k, x in enumerate(free))
        if m > 0:
            x = free.pop(-at)
            covered += m * len(t)
            reached += m * min(len(t), len(x))
    return 0.75 * covered / sum(map(len, text)) + 0.25 * reached / sum(map(len, b))


def english(name: str) -> str | None:
    """``name`` word by word in English, compounds taken apart; unknown words stay. None if no word of weight is known."""
    out: list[str] = []
    known = False
    for w in words(name):
        parts: list[str] = []
        rest = w
        while rest:
            part = next((rest[:k] for k in range(len(rest), 1, -1) if rest[:k] in _ENGLISH), None)
            if part is None:
                break
            parts.append(_ENGLISH[part])
            rest = rest[len(part) :]
        out += [w] if rest else parts
        known = known or (not rest and w not in LIGHT)
    return " ".join(out) if known else None


_ENGLISH = {fold(k): v for k, v in ENGLISH.items()}


def named(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Distinct (key, name) of the canonical table."""
    return df.select(F.col(key).alias("key"), F.explode(F.array(*names)).alias("name")).where("key is not null and name is not null").distinct()


def canonical_names(df: DataFrame, key: str, names: list[str], most: int = MAX_NAMES) -> list[tuple[str, str]]:
    """The names as a list for every task; more than ``most`` are an error (``mapped`` takes any number)."""
    return [(r[0], r[1]) for r in bounded(named(df, key, names), most, "the list of canonical names")]


def with_english(names: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """``names`` and the English forms of those that can be put into English."""
    return names + [(k, e) for k, n in names if (e := english(n))]


def resolve(text: Column, names: list[tuple[str, str]]) -> Column:
    """The key that ``text`` means, null if unmatched. Null texts give null."""

    @F.pandas_udf("string")
    def mapped(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        resolver = Resolver(names)
        for s in parts:
            yield s.map(resolver, na_action="ignore").astype(object)

    return mapped(text)


def mapped(values: DataFrame, names: DataFrame, block: int = MAX_NAMES) -> DataFrame:
    """(t, key) of the distinct texts ``t`` for a list of any length: (key, name) in blocks, each of which meets all texts.

    A block gives for a text its exact key, its mentions and its two nearest keys, a few short rows whatever
    the block holds; what all blocks give is decided together, as ``Resolver`` decides for one.
    """
    def spelled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = [(k, n, skeleton(n).replace(" ", "")) for k, n in with_english(list(zip(d["key"], d["name"])))]
            yield pd.DataFrame(rows, columns=["key", "name", "form"], dtype=object)

    whole = cut(names.mapInPandas(spelled, "key string, name string, form string").where("form <> ''").distinct())
    shared = whole.groupBy("form").agg(F.count_distinct("key").alias("n")).where("n > 1").select("form", F.lit(True).alias("shared"))
    blocks, salts = (-(-max(1, d.count()) // block) for d in (whole, values))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = values.select("t", F.pmod(F.xxhash64("t"), F.lit(salts)).cast("int").alias("salt")).withColumn("block", every(blocks))
    right = whole.join(shared, "form", "left").withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")).withColumn("salt", every(salts))

    def look(texts: pd.DataFrame, ns: pd.DataFrame) -> pd.DataFrame:
        r = Resolver(zip(ns["key"], ns["name"]), frozenset(ns.loc[ns["shared"].fillna(False).astype(bool), "form"]))
        rows = [(t, json.dumps(r.evidence(tokens) if tokens else None)) for t in texts["t"] for tokens in [skeleton(t).split()]]
        return pd.DataFrame(rows, columns=["t", "said"], dtype=object)

    @F.pandas_udf("string")
    def decided(t: pd.Series, said: pd.Series) -> pd.Series:
        return pd.Series([decide(skeleton(x).split(), [p for s in ss if (p := json.loads(s))]) for x, ss in zip(t, said)], index=t.index, dtype=object)

    evidence = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInPandas(look, "t string, said string")
    return evidence.groupBy("t").agg(F.collect_list("said").alias("said")).select("t", decided("t", "said").alias("key"))


def blank(text: Column) -> Column:
    """Null, nothing but white space, or one of ``NO_VALUE``."""
    return text.isNull() | (F.regexp_replace(text, r"(?U)[\s\p{Z}\p{Cf}]", "") == "") | text.isin(*NO_VALUE)


def found(stemming: DataFrame, speeches: DataFrame, fractie: DataFrame, most: int = MAX_NAMES) -> DataFrame:
    """Distinct (tabel, sleutel, fractie_id) of the values that are not literally an Afkorting; '' if unmatched.

    Null, blank, 'None' and 'nan' are no values. An empty fractie leaves everything unmatched. Up to ``most`` names
    go to every task; a longer list meets the distinct values in blocks, with the same result.
    """
    names = named(fractie, "Id", ["Afkorting", "NaamNL", "NaamEN"])
    literal = fractie.select(F.col("Afkorting").alias("__a")).where("__a is not null").distinct()
    both = stemming.select(F.lit("stemming").alias("tabel"), F.col("Id").alias("sleutel"), F.col("ActorFractie").alias("t")).unionByName(
        speeches.select(F.lit("speeches").alias("tabel"), F.col("speech_id").cast("string").alias("sleutel"), F.col("fractie").alias("t"))
    )
    typed = both.where(~blank(F.col("t")))
    listed = within(names, most, 200 * most)
    if listed is None:
        typed = cut(typed.join(literal, typed.t == literal["__a"], "left_anti"))
        keys = mapped(typed.select("t").distinct(), names, most)
        return typed.join(keys, "t", "left").select("tabel", "sleutel", F.coalesce("key", F.lit("")).alias("fractie_id")).distinct()
    short = [r[0] for r in within(literal, most, 200 * most)]
    typed = typed.where(~F.col("t").isin(short)) if len(short) < 2_000 else typed.join(F.broadcast(literal), typed.t == literal["__a"], "left_anti")
    meant = resolve(F.col("t"), with_english([(r[0], r[1]) for r in listed]))
    return typed.select("tabel", "sleutel", F.coalesce(meant, F.lit("")).alias("fractie_id")).distinct()


def unmatched(found_rows: DataFrame) -> DataFrame:
    """How many values of each table were matched and unmatched."""
    return found_rows.groupBy("tabel").agg(
        F.count("*").alias("waarden"), F.count_if(F.col("fractie_id") == "").cast("long").alias("niet_herkend")
    )
