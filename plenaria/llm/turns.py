"""Speech transcripts into clean, ordered speaker turns (problem 2).

Method: rows are parsed where they lie into segments, by the labels within their texts. The segments of a chunk of a
transcript are the nodes of a graph of precedence: dialogue order (volgnr, then place in the text), cues (time codes
within the text) and timing (the start of a row) each say what comes before what. Constraints are taken by weight
into an order that is kept topological; one that contradicts those taken before is dropped. Spans are cleaned and
neighbouring segments of one speaker merged. A transcript is ordered in chunks of its dialogue order, and only the
ends of chunks meet, so a transcript with a third of all rows is no task of its own.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenaria.functions.ordered import carry
from plenaria.llm.names import Resolver, canonical_names, with_english
from plenaria.llm.strings import distance, fold, words
from plenaria.runtime import bounded, cut

#: The list of persons must have at most so many rows; it is sent to every task.
MAX_PERSONS = 200_000
#: Places of the dialogue order in one chunk.
CHUNK = 256

#: Weights of the constraints (dialogue, cue, timing): the lighter one gives way in a conflict.
WEIGHTS = (4, 2, 1)

_MARK = "\x01"
_TIME = re.compile(r"\[t=\d+s\]|[\[(<]?\b\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\b[\])>]?(?:\s*-->)?")
_NOTE = re.compile(
    r"\[[^\]\n]++\]|\{[^}\n]++\}|«[^»\n]++»|<[^>\n]++>|(?<![*\w])\*(?!\*)[^*\n]++\*(?!\*)|--\s(?:[^\n-]|-(?!-))+?\s--"
    r"|(?:(?<=[.!?…:\n\x01\])>}])|\A)\s*\([^()\n]++\)"
)
# Sounds that are no words.
_FILLER = re.compile(r"(?i)(?<!\w)(?:e+h+m*|u+h+m*|u+m+|h+m+|tja)(?!\w)\s*(?:\.\.\.|…|[,;.](?=\s|$))?")
_BREAK = re.compile(r"(?<=[.!?…\])>}»*])\s+|(?<=--)\s+")

# How a chair and other speakers are announced.
_CHAIR = re.compile(r"(?:mijnheer |mevrouw )?(?:de )?(?:(?:waarnemend|plaatsvervangend|fungerend) )?(?:voorzitter|voorz\.?|vz\.?)\s*(?:\(([^)]*)\))?", re.I)
_TITLE = re.compile(r"(?:de heer|dhr\.?|heer|mevrouw|mevr\.?|mw\.?|spreker|de minister|minister|de staatssecretaris|staatssecretaris|het lid)\s+", re.I)


def label_forms(longest: int) -> list[tuple]:
    """Forms of labels of up to ``longest`` characters at the start of a passage, the label in group 1 (and its party in 2), each after a quick sign of it."""
    chair = r"(?:(?:de )?(?:voorzitter|voorz\.?|vz\.?)"
    bold, square, plain, dash = (re.compile(x, re.I) for x in (
        rf"\s*\*\*([^*\n:]{{2,{longest}}})\*\*\s*(\([^)\n]{{1,{longest}}}\))?\s*:(?=\s|$)",
        rf"\s*\[([^\]\n:]{{3,{longest}}})\](?=\s|$)",
        rf"\s*([^:\n<>\[\]{{}}«»?!\x01]{{2,{longest}}}?)\s*(?::|>{{1,2}})(?=\s|$|\x01)",
        rf"\s*({chair}|(?:minister|staatssecretaris)\s[^:\n\x01–-]{{2,{longest}}}?))\s[-–]\s",
    ))
    return [(lambda x: x.startswith("**"), bold), (lambda x: x.startswith("["), square), (lambda x: ":" in x or ">" in x, plain), (lambda x: x[:1] in "dDvVmMsS" and ("-" in x or "–" in x), dash)]


class People:
    """Persons by the names under which a transcript may announce them."""

    def __init__(self, persons: list[tuple], parties: list[tuple[str, str]], member_of: list[tuple[str, str]]):
        """persons: (id, infix, surname, first name, first names, party label)."""
        self.party = Resolver(parties)
        self.parties: dict[str, set[str]] = defaultdict(set)
        for p, f in member_of:
            if p and f:
                self.parties[p.lower()].add(f)
        self.ids: set[str] = set()
        self.full: dict[str, set[str]] = defaultdict(set)
        self.first: dict[str, set[str]] = defaultdict(set)
        self.by_infix: dict[str, dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
        self.grams: dict[tuple[str, str], set[str]] = defaultdict(set)
        for pid, infix, surname, given, names, label in persons:
            if not pid:
                continue
            pid = pid.strip().lower()
            self.ids.add(pid)
            if label and (f := self.party(label)):
                self.parties[pid].add(f)
            i, s = "".join(words(infix or "")), "".join(words(surname or ""))
            if not s:
                continue
            self.full[i + s].add(pid)
            self.by_infix[i][s].add(pid)
            for g in {s[k : k + 2] for k in range(len(s) - 1)}:
                self.grams[i, g].add(s)
            for n in {given, names, (names or "").split(" ")[0]}:
                if n:
                    self.first["".join(words(n)) + i + s].add(pid)
        self.infixes = sorted(self.by_infix, key=len, reverse=True)
        self.given = {"".join(words(n)) for p in persons for n in (p[3],) if n}
        named = [" ".join(x for x in (p[3], p[4], p[1], p[2]) if x) for p in persons]
        self.most_words = max((len(words(n)) for n in named), default=0) + 1
        # a label holds a name, a party and an office
        longest = max(110, 60 + max(map(len, named), default=0) + max((len(n) for _, n in parties if n), default=0))
        self.heads, self.longest = label_forms(longest), 2 * longest + 20
        self.announced = lru_cache(maxsize=100_000)(self._announced)
        self.described = lru_cache(maxsize=100_000)(self._described)

    def named(self, name: str, party: str | None = None) -> tuple[str, ...]:
        """Ids of the persons that ``name`` may be, nothing if it is none; a party decides between several."""
        tokens = words(name)
        if not tokens or len(tokens) > self.most_words:
            return ()
        form = "".join(tokens)
        found, near = self.full.get(form) or self.first.get(form), False
        if not found:
            found, near = self._near(tokens), True
        if not found:
            return ()
        f = self.party(party) if party else None
        if f and (of := {p for p in found if f in self.parties[p]}):
            found = of
        elif f and near and len(found) > 1:
            return ()
        return tuple(sorted(found))

    def _near(self, tokens: list[str]) -> set[str]:
        """Ids of the names with the fewest slips: at most two, at most one in the infix or in a short surname."""
        best: tuple[int, set[str]] = (9, set())
        for skip in range(min(2, len(tokens))):
            if skip and "".join(tokens[:skip]) not in self.given:
                break
            for k in range(skip, min(skip + 4, len(tokens))):
                typed, s = "".join(tokens[skip:k]), "".join(tokens[k:])
                if len(s) < 6:
                    continue
                for infix in self.infixes:
                    slip = distance(typed, infix, 1) if infix and typed else int(typed != infix) * 9
                    most = min(1 if len(s) < 9 else 2, 2 - slip)
                    if slip > 1 or most < 0:
                        continue
                    # a slip spoils at most three pairs of letters
                    shared = Counter(o for i in range(len(s) - 1) for o in self.grams.get((infix, s[i : i + 2]), ()))
                    for other in [o for o, n in shared.items() if n >= len(s) - 1 - 3 * most and abs(len(o) - len(s)) <= most]:
                        d = distance(s, other, most)
                        if d <= most and d + slip <= best[0]:
                            if d + slip < best[0]:
                                best = (d + slip, set())
                            ids = self.by_infix[infix][other]
                            if skip:
                                ids = self.first.get("".join(tokens[:skip]) + infix + other, ids)
                            best[1].update(ids)
        return best[1]

    def _announced(self, head: str) -> str | None:
        """What a label says: '!' the chair, or '|'-joined ids; None if it is no label."""
        head = re.sub(r"\s+", " ", head).strip(" *-–")
        if m := _CHAIR.fullmatch(head):
            ids = self.named(m[1]) if m[1] else ()
            return "|".join(ids) or "!"
        bare = head
        if titled := _TITLE.match(head):
            bare = head[titled.end() :].strip()
        splits: list[tuple[str, str | None]] = [(bare, None)]
        if m := re.fullmatch(r"(.+?)\s*\(([^()]*)\)", bare):
            splits = [(m[1], m[2])]
        else:
            for sep in (" - ", " – ", " / ", ", "):
                if sep in bare:
                    a, b = bare.rsplit(sep, 1)
                    splits += [(a, b), (b, a)]
                    a, b = bare.split(sep, 1)
                    splits += [(a, b), (b, a)]
            if titled and " van " in bare.casefold():
                at = bare.casefold().rindex(" van ")
                splits.append((bare[:at], bare[at + 5 :]))
        for name, party in splits:
            if party is not None and self.party(party) is None and "(" not in head:
                continue
            if ids := self.named(name, party):
                return "|".join(ids)
        return None

    def _described(self, pid: str | None, full: str | None, surname: str | None, given: str | None, party: str | None) -> str | None:
        """The person of a row's own fields, as '|'-joined ids, or None."""
        if pid and (p := pid.strip().lower()) in self.ids:
            return p
        for name in (full, surname):
            if name and (ids := self.named(name, party)):
                if len(ids) > 1 and given:
                    ids = tuple(p for p in ids if p in self.first.get("".join(words(given + " " + name)), ())) or ids
                return "|".join(ids)
        return None


def clean(text: str) -> str:
    """``text`` without time codes, notes and fillers, white space collapsed."""
    t = _NOTE.sub(" ", _TIME.sub(_MARK, text)).replace(_MARK, " ")
    return re.sub(r"\s+", " ", _FILLER.sub(" ", t)).strip(" ,;")


def has_words(cleaned: str) -> bool:
    return re.search(r"\w", cleaned) is not None


def seconds(code: str) -> int:
    """Seconds since midnight of a time code: a count of them, hours and minutes with or without seconds, or minutes of the day."""
    n = [int(x) for x in re.findall(r"\d+", code)]
    if len(n) == 1:
        return n[0]
    if len(n) >= 3 and code.count(":") == 2:
        return n[0] * 3600 + n[1] * 60 + n[2]
    return n[0] * 60 + n[1] if n[0] >= 24 else n[0] * 3600 + n[1] * 60


def segments(text: str | None, row_speaker: str | None, people: People) -> list[tuple[str | None, str, int | None]]:
    """(speaker, clean text, cue) in order of place; speaker None: whoever spoke before. A cue is the first time code of the segment, or right before its label."""
    if not text:
        return []
    codes: list[str] = []
    t = _TIME.sub(lambda m: codes.append(m[0]) or _MARK, text.replace(_MARK, " "))
    cuts: list[tuple[int, int, str | None]] = [(0, 0, row_speaker)]
    at = 0
    places = sorted({0, *(m.end() for m in re.finditer(r"[\n\x01]", t)), *(m.end() for m in _BREAK.finditer(t))})
    for place in places:
        if place < at:
            continue
        line = t.find("\n", place, place + people.longest)
        near = t[place : line if line > 0 else place + people.longest].lstrip()
        for sign, form in people.heads:
            # what has no sign of a label nearby is not gone through letter by letter
            if sign(near) and (m := form.match(t, place)) and (who := people.announced("".join(x for x in m.groups() if x))) is not None:
                at = m.end()
                # a time code right before a label belongs to what the label opens
                cuts.append((len(t[: m.start()].rstrip(f" \n{_MARK}")), at, who))
                break
    marks = [m.start() for m in re.finditer(_MARK, t)]
    out = []
    for (first, begin, who), (_, end, _) in zip(cuts, [*((0, c[0], None) for c in cuts[1:]), (0, len(t), None)]):
        if begin < end:
            body = re.sub(r"\s+", " ", _FILLER.sub(" ", _NOTE.sub(" ", t[begin:end]).replace(_MARK, " "))).strip(" ,;")
            if has_words(body):
                k = bisect_left(marks, first)
                out.append((who, body, seconds(codes[k]) if k < len(marks) and marks[k] < end else None))
    return out


_PARSED = "verslag_id string, chunk long, volgnr long, speech_id long, start int, seq int, who string, cue int, body string"
#: Rows without volgnr that no time places are in chunks before all others.
FIRST = 1 << 40


def started(start: Column) -> Column:
    """Seconds since midnight of a row's start; null if unreadable."""
    part = [F.regexp_extract(F.coalesce(start, F.lit("")), r"^\s*(\d{1,2}):(\d\d)(?::(\d\d))?", k).try_cast("int") for k in (1, 2, 3)]
    return part[0] * 3600 + part[1] * 60 + F.coalesce(part[2], F.lit(0))


def with_chunks(speeches: DataFrame) -> DataFrame:
    """``speeches`` with ``__start`` (seconds) and ``__chunk``: by volgnr; a row without it lies with the numbered row of its transcript that began last before it.

    Rows without volgnr and time, or before any numbered one, are in chunks before all others, by minute or id.
    """
    d = speeches.withColumn("__start", started(F.col("speech_start")))
    early = F.coalesce(F.floor(F.col("__start") / 60).cast("long"), F.floor(F.coalesce("speech_id", F.lit(0)) / CHUNK).cast("long")) - FIRST
    chunk = F.floor(F.col("volgnr") / CHUNK).cast("long")
    loose = d.where("volgnr is null and __start is not null").select("verslag_id", "__start").distinct()
    if loose.isEmpty():
        return d.withColumn("__chunk", F.coalesce(chunk, early))
    loose = cut(loose)
    with_loose = d.where("volgnr is not null and __start is not null").join(loose.select(F.col("verslag_id").alias("__v")).distinct(), F.col("verslag_id").eqNullSafe(F.col("__v")), "left_semi")
    both = with_loose.groupBy("verslag_id", "__start").agg(F.max("volgnr").alias("n")).unionByName(loose.withColumn("n", F.lit(None).cast("int")))
    near = carry(both.groupBy("verslag_id", "__start").agg(F.max("n").alias("n")).withColumn("__hour", F.floor(F.col("__start") / 900)), ["verslag_id"], "__hour", ["__start"], {"near": "n"})
    near = near.select(F.col("verslag_id").alias("__v"), F.col("__start").alias("__s"), F.floor(F.col("near") / CHUNK).cast("long").alias("__near"))
    placed = d.join(near, F.col("verslag_id").eqNullSafe(F.col("__v")) & (F.col("__start") == F.col("__s")) & F.col("volgnr").isNull(), "left")
    return placed.withColumn("__chunk", F.coalesce(chunk, "__near", early)).drop("__v", "__s", "__near")


def parse(chunked: DataFrame, people: tuple, texts: bool) -> DataFrame:
    """Segments with words of every row, where the row lies (no shuffle)."""
    columns = ["speech_id", "verslag_id", "volgnr", "persoon_id", "verslagnaam", "achternaam", "voornaam", "fractie", "is_voorzitter", "__start", "speech_text", "__chunk"]

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = People(*people)
        for d in parts:
            rows = []
            d = d.astype(object).where(d.notna(), None)
            for sid, vid, nr, pid, full, surname, given, party, chair, start, text, chunk in d[columns].itertuples(index=False):
                own = known.described(pid, full, surname, given, party) or ("!" if chair else None)
                for k, (who, body, cue) in enumerate(segments(text, own, known)):
                    rows.append((vid, chunk, nr, sid, start, k, who, cue, body if texts else None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PARSED.split(", ")], dtype=object)

    return chunked.select(*columns).mapInPandas(of, _PARSED)


class Precedence:
    """A topological order that constraints are added to one by one (after Pearce and Kelly): what agrees with the order costs nothing,
    what does not moves only the nodes between its ends, and what would close a circle is refused."""

    def __init__(self, nodes: int):
        self.at = list(range(nodes))  # node: place
        self.after: list[list[int]] = [[] for _ in range(nodes)]
        self.before: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int) -> bool:
        if a == b:
            return False
        if self.at[a] > self.at[b]:
            later = self._reach(b, self.after, lambda p: p <= self.at[a])
            if a in later:
                return False
            earlier = self._reach(a, self.before, lambda p: p >= self.at[b])
            moved = sorted(earlier, key=self.at.__getitem__) + sorted(later, key=self.at.__getitem__)
            for x, p in zip(moved, sorted(self.at[x] for x in moved)):
                self.at[x] = p
        self.after[a].append(b)
        self.before[b].append(a)
        return True

    def _reach(self, start: int, edges: list[list[int]], near) -> set[int]:
        seen, stack = {start}, [start]
        while stack:
            for y in edges[stack.pop()]:
                if y not in seen and near(self.at[y]):
                    seen.add(y)
                    stack.append(y)
        return seen


def topological(nodes: list[tuple], weights: tuple[int, int, int] = WEIGHTS) -> list[int]:
    """Places of ``nodes`` (volgnr, row, seq, cue, start; the row any mark of it, the rest may be None) in the order that the constraints give.

    Dialogue: what has a lower volgnr, and within a row a lower seq, comes before. Cue: a segment with an
    earlier time code does. Timing: the opening of a row that starts earlier does. Free nodes go by
    (volgnr, start, row, seq).
    """
    n = len(nodes)
    rank = sorted(range(n), key=lambda i: tuple((x is None, x or 0) for x in (nodes[i][0], nodes[i][4], nodes[i][1], nodes[i][2])))
    place = {i: k for k, i in enumerate(rank)}

    def levels(key, of: list[int]) -> list[list[int]]:
        by: dict = defaultdict(list)
        for i in of:
            if key(i) is not None:
                by[key(i)].append(i)
        return [by[k] for k in sorted(by)]

    opening: dict = {}
    rows: dict = defaultdict(list)
    for i in rank:
        rows[nodes[i][1]].append(i)
        opening.setdefault(nodes[i][1], i)
    first = list(opening.values())
    chains = [(weights[0], levels(lambda i: nodes[i][2], r)) for r in rows.values() if len(r) > 1]
    chains += [(weights[0], levels(lambda i: nodes[i][0], rank)), (weights[1], levels(lambda i: nodes[i][3], rank)), (weights[2], levels(lambda i: nodes[i][4], first))]
    # a joint between two levels stands for all pairs of theirs; it is placed behind the level before it
    steps, joints = [], []
    for weight, chain in chains:
        for a, b in zip(chain, chain[1:]):
            joint = n + len(joints)
            joints.append(max(place[i] for i in a) + 0.5)
            steps.append((weight, a, joint, b))
    whole = sorted(range(n + len(joints)), key=lambda x: (place[x] if x < n else joints[x - n], x))
    number = {x: k for k, x in enumerate(whole)}
    order = Precedence(len(whole))
    for _, a, joint, b in sorted(steps, key=lambda s: -s[0]):
        for x in a:
            order.add(number[x], number[joint])
        for y in b:
            order.add(number[joint], number[y])
    # of the orders that keep all that was taken, the one that leaves free nodes by rank
    open_ = [len(x) for x in order.before]
    ready = [(place.get(x, -1), x) for x in whole if not open_[number[x]]]
    heapq.heapify(ready)
    out = []
    while ready:
        x = heapq.heappop(ready)[1]
        if x < n:
            out.append(x)
        for k in order.after[number[x]]:
            open_[k] -= 1
            if not open_[k]:
                heapq.heappush(ready, (place.get(whole[k], -1), whole[k]))
    return out


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]]) for c in schema.split(", ")])


_ORDERED = "verslag_id string, chunk long, place long, volgnr long, speech_id long, seq int, who string, run long, body string"
_RUNS = "verslag_id string, chunk long, start_volgnr long, who string, opens boolean, closes boolean"


def _decide(who: str | None, chair: str | None, present: set[str]) -> str | None:
    if who is None:
        return None
    if who == "!":
        return chair
    if "|" in who:
        ids = who.split("|")
        here = [chair] if chair in ids else [p for p in ids if p in present]
        return here[0] if len(here) == 1 else None
    return who


def _order(weights: tuple[int, int, int], runs: bool):
    """A chunk of one transcript in order, its speakers decided: its segments, or only its runs of one speaker."""
    schema = _arrow(_RUNS if runs else _ORDERED)

    def of(group: pa.Table, context: pa.Table) -> pa.Table:
        chair, present = next(((c["chair"], set(c["present"] or ())) for c in context.to_pylist()), (None, set()))
        # a row delivered twice counts once
        nodes = list({(r["speech_id"], r["volgnr"], r["seq"]): r for r in group.to_pylist()}.values())
        mark = {k: i for i, k in enumerate(sorted({(r["speech_id"], r["volgnr"]) for r in nodes}, key=lambda k: tuple((x is None, x or 0) for x in k)))}
        out: list[dict] = []
        run, last = 0, None
        for place, i in enumerate(topological([(r["volgnr"], mark[r["speech_id"], r["volgnr"]], r["seq"], r["cue"], r["start"]) for r in nodes], weights)):
            r = nodes[i]
            who = _decide(r["who"], chair, present) or last
            if who != last and out:
                run += 1
            last = who
            if not runs:
                out.append({c: r[c] for c in ("verslag_id", "chunk", "volgnr", "speech_id", "seq", "body")} | {"place": place, "who": who, "run": run})
            elif who is not None and (not out or out[-1]["run"] != run):
                # before the first known speaker of a chunk is who spoke last in an earlier one
                out.append({"verslag_id": r["verslag_id"], "chunk": r["chunk"], "run": run, "start_volgnr": r["volgnr"], "who": who, "opens": not out, "closes": False})
        if runs and out:
            out[-1]["closes"] = True
        return pa.Table.from_pylist(out, schema=schema)

    return of


def people_of(persoon: DataFrame, membership: DataFrame, fractie: DataFrame) -> tuple:
    """The bounded lists that ``People`` is made of."""
    persons = bounded(persoon.select("Id", "Tussenvoegsel", "Achternaam", "Roepnaam", "Voornamen", "Fractielabel").distinct(), MAX_PERSONS, "the list of persons")
    members = bounded(membership.select("Persoon_Id", "Fractie_Id").distinct(), 10 * MAX_PERSONS, "the list of memberships")
    return [tuple(r) for r in persons], with_english(canonical_names(fractie, "Id", ["Afkorting", "NaamNL", "NaamEN"])), [tuple(r) for r in members]


def ordered(speeches: DataFrame, people: tuple, weights: tuple[int, int, int] = WEIGHTS, runs: bool = False, texts: bool = True) -> DataFrame:
    """Segments of all transcripts in order: verslag_id, chunk, place, volgnr, seq, speaker, run, body; or only the ``runs`` of one known speaker in a chunk.

    Speaker null: unknown. Rows without text or words give none. A label that may be several persons is the one of
    them who is named in the same transcript, if that is one. What is known of a transcript goes to each of its chunks once.
    """
    chunked = with_chunks(speeches)
    pid = F.lower(F.trim("persoon_id"))
    # both buffers hold distinct persons, whatever the rows of a transcript
    whole = speeches.groupBy(F.col("verslag_id").alias("__v")).agg(F.mode(F.when(F.col("is_voorzitter"), pid), True).alias("chair"), F.collect_set(pid).alias("present"))
    per = chunked.select("verslag_id", F.col("__chunk").alias("chunk")).distinct()
    context = per.join(whole, F.col("verslag_id").eqNullSafe(F.col("__v"))).drop("__v")
    parts = parse(chunked, people, texts)
    return parts.groupBy("verslag_id", "chunk").cogroup(context.groupBy("verslag_id", "chunk")).applyInArrow(_order(weights, runs), _RUNS if runs else _ORDERED)


def turns(runs: DataFrame) -> DataFrame:
    """The ``runs`` that begin a turn: verslag_id, start_volgnr, persoon_id.

    Only the first known run of a chunk can go on with a turn of an earlier one; the speakers that close chunks, one row
    for each, are carried on to tell. So no more than two rows of a chunk are shuffled again.
    """
    runs = cut(runs.select("verslag_id", "chunk", "start_volgnr", F.col("who").alias("persoon_id"), "opens", "closes"))
    ends = runs.where("closes").select("verslag_id", "chunk", "persoon_id", F.floor(F.col("chunk") / CHUNK).alias("__bucket"))
    ends = carry(ends, ["verslag_id"], "__bucket", ["chunk"], {"before": "persoon_id"}, inclusive=False)
    ends = ends.select(F.col("verslag_id").alias("__v"), F.col("chunk").alias("__c"), "before")
    opening = runs.where("opens").join(ends, F.col("verslag_id").eqNullSafe(F.col("__v")) & (F.col("chunk") == F.col("__c"))).where(~F.col("persoon_id").eqNullSafe(F.col("before")))
    columns = ["verslag_id", "start_volgnr", "persoon_id"]
    return runs.where(~F.col("opens")).select(*columns).unionByName(opening.select(*columns))


def found(speeches: DataFrame, persoon: DataFrame, membership: DataFrame, fractie: DataFrame, weights: tuple[int, int, int] = WEIGHTS) -> DataFrame:
    """Distinct (verslag_id, start_volgnr, persoon_id) of all turns."""
    t = turns(ordered(speeches, people_of(persoon, membership, fractie), weights, runs=True, texts=False))
    return t.select("verslag_id", F.col("start_volgnr").cast("int").alias("start_volgnr"), "persoon_id").distinct()
