import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenaria.llm import linkage

Z = "Id string, Nummer string, Soort string, Titel string, Onderwerp string, ApiGewijzigdOp timestamp"
P = "pair_id long, besluit_id string, agendapunt_onderwerp string, besluit_tekst string, activiteit_onderwerp string, datum string, vergaderjaar string, b string, z string"
SUBJECT = "het financieren van duurzame akkercontrole in Vlierhorn"


def zaken(spark):
    rows = [
        ("z1", "2009Z1", "Motie", "Nota", f"Gewijzigde motie van het lid Mosterakkerse over {SUBJECT}"), ("z2", "2009Z2", "Amendement", "Nota", f"Amendement van het lid Mosterakkerse inzake {SUBJECT}"),
        ("z3", "2009Z3", "Motie", f"Motie van het lid De Vink c.s. over {SUBJECT}", "Nota"), ("z4", "2004Z4", "Motie", "Nota", f"Motie van het lid Mosterakkerse over {SUBJECT}"),
        ("z5", "2009Z5", "Brief regering", None, f"Stand van zaken rond {SUBJECT}"), ("z6", "2010Z6", "Wetgeving", "Wijziging van de Wet bosplan Bolvenne in verband met het versterken van nieuwe bosplan", None),
        ("z7", "2010Z7", None, f"Voorstel van wet van het lid De Vink: wijziging van de Wet dijkfonds Markdam in verband met het uitbreiden van extra dijkfonds", None), ("z8", None, "Motie", None, None),
        ("z1", "2009Z1", "Motie", "Nota", f"Gewijzigde motie van het lid Mosterakkerse over {SUBJECT}"), (None, "2009Z9", "Motie", None, "x"),
    ]
    return spark.createDataFrame([(*r, None) for r in rows], Z)


DECISIONS = {
    "b1": ("Stemming over: omtie van het lid Mosterakkerse over het financieen van duurzame akkercontrole in Vlierhorn", "Verworpen.", "2009-11-25", "z1"),
    "b2": ("Mosterakkerse c.s.: amen. akkercontrole Vlierhorn: duurzame, financieren", "Amendement Mosterakkerse: aangenomen.", "2010-02-01", "z2"),
    "b3": ("AKKERCONTROLE VLIERHORN: DUURZAME, FINANCIEREN (MOTIE DE VINK, GRN)", None, "2009-05-01", "z3"),
    "b4": ("St. motie Haver inz. duurzame akkercontrole in Vlierhorn financieren", "Aangenomen.", "2009-05-01", None),
    "b5": ("Motie-Mosterakkerse over beperken duurzame akkercontrole Vlierhorn", None, "2009-05-01", None),
    "b6": ("Wet bosplan Bolvenne (versterken nieuwe)", "Wetgeving Haver: aangenomen.", "2010-05-01", "z6"),
    "b7": ("Wijz. Wet dijkfonds Markdam i.v.m. uitbreiden extra dijkf&oacute;nds", "Initiatiefwetgeving De Vink: aangenomen.", "2011-05-01", "z7"),
    "b8": ("Motie-Mosterakkerse over financieren duurzame akkercontrole Vlierhorn", None, "2005-05-01", "z4"),
    "b9": (None, "Aangenomen.", "2009-05-01", None),
    "b10": ("", "", "2009-05-01", None),
    "b11": ("woord " * 5_000, None, None, None),
}


def pairs(spark):
    rows = [(n, b, t, r, "Nota", d, None, "x", "y") for n, (b, (t, r, d, _)) in enumerate(DECISIONS.items())]
    return spark.createDataFrame(rows + rows[:3] + [(99, None, "x", None, None, None, None, None, None)], P)


def test_each_decision_gets_its_own_proposal_or_none(spark):
    got = {r.besluit_id: (r.zaak_id, r.confidence) for r in linkage.link(pairs(spark), zaken(spark)).collect()}
    assert {b: got[b][0] for b in got} == {b: z for b, (_, _, _, z) in DECISIONS.items() if z}
    assert all(linkage.ACCEPT <= c <= 1 for _, c in got.values())


def test_empty(spark):
    p, z = pairs(spark), zaken(spark)
    assert linkage.found(p.limit(0), z).count() == 0 and linkage.found(p, z.limit(0)).count() == 0


def test_swapped_and_missing_fields():
    assert linkage.proposal(None, "Motie van het lid X over water in A", "Nota") == ("motie", "x", ["a", "water"])
    assert linkage.proposal("Motie", None, None) is None and linkage.proposal(None, None, "zomaar") is None
    assert linkage.proposal("Initiatiefwetgeving", None, "Regels omtrent het water in A (Wet water A)")[0] == "initiatief"


RULES = "b string, z string, g long, rules array<struct<c: double, s: double, w: double>>"


def problem(spark, truths):
    """{(b, z, group): truth} as edges with the own rules of a pair."""
    own = lambda t: [(-1.0, t, linkage.SUBJECT), (1.0, t, linkage.NEEDS), (1.0, 0.0, linkage.PRIOR)]
    return spark.createDataFrame([(b, z, g, own(t)) for (b, z, g), t in truths.items()], RULES)


def loss(truths, y):
    """The sum of all hinges; ``y`` holds one column for each pair."""
    keys = list(truths)
    pos = lambda x: np.maximum(0, x)
    out = sum(linkage.SUBJECT * pos(t - y[i]) + linkage.NEEDS * pos(y[i] - t) + linkage.PRIOR * y[i] for i, t in enumerate(truths.values()))
    for side, w in ((0, linkage.ONE), (1, linkage.SHARED)):
        for node in {k[side] for k in keys}:
            out = out + w * pos(sum(y[i] for i, k in enumerate(keys) if k[side] == node) - 1)
    for star in {k[1:] for k in keys}:
        at = np.array([y[i] for i, k in enumerate(keys) if k[1:] == star])
        out = out + linkage.TRANSITIVE * np.abs(at - np.median(at, axis=0)).sum(0)
    return out


PROBLEMS = [
    {("a", "x", 1): 1.0, ("a", "y", 1): 0.6}, {("a", "x", 1): 1.0, ("b", "x", 2): 1.0}, {("a", "x", 1): 1.0, ("b", "x", 1): 0.8, ("b", "y", 1): 0.8},
    {("a", "x", 1): 1.0, ("b", "x", 2): 1.0, ("b", "y", 2): 0.9}, {("a", "x", 1): 1.0, ("b", "x", 1): 1.0, ("c", "x", 1): 0.4, ("c", "y", 1): 0.5},
    {("a", "x", 1): 0.8, ("a", "y", 1): 0.8, ("b", "y", 2): 1.0}, {("a", "x", 1): 0.8},
]


@pytest.mark.parametrize("truths", PROBLEMS)
def test_the_minimum_is_reached(spark, truths):
    """At production settings, against a grid that holds the optimum."""
    got = {(r.b, r.z): r.y for r in linkage.solve(problem(spark, truths)).collect()}
    grid = np.meshgrid(*[np.linspace(0, 1, 21)] * len(truths), indexing="ij")
    assert loss(truths, [got[k[:2]] for k in truths]) <= loss(truths, grid).min() + 1e-3
    for b in {k[0] for k in truths}:
        assert sum(v for k, v in got.items() if k[0] == b) <= 1 + 1e-3


@pytest.mark.parametrize("n", [2, 3, 5])
@pytest.mark.parametrize("alike", [True, False])
def test_equal_decisions_on_one_proposal_all_link(spark, n, alike):
    got = linkage.solve(problem(spark, {(f"b{i}", "x", 1 if alike else i): 1.0 for i in range(n)})).collect()
    assert len(got) == n and all(r.y > 0.99 for r in got)


def test_likeness_carries_a_link_over_and_a_free_proposal_wins_a_tie(spark):
    """b names nobody: alone x and y are equal. A like decision on x pulls it there; an unlike one on x leaves it y."""
    for group, best in ((1, "x"), (2, "y")):
        got = {(r.b, r.z): r.y for r in linkage.solve(problem(spark, {("a", "x", 1): 1.0, ("b", "x", group): 0.8, ("b", "y", group): 0.8})).collect()}
        assert max(("x", "y"), key=lambda z: got["b", z]) == best and got["a", "x"] > 0.99


def test_parts_are_packed_and_large_or_long_ones_go_across_tasks(spark):
    g = random.Random(3)
    truths = {(f"b{i}", f"z{i + d}", i): round(g.uniform(0.5, 1), 2) for i in range(9) for d in range(g.choice([1, 2]))} | {(f"c{i}", f"y{i // 2}", 100 + i // 2): 0.9 for i in range(10)}
    df = problem(spark, truths)
    whole = {(r.b, r.z): r.y for r in linkage.solve(df).collect()}
    for local, hops in ((4, 50), (1000, 0)):
        other = {(r.b, r.z): r.y for r in linkage.solve(df, local, hops, 3e-3).collect()}
        assert set(other) == set(whole)
        assert abs(loss(truths, [whole[k[:2]] for k in truths]) - loss(truths, [other[k[:2]] for k in truths])) < 0.05


def test_labels_of_parts(spark):
    df = problem(spark, {("a", "x", 1): 1.0, ("b", "x", 1): 1.0, ("b", "y", 1): 1.0, ("c", "u", 1): 1.0})
    at, open_ = linkage.parts(df)
    label = {(r.b, r.z): r.c for r in at.collect()}
    assert len({label["a", "x"], label["b", "x"], label["b", "y"]}) == 1 and label["c", "u"] != label["a", "x"] and open_.count() == 0


def test_alone_is_the_closed_minimum(spark):
    df = spark.createDataFrame([([(-1.0, 1.0, 4.0), (1.0, 0.8, 6.0), (1.0, 0.0, 1.0)],), ([(-1.0, 1.0, 4.0), (1.0, 0.0, 6.0), (1.0, 0.0, 1.0)],)], "r array<struct<c: double, s: double, w: double>>")
    assert [x.y for x in df.select(linkage.alone(F.col("r")).alias("y")).collect()] == [0.8, 0.0]


def test_spelling_beyond_the_bound_is_the_same(spark):
    """The shuffled join against the list sent to every task, with long words, ties and swaps."""
    g = random.Random(4)
    known = ["financieren", "water", "waters", "dijk", "bos", "k" + "oppel" * 13 + "teken", "".join(g.choice("abcde") for _ in range(90))]
    typed = {"finnacieren", "fnancierne", "watre", "wate", "dijkk", "dik", "bso", "zon", "x" * 300, ""}
    for w in known:
        for _ in range(12):
            t = list(w)
            for _ in range(g.choice([1, 2])):
                i = g.randrange(len(t))
                if g.random() < 0.5 and i + 1 < len(t):
                    t[i : i + 2] = t[i + 1 : i - 1 if i else None : -1]
                else:
                    t[i] = g.choice(["", "q", t[i] * 2])
            typed.add("".join(t))
    a, v = spark.createDataFrame([(w,) for w in sorted(typed)], "w string"), spark.createDataFrame([(w,) for w in known], "w string")
    one, other = (sorted(map(tuple, linkage.mended(a, v, most).collect())) for most in (1000, 1))
    assert one == other and len(one) > len(known) + 20


VERBS, KINDS = ["financieren", "beperken", "uitbreiden", "handhaven", "evalueren", "halveren"], ["duurzame", "brede", "digitale", "openbare", "extra"]
NOUNS = [a + b for a in ("akker", "bodem", "haven", "jeugd", "molen", "sluis", "water") for b in ("controle", "fonds", "norm", "project", "toeslag")]
PLACES = [a + b for a in ("Bol", "Grave", "Harke", "Marks", "Rietel", "Vlier") for b in ("dam", "horn", "kerke", "loo", "meer")]
NAMES = ["Mosterakkerse", "De Vink", "Van Zwaliepen", "Haver", "Ter Orlvoorter", "Grasboerse", "Stelwijckel"]


def corpus(n):
    """Proposals with near ones (another proposer, kind or year), and decisions in several wordings with slips; with the truth."""
    g = random.Random(11)
    zaken, rows, truth = [], [], set()
    seen = set()
    for k in range(n):
        verb, adj, noun, place, who, year = g.choice(VERBS), g.choice(KINDS), g.choice(NOUNS), g.choice(PLACES), g.choice(NAMES), g.randrange(2009, 2013)
        if (noun, place) in seen:
            continue
        seen.add((noun, place))
        text = lambda kind, who: f"{kind} van het lid {who} over het {verb} van {adj} {noun} in {place}"
        zaken.append((f"z{k}", f"{year}Z{k}", "Motie", "Nota", text("Motie", who)))
        near = g.choice(["proposer", "kind", "year", ""])
        if near:
            other = {"proposer": ("Motie", g.choice([x for x in NAMES if x != who]), year), "kind": ("Amendement", who, year), "year": ("Motie", who, year - 4)}[near]
            zaken.append((f"n{k}", f"{other[2]}Z9{k}", other[0], "Nota", text(other[0], other[1])))
        if g.random() < 0.15:
            continue
        slip = lambda w: w[: (i := g.randrange(2, len(w) - 1))] + w[i + 1 :] if g.random() < 0.2 else w
        v, a, o, p = slip(verb), slip(adj), slip(noun), slip(place)
        for m in range(g.choice([1, 1, 1, 2])):
            t = g.choice([f"Stemming over: motie van het lid {who} over het {v} van {a} {o} in {p}", f"{o} {p}: {a}, {v} (motie {who}, GRN)", f"Motie-{who} over {v} {a} {o} {p}".upper(), f"St. motie {who} inz. {a} {o} in {p} {v}"])
            rows.append((len(rows), f"b{k}-{m}", t, g.choice([None, "Aangenomen.", f"Motie {who}: verworpen."]), "Nota", f"{year + g.choice([0, 1])}-02-01", None, None, None))
            truth.add((f"b{k}-{m}", f"z{k}"))
    return zaken, rows, truth


def test_recall_and_precision(spark):
    zaken, rows, truth = corpus(500)
    z = spark.createDataFrame([(*r, None) for r in zaken], Z)
    got = {tuple(r) for r in linkage.found(spark.createDataFrame(rows, P), z).collect()}
    assert len(truth) > 300 and len(got & truth) / len(truth) >= 0.99 and len(got & truth) / len(got) >= 0.99


def test_hot_keys_take_a_third_word_and_lose_nothing(spark):
    """Every proposal shares its two rarest words with all others: the candidates are those of the plain keys."""
    zs = [(f"z{i}", "motie", None, sorted({"dijk", "horn", f"w{i % 7}", f"v{i % 5}", *([f"u{i}", f"t{i}"] if i % 3 else [])}), "", 2010 if i % 4 else None) for i in range(60)]
    bs = [(f"b{i}", None if i % 5 == 0 else "motie", None, zs[i][3][:6], False, "", None if i % 6 == 0 else 2010, zs[i][3]) for i in range(60)]
    z = spark.createDataFrame(zs, "z string, kind string, proposer string, subject array<string>, title string, year int")
    b = spark.createDataFrame(bs, "b string, kind string, proposer string, typed array<string>, named boolean, title string, year int, tokens array<string>")
    n = z.select(F.explode("subject").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    plain, third = ({(r.b, r.z) for r in linkage.candidates(b.withColumn("lead", F.col("tokens")), z, linkage.ranked(z, n), hot).collect()} for hot in (10**6, 2))
    brute = {(x[0], y[0]) for x in bs for y in zs if 4 * len(set(x[7]) & set(y[3])) / len(y[3]) > 3 and (x[6] is None or y[5] is None or y[5] in (x[6], x[6] - 1))}
    assert plain == third == brute
