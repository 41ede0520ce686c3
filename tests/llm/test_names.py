import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plenaria.llm import names, strings

LIST = [
    ("1", "VBP"), ("1", "Verbond voor Burger en Polder"), ("2", "VBP/Krelissen"), ("3", "Oosterbond"), ("4", "Westerbond"), ("5", "Waterbond"), ("5", "Nationale Waterbond"),
    ("6", "ÉénDelta"), ("6", "Beweging Één Delta"), ("7", "Hemelsblauw"), ("7", "Beweging Hemelsblauw"), ("8", "DUIN"), ("8", "Democratische Unie voor Inwoners en Natuur"), ("9", "Groep Haverslag"),
]


@pytest.fixture(scope="module")
def resolver():
    return names.Resolver(names.with_english(LIST))


CASES = {
    "vbp": "1", " V.B.P. ": "1", "V B P": "1", "fractie van VBP": "1", "VBP (Tweede Kamer)": "1", "VBP / Verbond voor Burger en Polder": "1", "Verb. v. Burger & Polder": "1",
    "voor Burger en Polder, Verbond": "1", "Verbond voor Burger en": "1", "Verbod voor Burger en Poldder": "1", "Union of Citizen and Polder": "1", "VBP/relissen": "2", "[VBP/Krelissen]": "2",
    "Ooste rbond": "3", "00STERBOND": "3", "Oosterbond: Oosterbond": "3", "the Eastern League": "3", "Wsterbond": "4", "westerbond-fractie": "4", "Nationale Wa": "5", "Natiotale Waterbond": "5",
    "Een Delta": "6", "Beweging Één": "6", "Beweglng Één De1ta": "6", "sky blue movement": "7", "Demo. Unie v. Inwo. & Natuur": "8", "Gr. Haverslag": "9", "vbp ": "1",
    "Partij Morgenrood": None, "Unie Havenstad": None, "geen fractie": None, "XQJ": None, "12": None, "???": None, "": None, "Beweging": None, "VBP en DUIN": None, None: None, "x" * 50_000: None,
}


@pytest.mark.parametrize("text", CASES, ids=lambda t: repr(t)[:30])
def test_values(resolver, text):
    assert resolver(text) == CASES[text]


def test_longest_mention_wins(resolver):
    tokens = strings.skeleton("de VBP/Krelissen").split()
    assert {k for *_, k in resolver.mentions(tokens)} == {"1", "2"} and names.decide(tokens, [resolver.evidence(tokens)]) == "2"


def test_no_names():
    r = names.Resolver([])
    assert r("x") is None and r("") is None
    assert names.Resolver([("1", "A b"), ("2", "a B")])("ab") is None  # two entries of one form


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcde", max_size=8), st.text(alphabet="abcde", max_size=8))
def test_distance_against_a_full_table(a, b):
    t = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                t[i][j] = min(t[i][j], t[i - 2][j - 2] + 1)
    for most in (0, 1, 2, 3):
        assert strings.distance(a, b, most) == min(t[-1][-1], most + 1)


def test_found(spark):
    fractie = spark.createDataFrame([(k, n, None, None) for k, n in LIST], "Id string, Afkorting string, NaamNL string, NaamEN string")
    s = spark.createDataFrame([("a", "VBP", "q"), ("b", "vbp", "q"), ("b", "vbp", "q"), ("c", "  ", "q"), ("d", None, "q"), ("e", "None", "q"), ("f", "nan", "q"), ("g", "zomaar", "q"), (None, "duin", None)], "Id string, ActorFractie string, fractie_id string")
    p = spark.createDataFrame([(1, "Duin", 3), (2, None, 4)], "speech_id long, fractie string, tabel int")
    got = {tuple(r) for r in names.found(s, p, fractie).collect()}
    assert got == {("stemming", "b", "1"), ("stemming", "g", ""), ("stemming", None, "8"), ("speeches", "1", "8")}
    assert sorted(tuple(r) for r in names.unmatched(names.found(s, p, fractie)).collect()) == [("speeches", 1, 0), ("stemming", 3, 1)]
    assert names.found(s.limit(0), p.limit(0), fractie).count() == 0
    assert {r.fractie_id for r in names.found(s, p, fractie.limit(0)).collect()} == {""}


def test_a_list_in_blocks_gives_the_same(spark):
    """Every name in a block of its own, and forms that two keys of different blocks share."""
    more = [*LIST, ("10", "Ooster Bond"), ("11", "Zuid"), ("12", "zuid")]
    whole = names.Resolver(names.with_english(more))
    texts = [t for t in CASES if t] + ["Oosterbond", "zuid", "westerbond"]
    t, n = spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame(more, "key string, name string")
    for block in (1, 5, 1000):
        assert {r.t: r.key for r in names.mapped(t, n, block).collect()} == {t: whole(t) for t in texts}
    f = spark.createDataFrame([(k, n, None, None) for k, n in LIST], "Id string, Afkorting string, NaamNL string, NaamEN string")
    s = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "Id string, ActorFractie string")
    p = spark.createDataFrame([(1, "Duin"), (2, None)], "speech_id long, fractie string")
    assert sorted(map(tuple, names.found(s, p, f, 3).collect())) == sorted(map(tuple, names.found(s, p, f).collect()))


def test_candidates_lose_no_name():
    """Scores by the indexes against all names."""
    import random

    g = random.Random(2)
    pool = sorted({n for _, n in LIST} | {"Algemene Huurderspartij", "Vrije Zeelieden Nu", "Partij van het Veen", "Lokaal Belang"})
    r = names.Resolver([(n, n) for n in pool])
    for _ in range(300):
        t = list(g.choice(pool))
        for _ in range(g.randrange(4)):
            i = g.randrange(len(t))
            t[i] = g.choice(["", t[i] * 2, g.choice("aeno ")])
        tokens = strings.skeleton("".join(t)).split()
        if not tokens:
            continue
        best = {}
        for core in names.cores(tokens):
            weighty = [x for x in core if x not in names._LIGHT and not names.skeleton_around(x)] or core
            for key, name, form in r.names:
                near = {x: {y: names.match(x, y) for y in name} for x in weighty}
                best[key] = max(best.get(key, 0), names.spelling("".join(core), form) if len("".join(core)) > 2 else 0, names.token_set(weighty, name, near) if len("".join(core)) > 2 else 0)
        want = [x for x in sorted(best.values(), reverse=True)[:2] if x >= names.ACCEPT - names.MARGIN]
        assert [x for x, *_ in r.similar(tokens) if x >= names.ACCEPT - names.MARGIN] == pytest.approx(want)


def test_bound_is_an_error_and_no_cut(spark):
    from plenaria.runtime import BoundExceeded

    df = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, n string")
    assert len(names.canonical_names(df, "k", ["n"], 2)) == 2
    with pytest.raises(BoundExceeded):
        names.canonical_names(df, "k", ["n"], 1)
