import random

import pytest

from plenaria.llm import turns

PERSONS = [
    ("P1", None, "Haverselaar", "Wiebe", "Wiebe Jan", "GRN"), ("p2", "van der", "Molmzandsel", "Joriska", "Joriska", "DKA"), ("p3", None, "Orliepen", "Gijs", "Gijs", "CLD"),
    ("p4", None, "Orliepen", "Nienke", "Nienke", "GRN"), ("p5", "de", "Haverselaar", "Otto", "Otto", "CLD"),
]
PARTIES = [("g", "GRN"), ("g", "Groene Ruimte Nu"), ("d", "DKA"), ("c", "CLD")]
MEMBERS = [("p3", "c"), ("p4", "g")]


@pytest.fixture(scope="module")
def people():
    return turns.People(PERSONS, PARTIES, MEMBERS)


LABELS = {
    "De heer Haverselaar (GRN)": "p1", "HAVERSELAAR / GRN": "p1", "Haverselaar, grn": "p1", "GRN, Haverselaar": "p1", "Haverselaar - GRN": "p1", "Mw. Van der Molmzandsel (dka)": "p2",
    "Joriska van der Molmzandsel": "p2", "Spreker Van der Molmmzandsel (DKA-fractie)": "p2", "Mevr. Van der Molmzandsel van DKA ": "p2", "MINISTER Haverselaar": "p1", "Orliepen (CLD)": "p3",
    "Orliepen (Groene Ruimte Nu)": "p4", "Gijs Orliepen": "p3", "Orliepen": "p3|p4", "De Haverselaar": "p5", "Dee Haverselaar": "p5", "De voorzitter": "!", "Vz.": "!", "VOORZITTER": "!", "**Voorzitter** ": "!",
    "De voorzitter (Haverselaar)": "p1", "Mijn vraag aan de heer Haverselaar": None, "De vraag is simpel": None, "Een bewoner uit Bolhorn schreef": None, "Zoals de heer Haverselaar zei": None, "": None,
}


@pytest.mark.parametrize("head", LABELS)
def test_labels(people, head):
    assert people.announced(head) == LABELS[head]


def test_segments(people):
    text = "(09:30:03) Graag een antwoord. <09:30:10.872> Voorzitter -\nWil Eh... de Kamer dit? [applaus]\n[590:06] Haverselaar - GRN:\nDat (nog) niet. Uhm, De vraag is simpel: ja?\n\n[Orliepen, CLD]\nHm. Zeker."
    assert turns.segments(text, "p2", people) == [
        ("p2", "Graag een antwoord.", 34203), ("!", "Wil de Kamer dit?", 34210), ("p1", "Dat (nog) niet. De vraag is simpel: ja?", 35406), ("p3", "Zeker.", None),
    ]


def test_time_codes():
    assert [turns.seconds(c) for c in ("[t=35467s]", "(09:30:03)", "<09:58:51.633>", "10:09:46,212 -->", "[606:46]", "09:30")] == [35467, 34203, 35931, 36586, 36406, 34200]


def test_long_notes_and_names_are_no_speech(people):
    assert turns.segments("Ja. [" + "applaus en rumoer " * 40 + "] Nee. (" + "De leden verlaten de zaal. " * 20 + ")", "p1", people) == [("p1", "Ja. Nee.", None)]
    long = [("p7", "van der", "Bosch", "Anna", "Anna Maria Petronella Johanna Cornelia Wilhelmina", None)]
    assert turns.People(long, [], []).named("Anna Maria Petronella Johanna Cornelia Wilhelmina van der Bosch") == ("p7",)


@pytest.mark.parametrize("text", [None, "", "  ", "10:00:46", "[t=35467s]", "* applaus *", "Eh, eh...", "[zucht] Uhm...", "09:36:39 [schorsing van 5 minuten]", "De voorzitter: Hm.", "(De bel wordt geluid.)", "-- stilte --"])
def test_passages_without_words(people, text):
    assert turns.segments(text, "p1", people) == []


def test_very_long_text(people):
    assert len(turns.segments("Dat klopt. Haverselaar: ja.\n" * 5_000, None, people)) == 5_001  # what follows a label up to the next is one segment
    assert len(turns.segments("woord " * 100_000, "p1", people)) == 1


def test_order_takes_constraints_by_weight():
    """Nodes are (volgnr, row, seq, cue, start)."""
    a, b, c = (1, 0, 0, 300, 100), (2, 1, 0, 200, 200), (3, 2, 0, 100, 50)
    assert turns.topological([c, a, b]) == [1, 2, 0]  # dialogue first; all else contradicts it or agrees
    assert turns.topological([c, a, b], (1, 4, 2)) == [0, 2, 1]  # cues first
    assert turns.topological([c, a, b], (1, 2, 4)) == [0, 1, 2]  # starts first
    # without volgnr, cues decide where they speak, starts elsewhere
    assert turns.topological([(None, 0, 0, None, 30), (None, 1, 0, 5, 20), (None, 2, 0, 9, 10)]) == [1, 2, 0]
    # an unnumbered row goes where its time lies
    assert turns.topological([(None, 9, 0, None, 102), (1, 1, 0, None, 100), (2, 2, 0, None, 104), (3, 3, 0, None, None)]) == [1, 0, 2, 3]
    assert turns.topological([]) == [] and turns.topological([(None, 0, 0, None, None)]) == [0]


def test_place_in_a_row_holds_against_cues():
    assert turns.topological([(1, 0, 0, 500, 10), (1, 0, 1, 400, None), (1, 0, 2, 600, None)]) == [0, 1, 2]


def test_any_order_keeps_dialogue_and_all_that_does_not_contradict():
    g = random.Random(1)
    for _ in range(80):
        nodes = [(g.choice([None, *range(6)]), row, seq, g.choice([None, g.randrange(9)]), g.choice([None, g.randrange(9)])) for row in range(g.randrange(9)) for seq in range(g.choice([1, 1, 2, 3]))]
        nodes = [(next(x[0] for x in nodes if x[1] == n[1]), *n[1:]) for n in nodes]
        out = turns.topological(nodes)
        assert sorted(out) == list(range(len(nodes)))
        numbers = [nodes[i][0] for i in out if nodes[i][0] is not None]
        assert numbers == sorted(numbers)
        for row in {n[1] for n in nodes}:
            assert [nodes[i][2] for i in out if nodes[i][1] == row] == sorted(n[2] for n in nodes if n[1] == row)
        free = [(None, n[1], 0, n[3], None) for n in nodes]
        cues = [free[i][3] for i in turns.topological(free) if free[i][3] is not None]
        assert len({n[1] for n in free}) < len(free) or cues == sorted(cues)


def test_precedence_refuses_circles():
    o = turns.Precedence(4)
    assert o.add(3, 0) and o.add(0, 2) and o.add(2, 1) and not o.add(1, 3) and not o.add(2, 2)
    assert o.at[3] < o.at[0] < o.at[2] < o.at[1]


SPEECH = "speech_id long, verslag_id string, volgnr int, persoon_id string, verslagnaam string, achternaam string, voornaam string, fractie string, is_voorzitter boolean, speech_start string, speech_text string, who string"


def frames(spark):
    p = spark.createDataFrame(PERSONS, "Id string, Tussenvoegsel string, Achternaam string, Roepnaam string, Voornamen string, Fractielabel string")
    m = spark.createDataFrame(MEMBERS, "Persoon_Id string, Fractie_Id string")
    f = spark.createDataFrame([(k, n, None, None) for k, n in PARTIES], "Id string, Afkorting string, NaamNL string, NaamEN string")
    return p, m, f


def row(i, nr, text, pid=None, chair=None, v="v", name=None, party=None):
    return (i, v, nr, pid, name, name, None, party, chair, None, text, "x")


def found(spark, rows):
    return sorted(tuple(r) for r in turns.found(spark.createDataFrame(rows, SPEECH), *frames(spark)).collect())


def test_turns(spark):
    rows = [
        row(1, 1, "Ik open.", " P1", True), row(2, 2, "Welkom."), row(3, 3, "[applaus]", "p2"), row(4, 4, "En verder.\nOrliepen: Dank. De voorzitter: Goed."), row(5, 5, "Door."),
        row(6, 6, "Ja.", None, None, "v", "Orliepen", "CLD"), row(6, 6, "Ja.", None, None, "v", "Orliepen", "CLD"), row(7, 1, "Los.", None), row(8, 1, "Ander verslag.", "p2", None, "w"), row(9, 2, None, "p1", None, "w"), row(10, 3, "Weer.", None, None, "w"),
    ]
    # "Orliepen:" may be two persons and nobody of that name is present: the speaker goes on
    assert found(spark, rows) == [("v", 1, "p1"), ("v", 6, "p3"), ("w", 1, "p2")]


def test_ambiguous_label_is_the_one_present(spark):
    rows = [row(1, 1, "Ik open.", "p1", True), row(2, 2, "Dit.", "p4"), row(3, 3, "De voorzitter: Ja.\nOrliepen: Nee.")]
    assert found(spark, rows) == [("v", 1, "p1"), ("v", 2, "p4"), ("v", 3, "p1"), ("v", 3, "p4")]


def test_a_turn_over_many_chunks_is_one(spark):
    rows = [row(n, n, "Woorden.", "p1" if n == 1 else None) for n in range(1, 3 * turns.CHUNK)] + [row(9000, 9000, "Slot.", "p2")]
    assert found(spark, rows) == [("v", 1, "p1"), ("v", 9000, "p2")]


def at(i, nr, start, pid, text="Woorden."):
    return (i, "v", nr, pid, None, None, None, None, None, start, text, "x")


def test_rows_without_volgnr_lie_where_their_time_says(spark):
    rows = [at(1, 1, "10:00:00", "p1"), at(2, None, "10:05:00", "p2"), at(3, 400, "10:10:00", "p3"), at(4, None, None, "p4"), at(5, None, "onleesbaar", "p4"), at(6, None, "10:20", "p5"), at(7, None, "08:00", "p2")]
    s = turns.ordered(spark.createDataFrame(rows, SPEECH), turns.people_of(*frames(spark))).orderBy("chunk", "place").collect()
    assert [r.speech_id for r in s if r.speech_id not in (4, 5)] == [7, 1, 2, 3, 6] and {r.speech_id for r in s[:3]} >= {4, 5}
    assert ("v", None, "p2") in found_any(spark, rows)


def test_the_weights_decide_what_is_found(spark):
    """Cues, starts and volgnr contradict each other; each of them, if it weighs most, makes other turns."""
    rows = [at(1, 1, "10:02:00", "p1", "[t=400s] Een."), at(2, 2, "10:01:00", "p2", "[t=500s] Twee."), at(3, 3, "10:00:00", "p1", "[t=450s] Drie.")]
    df = spark.createDataFrame(rows, SPEECH)
    by = {w: {tuple(r)[1:] for r in turns.found(df, *frames(spark), weights=w).collect()} for w in (turns.WEIGHTS, (1, 4, 2))}
    assert by[turns.WEIGHTS] == {(1, "p1"), (2, "p2"), (3, "p1")} and by[1, 4, 2] == {(1, "p1"), (2, "p2")}


def found_any(spark, rows):
    return [tuple(r) for r in turns.found(spark.createDataFrame(rows, SPEECH), *frames(spark)).collect()]


def test_empty_and_unknown(spark):
    assert found(spark, []) == []
    assert found(spark, [row(1, 1, "Wie spreekt?")]) == []


def test_clean_segments(spark):
    s = turns.ordered(spark.createDataFrame([row(1, 1, "10:00 Uhm, Ik open.", "p1", True), row(2, 2, "Vz.: Ja. [lacht]")], SPEECH), turns.people_of(*frames(spark)))
    assert [(r.volgnr, r.seq, r.who, r.body) for r in s.orderBy("chunk", "place").collect()] == [(1, 0, "p1", "Ik open."), (2, 0, "p1", "Ja.")]
