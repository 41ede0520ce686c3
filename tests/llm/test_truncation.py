import html
import json
import random

import pytest
from pyspark.sql import functions as F

from plenaria.llm import truncation

COMPLETE = [
    "Dit is klaar.", "Echt waar?", "Ja!", "'Dat was het, voorzitter.'", "Tekst.\nHoogachtend,\nVan der Tjaarakkerse", "Tekst.\nDe griffier,\nDrongelslagter", "Tekst.\nMet groet,\nVan\nder Hool", "Tekst.\n---",
    "Voor: DKA, Groep Zwalmer\nTegen: Lid Mosterkamp", "Ja: vDH, " + ", ".join(f"Groep Naam{n}" for n in range(80)) + "\nNee: A/B", "Klaar. 🙏", "Klaar.  \n ", "Klaar ½.", "Klaar. Kenmerk 1291913167085806296.", "Alles (ook dit).",
]
OPEN = ["De vraag is simpel: k", "Volgens art.", "Op blz.", "binne�", "verplicht.�", "pleit voor&eum", "oo &am", "de pens <br", "dat ko \\u00", "Tekst. De heer of mevrouw", "noemde dat 'onwerkbaar en onnodig'", "x", "Hoogachtend,", "Voor: DKA, Groep", "Tekst.\nSluiting 22.30 uur"]
NOTED = ["achtte de (lees verder)", "voor de jeugd te [meer]"]
DOTS = ["sprak eerder van…", "is geen detail..."]
BLANK = [None, "", "  \n\t", " "]


def test_endings(spark):
    want = {t: k for k, ts in {"complete": COMPLETE, "open": OPEN, "noted": NOTED, "dots": DOTS, None: BLANK}.items() for t in ts}
    df = spark.createDataFrame([(t,) for t in want], "t string").withColumn("e", truncation.ending(truncation.tail(F.col("t"))))
    assert {r.t: r.e for r in df.collect()} == want


# wordings that occur nowhere else: none of them is listed in the operator
CLOSINGS = ["Dossier gesloten door {name}", "Blad {n} van 9", "(get.) {name}", "Aldus vastgesteld", "Wordt later voortgezet...", "Vergaderd tot {n}:15 u", "Afschrift aan: {name}, {name}"]
FORM = "Geachte heer,\nHierbij ontvangt u de stukken.\nVoor het vervolg verwijst de minister naar de"


def held_out(n=2000):
    g = random.Random(8)
    name = lambda: g.choice(["Van der ", "De ", ""]) + g.choice(["Tol", "Wind", "Maas"]) + g.choice(["akker", "hoven", "stra"])
    word = lambda: "".join(g.choice("aeioubdgklmnrst") for _ in range(g.randrange(3, 11)))
    rows, cut = [], set()
    for i in range(n):
        t = " ".join("De " + " ".join(word() for _ in range(g.randrange(4, 12))) + "." for _ in range(g.randrange(1, 9)))
        source, body = g.choice(["veld", "bode", "bode"]), len(t)
        if g.random() < 0.3:
            t += "\n" + g.choice(CLOSINGS).format(name=name(), n=g.randrange(1, 99))
        if source == "veld" and body > 240:  # a cut within a closing that ends in a name or figure cannot be told from the whole
            t, _ = t[:240], cut.add(i)
            if t.endswith("."):
                cut.discard(i)
        elif source == "bode" and g.random() < 0.1:
            t, _ = t[: g.randrange(5, len(t) // 2 + 6)].rstrip(" .\n"), cut.add(i)
        rows.append((i, t, source))
    return rows, cut


def test_closings_are_learnt_from_texts_below_limits(spark):
    rows, cut = held_out()
    got = {r.doc_id for r in truncation.found(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got & cut) / len(cut) >= 0.99 and len(got & cut) / len(got) >= 0.99


def test_limits_decide_what_is_a_closing(spark):
    """Form letters that a field cuts at one place all end alike. Only the limit tells that from a closing."""
    rows, cut = held_out()
    letters = [(10_000 + i, FORM, "brief") for i in range(60)] + [(20_000 + i, f"Kort bericht {i} van " + "x" * i + ".", "brief") for i in range(60)]
    df = spark.createDataFrame(rows + letters, "doc_id long, text string, source string")
    got = {r.doc_id for r in truncation.found(df).collect()}
    assert {i for i, _, _ in letters[:60]} <= got and not got & {i for i, _, _ in letters[60:]}
    off = truncation.detect(df, "text", "source", least=10**9).where("cut")
    assert not {r.doc_id for r in off.collect()} & {i for i, _, _ in letters}


def test_histogram_buckets_do_not_change_limits(spark, monkeypatch):
    df, _ = corpus(spark)
    m = truncation.measured(df, "text", "source", [])
    rows = lambda: sorted(map(tuple, truncation.limits(m, "__source").collect()), key=str)
    whole = rows()
    monkeypatch.setattr(truncation, "BUCKET", 40)
    assert rows() == whole and whole


def test_very_long(spark):
    texts = ["woord " * 50_000, "klaar. " * 50_000, "a." + " " * 5_000, " " * 100_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.e for r in df.select("i", truncation.ending(truncation.tail(F.col("t"))).alias("e")).orderBy("i").collect()] == ["open", "complete", "complete", None]


def test_lengths_against_real_encoders(spark):
    texts = ["gewoon", 'é<b>&"\'\n\\', "🙏🏽\n\n½", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", *[c.alias(m) for m, c in truncation.lengths(F.col("t")).items()]).collect():
        t = r.t
        assert r.characters == len(t) and r.utf8 == len(t.encode()) and r.utf16 == len(t.encode("utf-16-le")) // 2
        assert r.characters_crlf == len(t.replace("\n", "\r\n")) and r.utf8_crlf == len(t.replace("\n", "\r\n").encode())
        assert r.characters_entities == len(html.escape(t, quote=False)) and r.utf8_entities_quotes == len(html.escape(t).encode())
        assert r.characters_json == len(json.dumps(t, ensure_ascii=False)) - 2 and r.ascii_json == len(json.dumps(t)) - 2


def corpus(spark):
    g = random.Random(5)
    sentence = lambda: "De commissie behandelt é" + "a" * g.randrange(3, 40) + " op de dag. "
    rows, cut = [], set()
    for n in range(600):
        t = "".join(sentence() for _ in range(g.randrange(1, 12))).strip()
        source = "kort" if n % 2 else "lang"
        if source == "kort" and len(t.encode()) > 200:
            t = t.encode()[:200].decode("utf8", "ignore")
        elif source == "lang" and n % 10 == 0:
            t = t[: len(t) // 2].rstrip(" .")
        if not t.rstrip().endswith("."):
            cut.add(n)
        rows.append((n, t, source, "x"))
    rows += [(900, None, "kort", "x"), (901, "", None, "x"), (902, "Klaar.", None, "x"), (902, "Klaar.", None, "x"), (903, "Nie", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, cut string"), cut | {903}


def test_found_limits_and_rates(spark):
    df, cut = corpus(spark)
    assert {r.doc_id for r in truncation.found(df).collect()} == cut
    found = {(r.source, r.measure, r.length) for r in truncation.limits(truncation.measured(df, "text", "source", []), "__source").collect()}
    assert ("kort", "utf8", 200) in found and not [f for f in found if f[0] == "lang" and f[2] > 60 and f[1] == "utf8"]
    rates = {r.source: r for r in truncation.rates(df).collect()}
    assert rates["kort"].op_veldgrens > 50 and rates["lang"].op_veldgrens == 0 and rates["lang"].in_overdracht > 20
    assert rates[None].teksten == 3 and rates[None].afgekapt == 1
    assert truncation.found(df.limit(0)).count() == 0 and truncation.rates(df.limit(0)).count() == 0


@pytest.mark.parametrize("extra", ["ending", "at_limit", "cut"])
def test_clashing_columns_are_replaced(spark, extra):
    df = spark.createDataFrame([("Klaar.", "s", 1)], f"text string, source string, {extra} int")
    assert truncation.detect(df, "text", "source").columns == ["text", "source", "ending", "at_limit", "cut"]
