import io
import json
import sqlite3
import urllib.error

import pytest
from pyspark.sql.types import StructType

from plenaria import catalog
from plenaria.sources import files, odata, transcripts

NS = 'xmlns="http://example.org/verslag"'
XML = f"""<v {NS}><vergadering objectid="m1" soort="Plenair"><titel> Titel </titel><vergaderjaar>2021-2022</vergaderjaar><datum>2022-01-01</datum>
<activiteit objectid="a1" soort="Debat"><onderwerp>Water</onderwerp><activiteithoofd objectid="h1"><onderwerp>Schoon</onderwerp>
<zaken><zaak objectid="z1" soort="Motie"/><zaak objectid="z2"/></zaken>
<activiteitdeel soort="Spreekbeurt"><spreker objectid="p0"><fractie>A</fractie></spreker><markeertijdbegin>10:00</markeertijdbegin>
<activiteititem><woordvoerder><spreker objectid="p1" soort="Lid"><fractie> B </fractie><achternaam>Jansen</achternaam></spreker><isvoorzitter>TRUE</isvoorzitter>
<tekst><alinea>Een <nadruk>heel</nadruk> mooi   verhaal</alinea><alinea/><alinea>over water</alinea></tekst>
<interrumpant><isvoorzitter/><tekst><alinea>Dat klopt niet helemaal</alinea></tekst></interrumpant></woordvoerder></activiteititem>
<activiteititem><woordvoerder><tekst><alinea>Zonder eigen spreker</alinea></tekst></woordvoerder><woordvoerder><tekst><alinea>te kort</alinea></tekst></woordvoerder></activiteititem>
</activiteitdeel><activiteitdeel soort="Opening"><activiteititem><woordvoerder><tekst><alinea>Dit telt niet mee hoor</alinea></tekst></woordvoerder></activiteititem></activiteitdeel>
</activiteithoofd></activiteit></vergadering></v>"""


def test_transcript():
    a, b, c = transcripts.speeches(XML, "v1")
    assert (a["persoon_id"], a["fractie"], a["achternaam"], a["is_voorzitter"], a["speech_text"]) == ("p1", "B", "Jansen", True, "Een heel mooi verhaal\nover water")
    assert (a["zaak_ids"], a["zaak_soorten"], a["activiteit_onderwerp"], a["activiteithoofd_id"], a["speech_start"], a["speech_end"]) == ("z1;z2", "Motie", "Water", "h1", "10:00", None)
    assert (b.get("persoon_id"), b["is_interruptie"], b["is_voorzitter"], b["speech_text"]) == (None, True, False, "Dat klopt niet helemaal")
    assert (c["persoon_id"], c["fractie"], c["volgnr"]) == ("p0", "A", 3)


def test_transcripts_that_have_none():
    assert transcripts.speeches("<kapot>", "v") == [] and transcripts.speeches("<v/>", "v") == [] and transcripts.speeches("", "v") == []


def test_many_files(spark, tmp_path):
    (tmp_path / "een.xml").write_text(XML)
    (tmp_path / "twee.xml").write_text(XML.replace(NS, ""))
    (tmp_path / "kapot.xml").write_text("<v>")
    (tmp_path / "ander.txt").write_text(XML)
    got = transcripts.read(spark, str(tmp_path))
    assert got.columns == transcripts.COLUMNS
    assert sorted((r.verslag_id, r.volgnr) for r in got.collect()) == [(v, n) for v in ("een", "twee") for n in (1, 2, 3)]


def test_json_parquet_csv(spark, tmp_path):
    raw = tmp_path / "Fractie.json"
    raw.write_text(json.dumps([{"Id": "a", "AantalZetels": 3, "GewijzigdOp": None}, {"Id": "b", "AantalZetels": None}], indent=2))
    df = files.read_raw(spark, str(raw), catalog.schema(["Id", "AantalZetels", "GewijzigdOp"]))
    assert sorted(tuple(r) for r in df.collect()) == [("a", 3, None), ("b", None, None)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_raw(spark, str(tmp_path / "weg.json")).count()
    raw.write_text("[]")
    assert files.read_raw(spark, str(raw), catalog.schema(["Id"])).count() == 0
    p = files.save(df.limit(0).unionByName(spark.createDataFrame([("x", 1, None)], df.schema)), str(tmp_path / "p"))
    assert files.read_table(spark, p).count() == 1
    assert files.read_table(spark, str(tmp_path / "weg"), StructType.fromDDL("a int")).columns == ["a"]
    c = files.save(spark.range(3), str(tmp_path / "c"), "csv")
    assert sorted(r.id for r in files.read_csv(spark, c).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        files.save(df, str(tmp_path / "x"), "xlsx")
    files.write_raw(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_export_metrics_and_stages(spark, tmp_path):
    assert files.read_csv(spark, files.export_csv(spark.range(50), str(tmp_path / "e"), 10)).count() == 10
    assert files.read_csv(spark, files.export_csv(spark.range(50), str(tmp_path / "f"), None)).count() == 50
    for k in (1, 2):
        files.append_metrics(spark, str(tmp_path / "m"), {"run": k})
    assert files.read_csv(spark, str(tmp_path / "m")).count() == 2
    made = []
    for _ in range(2):
        got = files.staged(spark, str(tmp_path / "s"), lambda: made.append(1) or spark.range(4))
    assert got.count() == 4 and made == [1]
    assert str(files.each(["a", "b"], lambda n: 1 / (n == "a"))["b"]) == "division by zero"


def test_sqlite(spark, tmp_path):
    db = str(tmp_path / "x.sqlite")
    for _ in range(2):
        assert files.export_sqlite({"t": spark.sql("select 1 a, 'x' b, current_date() c, cast(null as int) d"), "_s": spark.range(1)}, db) == ["t"]
    with sqlite3.connect(db) as c:
        assert c.execute("select a, b, d from t").fetchall() == [(1, "x", None)]


class Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *a):
        return False


def test_retries():
    waits, calls = [], []

    def opener(url, timeout):
        calls.append(url)
        code = {1: 429, 2: 503}.get(len(calls))
        if code:
            raise urllib.error.HTTPError(url, code, "", {}, None)
        if len(calls) == 3:
            raise urllib.error.URLError("weg")
        return Answer(b'{"value": []}')

    assert odata.get("u", sleep=waits.append, opener=opener) == {"value": []} and waits == [4.0, 4.0, 8.0]

    def never(url, timeout):
        raise urllib.error.HTTPError(url, 404, "", {}, None)

    with pytest.raises(urllib.error.HTTPError):
        odata.get("u", sleep=waits.append, opener=never)

    def busy(url, timeout):
        raise urllib.error.HTTPError(url, 500, "", {}, None)

    with pytest.raises(odata.TooManyFailures):
        odata.get("u", sleep=lambda s: None, opener=busy)


def test_pages_and_count():
    book = {odata.first_page("b", "Zaak"): {"value": [{"Id": 1}, {"Id": 2}], "@odata.nextLink": "n"}, "n": {"value": [{"Id": 3}]}, "b/Zaak?$top=0&$count=true": {"@odata.count": 3}}
    go = lambda **k: [r["Id"] for r in odata.pages("b", "Zaak", fetch=book.__getitem__, sleep=lambda s: None, **k)]
    assert go() == [1, 2, 3] and go(limit=2) == [1, 2]
    assert odata.count("b", "Zaak", book.__getitem__) == 3 and odata.count("b", "Weg", book.__getitem__) is None


def test_source_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class H(BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.strip("/").partition("?")[0]
            more = {} if "page2" in self.path else {"@odata.nextLink": f"http://127.0.0.1:{server.server_port}/{name}?page2"}
            body = json.dumps({"value": [{"Id": f"{name}{'2' if 'page2' in self.path else '1'}", "N": 5}]} | more).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(odata.ODataSource)
    df = spark.read.format("odata").schema("Id string, N string, Weg string").option("url", f"http://127.0.0.1:{server.server_port}").option("entity", "Zaak,Besluit").option("pause", "0").load()
    assert sorted(tuple(r) for r in df.collect()) == [(f"{n}{k}", "5", None) for n in ("Besluit", "Zaak") for k in (1, 2)]
    server.shutdown()


def test_catalog(spark, data):
    assert len(catalog.entities()) == 38
    chosen, unknown = catalog.select(["Zaak", "Vreemd"])
    assert [e.name for e in chosen] == ["Zaak"] and unknown == ["Vreemd"]
    assert catalog.select(None, catalog.entities(frozenset({"Zaal"})))[0][-1].name == "Toezegging"
    assert "zaak" in catalog.register(spark, data) and spark.sql("select count(*) from zaak").first()[0] > 0
    assert catalog.listing(spark).count() == 38


def test_export_of_named_tables(spark, tmp_path):
    tables = {"Zaak": spark.range(5), "Persoon": spark.range(7), "_summary": spark.range(1)}
    assert set(files.export_tables(tables, str(tmp_path / "a"))) == {"Zaak", "Persoon"}
    got = files.export_tables(tables, str(tmp_path / "b"), ["Persoon", "Weg"], 3)
    assert list(got) == ["Persoon"] and files.read_csv(spark, got["Persoon"]).count() == 3
    with pytest.raises(ValueError):
        files.export_tables(tables, str(tmp_path / "c"), ["Weg"])


def test_sizes_and_views_through_the_file_system(spark, tmp_path):
    from plenaria import catalog

    spark.range(100_000).write.parquet(str(tmp_path / "Getal.parquet"))
    assert files.size_mb(f"file://{tmp_path}/Getal.parquet") > 0 and files.size_mb(str(tmp_path / "weg")) == 0.0
    assert catalog.register(spark, f"file://{tmp_path}") == ["Getal"] and spark.sql("select count(*) n from Getal").first().n == 100_000


def test_malformed_transcripts_are_named_and_files_limited(spark, tmp_path):
    for name, text in (("a", "<v><vergadering"), ("b", "<v/>"), ("c", "geen xml")):
        (tmp_path / f"{name}.xml").write_text(text)
    bad = transcripts.failures(transcripts.documents(spark, str(tmp_path))).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in bad) == ["a.xml", "c.xml"] and all(r.reason for r in bad)
    assert [r.path.rsplit("/", 1)[1] for r in transcripts.documents(spark, str(tmp_path), 2).orderBy("path").collect()] == ["a.xml", "b.xml"]
    assert transcripts.read(spark, str(tmp_path), 2).count() == 0
