"""Transcript XML to one row for each speech, many files at once."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fields of a row, in order.
SCHEMA = (
    "verslag_id string, volgnr int, vergadering_id string, vergadering_soort string, vergadering_titel string, vergaderjaar string, datum string, "
    "activiteit_id string, activiteit_soort string, activiteit_onderwerp string, activiteithoofd_id string, activiteithoofd_onderwerp string, "
    "zaak_ids string, zaak_soorten string, persoon_id string, spreker_soort string, fractie string, achternaam string, voornaam string, "
    "verslagnaam string, functie string, is_voorzitter boolean, is_interruptie boolean, speech_text string, speech_start string, speech_end string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Shorter texts are noise.
LEAST = 11


class Node:
    """An element seen without its namespace."""

    def __init__(self, e: ET.Element):
        self.e = e

    def _is(self, e: ET.Element, tag: str) -> bool:
        return isinstance(e.tag, str) and e.tag.rpartition("}")[2] == tag

    def kids(self, tag: str) -> Iterator[Node]:
        return (Node(c) for c in self.e if self._is(c, tag))

    def deep(self, tag: str) -> Iterator[Node]:
        return (Node(c) for c in self.e.iter() if c is not self.e and self._is(c, tag))

    def kid(self, tag: str) -> Node | None:
        return next(self.kids(tag), None)

    def attr(self, name: str) -> str | None:
        return self.e.get(name)

    def value(self, tag: str) -> str | None:
        k = self.kid(tag)
        return k.e.text.strip() if k is not None and k.e.text else None

    def text(self) -> str:
        """Paragraphs (alinea) on lines of their own, each collapsed; without any, all the text.

        The text after an inline element follows the element's own text, as in the document.
        """
        paragraphs = [" ".join("".join(f" {t} " for t in p.e.itertext()).split()) for p in self.deep("alinea")]
        if not paragraphs:
            return " ".join("".join(self.e.itertext()).split())
        return "\n".join(p for p in paragraphs if p)


def speaker(e: Node | None) -> dict:
    if e is None:
        return {}
    own = {"persoon_id": e.attr("objectid"), "spreker_soort": e.attr("soort")}
    return own | {t: e.value(t) for t in ("fractie", "achternaam", "voornaam", "verslagnaam", "functie")}


def is_true(e: Node, tag: str) -> bool:
    return (e.value(tag) or "").lower() == "true"


def speeches(xml: str | bytes, verslag_id: str) -> list[dict]:
    """Rows of one transcript in document order; a malformed one, or one without meeting, has none."""
    try:
        root = Node(ET.fromstring(xml))
    except ET.ParseError:
        return []
    meeting = root.kid("vergadering")
    if meeting is None:
        return []
    rows: list[dict] = []
    base = {"verslag_id": verslag_id, "vergadering_id": meeting.attr("objectid"), "vergadering_soort": meeting.attr("soort")}
    base |= {"vergadering_titel": meeting.value("titel"), "vergaderjaar": meeting.value("vergaderjaar"), "datum": meeting.value("datum")}

    def add(context: dict, who: dict, said: Node, interruption: bool) -> None:
        body = said.kid("tekst")
        text = body.text().strip() if body is not None else ""
        if len(text) >= LEAST:
            flags = {"is_voorzitter": is_true(said, "isvoorzitter"), "is_interruptie": interruption, "speech_text": text}
            rows.append(context | who | flags | {"volgnr": len(rows) + 1})

    for act in meeting.kids("activiteit"):
        a = base | {"activiteit_id": act.attr("objectid"), "activiteit_soort": act.attr("soort"), "activiteit_onderwerp": act.value("onderwerp")}
        for head in act.kids("activiteithoofd"):
            cases = [z for zs in head.kids("zaken") for z in zs.kids("zaak")]
            joined = {f: ";".join(v for z in cases if (v := z.attr(x))) or None for f, x in (("zaak_ids", "objectid"), ("zaak_soorten", "soort"))}
            h = a | {"activiteithoofd_id": head.attr("objectid"), "activiteithoofd_onderwerp": head.value("onderwerp")} | joined
            for part in head.deep("activiteitdeel"):
                if part.attr("soort") != "Spreekbeurt":
                    continue
                c = h | {"speech_start": part.value("markeertijdbegin"), "speech_end": part.value("markeertijdeind")}
                own = speaker(part.kid("spreker"))
                for item in part.deep("activiteititem"):
                    for said in item.kids("woordvoerder"):
                        who = said.kid("spreker")
                        add(c, speaker(who) if who is not None else own, said, False)
                        for cut_in in said.kids("interrumpant"):
                            add(c, speaker(cut_in.kid("spreker")), cut_in, True)
    return rows


def parse(files: DataFrame) -> DataFrame:
    """Rows of files read with ``binaryFile`` (path, content), parsed where they lie."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            rows = [r for path, content in zip(d["path"], d["content"]) for r in speeches(bytes(content), PurePosixPath(re.sub(r"^\w+:", "", path)).stem)]
            yield pd.DataFrame([[r.get(c) for c in COLUMNS] for r in rows], columns=COLUMNS, dtype=object)

    return files.select("path", "content").mapInPandas(of, SCHEMA)


def failures(files: DataFrame) -> DataFrame:
    """(path, reason) of the files that are no well-formed document; ``parse`` gives no rows for them."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in parts:
            bad = []
            for path, content in zip(d["path"], d["content"]):
                try:
                    ET.fromstring(bytes(content))
                except ET.ParseError as e:
                    bad.append((path, str(e)))
            yield pd.DataFrame(bad, columns=["path", "reason"], dtype=object)

    return files.select("path", "content").mapInPandas(of, "path string, reason string")


def documents(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(path, content) of every ``*.xml`` under ``folder``, or of the first ``limit`` by path; the paths are ranked without reading the files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder).select("path", "content")
    return found if limit is None else found.join(found.select("path").orderBy("path").limit(limit), "path", "left_semi")


def read(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Speeches of the transcripts under ``folder``. Malformed files give none; ``failures(documents(...))`` names them."""
    return parse(documents(spark, folder, limit))
