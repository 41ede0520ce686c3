"""Registry of the entities and their types."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

# The entities of the public records, by group.
ENTITIES = {
    "personen": "Persoon PersoonContactinformatie PersoonGeschenk PersoonLoopbaan PersoonNevenfunctie PersoonNevenfunctieInkomsten PersoonOnderwijs PersoonReis",
    "fracties": "Fractie FractieAanvullendGegeven FractieZetel FractieZetelPersoon FractieZetelVacature",
    "commissies": "Commissie CommissieContactinformatie CommissieZetel CommissieZetelVastPersoon CommissieZetelVastVacature CommissieZetelVervangerPersoon CommissieZetelVervangerVacature",
    "activiteiten": "Activiteit ActiviteitActor Agendapunt Reservering",
    "documenten": "Document DocumentActor DocumentVersie DocumentPublicatie DocumentPublicatieMetadata Kamerstukdossier",
    "besluiten": "Besluit Stemming Zaak ZaakActor",
    "vergaderingen": "Vergadering Verslag Toezegging Zaal",
}


@dataclass(frozen=True)
class Entity:
    name: str
    group: str
    enabled: bool = True


def entities(disabled: frozenset[str] = frozenset()) -> list[Entity]:
    return [Entity(n, g, n not in disabled) for g, names in ENTITIES.items() for n in names.split()]


def select(names: list[str] | None, known: list[Entity] | None = None) -> tuple[list[Entity], list[str]]:
    """The enabled entities, or those named (enabled or not), and the names that are unknown."""
    known = known or entities()
    if not names:
        return [e for e in known if e.enabled], []
    by = {e.name: e for e in known}
    return [by[n] for n in names if n in by], [n for n in names if n not in by]


def load_config(path: str) -> dict:
    """Settings of a run from a YAML or JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need the yaml package; JSON ones do not") from e
    return yaml.safe_load(text)


def column_type(name: str) -> DataType:
    """Type of a column by its name, as all entities follow one naming."""
    if name in {"AantalZetels", "FractieGrootte", "Volgorde", "HoogsteVolgnummer", "VergaderingNummer", "Gewicht", "Jaar", "Versienummer"}:
        return IntegerType()
    if name in {"AantalStemmen", "ContentLength", "Bestandsgrootte", "Bedrag"}:
        return LongType()
    if name in {"Vergissing", "Verwijderd", "Afgesloten", "IsActief"}:
        return BooleanType()
    if name.endswith("Op") and name.startswith(("Gewijzigd", "ApiGewijzigd")) or name in {"DatumActief", "DatumInactief", "Geboortedatum"}:
        return TimestampType()
    return StringType()


def schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, column_type(c)) for c in columns])


def register(spark: SparkSession, root: str) -> list[str]:
    """Every Parquet table under ``root``, on any file system, as a temporary view, for SQL; gives their names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = [f.getPath() for f in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)]
    tables = sorted((p.getName().removesuffix(".parquet"), p.toString()) for p in found if p.getName().endswith(".parquet"))
    for name, path in tables:
        spark.read.parquet(path).createOrReplaceTempView(name)
    return [name for name, _ in tables]


def listing(spark: SparkSession) -> DataFrame:
    """The registry as a table (name, groep, aan)."""
    return spark.createDataFrame([(e.name, e.group, e.enabled) for e in entities()], "naam string, groep string, aan boolean")
