"""An invented snapshot of three sources (a fourth can be added) with totals worked out by hand."""

from __future__ import annotations

import csv
import hashlib
import io
from dataclasses import replace

from crashmart.contracts import (
    CRS, MISSING_CODE, Category, CountRule, Coverage, DateRule, FileSpec, LocationRule, Manifest, PersonRule, SeverityRule, Source, UnitRule,
)
from crashmart.model import RAW_SCHEMA

FERRY_CRASH = ("Event", "Harm", "In year", "In month", "North", "East", "Craft", "Dead", "Badly hurt", "Hurt", "Bruised")
FERRY_UNIT = ("Event", "Craft no", "Craft kind")
RIDGE_CRASH = ("CASE", "DAY", "SPOT", "SLEDS", "DEAD", "HURT_A", "HURT_B", "PEOPLE", "HARM")
RIDGE_UNIT = ("CASE", "SLED", "SLED_KIND")
RIDGE_PERSON = ("CASE", "PERSON", "SLED")
RIDGE_NODE = ("CASE", "SPOT", "LAT", "LON")
DELTA_CRASH = ("No", "Harm", "Yr", "Mon", "Lat", "Lon", "Died", "Ward", "Clinic", "Scratch", "All")
ATOLL_CRASH = ("ID", "Y", "M", "HARM", "DEAD", "HURT_ALL", "LAT", "LON")

# Invented for these tests. Totals by hand: 8 crashes, 3 of them fatal, 1 + 2 + 1 = 4 dead, 4 + 4 + 2 + 3 + 2 + 0 + 1 = 16 hurt or dead,
# 6 points (F-18 has no place, the two observations of R6 contradict each other), 5 + 3 = 8 units.
ROWS = {
    "ferry_crash": (FERRY_CRASH, [
        ("F-17", "K", "2022", "March", "51.4012000", "-2.5100000", "3", "1", "2", "1", "0"),
        ("F-18", "", "2023", "", "", "", "1", "", "", "", ""),
        ("F-19", "H", "2022", "November", "51.5", "-2.25", "1", "0", "0", "3", "1")]),
    "ferry_unit": (FERRY_UNIT, [("F-17", "1", "BOAT"), ("F-17", "2", "BOAT"), ("F-17", "3", "BOAT"), ("F-18", "1", "BOAT"), ("F-19", "1", "BOAT")]),
    "ridge_crash": (RIDGE_CRASH, [
        ("R5", "2021-06-30", "S9", "1", "0", "2", "0", "2", "H"), ("R6", "2024-09-02", "S4", "2", "2", "0", "1", "1", "K")]),
    "ridge_unit": (RIDGE_UNIT, [("R5", "A", "BOAT"), ("R6", "A", "BOAT"), ("R6", "B", "BOAT")]),
    "ridge_person_raw": (RIDGE_PERSON, [("R5", "P1", "A"), ("R5", "P2", "A"), ("R6", "P1", "")]),
    "ridge_node_raw": (RIDGE_NODE, [("R5", "S9", "46.25", "7.5"), ("R5", "S9", "46.2500", "7.50"),
                                    ("R6", "S4", "46.9", "7.0"), ("R6", "S4", "46.8", "7.1")]),
    "delta_crash": (DELTA_CRASH, [
        ("D-3", "H", "2021", "April", "-3.1000000", "-60.0200000", "0", "1", "1", "0", "2"),
        ("D-4", "O", "2020", "December", "-3.2500000", "-60.1000000", "0", "0", "0", "0", "0"),
        ("D-5", "K", "2024", "May", "-3.3", "-60.3", "1", "0", "0", "0", "1")]),
}
ATOLL_ROWS = {"atoll_crash": (ATOLL_CRASH, [("A1", "2023", "07", "H", "0", "2", "-17.5", "-149.5")])}

CATEGORIES = (("K", Category("K", "deadly", True, "at least one death")), ("H", Category("H", "harm", False, "hurt, nobody dead")),
              ("O", Category("O", "no harm", False, "things alone were damaged")))
MISSING = Category(MISSING_CODE, "unknown", None, "not stated")
COVER = (Coverage(2020, 2024, tuple(range(1, 13)), "made up"),)


def file_text(table: tuple) -> bytes:
    """The native file of some rows."""
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([table[0], *table[1]])
    return out.getvalue().encode()


def files(folder, rows: dict | None = None, fourth: bool = False) -> dict[str, str]:
    """Writes the native files and gives the path of each."""
    tables = {**(rows or ROWS), **(ATOLL_ROWS if fourth else {})}
    for name, table in tables.items():
        (folder / f"{name}.csv").write_bytes(file_text(table))
    return {name: f"file://{folder}/{name}.csv" for name in tables}


def spec(name: str, rows: dict, keys, parent=(), crash=()) -> FileSpec:
    source, role = name.split("_", 1)
    return FileSpec(name, source, role, rows[name][0], keys, hashlib.sha256(file_text(rows[name])).hexdigest(), raw_count=len(rows[name][1]),
                    parent_resource_id=f"{source}_crash" if parent else None, parent_fields=parent, parent_crash_fields=crash or parent)


def manifest(rows: dict | None = None, fourth: bool = False) -> Manifest:
    rows = {**(rows or ROWS), **(ATOLL_ROWS if fourth else {})}
    sev = lambda f: SeverityRule(f, "s1", CATEGORIES, MISSING)
    types = (("BOAT", "BOAT"),)
    ferry = Source("ferry", "Ferry coast", "FER", "r1", "all",
                   (spec("ferry_crash", rows, ("Event",)), spec("ferry_unit", rows, ("Event", "Craft no"), ("Event",))),
                   sev("Harm"), DateRule("month_name", "In year", "In month", r"\A[0-9]{1,4}\z"),
                   CountRule("Dead", ("Dead", "Badly hurt", "Hurt", "Bruised")),
                   LocationRule("own", "North", "East", CRS), UnitRule("Craft kind", types, "unit", declared_field="Craft"), COVER)
    ridge = Source("ridge", "Snow ridge", "RID", "r1", "all",
                   (spec("ridge_crash", rows, ("CASE",)), spec("ridge_unit", rows, ("CASE", "SLED"), ("CASE",)),
                    spec("ridge_person_raw", rows, ("CASE", "PERSON"), ("CASE",)), spec("ridge_node_raw", rows, ("CASE", "SPOT"), ("CASE",))),
                   sev("HARM"), DateRule("date", "DAY", year_min=1, year_max=9999), CountRule("DEAD", ("DEAD", "HURT_A", "HURT_B")),
                   LocationRule("observations", "LAT", "LON", CRS, observation_key=("CASE", "SPOT"), crash_key=("CASE", "SPOT")),
                   UnitRule("SLED_KIND", types, "vehicle", declared_field="SLEDS", note_field="count_eligible"), COVER,
                   persons=PersonRule("SLED", "PEOPLE"))
    delta = Source("delta", "River delta", "DEL", "r1", "all", (spec("delta_crash", rows, ("No",)),), sev("Harm"),
                   DateRule("month_name", "Yr", "Mon", year_min=1, year_max=9999),
                   CountRule("Died", ("Died", "Ward", "Clinic", "Scratch"), "declared_with_parts", "All"),
                   LocationRule("own", "Lat", "Lon", CRS, "definition_unconfirmed"), None, COVER)
    sources = (ferry, ridge, delta)
    if fourth:
        sources += (Source("atoll", "Ring atoll", "ATO", "r1", "all", (spec("atoll_crash", rows, ("ID",)),), sev("HARM"),
                           DateRule("month_number", "Y", "M", month_required=True),
                           CountRule("DEAD", (), "declared", "HURT_ALL", fatality_within_total=True), LocationRule("own", "LAT", "LON", CRS), None, COVER),)
    return Manifest("synthetic", 2020, 2024, sources).validate()


def raw(spark, rows: dict | None = None, fourth: bool = False):
    rows = {**(rows or ROWS), **(ATOLL_ROWS if fourth else {})}
    out = []
    for s in manifest(rows, fourth).sources:
        for f in s.files:
            header, values = rows[f.resource_id]
            for i, v in enumerate(values, 1):
                out.append((f"{f.resource_id}-{i}", s.source_id, f.resource_id, f.file_sha256, f.parser_version, f"csv:{i}", dict(zip(header, v))))
    return spark.createDataFrame(out, RAW_SCHEMA)


def edit(name: str, row: int, **changes) -> dict:
    """ROWS with some cells of one row changed."""
    header, values = ROWS[name]
    cells = dict(zip(header, values[row]))
    for k, v in changes.items():
        match = [h for h in header if h.replace(" ", "_").replace(".", "") == k]
        assert len(match) == 1, k
        cells[match[0]] = v
    new = list(values)
    new[row] = tuple(cells[h] for h in header)
    return {**ROWS, name: (header, new)}


def add(name: str, row: tuple) -> dict:
    header, values = ROWS[name]
    return {**ROWS, name: (header, [*values, row])}


def without_crs(m: Manifest, source_id: str) -> Manifest:
    return replace(m, sources=tuple(replace(s, location=replace(s.location, crs=None)) if s.source_id == source_id else s for s in m.sources))
