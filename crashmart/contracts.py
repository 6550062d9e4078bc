"""Declared rules: what each source publishes and how its text becomes typed rows.

Contracts are small driver-side values (sources, files, categories). Anything that grows with the data is a DataFrame.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

from .errors import ContractError

MISSING_CODE = "__MISSING__"
# Fixed values.
KINDS = ("official", "synthetic")
ROLES = ("crash", "unit", "person_raw", "node_raw")
CRS = "EPSG:4326"


@dataclass(frozen=True)
class FileSpec:
    """One native file set of one role, identified by (source, resource, hash, parser)."""

    resource_id: str
    source_id: str
    role: str
    header: tuple[str, ...]
    key_fields: tuple[str, ...]
    file_sha256: str
    parser_version: str = "csv-native-v1"
    raw_count: int | None = None
    parent_resource_id: str | None = None
    parent_fields: tuple[str, ...] = ()
    parent_crash_fields: tuple[str, ...] = ()
    multi_line: bool = False


@dataclass(frozen=True)
class Category:
    code: str
    label: str
    fatal: bool | None
    text: str


@dataclass(frozen=True)
class SeverityRule:
    field: str
    version: str
    categories: tuple[tuple[str, Category], ...]
    missing: Category
    # Set only where the source declares what an absent token means.
    missing_override: Category | None = None
    missing_reason: str = "declared meaning of an absent token"

    def definitions(self) -> list[Category]:
        found = {c.code: c for _, c in self.categories}
        found[self.missing.code] = self.missing
        return [found[k] for k in sorted(found)]


@dataclass(frozen=True)
class DateRule:
    """style: date (YYYY-MM-DD) | month_name | month_number."""

    style: str
    year_field: str
    month_field: str | None = None
    year_pattern: str = r"\A[0-9]{4}\z"
    year_min: int = 1900
    year_max: int = 2100
    month_required: bool = False


@dataclass(frozen=True)
class CountRule:
    """total: sum (all parts known) | declared | declared_with_parts (declared, known only if all parts are)."""

    fatality_field: str
    part_fields: tuple[str, ...] = ()
    total: str = "sum"
    total_field: str | None = None
    fatality_within_total: bool = False


@dataclass(frozen=True)
class LocationRule:
    """style: own (fields of the crash row) | observations (separate file) | none."""

    style: str
    latitude_field: str = ""
    longitude_field: str = ""
    crs: str | None = None
    unconfirmed_reason: str = "crs_unconfirmed"
    evidence_ref: str = "contract"
    observation_key: tuple[str, str] = ("", "")
    crash_key: tuple[str, str] = ("", "")


@dataclass(frozen=True)
class UnitRule:
    type_field: str
    types: tuple[tuple[str, str], ...]
    statistical_scope: str
    restricted: bool = False
    declared_field: str | None = None
    note_field: str = "unit_type_code"


@dataclass(frozen=True)
class PersonRule:
    """Secondary children that may name a unit of the same crash. blank_reference: allowed | forbidden | unresolved."""

    reference_field: str
    declared_field: str
    blank_reference: str = "allowed"
    count_scope_confirmed: bool = True


@dataclass(frozen=True)
class Coverage:
    year_from: int
    year_to: int
    months: tuple[int, ...]
    basis: str


@dataclass(frozen=True)
class Source:
    source_id: str
    source_name: str
    jurisdiction_code: str
    release_label: str
    release_scope: str
    files: tuple[FileSpec, ...]
    severity: SeverityRule
    dates: DateRule
    counts: CountRule
    location: LocationRule
    units: UnitRule | None = None
    coverage: tuple[Coverage, ...] = ()
    empty_is_missing: bool = True
    contract_version: str = "v1"
    restricted: bool = False
    confirmed: bool = True
    unavailable: tuple[tuple[str, str], ...] = ()
    persons: PersonRule | None = None

    def file(self, role: str) -> FileSpec:
        found = [f for f in self.files if f.role == role]
        if len(found) != 1:
            raise ContractError("FILE_ROLE", "exactly one file of this role is needed", source_id=self.source_id,
                                role=role, found=len(found))
        return found[0]

    def has(self, role: str) -> bool:
        return any(f.role == role for f in self.files)


@dataclass(frozen=True)
class Manifest:
    dataset_kind: str
    year_from: int
    year_to: int
    sources: tuple[Source, ...]
    producer_version: str = "v1"
    provenance: dict = field(default_factory=dict)

    def validate(self) -> Manifest:
        if self.dataset_kind not in KINDS:
            raise ContractError("DATASET_KIND", "unknown kind", kind=self.dataset_kind)
        if not 1 <= self.year_from <= self.year_to <= 9999:
            raise ContractError("ANALYSIS_RANGE", "invalid year interval", year_from=self.year_from, year_to=self.year_to)
        ids = [s.source_id for s in self.sources]
        places = [s.jurisdiction_code for s in self.sources]
        if not ids or len(set(ids)) != len(ids):
            raise ContractError("SOURCE_DUPLICATE", "sources must be present and unique", sources=ids)
        if len(set(places)) != len(places):
            raise ContractError("JURISDICTION_REPEATED", "one source per jurisdiction", jurisdictions=places)
        resources = [f.resource_id for f in self.files()]
        if len(set(resources)) != len(resources):
            raise ContractError("RESOURCE_DUPLICATE", "resource ids must be unique", resources=resources)
        for s in self.sources:
            if not all(t.strip() for t in (s.source_id, s.source_name, s.jurisdiction_code, s.release_label, s.release_scope)):
                raise ContractError("SOURCE_TEXT", "labels must not be blank", source_id=s.source_id)
            if s.severity.missing.code != MISSING_CODE:
                raise ContractError("MISSING_CATEGORY", "every source defines the missing category", source_id=s.source_id)
            for f in s.files:
                if f.source_id != s.source_id or f.role not in ROLES:
                    raise ContractError("FILE_OWNER", "file does not belong to its source", resource_id=f.resource_id)
            s.file("crash")
        return self

    def files(self) -> list[FileSpec]:
        return [f for s in self.sources for f in s.files]

    def source(self, source_id: str) -> Source:
        for s in self.sources:
            if s.source_id == source_id:
                return s
        raise ContractError("SOURCE", "source is not enabled for this batch", source_id=source_id)

    def with_counts(self, counts: dict[str, int]) -> Manifest:
        """The manifest with observed row counts frozen per resource."""
        return replace(self, sources=tuple(
            replace(s, files=tuple(replace(f, raw_count=counts.get(f.resource_id, f.raw_count)) for f in s.files))
            for s in self.sources))

    def to_json(self) -> str:
        """Normalised text: sorted keys, no provenance."""
        value = asdict(self)
        value.pop("provenance")
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))

    def fingerprint(self) -> str:
        return hashlib.sha256(self.to_json().encode("utf-8")).hexdigest()
