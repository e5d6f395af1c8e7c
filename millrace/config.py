"""The run configuration: typed settings, read from YAML and checked at once."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation
from pathlib import Path


class ConfigError(Exception):
    """The configuration can't be used."""


class OcrUnavailableError(Exception):
    """Images are to be read and no text recogniser is at hand."""


class OutputWriteError(Exception):
    """A result can't be written."""


@dataclass(frozen=True)
class Locale:
    date_format: str = "dd/mm/yyyy"
    decimal_separator: str = "comma"
    thousands_separator: str = "space"
    #: Whether narrow no-break spaces (U+202F) count as spaces too.
    narrow_spaces: bool = False


@dataclass(frozen=True)
class Source:
    account: str
    statement_type: str
    path_pattern: str | None = None
    column_map: dict[str, str] = field(default_factory=dict)
    locale: Locale = Locale()
    pdf_profile: str | None = None

    def column(self, name: str) -> str:
        return self.column_map.get(name, name)


@dataclass(frozen=True)
class Matching:
    date_window_days: int = 3
    amount_tolerance: Decimal = Decimal(0)
    fuzzy_vendor: bool = True


@dataclass(frozen=True)
class Archive:
    root: str = "archive"
    layout: str = "year/month"


@dataclass(frozen=True)
class Config:
    sources: tuple[Source, ...]
    matching: Matching = Matching()
    archive: Archive = Archive()
    output_dir: str | None = None
    format: str = "xlsx"


#: Settings with a closed set of values.
CHOICES = {
    "statement_type": ("csv", "pdf"), "decimal_separator": ("comma", "dot"), "thousands_separator": ("space", "dot", "comma", "none"),
    "layout": ("year/month", "flat"), "format": ("xlsx", "ods"),
}


def _chosen(name: str, value: str, where: str) -> str:
    if value not in CHOICES[name]:
        raise ConfigError(f"{where}: {name} must be one of {', '.join(CHOICES[name])}, not {value!r}")
    return value


def _part(data: dict, name: str) -> dict:
    """A nested mapping; anything else counts as absent."""
    found = data.get(name)
    return found if isinstance(found, dict) else {}


def _source(data: object, i: int) -> Source:
    where = f"sources[{i}]"
    if not isinstance(data, dict):
        raise ConfigError(f"{where} must be a mapping")
    if not data.get("account"):
        raise ConfigError(f"{where}: account is missing")
    if not data.get("statement_type"):
        raise ConfigError(f"{where}: statement_type is missing")
    place = _part(data, "locale")
    plain = Locale()
    return Source(
        str(data["account"]),
        _chosen("statement_type", str(data["statement_type"]), where),
        None if data.get("path_pattern") is None else str(data["path_pattern"]),
        {str(k): str(v) for k, v in _part(data, "column_map").items()},
        Locale(
            str(place.get("date_format", plain.date_format)),
            _chosen("decimal_separator", str(place.get("decimal_separator", plain.decimal_separator)), where),
            _chosen("thousands_separator", str(place.get("thousands_separator", plain.thousands_separator)), where),
            bool(place.get("narrow_spaces", plain.narrow_spaces)),
        ),
        None if data.get("pdf_profile") is None else str(data["pdf_profile"]),
    )


def parse_config(data: object) -> Config:
    """A checked configuration from what YAML gives."""
    if not isinstance(data, dict):
        raise ConfigError("the configuration must be a mapping")
    sources = data.get("sources")
    if not isinstance(sources, list) or not sources:
        raise ConfigError("sources must be a list that isn't empty")
    match, archive = _part(data, "matching"), _part(data, "archive")
    try:
        matching = Matching(int(match.get("date_window_days", 3)), Decimal(str(match.get("amount_tolerance", 0))), bool(match.get("fuzzy_vendor", True)))
    except (ValueError, TypeError, InvalidOperation) as e:
        raise ConfigError(f"matching: {e}") from e
    return Config(
        tuple(_source(s, i) for i, s in enumerate(sources)),
        matching,
        Archive(str(archive.get("root", "archive")), _chosen("layout", str(archive.get("layout", "year/month")), "archive")),
        None if data.get("output_dir") is None else str(data["output_dir"]),
        _chosen("format", str(data.get("format", "xlsx")), "format"),
    )


def load_config(path: str | Path) -> Config:
    """Read and check a YAML file."""
    import yaml

    try:
        text = Path(path).read_text(encoding="utf-8")
    except (OSError, UnicodeDecodeError) as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} isn't YAML: {e}") from e
    return parse_config(data)
