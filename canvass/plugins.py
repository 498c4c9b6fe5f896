"""Parsers, backends and reports by group and name; installed packages add theirs by entry points."""

from __future__ import annotations

from importlib.metadata import entry_points

from .errors import DuplicatePluginError, PluginNotFoundError
from .plans.codebook_yaml import YamlMetadataParser
from .sources.reports import CsvReport, ExcelReport, HtmlReport, JsonReport
from .sources.sav import SavMetadataParser
from .sources.tables import load_file

BACKENDS, PARSERS, REPORTS = "canvass.data_backends", "canvass.metadata_parsers", "canvass.report_generators"

_KNOWN: dict[str, dict[str, object]] = {
    BACKENDS: {"spark": load_file},
    PARSERS: {"yaml": YamlMetadataParser(), "sav": SavMetadataParser()},
    REPORTS: {"json": JsonReport(), "csv": CsvReport(), "html": HtmlReport(), "excel": ExcelReport()},
}


def available(group: str) -> list[str]:
    return sorted(_KNOWN.get(group, ()))


def plugin(group: str, name: str):
    """The plugin; a mistake in the name is answered with the names there are."""
    try:
        return _KNOWN[group][name]
    except KeyError:
        raise PluginNotFoundError(f"no {name!r} in {group}, only {', '.join(available(group)) or 'nothing'}") from None


def add_plugin(group: str, name: str, value: object, replace: bool = False) -> None:
    names = _KNOWN.setdefault(group, {})
    if not replace and name in names:
        raise DuplicatePluginError(f"{name!r} is taken in {group}")
    names[name] = value


def add_installed(group: str) -> list[str]:
    """Loads what installed packages offer in the group, in place of others of the same names. Only done on request."""
    offered = {p.name: p.load() for p in entry_points(group=group)}
    for name, value in offered.items():
        add_plugin(group, name, value, replace=True)
    return sorted(offered)
