"""Codebooks from the metadata of .sav files; needs the optional package pyreadstat."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from ..errors import CodebookError, MetadataParseError
from ..plans.codebook import Category, Codebook, MultiQuestion, NumericQuestion, Question, SingleQuestion, TextQuestion


def label_code(key: Any) -> int:
    """A value label's key as a whole code."""
    if isinstance(key, bool) or not isinstance(key, int | float) or not float(key).is_integer():
        raise MetadataParseError(f"value label {key!r} is not a whole code")
    return int(key)


def codebook_from_metadata(meta: Any) -> Codebook:
    """From the metadata object that pyreadstat returns: labelled variables are single, text is text,
    others are numeric; a multiple response set of dichotomies is a multi question with codes 1, 2, ..."""
    names = list(meta.column_names)
    labels = {n: (meta.column_names_to_labels or {}).get(n) or n for n in names}
    sets = getattr(meta, "mr_sets", None) or {}
    questions: list[Question] = []
    members: set[str] = set()
    for name, found in sets.items():
        if not found.get("is_dichotomy", found.get("type") in ("D", "dichotomy", None)):
            raise MetadataParseError(f"multiple response set {name!r} is not one of dichotomies")
        variables = list(found.get("variable_list") or [])
        if not variables:
            raise MetadataParseError(f"multiple response set {name!r} has no variables")
        categories = tuple(Category(k, labels.get(v, v)) for k, v in enumerate(variables, 1))
        questions.append(MultiQuestion(name.lstrip("$"), found.get("label") or name.lstrip("$"), categories=categories))
        members.update(variables)
    for n in names:
        if n in members:
            continue
        values = (meta.variable_value_labels or {}).get(n)
        if values:
            categories = tuple(Category(label_code(k), str(v)) for k, v in sorted(values.items(), key=lambda kv: label_code(kv[0])))
            questions.append(SingleQuestion(n, labels[n], categories=categories))
        elif (getattr(meta, "readstat_variable_types", None) or {}).get(n) == "string":
            questions.append(TextQuestion(n, labels[n]))
        else:
            questions.append(NumericQuestion(n, labels[n]))
    return Codebook(questions)


class SavMetadataParser:
    """Metadata parser plugin for .sav files."""

    def parse(self, source: str | Path) -> Codebook:
        try:
            import pyreadstat
        except ImportError as e:
            raise MetadataParseError("reading .sav files needs the package pyreadstat") from e
        try:
            _, meta = pyreadstat.read_sav(str(source), metadataonly=True)
        except Exception as e:
            raise MetadataParseError(f"can't read {source}: {e}") from e
        try:
            return codebook_from_metadata(meta)
        except MetadataParseError as e:
            raise MetadataParseError(f"In {source}: {e}") from e
        except CodebookError:
            raise
