"""Reading typed fields from YAML mappings; a bool is never a number."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


class Fields:
    """One mapping; complaints are raised as ``error`` and name ``where``. ``null_is_absent`` tells
    whether an explicit null counts as a missing optional field."""

    def __init__(self, data: object, where: str, error: type[Exception], null_is_absent: bool) -> None:
        self.where, self.error, self.null_is_absent = where, error, null_is_absent
        if not isinstance(data, Mapping):
            raise error(f"{where} must be a mapping")
        self.data: Mapping[str, Any] = data

    def _fail(self, name: str, want: str) -> Exception:
        return self.error(f"{self.where}: field {name!r} must be {want}")

    def _absent(self, name: str, always: bool = False) -> bool:
        return name not in self.data or (self.null_is_absent or always) and self.data[name] is None

    def text(self, name: str) -> str:
        if not isinstance(value := self.data.get(name), str):
            raise self._fail(name, "a string")
        return value

    def text_or(self, name: str, default: str | None = None) -> str | None:
        return default if self._absent(name) else self.text(name)

    def flag(self, name: str) -> bool:
        if self._absent(name):
            return False
        if not isinstance(value := self.data[name], bool):
            raise self._fail(name, "true or false")
        return value

    def whole(self, name: str) -> int:
        value = self.data.get(name)
        if isinstance(value, bool) or not isinstance(value, int):
            raise self._fail(name, "a whole number")
        return value

    def whole_or(self, name: str, default: int | None = None) -> int | None:
        return default if self._absent(name, always=True) else self.whole(name)

    def number(self, name: str) -> float:
        value = self.data.get(name)
        if isinstance(value, bool) or not isinstance(value, int | float):
            raise self._fail(name, "a number")
        return float(value)

    def number_or(self, name: str, default: float | None = None) -> float | None:
        return default if self._absent(name, always=True) else self.number(name)

    def items(self, name: str) -> list:
        if not isinstance(value := self.data.get(name), list):
            raise self._fail(name, "a list")
        return value

    def texts(self, name: str) -> tuple[str, ...]:
        values = self.items(name)
        if not all(isinstance(v, str) for v in values):
            raise self._fail(name, "a list of strings")
        return tuple(values)

    def texts_or(self, name: str) -> tuple[str, ...]:
        return () if self._absent(name, always=True) else self.texts(name)

    def wholes(self, name: str) -> tuple[int, ...]:
        values = self.items(name)
        if any(isinstance(v, bool) or not isinstance(v, int) for v in values):
            raise self._fail(name, "a list of whole numbers")
        return tuple(values)
