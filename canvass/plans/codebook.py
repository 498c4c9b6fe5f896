"""The codebook: what each variable of a survey may hold. Plain objects on the driver."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import types as T

from ..errors import CircularDependencyError, DuplicateQuestionIdError, InvalidQuestionDefinitionError, UnknownVariableError


class Severity(StrEnum):
    INFO = "info"
    WARNING = "warning"
    ERROR = "error"


class QuestionType(StrEnum):
    SINGLE = "single"
    MULTI = "multi"
    GRID = "grid"
    RANKING = "ranking"
    NUMERIC = "numeric"
    TEXT = "text"
    DERIVED = "derived"


class DataType(StrEnum):
    """Declared kinds of values; documentation only, no code depends on them."""

    INTEGER = "integer"
    FLOAT = "float"
    CATEGORICAL = "categorical"
    STRING = "string"
    BOOLEAN = "boolean"


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidQuestionDefinitionError(message)


def _distinct(values: list, what: str) -> None:
    _need(len(set(values)) == len(values), f"{what} must not repeat: {values}")


@dataclass(frozen=True)
class Category:
    code: int
    label: str

    def __post_init__(self) -> None:
        _need(bool(self.label.strip()), f"category {self.code} needs a label")


@dataclass(frozen=True)
class Question:
    id: str
    label: str
    required: bool = False

    def __post_init__(self) -> None:
        _need(bool(self.id.strip()), "a question needs an id")
        _need(bool(self.label.strip()), f"question {self.id!r} needs a label")

    def spark_type(self) -> T.DataType | None:
        return None


def _check_categories(question: str, categories: tuple[Category, ...], what: str = "category codes") -> None:
    _need(bool(categories), f"question {question!r} needs at least one of its {what}")
    _distinct([c.code for c in categories], f"{what} of question {question!r}")


@dataclass(frozen=True)
class SingleQuestion(Question):
    categories: tuple[Category, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        _check_categories(self.id, self.categories)

    def spark_type(self) -> T.DataType:
        return T.LongType()


@dataclass(frozen=True)
class MultiQuestion(Question):
    categories: tuple[Category, ...] = ()
    max_selections: int | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        _check_categories(self.id, self.categories)
        if self.max_selections is not None:
            _need(1 <= self.max_selections <= len(self.categories), f"max_selections of question {self.id!r} must be 1 to {len(self.categories)}")

    def spark_type(self) -> T.DataType:
        return T.ArrayType(T.LongType())


@dataclass(frozen=True)
class NumericQuestion(Question):
    min_value: float | None = None
    max_value: float | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.min_value is not None and self.max_value is not None:
            _need(self.min_value <= self.max_value, f"question {self.id!r} has its minimum above its maximum")

    def spark_type(self) -> T.DataType:
        return T.DoubleType()


@dataclass(frozen=True)
class TextQuestion(Question):
    max_length: int | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(self.max_length is None or self.max_length >= 1, f"max_length of question {self.id!r} must be at least 1")

    def spark_type(self) -> T.DataType:
        return T.StringType()


@dataclass(frozen=True)
class RankingQuestion(Question):
    items: tuple[Category, ...] = ()
    rank_count: int = 1

    def __post_init__(self) -> None:
        super().__post_init__()
        _check_categories(self.id, self.items, "item codes")
        _need(1 <= self.rank_count <= len(self.items), f"rank_count of question {self.id!r} must be 1 to {len(self.items)}")


@dataclass(frozen=True)
class GridQuestion(Question):
    rows: tuple[Question, ...] = ()
    columns: tuple[Category, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(bool(self.rows), f"grid {self.id!r} needs at least one row")
        _check_categories(self.id, self.columns, "column codes")
        _need(not any(isinstance(r, GridQuestion) for r in self.rows), f"grid {self.id!r} must not hold a grid")
        _distinct([r.id for r in self.rows], f"row ids of grid {self.id!r}")


@dataclass(frozen=True)
class DerivedVariable(Question):
    expression: str = ""
    depends_on: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        _need(bool(self.expression.strip()), f"derived variable {self.id!r} needs an expression")
        _distinct(list(self.depends_on), f"dependencies of {self.id!r}")
        _need(self.id not in self.depends_on, f"derived variable {self.id!r} depends on itself")


class Codebook:
    """Questions by id in the order given, each grid's rows right behind it."""

    def __init__(self, questions: tuple[Question, ...] | list[Question]) -> None:
        self._top = tuple(questions)
        self._by_id: dict[str, Question] = {}
        for q in self._top:
            for each in (q, *q.rows) if isinstance(q, GridQuestion) else (q,):
                if each.id in self._by_id:
                    raise DuplicateQuestionIdError(f"question id {each.id!r} is used twice")
                self._by_id[each.id] = each
        for d in self._derived():
            for name in d.depends_on:
                if name not in self._by_id:
                    raise UnknownVariableError(f"{d.id!r} depends on unknown variable {name!r}")
        self._levels = self._sorted()

    def _derived(self) -> list[DerivedVariable]:
        return [q for q in self._by_id.values() if isinstance(q, DerivedVariable)]

    def _sorted(self) -> tuple[DerivedVariable, ...]:
        derived = {d.id: d for d in self._derived()}
        waits = {i: {x for x in d.depends_on if x in derived} for i, d in derived.items()}
        ready, order = deque(sorted(i for i, w in waits.items() if not w)), []
        while ready:
            done = ready.popleft()
            order.append(derived[done])
            for i in sorted(waits):
                if done in waits[i]:
                    waits[i].discard(done)
                    if not waits[i]:
                        ready.append(i)
        if len(order) < len(derived):
            raise CircularDependencyError(f"derived variables depend on each other: {sorted(i for i, w in waits.items() if w)}")
        return tuple(order)

    @property
    def questions(self) -> tuple[Question, ...]:
        """All questions, rows of grids included."""
        return tuple(self._by_id.values())

    @property
    def top_level(self) -> tuple[Question, ...]:
        return self._top

    @property
    def derived_variables(self) -> tuple[DerivedVariable, ...]:
        """In an order in which each comes after all it depends on."""
        return self._levels

    def get_question(self, question_id: str) -> Question:
        try:
            return self._by_id[question_id]
        except KeyError:
            raise UnknownVariableError(f"no question has the id {question_id!r}") from None

    def __contains__(self, question_id: object) -> bool:
        return question_id in self._by_id

    def __len__(self) -> int:
        return len(self._by_id)

    def __iter__(self) -> Iterator[Question]:
        return iter(self._by_id.values())

    def struct_type(self) -> T.StructType:
        """The declared schema of the variables that have a type of their own."""
        return T.StructType([T.StructField(q.id, t) for q in self if (t := q.spark_type()) is not None])
