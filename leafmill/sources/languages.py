"""Languages: kinds of elements, declared once, checked, and turned into small tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class LanguageError(ValueError):
    """code is one of: not_an_integer, missing_kind, duplicate_kind, duplicate_name, out_of_range, bad_static_text, unknown_sentinel."""

    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def kind_number(literal: int | str) -> int:
    """A kind's number; strings may group digits and use 0x, 0b or 0o."""
    try:
        number = int(literal.replace("_", ""), 0) if isinstance(literal, str) else literal
    except ValueError as e:
        raise LanguageError("not_an_integer", repr(literal)) from e
    if isinstance(number, bool) or not isinstance(number, int):
        raise LanguageError("not_an_integer", repr(literal))
    if not 0 <= number < 1 << 32:
        raise LanguageError("out_of_range", str(number))
    return number


@dataclass(frozen=True)
class Kind:
    number: int | str
    name: str
    static_text: str | None = None
    trivia: bool = False
    node: bool | None = None  # unless said, what has no fixed text is a node
    precedence: int | None = None


@dataclass(frozen=True)
class Language:
    id: str
    kinds: tuple[Kind, ...]
    root: str
    missing: str
    error: str
    version: int = 1
    _by_name: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        numbers: set[int] = set()
        for k in self.kinds:
            n = kind_number(k.number)
            if n in numbers:
                raise LanguageError("duplicate_kind", f"{k.name} = {n}")
            if k.name in self._by_name:
                raise LanguageError("duplicate_name", k.name)
            if k.static_text is not None and not isinstance(k.static_text, str):
                raise LanguageError("bad_static_text", k.name)
            numbers.add(n)
            self._by_name[k.name] = n
        if not numbers:
            raise LanguageError("missing_kind", self.id)
        for s in (self.root, self.missing, self.error):
            if s not in self._by_name:
                raise LanguageError("unknown_sentinel", s)

    def __getitem__(self, name: str) -> int:
        return self._by_name[name]

    def is_node(self, kind: Kind) -> bool:
        return kind.static_text is None if kind.node is None else kind.node

    def rows(self) -> Iterable[tuple]:
        for k in self.kinds:
            node = self.is_node(k)
            yield self.id, kind_number(k.number), k.name, k.static_text, k.trivia, node, not node


KINDS_SCHEMA = "language_id string, kind bigint, name string, static_text string, is_trivia boolean, is_node boolean, is_token boolean"


def kinds(spark: SparkSession, *languages: Language) -> DataFrame:
    """The kinds of the languages: a table as long as their declarations, safe to broadcast."""
    return spark.createDataFrame([r for lang in languages for r in lang.rows()], KINDS_SCHEMA)


def languages(spark: SparkSession, *all_of: Language) -> DataFrame:
    return spark.createDataFrame([(x.id, x.version, x[x.root], x[x.missing], x[x.error]) for x in all_of], "language_id string, version int, root_kind bigint, missing_kind bigint, error_kind bigint")


def kind_name(lang: Language, kind: Column) -> Column:
    """The name of a kind; an unknown one is called by its number."""
    out = F.concat(F.lit("kind"), kind.cast("string"))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k in lang.kinds for x in (kind_number(k.number), k.name)]), kind.cast("int")), out)


def static_text(lang: Language, kind: Column) -> Column:
    pairs = [F.lit(x) for k in lang.kinds if k.static_text is not None for x in (kind_number(k.number), k.static_text)]
    return F.element_at(F.create_map(*pairs), kind.cast("int")) if pairs else F.lit(None).cast("string")


def is_known(lang: Language, kind: Column) -> Column:
    return kind.isin([kind_number(k.number) for k in lang.kinds])


TEXT = Language("text", (Kind(1, "root"), Kind(2, "line"), Kind(3, "turn"), Kind(4, "word", node=False), Kind(5, "number", node=False), Kind(6, "space", node=False, trivia=True), Kind(7, "newline", "\n", trivia=True), Kind(8, "missing", node=True), Kind(9, "error", node=True)), "root", "missing", "error")

#: The calculator's kinds.
CALC = Language(
    "calculator",
    (
        Kind(1, "number", node=False), Kind(2, "whitespace", node=False, trivia=True), Kind(3, "invalid", node=False), Kind(4, "realNumber", node=False),
        Kind(10, "plus", "+", precedence=1), Kind(11, "minus", "-", precedence=1), Kind(12, "star", "*", precedence=2), Kind(13, "slash", "/", precedence=2),
        Kind(14, "leftParen", "("), Kind(15, "rightParen", ")"), Kind(16, "round", "round"),
        Kind(100, "root"), Kind(101, "integerExpr"), Kind(102, "unaryExpr"), Kind(103, "binaryExpr"), Kind(104, "groupExpr"), Kind(105, "realExpr"), Kind(106, "roundCallExpr"),
        Kind(198, "missing"), Kind(199, "error"),
    ),
    "root", "missing", "error",
)
