"""A rule that writes queries from plain questions and the schema it is given: the default writer for ``sqlguard.ask``.

A question names a measure (how many, the average, total, highest or lowest of a column), a table, perhaps a column to go by
(``per`` or ``by``) and conditions (``with``/``where`` column over, under or is a value). Names are matched to the schema's
by their words: prefixes like ``o_`` and plural endings play no part. A column of another table is reached by a join on the
key that both tables name alike. What cannot be matched is refused; nothing is guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from millrace.operators.sqlguard import Refused

#: Fixed words of questions, and the aggregates that they name.
MEASURES = (("how many", "count"), ("number of", "count"), ("average", "avg"), ("mean", "avg"), ("total", "sum"), ("highest", "max"), ("largest", "max"), ("lowest", "min"), ("smallest", "min"))
COMPARED = (("at least", ">="), ("at most", "<="), ("over", ">"), ("above", ">"), ("under", "<"), ("below", "<"), ("is", "="), ("of", "="))


@dataclass
class Column:
    table: str
    name: str
    kind: str

    @property
    def words(self) -> str:
        """``o_totalprice`` is totalprice, ``c_mktsegment`` mktsegment."""
        return re.sub(r"^[a-z]{1,2}_", "", self.name.lower()).replace("_", " ")


def schema_of(description: str) -> list[Column]:
    """Columns of lines ``table(column type, column type)``, as ``sqlguard.ask`` describes tables."""
    out = []
    for line in filter(None, description.split("\n")):
        table, inside = line.rstrip(")").split("(", 1)
        out += [Column(table, *c.split(" ", 1)) for c in re.split(r", (?=\w+ )", inside)]
    return out


def _stem(text: str) -> str:
    word = text.strip().lower()
    return re.sub(r"ies$", "y", word) if word.endswith("ies") else re.sub(r"(?<=[a-z]{2})s$", "", word)


def _plain(text: str) -> str:
    return _stem(text).replace(" ", "")


class Writer:
    def __init__(self, description: str):
        self.columns = schema_of(description)
        self.tables = list(dict.fromkeys(c.table for c in self.columns))

    def table(self, words: str) -> str:
        found = [t for t in self.tables if _plain(t.rsplit("_", 1)[-1]) == _plain(words) or _plain(t) == _plain(words)]
        return self._only(found, f"table {words!r}")

    def column(self, words: str, tables: Iterable[str]) -> Column:
        """The column of that name, sooner of an earlier table; a table's name may stand before it."""
        first, _, rest = words.strip().partition(" ")
        named = [t for t in tables if rest and _plain(t.rsplit("_", 1)[-1]) == _plain(first)]
        words, tables = (rest, named) if named else (words, tables)
        for t in tables:
            own = [c for c in self.columns if c.table == t]
            found = [c for c in own if _plain(c.words) == _plain(words)] or [c for c in own if _plain(words) in _plain(c.words)]
            if found:
                return self._only(found, f"column {words!r} of {t}")
        raise Refused(f"no column {words!r}")

    @staticmethod
    def _only(found: list, what: str):
        if len(found) != 1:
            raise Refused(f"{'no' if not found else 'more than one'} {what}")
        return found[0]

    def join(self, table: str, other: str) -> str:
        """The condition that joins two tables: the one key that both name alike."""
        mine, theirs = ({c.words: c.name for c in self.columns if c.table == t and c.words.endswith("key")} for t in (table, other))
        key = self._only([k for k in mine if k in theirs], f"key of {table} and {other}")
        return f"`{table}`.`{mine[key]}` = `{other}`.`{theirs[key]}`"

    def write(self, question: str) -> str:
        q = re.sub(r"[?.!]+$", "", " ".join(question.split())).lower()
        measure = next(((words, how) for words, how in MEASURES if re.search(rf"\b{words}\b", q)), None)
        if measure is None:
            raise Refused("no measure in the question")
        rest = q[re.search(rf"\b{measure[0]}\b", q).end() :].strip()
        rest, *conditions = re.split(r"\b(?:with|where|and)\b", rest)
        rest, _, by = re.sub(r"\bper\b|\bby\b", "|", rest).partition("|")
        rest = re.sub(r"\b(?:the|a|an|are there|is there|do we have)\b", " ", rest).strip()
        if measure[1] == "count":
            table, value = self.table(rest), None
        else:
            what, _, of = rest.partition(" of ")
            table = self.table(of)
            value = self.column(what, [table])
        reach = [table, *(t for t in self.tables if t != table)]
        group = self.column(by, reach) if by.strip() else None
        said = [self._condition(c, table) for c in conditions]
        joins = f" JOIN `{group.table}` ON {self.join(table, group.table)}" if group and group.table != table else ""
        name = "n" if value is None else f"{measure[1]}_{value.words.replace(' ', '_')}"
        head = "count(*)" if value is None else f"{measure[1]}(`{table}`.`{value.name}`)"
        keys = f"`{group.table}`.`{group.name}`" if group else None
        where = f" WHERE {' AND '.join(said)}" if said else ""
        return f"SELECT {keys + ', ' if keys else ''}{head} AS `{name}` FROM `{table}`{joins}{where}{f' GROUP BY {keys}' if keys else ''}"

    def _condition(self, text: str, table: str) -> str:
        for words, sign in COMPARED:
            if m := re.match(rf"(.+?)\s+{words}\s+(.+)$", text.strip()):
                column = self.column(re.sub(r"^(?:the|a|an)\s+", "", m[1]), [table])
                value = m[2].strip().strip("'\"")
                if column.kind in ("string", "varchar"):
                    return f"lower(`{table}`.`{column.name}`) {sign} '{value.replace(chr(39), chr(39) * 2)}'"
                if not re.fullmatch(r"-?\d+(\.\d+)?", value):
                    raise Refused(f"{value!r} is no number")
                return f"`{table}`.`{column.name}` {sign} {value}"
        raise Refused(f"no condition in {text.strip()!r}")


def write_query(question: str, description: str) -> str:
    """The query for a question, from the tables that are described; refuses what it cannot match."""
    return Writer(description).write(question)
