"""Path expressions over nested data: parsed on the driver, compiled to Columns against the schema."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WILDCARD = "*"
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class PathError(ValueError):
    def __init__(self, code: str, path: str, position: int):
        super().__init__(f"{code} at {position} in {path!r}")
        self.code, self.path, self.position = code, path, position


def parse(path: str) -> list[str | int]:
    """Tokens: property names (texts), indices (numbers) and WILDCARD for ``[]``. Blanks around the path do not count."""
    if not isinstance(path, str) or not path.strip():
        raise PathError("PATH_EMPTY", str(path), 0)
    tokens: list[str | int] = []
    path, at, name_due = path.strip(), 0, True
    while at < len(path):
        c = path[at]
        if name_due:
            m = _IDENT.match(path, at)
            if not m:
                raise PathError("PATH_INVALID_IDENTIFIER", path, at)
            tokens.append(m[0])
            at, name_due = m.end(), False
        elif c == ".":
            at, name_due = at + 1, True
        elif c == "[":
            end = path.find("]", at)
            if end < 0:
                raise PathError("PATH_UNTERMINATED_BRACKET", path, at)
            inside = path[at + 1 : end]
            if inside and not re.fullmatch("[0-9]+", inside):
                raise PathError("PATH_INVALID_INDEX", path, at + 1)
            tokens.append(int(inside) if inside else WILDCARD)
            at = end + 1
        else:
            raise PathError("PATH_INVALID_CHARACTER", path, at)
    if name_due:
        raise PathError("PATH_INVALID_IDENTIFIER", path, at)
    return tokens


@dataclass
class Resolved:
    """A compiled path: its Column and type; column None if the schema lacks the path; many if a wildcard made it a list."""

    column: Column | None
    type: T.DataType
    many: bool = False


def resolve(path: str, schema: T.StructType, root: str = "") -> Resolved:
    """Compile a get. An index or wildcard on what is not a list raises PATH_TYPE_MISMATCH; null on the way is missing."""
    at: Column | None = None
    kind: T.DataType = schema
    many = False
    for n, token in enumerate(parse(path)):
        if isinstance(token, int) or token == WILDCARD:
            if not isinstance(kind, T.ArrayType):
                raise PathError("PATH_TYPE_MISMATCH", path, n)
            inner = kind.elementType
            if token == WILDCARD:
                # One level of lists goes at each wildcard; null lists on the way vanish.
                at = F.flatten(F.filter(at, lambda x: x.isNotNull())) if many else at
                many = True
            else:
                at = F.filter(F.transform(at, lambda x: F.get(x, F.lit(token))), lambda x: x.isNotNull()) if many else F.get(at, F.lit(token))
            kind = inner
        else:
            names = kind.fieldNames() if isinstance(kind, T.StructType) else []
            if token not in names:
                return Resolved(None, T.NullType(), many)
            inner = kind[token].dataType
            at = F.col(root + token) if at is None else F.transform(at, lambda x: x[token]) if many else at[token]
            kind = inner
    return Resolved(at, T.ArrayType(kind) if many else kind, many)
