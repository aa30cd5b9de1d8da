"""SQL logic tests: records of statements and queries with their expected values or an MD5 of them."""

import hashlib
import re
from pathlib import Path

import pytest

from quarryline.engine import Engine


def records(text):
    for part in re.split(r"\n\s*\n", re.sub(r"(?m)^#.*\n?", "", text)):
        lines = part.strip().split("\n")
        if lines[0]:
            body = lines[1:]
            cut = body.index("----") if "----" in body else len(body)
            yield lines[0].split(), "\n".join(body[:cut]), body[cut + 1 :]


def shown(value, kind):
    if value is None:
        return "NULL"
    if kind == "I":
        return str(int(value))
    if kind == "R":
        return f"{float(value):.3f}"
    return str(value) or "(empty)"


def values(rows, types, sort):
    rows = [[shown(v, k) for v, k in zip(r, types)] for r in rows]
    if sort == "rowsort":
        rows.sort()
    flat = [v for r in rows for v in r]
    return sorted(flat) if sort == "valuesort" else flat


@pytest.mark.parametrize("path", sorted(Path(__file__).parent.glob("slt/*.test")), ids=lambda p: p.stem)
def test_file(spark, tmp_path, path):
    db = Engine(spark, str(tmp_path / "db"))
    for head, sql, expected in records(path.read_text()):
        if head[0] == "statement":
            if head[1] == "error":
                with pytest.raises(Exception):  # noqa: B017
                    db.sql(sql)
            else:
                db.sql(sql)
            continue
        _, types, sort = (*head, "nosort")[:3]
        got = values(db.query(sql).collect(), types, sort)
        if len(expected) == 1 and "values hashing to" in expected[0]:
            digest = hashlib.md5("".join(f"{v}\n" for v in got).encode()).hexdigest()
            assert expected[0] == f"{len(got)} values hashing to {digest}", sql
        else:
            assert got == expected, sql
