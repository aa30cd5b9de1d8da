"""Work that SQL text alone leaves to one task: joins without an equality and row numbers over a whole table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .ranking import global_row_number

#: Rows of the larger side of a join without an equality that a task compares with all of the other.
SIDE_ROWS = 2048


class Spread:
    """What `translate` asks of a session whose views hold the tables that a query reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def sides(self, left: str, right: str) -> tuple[str, str]:
        """Two tables of such a join. The larger is dealt to tasks by its number of rows, however few files it has."""
        sizes = [self.spark.table(t).count() for t in (left, right)]
        at = int(sizes[1] > sizes[0])
        out = [left, right]
        if (tasks := -(-sizes[at] // SIDE_ROWS)) > 1:
            out[at] = f"(SELECT /*+ REPARTITION({tasks}) */ * FROM {out[at]})"
        return out[0], out[1]

    def numbered(self, source: str, numbers: dict[str, list[str]], used: str) -> str:
        """A view of what `source` selects from, as far as the text `used` names its columns, with row numbers in
        the orders given."""
        keys = {f"{name}_{i}": item for name, order in numbers.items() for i, item in enumerate(order)}
        split = {k: re.fullmatch(r"(.*) (ASC|DESC) NULLS (FIRST|LAST)", item, re.S).groups() for k, item in keys.items()}
        df = self.spark.sql(f"SELECT *, {', '.join(f'{text} AS {k}' for k, (text, _, _) in split.items())} {source}")
        df = df.select(*(f"`{c}`" for c in df.columns if c in keys or re.search(rf"(?<!\w){re.escape(c)}(?!\w)", used, re.I)))
        for name in numbers:
            order = [getattr(F.col(k), f"{way.lower()}_nulls_{end.lower()}")() for k, (_, way, end) in split.items() if k.rsplit("_", 1)[0] == name]
            df = global_row_number(df, *order, name=name)
        view = f"ql_numbered_{uuid.uuid4().hex}"
        df.drop(*keys).createOrReplaceTempView(view)
        return view
