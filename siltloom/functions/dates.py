"""Date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how pages write a date, day first.
_DATE = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})"


def sniff_date(nodes: Column) -> Column:
    """The first valid day/month/year date in an array of text nodes; each node's first match is tried alone."""

    def first(node):
        d, m, y = (F.regexp_extract(node, _DATE, i) for i in (1, 2, 3))
        return F.try_to_timestamp(F.concat_ws("/", F.lpad(d, 2, "0"), F.lpad(m, 2, "0"), y), F.lit("dd/MM/yyyy"))

    return F.try_element_at(F.filter(F.transform(F.filter(nodes, lambda n: n.rlike(_DATE)), first), lambda t: t.isNotNull()), F.lit(1))
