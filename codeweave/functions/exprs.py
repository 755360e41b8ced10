"""Expression helpers.

``let(value, body)`` binds ``value`` once per row and passes it to ``body`` as a
lambda variable (a one-element ``transform``). Catalyst never hoists common
subexpressions out of lambda bodies and freely inlines projected aliases into
them, so without a binding an array built once per row (a sort, a max, a sum)
would be rebuilt for every element the lambda visits."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)
