"""Ways to build expressions that evaluate their input once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    The optimizer may inline a projected column into every place that uses it;
    a lambda variable is computed once whatever the plan becomes.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def where(text: Column, test: Callable[[Column], Column], fix: Callable[[Column], Column]) -> Column:
    """``fix`` only the texts that pass ``test``; the text is worked out once."""
    return let(text, lambda x: F.when(test(x), fix(x)).otherwise(x))
