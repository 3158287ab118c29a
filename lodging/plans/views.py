"""Name the inputs as SQL views, so statements can also be written in Spark SQL.

The original addresses its tables by name (one per yearly sheet, two
lookups).  ``register_views`` gives the same tables names in the session
catalog; Spark SQL then plans a statement over them with the same optimizer
as the DataFrame code (pushdown into the partitioned table, broadcast of the
literal lookups).
"""

from __future__ import annotations

from lodging.plans.inputs import Inputs

YEARLY_VIEW = "bookings_{year}"


def register_views(inp: Inputs, prefix: str = "") -> dict[str, str]:
    """Create temp views; returns {role: view name}.

    ``{prefix}bookings_<year>`` per yearly table, ``{prefix}bookings`` for all
    years, ``{prefix}market_segment`` and ``{prefix}meal_cost`` for the lookups.
    """
    names: dict[str, str] = {}
    for year, table in inp.yearly().items():
        name = prefix + YEARLY_VIEW.format(year=year)
        table.createOrReplaceTempView(name)
        names[str(year)] = name
    for role, df in (("bookings", inp.bookings), ("market_segment", inp.segments), ("meal_cost", inp.meals)):
        df.createOrReplaceTempView(prefix + role)
        names[role] = prefix + role
    return names
