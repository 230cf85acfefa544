"""All registered queries over the driver's tables, with their SQL twins."""

from marquee.plans import listings, normalized, ruled, scalars, snapshots  # noqa: F401
from marquee.plans.registry import QUERIES, SQL  # noqa: F401
