"""All registered queries and their SQL twins."""

from ledgerlight.catalog.base import ORACLES, QUERIES  # noqa: F401
from ledgerlight.catalog import (  # noqa: F401
    cleaning, evidence, io, joins, models, rankings, reporting, texts,
)
