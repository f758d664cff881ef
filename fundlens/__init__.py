"""Funding-call matching on Spark: DataFrame operators over calls, companies and documents."""

import datetime

#: Evaluation date used when a caller gives none; every time-dependent operator takes ``as_of``.
DEFAULT_AS_OF = datetime.date(2024, 6, 1)
