"""Named queries over the test tables."""

from marlstone.plans import backtests, decisions, joins, market, remaining, retrieval, scores, sectors, stored, strategies, streams  # noqa: F401
