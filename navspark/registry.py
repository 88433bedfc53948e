"""All queries of the reference-side operators, and their SQL."""

from __future__ import annotations

from navspark.operators import evaluation, graph, match, relational, search, text_index, usage
from navspark.sources import git, stored_index, usage_log
from navspark.streaming import reminders, usage_stream

QUERIES = text_index.QUERIES | usage.QUERIES | graph.QUERIES | relational.QUERIES | search.QUERIES | usage_stream.QUERIES | evaluation.QUERIES | match.QUERIES | stored_index.QUERIES | reminders.QUERIES | git.QUERIES | usage_log.QUERIES
SQL = text_index.SQL | usage.SQL | graph.SQL | relational.SQL | usage_stream.SQL | evaluation.SQL | search.SQL | match.SQL | stored_index.SQL | reminders.SQL | git.SQL | usage_log.SQL
