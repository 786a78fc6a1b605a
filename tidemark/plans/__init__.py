"""The queries over the test tables. Importing any of them registers all; ``registry`` imports none."""

from tidemark.plans import books, copies, evidence, landed, market, news, path, study, text  # noqa: F401
