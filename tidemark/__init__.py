"""A PySpark engine for news-driven equity research: bars, news, mentions, sentiment, event studies, portfolios."""
