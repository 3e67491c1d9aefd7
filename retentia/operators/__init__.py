"""DataFrame -> DataFrame operators.

clean (typed load), quality (data-quality checks), revenue, rfm, rootcause,
churn (the analytics), ntile (global ranking), common (shared building blocks).
"""
