from skarn.plans import catalog, analyses, corpora  # noqa: F401, I001  (the others add their queries to the first's)
