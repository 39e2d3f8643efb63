"""plans of the library: importing it registers all queries."""

from locusframe.plans import case_queries, job_queries, queries, table_queries  # noqa: F401
