"""litsift: a Spark-native engine that turns alert digests into a ranked reading list.

Every public operator is a ``DataFrame -> DataFrame`` function with no action inside,
so Catalyst sees (and optimises) the whole plan of a triage run at once.

Layout
------
``sources``    scans, sinks and small config tables (messages, papers, catalogue, questions, models)
``functions``  Column-level scalar functions (mail headers, HTML fields, text cleaning, prompts, responses)
``operators``  relational operators (filters, extraction, catalogue lookup, dedup, scoring, ranking)
``plans``      compositions of operators (triage, recent papers) and the driver-table bindings
``streaming``  incremental ingest with Structured Streaming
"""

__version__ = "0.1.0"
