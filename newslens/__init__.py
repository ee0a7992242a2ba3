"""newslens: news and text analytics as Spark DataFrame and Structured Streaming jobs.

Modules: `sources` (readers, sinks), `functions` (column expressions),
`operators` (text weights, similarity, ranking, counts, pages), `plans`
(composite queries and the registered query set), `streaming` (word history).
"""

__version__ = "0.1.0"
