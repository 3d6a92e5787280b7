"""riskscope — URL and web-page scam-risk features, scoring and evaluation as
Spark DataFrame jobs.

Layout:
  functions/  Column -> Column expressions (URL, HTML, text, dates)
  operators/  DataFrame -> DataFrame operators (features, pages, domains,
              dataset building, scoring, evaluation, ML)
  sources/    readers / writers and the mapping of the test tables
  plans/      end-to-end jobs (score pages, build dataset, train, store)
  streaming/  Structured Streaming jobs
"""

__version__ = "0.1.0"
