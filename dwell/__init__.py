"""dwell — rental-market analytics expressed as Spark DataFrame plans.

Sub-packages:
  sources    five rental tables (binding to the driver tables), readers, writers, contracts
  functions  column-expression helpers: null rules, boolean/date parsing, safe ratios
  operators  joins, statistics, windows, ordering, sets, splits, data-quality rules
  ml         Spark ML pipelines: encoders, OLS/Gram selection, forests, boosting, metrics
  plans      end-to-end plans: feature datasets, audit report, training runs, query registry
  streaming  micro-batch application of the audit rules (the reference has no streaming)
"""

__version__ = "0.1.0"
