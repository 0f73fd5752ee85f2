"""loanscope: loan-portfolio profiling, imputation and risk reporting on Spark.

Every operator is a function from DataFrame to DataFrame built with the
DataFrame API, takes its column names as parameters and gives deterministic
results under ties.  The scale paths (global tiering, skew-safe ranking,
exact percentiles) compute small literal cut tables first and then run as
plain projections and bucket-local windows, so no step needs the whole
table in one task.
"""

from loanscope.session import get_session

__all__ = ["get_session"]
__version__ = "0.1.0"
