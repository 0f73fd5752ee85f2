"""Report plans over the loan book: the seven scripts of the process as
DataFrame plans, the published-figure checks and the report marts, plus the
query catalog (``catalog.queries``) and its DuckDB oracles (``oracle``)."""
