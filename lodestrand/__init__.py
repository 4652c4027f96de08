"""Panel analytics on PySpark: operators, formulas, factor sets, evaluation and portfolios."""
