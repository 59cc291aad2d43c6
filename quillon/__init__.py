"""quillon: a PySpark engine for questions that join relational predicates with judged text predicates."""
