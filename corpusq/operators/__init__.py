"""Table-to-table operators: cleaning, features, duplicates, scoring, reports."""
