"""Building blocks of the queries."""
