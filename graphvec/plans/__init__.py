"""Building blocks of query plans: predicates and paging."""
