"""All core queries by name, and the SQL of those that SQL can express."""

from lodestone.plans import checks, matrix, problems, space

QUERIES = {**problems.QUERIES, **matrix.QUERIES, **space.QUERIES, **checks.QUERIES}
SQL = {**problems.SQL, **matrix.SQL, **space.SQL, **checks.SQL}
