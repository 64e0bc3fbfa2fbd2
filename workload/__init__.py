"""The registered queries: every operator run over the given tables, with the SQL it is checked against."""
