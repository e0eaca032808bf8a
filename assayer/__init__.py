"""Decides whether SQL is right: result diffs, expectations, plan equivalence and metric queries as Spark plans."""
