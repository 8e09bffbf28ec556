"""DataFrame-to-DataFrame operators: rules, checks, scores, history, analytics."""
