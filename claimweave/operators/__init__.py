"""DataFrame operators: matching, clustering, edges, credibility, verdicts, failures, documents."""
