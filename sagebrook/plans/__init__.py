"""Query catalogue, oracle SQL, pipelines and routing."""
