"""End-to-end flows (explore, prepare, train, evaluate, drift) and the query catalog."""
