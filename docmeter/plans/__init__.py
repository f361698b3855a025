"""docmeter.plans."""
