"""Where data comes from: source contracts, CSV landing, and the test-table adapter."""
