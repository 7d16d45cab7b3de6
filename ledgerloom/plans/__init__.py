"""The models: dimensions, posting fact, P&L mart, its reports and the layered refresh."""
