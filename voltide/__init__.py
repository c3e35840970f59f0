"""voltide: DataFrame operators for market-data bars, volatility features, labels, pricing and quality checks."""
