"""DataFrame to DataFrame operators on time series."""
