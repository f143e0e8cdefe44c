"""Sales analytics and forecasting on large order-item tables, written for Spark."""
