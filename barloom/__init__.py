"""Daily-bar research on Spark: bars, point-in-time joins, window features, pattern miners, reviews, labels, tracking."""
