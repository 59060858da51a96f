"""Click-log and ad-click analytics as composable PySpark DataFrame functions."""
