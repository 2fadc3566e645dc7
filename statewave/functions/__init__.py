"""Column helpers and small numeric kernels used inside Spark tasks."""
